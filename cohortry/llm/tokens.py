"""Token counts by a transducer compiled from a merge vocabulary.

A merge tokenizer has this property: what it makes of a prefix ends in the one vocabulary piece that
fits both the end of the prefix and the piece before it. So reading one character needs, of what was
read before, only the last piece at each position from which a piece may still be growing. These
are the states of a deterministic transducer; a transition is annotated with the number of tokens
it adds (less than 0 where a new piece replaces several). Transitions are compiled when first taken
and kept, up to a bound.

Texts are cut into chunks, each of which becomes a map of states: what it does up to the first
place no piece can cross depends on the state it is entered in and is kept as text; from there on
its count and its last state are fixed. A place is crossed by no piece if no piece has its two
characters next to each other, so texts without blanks have such places too; only where there is none
(one character over and over) does a map keep the whole chunk. Maps compose associatively: chunks of
long texts are spread over the cluster, and `FAN` neighbouring maps become one, in rounds, until one
is left for each text.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.native import row_id

#: Bytes of a chunk, and of the longest text that is counted as one.
CHUNK = 1 << 15
#: Maps that one round makes into one.
FAN = 64
LONGEST_TEXT = 1 << 31
#: Bytes of chunks that a task hands over at a time.
OUT_BYTES = 1 << 21
MANY_TOKENS = 4096
#: Entries that a worker keeps of each table; a full table is started anew.
KEPT = 1 << 20
#: Characters of the longest word that is kept; with it, tables are bounded in bytes too.
KEPT_WORD = 32

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

#: Text that a piece may still grow from; and for each place in it where one may begin: characters
#: since, the last piece before it, and tokens up to it less tokens so far.
State = tuple[str, tuple[tuple[int, str, int], ...]]
#: (head, inner, tail): text up to the first place that no piece crosses, tokens from there to the last
#: such place, and the text after it. Without such a place it is all head, and inner is None.
Map = tuple[str, int | None, str]


class Transducer:
    """States and counted transitions of a vocabulary: piece -> score, higher merged first.

    States are numbered as they are met, START first.
    """

    START = 0
    FIRST: State = ("", ((0, "", 0),))

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.open = {p[:k] for p in scores for k in range(1, len(p))}
        self.inside = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.splits_words = all(pair[1] != SPACE or pair[0] == SPACE for pair in self.inside)
        self._restart()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: again and again the best pair, the first of equals."""
        parts = list(text)
        while True:
            found = [
                (-self.scores[a + b], k)
                for k, (a, b) in enumerate(zip(parts, parts[1:]))
                if a + b in self.scores
            ]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, before: str, piece: str) -> bool:
        key = (before, piece)
        if key not in self.pairs:
            _keep(self.pairs)
            self.pairs[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return self.pairs[key]

    def weight(self, piece: str) -> int:
        """Tokens of a piece: one, or its bytes if the vocabulary lacks it."""
        return 1 if piece in self.scores else len(piece.encode())

    def trim(self) -> None:
        """Start anew if there are too many transitions; call it between texts only."""
        if self.taken >= KEPT:
            self._restart()

    def _restart(self) -> None:
        self.states: list[State] = [self.FIRST]
        self.numbers: dict[State, int] = {self.FIRST: self.START}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.taken = 0

    def _take(self, number: int, char: str) -> tuple[int, int]:
        """Compile the transition from a state by a character."""
        state, added = self._compile(self.states[number], char)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        self.steps[number][char] = (to, added)
        self.taken += 1
        return to, added

    def _compile(self, state: State, char: str) -> tuple[State, int]:
        tail, places = state
        if tail and tail[-1] + char not in self.inside:
            tail, places = self.FIRST  # no piece crosses this place
        tail += char
        for back, before, less in places:
            piece = tail[len(tail) - back - 1 :]
            if (back == 0 or piece in self.scores) and self.fits(before, piece):
                added = less + self.weight(piece)
                break
        else:
            raise ValueError("the vocabulary is not one of merges")
        alive = [(0, piece, 0)]
        for back, before, less in places:
            if tail[len(tail) - back - 1 :] in self.open:
                alive.append((back + 1, before, less - added))
        return (tail[len(tail) - max(1, alive[-1][0]) :], tuple(alive)), added

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Read a text from a state: the state after it, and the tokens it adds."""
        total, steps = 0, self.steps
        for char in text:
            state, added = steps[state].get(char) or self._take(state, char)
            total += added
        return state, total

    def word(self, text: str) -> int:
        """Tokens of a text between two places that no piece crosses."""
        found = self.words.get(text)
        if found is None:
            found = self.run(self.START, text)[1]
            if len(text) <= KEPT_WORD:
                _keep(self.words)
                self.words[text] = found
        return found

    def apart(self, before: str, after: str) -> bool:
        """Whether no piece crosses the place between two texts, neither of them empty."""
        return before[-1] + after[0] not in self.inside

    def chunk_map(self, text: str) -> Map:
        """The map of a text, which is not empty."""
        words = _WORD.findall(text) if self.splits_words else [text]
        if len(words) > 1:
            return words[0], sum(map(self.word, words[1:-1])), words[-1]
        places = (k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.inside)
        first = next(places, None)
        if first is None:
            return text, None, ""
        last = next(k for k in range(len(text) - 1, 0, -1) if text[k - 1 : k + 1] not in self.inside)
        return text[:first], self.run(self.START, text[first:last])[1], text[last:]

    def join(self, one: Map, other: Map) -> Map:
        """The map of two texts one after the other."""
        head, inner, tail = one
        head2, inner2, tail2 = other
        if inner is None:
            if not self.apart(head, head2):
                return head + head2, inner2, tail2
            if inner2 is None:
                return head, 0, head2
            return head, self.word(head2) + inner2, tail2
        if inner2 is not None:
            return head, inner + self.word(tail + head2) + inner2, tail2
        if self.apart(tail, head2):
            return head, inner + self.word(tail), head2
        return head, inner, tail + head2

    def total(self, whole: Map) -> int:
        """Tokens of a text from its map."""
        head, inner, tail = whole
        return self.word(head) + (0 if inner is None else inner + self.word(tail))

    def count(self, text: str) -> int:
        """Tokens of a whole text that is one chunk."""
        if not self.splits_words:
            return self.run(self.START, text)[1]
        return sum(map(self.word, _WORD.findall(text)))


def _keep(table: dict) -> None:
    if len(table) >= KEPT:
        table.clear()


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The transducer of a sentencepiece model, which must merge, escape blanks and change nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " Aﬁª  \tb "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{path} changes texts before it splits them")
    size = range(model.get_piece_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in size]
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in size if not special[i]})


def _escaped(text: str) -> str:
    return text.replace(" ", SPACE)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        gc.freeze()  # the tables hold no cycles; passing over them again and again costs much
        for batch in batches:
            machine.trim()
            tokens = [
                machine.count(SPACE + _escaped(t)) if t else 0 for t in batch.column("text").to_pylist()
            ]
            out = batch.drop_columns("text")
            yield out.append_column("n_tokens", pa.array(tokens, pa.int64()))

    return count


def _cutter(chunk: int):
    """Chunks of texts, numbered; a text is passed over once, and cut between characters only."""

    def parts(text: memoryview) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            stop = min(at + chunk, len(text))
            while stop < len(text) and text[stop] & 0xC0 == 0x80:
                stop += 1
            yield text[at:stop].tobytes()
            at = stop

    def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rids, numbers, texts = zip(*rows)
        return pa.RecordBatch.from_pydict(
            {
                "rid": pa.array(rids, pa.int64()),
                "k": pa.array(numbers, pa.int64()),
                "chunk": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text")):
                for k, part in enumerate(parts(memoryview(text.as_buffer()))):
                    rows.append((rid, k, part))
                    size += len(part)
                    if size >= OUT_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    return cut


_MAP = "rid long, k long, head string, inner long, tail string"


def _maps(rids: list[int], numbers: list[int], maps: list[Map]) -> pa.RecordBatch:
    heads, inners, tails = zip(*maps) if maps else ((), (), ())
    return pa.RecordBatch.from_pydict(
        {
            "rid": pa.array(rids, pa.int64()),
            "k": pa.array(numbers, pa.int64()),
            "head": pa.array(heads, pa.string()),
            "inner": pa.array(inners, pa.int64()),
            "tail": pa.array(tails, pa.string()),
        }
    )


def _mapper(path: str):
    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            machine.trim()
            numbers = batch.column("k").to_pylist()
            maps = [
                machine.chunk_map((SPACE if k == 0 else "") + _escaped(text.as_py()))
                for k, text in zip(numbers, batch.column("chunk"))
            ]
            yield _maps(batch.column("rid").to_pylist(), numbers, maps)

    return to_maps


def _runs(
    batches: Iterator[pa.RecordBatch], machine: Transducer, fan: int
) -> Iterator[tuple[int, int, Map]]:
    """(rid, number, map) of each run of up to `fan` neighbours, from maps sorted by rid and number.

    A row like the one before it is of a repeated text, and passed over.
    """
    key, last, whole = None, None, ("", None, "")
    for batch in batches:
        machine.trim()
        columns = [batch.column(c) for c in ("rid", "k", "head", "inner", "tail")]
        for rid, k, *found in zip(*columns):
            rid, k = rid.as_py(), k.as_py()
            if (rid, k) == last:
                continue
            one = tuple(value.as_py() for value in found)
            if key == (rid, k // fan):
                whole = machine.join(whole, one)
            else:
                if key is not None:
                    yield *key, whole
                key, whole = (rid, k // fan), one
            last = (rid, k)
    if key is not None:
        yield *key, whole


def _composer(path: str, fan: int):
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, number, whole in _runs(batches, transducer(path), fan):
            yield _maps([rid], [number], [whole])

    return compose


def _totals(path: str, fan: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for rid, _, whole in _runs(batches, machine, fan):
            yield pa.RecordBatch.from_pydict(
                {"rid": pa.array([rid], pa.int64()), "n_tokens": pa.array([machine.total(whole)], pa.int64())}
            )

    return total


def _long_counts(large: DataFrame, model: str, chunk: int, fan: int) -> DataFrame:
    """(rid, n_tokens) of the different texts of (rid, text): maps of chunks, composed in rounds."""
    chunks = large.select("rid", "text").mapInArrow(_cutter(chunk), "rid long, k long, chunk string")
    maps = chunks.repartition("rid", "k").mapInArrow(_mapper(model), _MAP)
    most = -(-LONGEST_TEXT // chunk)
    while True:
        block = F.floor(F.col("k") / fan)
        near = maps.repartition(F.col("rid"), block).sortWithinPartitions("rid", "k")
        if most <= fan:
            return near.mapInArrow(_totals(model, fan), "rid long, n_tokens long")
        maps = near.mapInArrow(_composer(model, fan), _MAP)
        most = -(-most // fan)


def token_counts(
    documents: DataFrame, model: str, chunk: int = CHUNK, many: int = MANY_TOKENS, fan: int = FAN
) -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes, n_tokens, over_limit (more than `many`).

    `model` is the path of a sentencepiece model on every executor. Counts are those of the model's
    library without begin, end or added tokens; names of special tokens in a text are plain text. A
    null text is an empty one, of no tokens. Null ids and repeated rows are counted like any other, and
    an empty table has no counts. Texts over `chunk` bytes, up to the longest that a row can hold, are
    counted in chunks, whose maps become one `fan` at a time. Other columns of the input are not read.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    is_long = F.col("n_bytes") > chunk
    short = rows.filter(~is_long).mapInArrow(
        _counter(model), f"doc_id {id_type}, n_bytes long, n_tokens long"
    )
    large = rows.filter(is_long).withColumn("rid", row_id())
    counted = _long_counts(large, model, chunk, fan)
    long_rows = large.select("doc_id", "rid", "n_bytes").join(counted, "rid")
    return short.unionByName(long_rows.select("doc_id", "n_bytes", "n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > many
    )
