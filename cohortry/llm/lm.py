"""Scoring by a class-based bigram model.

1. Words of the training documents are counted. The `FREQUENT` most frequent ones are numbered by
   falling count, the others after them by rising hash. Documents are written once as numbers; words
   are looked up in blocks of `VOCABULARY` words, one block in memory at a time.
2. The neighbours of every training word, left and right, are listed once: words are dealt to
   buckets, and equal neighbours in a bucket are summed. A word with many neighbours is dealt in pieces.
3. Classes begin with an exchange of the `HEAD` most frequent words on the driver, over the
   HEAD x HEAD table of neighbours of all training tokens. Every other word is then placed into the
   class that raises the likelihood of the class bigrams most.
4. Exchange clustering of all words, in `SWEEPS` distributed sweeps of two rounds: left and right
   class counts of half of the words, dealt by hash, are summed over their lists, and each of these
   words moves to its best class. A round whose moves together lower the likelihood is taken back. The
   end of a document is a class of its own, as are words not seen in training.
5. Class transitions are counted over all training tokens. A word's probability is that of its
   class after the last word's class, times its share of the class.

The words of up to 254 tokens lie whole in one row of lists, so tasks choose their classes at once;
those of the others are chosen after their contexts, at most two per class and row, are gathered.
Tasks know all classes: one byte for each distinct training word is sent to them, and one for its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.text import mix, slices

#: Words of one block of lookups.
VOCABULARY = 1 << 20
HEAD = 1024
CLASSES = 64
PASSES = 4
#: Sweeps of the distributed exchange; in each, every word may move once.
SWEEPS = 2
#: Words gathered before they are counted and sent on.
GATHERED = 1 << 21
#: Numbers of a batch that are worked on at a time.
AT_ONCE = 1 << 18
#: Words numbered by count.
FREQUENT = 1 << 16
#: Neighbours of a word that are dealt to one bucket, and tokens for each bucket.
PIECE = 1024
BUCKET = 1 << 21
#: Entries in a row of lists, and rows of contexts worked on at a time.
ENTRIES = 1 << 14
ROWS = 512
#: A count in one byte; it stands for all larger ones too.
MANY = 255
TRANSITION_PRIOR = 0.1
#: Hash of the end of a document, apart from words.
END = np.uint64(0xD1B54A32D192ED03)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with one end each, and the bounds of the texts."""
    words = texts.words(fold=True)
    n = len(texts)
    bounds = words.bounds + np.arange(n + 1)
    out = np.empty(len(words.hashes) + n, dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[bounds[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = words.hashes
    return out, bounds


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"w": values.view(np.int64), "n": n})

    for batch in batches:
        for texts in slices(batch):
            held.append(_tokens(texts)[0])
            size += len(held[-1])
            if size >= GATHERED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def word_counts(training: DataFrame) -> DataFrame:
    """(w, n): how often each token occurs, tokens as hashes."""
    return (
        training.select("text")
        .mapInArrow(_count_words, "w long, n long")
        .groupBy("w")
        .agg(F.sum("n").alias("n"))
    )


def _vocabulary(counts: DataFrame, bound: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of all words; and the most frequent ones, at most `bound`, by falling count, with counts."""
    # Hashes are unsigned: negative longs come last.
    table = counts.orderBy(F.desc("n"), F.col("w") < 0, "w").limit(bound).toArrow()
    words = table.column("w").to_numpy().view(np.uint64)
    return counts.count(), words, table.column("n").to_numpy()


class _Words:
    """Numbers of the training words: the frequent ones by falling count, then all others by hash.

    Hashes of the others are sent to tasks in blocks of about `block` words. The driver sees one block
    at a time and keeps what it needs of each word: in which round it moves, and its count in a byte
    (large counts are listed apart).
    """

    def __init__(self, counts: DataFrame, size: int, block: int, frequent: np.ndarray, n: np.ndarray):
        context = counts.sparkSession.sparkContext
        frequent = frequent.view(np.int64)
        self.order = np.argsort(frequent)
        self.top = frequent[self.order]
        blocks = max(1, -(-size // block))
        edges = [(k << 64) // blocks - (1 << 63) for k in range(blocks + 1)]
        self.edges = np.array(edges[1:-1], dtype=np.int64)
        self.parts, self.starts = [], [len(frequent)]
        halves, small, large = [], [], []

        def keep(words: np.ndarray, often: np.ndarray, start: int) -> None:
            at = np.flatnonzero(often >= MANY)
            large.append((at + start, often[at]))
            halves.append(_half(words).astype(np.uint8))
            small.append(np.minimum(often, MANY).astype(np.uint8))

        keep(frequent, n, 0)
        for low, high in zip(edges, edges[1:]):
            table = counts.filter(F.col("w").between(low, high - 1)).toArrow()
            words = table.column("w").to_numpy()
            order = np.argsort(words)
            words, often = words[order], table.column("n").to_numpy()[order]
            rest = ~self._is_top(words)[1]
            keep(words[rest], often[rest], self.starts[-1])
            self.starts.append(self.starts[-1] + int(rest.sum()))
            self.parts.append(context.broadcast(words[rest]))
        self.size = self.starts[-1]
        self.halves, self.counts = np.concatenate(halves), np.concatenate(small)
        self.large = tuple(np.concatenate(x) for x in zip(*large))

    def _is_top(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.top):
            return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        place = np.minimum(np.searchsorted(self.top, tokens), len(self.top) - 1)
        return place, self.top[place] == tokens

    def for_tasks(self) -> _Words:
        """What the lookup needs, without the tables of the driver."""
        out = _Words.__new__(_Words)
        for name in ("top", "order", "edges", "parts", "starts", "size"):
            setattr(out, name, getattr(self, name))
        return out

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """The number of each hash; `size` for an unknown one."""
        tokens = tokens.view(np.int64)
        out = np.full(len(tokens), self.size, dtype=np.uint32)
        place, top = self._is_top(tokens)
        out[top] = self.order[place[top]]
        rest = np.flatnonzero(~top)
        block = np.searchsorted(self.edges, tokens[rest], side="right")
        for k, part in enumerate(self.parts):
            at = rest[block == k]
            words = part.value
            if len(words) and len(at):
                place = np.minimum(np.searchsorted(words, tokens[at]), len(words) - 1)
                known = words[place] == tokens[at]
                out[at[known]] = place[known] + self.starts[k]
            if len(self.parts) > 1:
                # A task holds one block at a time; it is read again from the executor's disk.
                part.__dict__.pop("_value", None)
        return out

    def drop_hashes(self) -> None:
        for part in self.parts:
            part.unpersist()


def _encoder(words: _Words):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def encoded() -> Iterator[pa.RecordBatch]:
            numbers = words.numbers(np.concatenate([tokens for _, tokens, _ in held]))
            at = 0
            for batch, tokens, bounds in held:
                yield _with_numbers(batch, numbers[at : at + len(tokens)], bounds)
                at += len(tokens)

        for batch in batches:
            for texts in slices(batch):
                held.append((texts.batch.drop_columns("text"), *_tokens(texts)))
                total += len(held[-1][1])
                if total >= GATHERED:
                    yield from encoded()
                    held, total = [], 0
        if held:
            yield from encoded()

    return encode


#: Numbers are stored as two halves. Most words are frequent: their upper halves are zeros, which
#: cost next to nothing in a file.
NUMBERS = "low binary, high binary"


def _with_numbers(batch: pa.RecordBatch, numbers: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    low = _binary((numbers & 0xFFFF).astype(np.uint16), bounds)
    high = _binary((numbers >> 16).astype(np.uint16), bounds)
    return batch.append_column("low", low).append_column("high", high)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    low, bounds = _flat(batch.column("low"), "<u2")
    high, _ = _flat(batch.column("high"), "<u2")
    return low | (high.astype(np.uint32) << np.uint32(16)), bounds


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of an array as binary values."""
    offsets = pa.py_buffer((np.asarray(bounds) * values.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values in a column of binary values end to end, and the bounds of each row's values."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    values = raw[offsets[0] : offsets[-1]].view(kind)
    return values, (offsets - offsets[0]) // values.itemsize


def _sequences(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens of a batch, that of the token before each, and the texts' bounds."""
    ids, bounds = _numbers(batch)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = end
    return ids, before, bounds


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with at most `AT_ONCE` numbers together, or one row with more."""
    _, bounds = _flat(batch.column("low"), "<u2")
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + AT_ONCE, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


PARTS = f"bucket int, keys binary, counts binary, {NUMBERS}"
LISTS = f"frequent boolean, keys binary, sizes binary, counts binary, {NUMBERS}"


def _summed(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes as one, with their number or the sum of their counts."""
    if n is None:
        return np.unique(code, return_counts=True)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n[order].astype(np.int64), first)


def _in_bytes(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with counts of a byte each: a larger one is spread over several entries."""
    times = (n + 254) // 255
    counts = np.full(int(times.sum()), 255, dtype=np.uint8)
    counts[np.cumsum(times) - 1] = n - 255 * (times - 1)
    return np.repeat(code, times), counts


def _rows(code: np.ndarray, bounds: np.ndarray, counts: np.ndarray, **columns) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pydict(columns | {"counts": _binary(counts, bounds)})
    return _with_numbers(batch, code.astype(np.uint32), bounds)


def _lister(end: int, buckets: int):
    """Neighbours of words by bucket, coded as key and neighbour; a key is 2 * word, plus 1 for the right.

    The end of a text never moves, and a word beside itself is met from its left already, so neither
    has a list to the right of these.
    """
    one, low = np.uint64(1), np.uint64(32)

    def dealt(ids: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        ids, before = ids.astype(np.uint64), before.astype(np.uint64)
        right = (before != end) & (before != ids)
        left = (ids << np.uint64(33)) | before
        code, counts = _in_bytes(
            *_summed(np.concatenate([left, (((before[right] << one) | one) << low) | ids[right]]))
        )
        key = (code >> low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        piece = (np.arange(len(key)) - np.repeat(first, np.diff([*first, len(key)]))) // PIECE
        bucket = (key // 2 + piece * 40503) % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, code, key, counts = bucket[order], code[order], key[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        # Keys rise within a bucket; steps are small.
        step = np.diff(key, prepend=0)
        step[starts] = key[starts]
        bounds = np.append(starts, len(key))
        names = {"bucket": bucket[starts].astype(np.int32), "keys": _binary(step.astype("<u4"), bounds)}
        return _rows(code, bounds, counts, **names)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for part in (part for batch in batches for part in _parts(batch)):
            ids, before, _ = _sequences(part, end)
            for a in range(0, len(ids), AT_ONCE):
                held.append((ids[a : a + AT_ONCE], before[a : a + AT_ONCE]))
                total += len(held[-1][0])
                if total >= GATHERED:
                    yield dealt(*map(np.concatenate, zip(*held)))
                    held, total = [], 0
        if held:
            yield dealt(*map(np.concatenate, zip(*held)))

    return lists


def _merger(often):
    """Lists of whole buckets, in rows of about `ENTRIES` entries; parts come sorted by bucket.

    A row does not end within an infrequent word.
    """

    def packed(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, counts = _in_bytes(code, n)
        key = (code >> np.uint64(32)).astype(np.int64)
        frequent = often.value[key // 2] == MANY
        for kind in (False, True):
            at = np.flatnonzero(frequent == kind)
            if not len(at):
                continue
            own = key[at]
            # Ends of words, then the first end past each multiple of the size.
            ends = np.append(np.flatnonzero(own[1:] // 2 != own[:-1] // 2) + 1, len(own))
            if kind:
                ends = np.unique(np.append(ends, np.arange(ENTRIES, len(own), ENTRIES)))
            wanted = np.searchsorted(ends, np.arange(ENTRIES, len(own) + ENTRIES, ENTRIES))
            ends = np.unique(ends[np.minimum(wanted, len(ends) - 1)])
            for a, b in zip([0, *ends], ends):
                names, first = np.unique(own[a:b], return_index=True)
                sizes = np.diff([*first, b - a]).astype("<u4")
                whole = np.array([0, len(names)])
                yield _rows(
                    code[at[a:b]],
                    np.array([0, b - a]),
                    counts[at[a:b]],
                    frequent=[kind],
                    keys=_binary(names.astype("<u4"), whole),
                    sizes=_binary(sizes, whole),
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes, counts = None, [], []

        def merged() -> Iterator[pa.RecordBatch]:
            if codes:
                yield from packed(*_summed(np.concatenate(codes), np.concatenate(counts)))

        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != last:
                    yield from merged()
                    last, codes, counts = bucket, [], []
                row = batch.slice(k, 1)
                key = np.cumsum(_flat(row.column("keys"), "<u4")[0], dtype=np.uint64)
                codes.append((key << np.uint64(32)) | _numbers(row)[0])
                counts.append(_flat(row.column("counts"), "u1")[0])
        yield from merged()

    return merge


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row: its keys; and place of the key, neighbour and count of every entry."""
    for k in range(batch.num_rows):
        row = batch.slice(k, 1)
        key = _flat(row.column("keys"), "<u4")[0].astype(np.int64)
        sizes = _flat(row.column("sizes"), "<u4")[0]
        yield key, np.repeat(np.arange(len(key)), sizes), _numbers(row)[0], _flat(row.column("counts"), "u1")[0]


def _pair_counter(of, size: int):
    """Counts of neighbouring values, from lists to the left; `of` has a value for each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for batch in batches:
            for key, row, beside, n in _entries(batch):
                left = (key % 2 == 0)[row]
                own = of.value[key // 2].astype(np.int64)[row[left]]
                np.add.at(total, of.value[beside[left]].astype(np.int64) * size + own, n[left])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": at.astype(np.int64), "n": total[at].astype(np.int64)})

    return count


def _pairs(lists: DataFrame, of, size: int) -> np.ndarray:
    table = (
        lists.mapInArrow(_pair_counter(of, size), "pair long, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros(size * size)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _rise(base: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _xlogx(base + n) - _xlogx(base)


def exchange(neighbours: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each word from the table of neighbours; the last two rows keep classes of their own.

    Words start dealt over the classes by frequency. Each in turn moves to the class that raises the
    likelihood of the class bigrams most, if any does; ties go to the lower class.
    """
    words = len(neighbours) - 2
    size = classes + 2
    of = np.concatenate([np.arange(words) % classes, [classes, classes + 1]])
    member = np.eye(size)[of]
    table = member.T @ neighbours @ member
    for _ in range(passes):
        moved = 0
        for w in range(words):
            to = neighbours[w] @ member
            by = neighbours[:, w] @ member
            own = neighbours[w, w]
            a = of[w]
            to[a] -= own
            by[a] -= own
            table[a] -= to
            table[:, a] -= by
            table[a, a] -= own
            rows = table[:classes]
            columns = table[:, :classes].T
            gain = (_xlogx(rows + to) - _xlogx(rows)).sum(axis=1)
            gain += (_xlogx(columns + by) - _xlogx(columns)).sum(axis=1)
            k = np.arange(classes)
            corner = table[k, k]
            gain -= _xlogx(corner + to[:classes]) + _xlogx(corner + by[:classes]) - 2 * _xlogx(corner)
            gain += _xlogx(corner + to[:classes] + by[:classes] + own) - _xlogx(corner)
            # Neighbours of the word keep their own margins wherever it goes.
            left, right = rows.sum(axis=1) + by[:classes], columns.sum(axis=1) + to[:classes]
            gain -= _xlogx(left + to.sum() + own) - _xlogx(left)
            gain -= _xlogx(right + by.sum() + own) - _xlogx(right)
            best = int(gain.argmax())
            table[best] += to
            table[:, best] += by
            table[best, best] += own
            if best != a and gain[best] > gain[a] + 1e-9:
                member[w, a], member[w, best] = 0.0, 1.0
                of[w] = best
                moved += 1
            elif best != a:
                table[best] -= to
                table[:, best] -= by
                table[best, best] -= own
                table[a] += to
                table[:, a] += by
                table[a, a] += own
        if not moved:
            break
    return of


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for a constant."""
    return float(_xlogx(table).sum() - sum(_xlogx(table.sum(axis=axis)).sum() for axis in (0, 1)))


CONTEXTS = "id long, contexts binary, counts binary"


def _contexts(entries, of, moving, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The moving words of a row of lists, and their contexts: classes to the left (below `size`) and
    to the right, and own. A word next to itself counts once, as own context (2 * size)."""
    key, row, beside, n = entries
    ids = key // 2
    names = np.unique(ids[moving.value[ids] != 0])
    word = np.full(len(key), -1)
    picked = moving.value[ids] != 0
    word[picked] = np.searchsorted(names, ids[picked])
    at = picked[row]
    row, beside, n = row[at], beside[at], n[at]
    context = of.value[beside].astype(np.int64) + size * (key % 2)[row]
    context[beside == ids[row]] = 2 * size
    wide = 2 * size + 1
    sums = np.bincount(word[row] * wide + context, weights=n, minlength=len(names) * wide)
    return names, sums.reshape(-1, wide)


def _context_counter(of, moving, size: int):
    """Contexts of the moving words, as far as a row of lists has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in _entries(batch):
                names, contexts = _contexts(entries, of, moving, size)
                if not len(names):
                    continue
                row, context = np.nonzero(contexts)
                bounds = np.searchsorted(row, np.arange(len(names) + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": names,
                        "contexts": _binary(context.astype("<u2"), bounds),
                        "counts": _binary(contexts[row, context].astype("<u4"), bounds),
                    }
                )

    return count


MOVES = "id long, class int"


def _moves(ids: np.ndarray, contexts: np.ndarray, table: np.ndarray, classes: int, of) -> pa.RecordBatch:
    """New class of each word that moves."""
    old = of.value[ids].astype(np.int64)
    best = np.empty_like(old)
    for a in range(0, len(ids), ROWS):
        # Words of one class that were met in the same contexts go to the same class.
        alike = np.column_stack([old[a : a + ROWS], contexts[a : a + ROWS]])
        alike, place = np.unique(alike, axis=0, return_inverse=True)
        best[a : a + ROWS] = best_classes(table, classes, alike[:, 0].astype(np.int64), alike[:, 1:])[place.ravel()]
    moves = best != old
    return pa.RecordBatch.from_pydict({"id": ids[moves], "class": best[moves].astype(np.int32)})


def _whole_chooser(table: np.ndarray, classes: int, of, moving):
    """New classes of words that lie whole in one row of lists."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in _entries(batch):
                names, contexts = _contexts(entries, of, moving, len(table))
                yield _moves(names, contexts, table, classes, of)

    return choose


def _half(w: np.ndarray) -> np.ndarray:
    """Which of the two rounds of a sweep a word moves in."""
    return (mix(w.view(np.uint64)) & np.uint64(1)).astype(np.int64)


def best_classes(table: np.ndarray, classes: int, of: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Class of each word that raises the likelihood most when the word alone moves there.

    `of` are the classes that words are in, `contexts` their left, right and own counts, a row each.
    Ties go to the lower class, but a word moves for a rise only.
    """
    size = len(table)
    by, to, own = contexts[:, :size], contexts[:, size : 2 * size], contexts[:, 2 * size :]
    rows = np.arange(len(of))
    placed = np.flatnonzero(of < classes)
    gain = np.zeros((len(of), classes))
    for there, back, matrix in ((to, by, table.T), (by, to, table)):
        i, j = np.nonzero(there)
        n = there[i, j]
        # Most contexts are alike: their terms differ only in the class that a word is in.
        _, first, like = np.unique(n * size + j, return_index=True, return_inverse=True)
        terms = _rise(matrix[j[first], :classes], n[first][:, None])[like]
        mine = np.flatnonzero(of[i] < classes)
        at = of[i[mine]]
        terms[mine, at] = _rise(matrix[j[mine], at] - n[mine], n[mine])
        corner = np.flatnonzero(j == of[i])
        base = matrix[j[corner], :classes]
        inner = np.flatnonzero(of[i[corner]] < classes)
        at, word = of[i[corner[inner]]], i[corner[inner]]
        base[inner, at] -= n[corner[inner]]
        base -= back[i[corner], :classes]
        base[inner, at] -= own[word, 0]
        terms[corner] = _rise(base, n[corner][:, None])
        if len(i):
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            gain[i[starts]] += np.add.reduceat(terms, starts, axis=0)
        margin = matrix.sum(axis=0)[:classes]
        whole = there.sum(axis=1) + own[:, 0]
        sizes, like = np.unique(whole, return_inverse=True)
        terms = _rise(margin, sizes[:, None])[like]
        at = of[placed]
        terms[placed, at] = _rise(margin[at] - whole[placed], whole[placed])
        gain -= terms
    corner = np.tile(np.diag(table)[:classes], (len(of), 1))
    at = of[placed]
    corner[placed, at] -= to[placed, at] + by[placed, at] + own[placed, 0]
    # Nothing changes where a word has none of these.
    i, j = np.nonzero((to[:, :classes] != 0) | (by[:, :classes] != 0) | (own != 0))
    corner, after, before = corner[i, j], to[i, j], by[i, j]
    right, left = corner + after, corner + before
    gain[i, j] += _xlogx(right + before + own[i, 0]) + _xlogx(corner) - _xlogx(right) - _xlogx(left)
    best = gain.argmax(axis=1)
    stays = placed[gain[placed, best[placed]] <= gain[placed, at] + 1e-9]
    best[stays] = of[stays]
    return best


def _chooser(table: np.ndarray, classes: int, of):
    """New classes of words whose contexts come in several rows, sorted by word."""
    wide = 2 * len(table) + 1

    def chosen(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        ids = batch.column("id").to_numpy()
        context, bounds = _flat(batch.column("contexts"), "<u2")
        n, _ = _flat(batch.column("counts"), "<u4")
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        word = np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
        word = np.repeat(word, np.diff(bounds))
        contexts = np.bincount(word * wide + context, weights=n, minlength=len(starts) * wide)
        return _moves(ids[starts], contexts.reshape(-1, wide), table, classes, of)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rest.append(batch.slice(a, ROWS))
                part = pa.Table.from_batches(rest)
                ids = part.column("id").to_numpy()
                last = int(np.searchsorted(ids, ids[-1]))
                if last:
                    yield chosen(part.slice(0, last))
                    rest = part.slice(last).to_batches()
        if rest:
            yield chosen(pa.Table.from_batches(rest))

    return choose


def _scorer(of, often, large, transition, of_class, total: int, end: int):
    """Sums over the tokens of a text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = len(of.value) - 1
        for batch in (part for batch in batches for part in _parts(batch)):
            ids, before, bounds = _sequences(batch, end)
            own = of.value[ids]
            n = often.value[ids].astype(np.float64)
            many = np.flatnonzero(n == MANY)
            if len(many):
                n[many] = large.value[1][np.searchsorted(large.value[0], ids[many])]
            known = ids != unknown
            model = transition[of.value[before], own]
            # A word that training lacks is the only one of its class.
            model[known] += np.log10(n[known] / of_class[own[known]])
            base = np.log10((n + 1) / (total + unknown + 1))
            out = batch.drop_columns(["low", "high"])
            starts = bounds[:-1]
            for name, values in (
                ("n_tokens", np.diff(bounds)),
                ("n_known", np.add.reduceat(known.astype(np.int64), starts)),
                ("base_score", np.add.reduceat(base, starts)),
                ("score", np.add.reduceat(model, starts)),
            ):
                out = out.append_column(name, pa.array(values))
            yield out

    return score


def model_scores(
    documents: DataFrame,
    held_out: Column,
    vocabulary: int = VOCABULARY,
    head: int = HEAD,
    classes: int = CLASSES,
) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score and perplexity (of the model, per token).

    The model learns from the rows that are not `held_out`. Tokens are words with A-Z lower-cased
    and one end per text; a null or empty text is its end alone. base_score is the add-one unigram
    log10 probability, score the class model's. n_known counts tokens that training has. Without
    training rows every token is unknown. Rows without id and repeated rows are scored like any
    other, texts of any length as whole ones. An empty table gives an empty result. Other columns are
    not read. `vocabulary` is the number of words looked up at once; no result depends on it.
    """
    spark = documents.sparkSession
    send = spark.sparkContext.broadcast
    rows = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = stage(word_counts(rows.filter(~F.col("held_out"))), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    size, frequent, n = _vocabulary(counts, max(FREQUENT, head))
    words = _Words(counts, size, vocabulary, frequent, n)
    encoded = stage(
        rows.select("doc_id", "held_out", "text").mapInArrow(
            _encoder(words.for_tasks()), f"doc_id {id_type}, held_out boolean, {NUMBERS}"
        ),
        "encoded",
    )
    end = int(words.numbers(np.array([END]))[0])
    words.drop_hashes()
    often = send(np.append(words.counts, np.uint8(0)))
    lists = stage(
        encoded.filter(~F.col("held_out"))
        .select("low", "high")
        .mapInArrow(_lister(end, max(1, total // BUCKET)), PARTS)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_merger(often), LISTS),
        "neighbours",
    )

    # Heads keep their number; all other words share one, ends another.
    head = min(head, size)
    value = np.minimum(np.arange(size + 1), head).astype(np.uint16)
    value[end] = head + 1
    rare_class, end_class, k = classes, classes + 1, classes + 2
    of = exchange(_pairs(lists, send(value), head + 2), classes).astype(np.uint8)[value]
    of[end], of[size] = end_class, rare_class

    def moved(of: np.ndarray, sent, table: np.ndarray, half: int | None) -> np.ndarray:
        """Classes after a round: of the words without a class, or of a half of all words."""
        moving = np.append(of[:-1] == rare_class if half is None else words.halves == half, False)
        moving[end] = False
        picked = send(moving.astype(np.uint8))
        whole = lists.filter("NOT frequent").mapInArrow(_whole_chooser(table, classes, sent, picked), MOVES)
        others = (
            lists.filter("frequent")
            .mapInArrow(_context_counter(sent, picked, k), CONTEXTS)
            .repartition("id")
            .sortWithinPartitions("id")
            .mapInArrow(_chooser(table, classes, sent), MOVES)
        )
        chosen = stage(whole.unionByName(others), "classes")
        picked.unpersist()
        of = of.copy()
        for a in range(0, size, vocabulary):
            new = chosen.filter(F.col("id").between(a, a + vocabulary - 1)).toArrow()
            of[new.column("id").to_numpy()] = new.column("class").to_numpy()
        return of

    sent = send(of)
    moves = _pairs(lists, sent, k)
    for half in (None, *(0, 1) * SWEEPS):
        new = moved(of, sent, moves, half)
        new_sent = send(new)
        table = _pairs(lists, new_sent, k)
        if half is None or likelihood(table) > likelihood(moves):
            sent.unpersist()
            of, sent, moves = new, new_sent, table
        else:
            new_sent.unpersist()

    transition = np.log10(
        (moves + TRANSITION_PRIOR) / (moves.sum(axis=1, keepdims=True) + TRANSITION_PRIOR * k)
    )
    # Every token of a class follows another token.
    scored = encoded.mapInArrow(
        _scorer(sent, often, send(words.large), transition, moves.sum(axis=0), total, end),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
