"""Byte strings of a fixed width that occur more than once, and texts without them.

Column-wise multi-document construction does the comparing: the Burrows-Wheeler transform and the
common prefixes of a collection of strings are built by inserting one symbol of every string each
round, from their ends on. Both are kept in files, one pair for each first symbol, that a round
reads and rewrites in order. Neighbours in the finished order that share `WIDTH` symbols or more
show the strings that repeat.

One collection cannot hold a corpus, so it is dealt to collections that can be built apart:

- Of the byte runs of length `ANCHOR` within a window of `WIDTH` bytes the one with the least hash is
  the window's anchor. Equal windows have equal anchors, so only windows with the same anchor need
  to meet. Neighbouring windows with one anchor are kept as one hull.
- An anchor that occurs once is done, and so are equal hulls: all their windows repeat. They are
  told by counts, so thousands of copies of a document cost what one does.
- What is left, each different hull once, is dealt by anchor to collections of about `SHARD_BYTES`.
  Anchors with very many different hulls have their hulls cut to shorter ones first, which are dealt
  by all the bytes that the windows of a short one share.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.native import row_id
from cohortry.llm.text import mix

WIDTH = 200  # bytes that have to be equal
ANCHOR = 100  # bytes of an anchor
PIECE = 1 << 18  # bytes of a text that are hashed at a time
SHARD_BYTES = 8 << 20  # of a collection
GROUP = 4096  # different hulls of one anchor that may share a collection uncut
CUTS = (8, 1)  # windows of the hulls that larger groups are cut to, in turn

_BASE = 0x9E3779B97F4A7C15

# Bytes that no UTF-8 text has.
MARK = 254  # stands before the number of a group, in the place of the bytes that its hulls share
END = 255  # before a whole string


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class _Anchors:
    """The hulls of byte strings."""

    def __init__(self, width: int, anchor: int):
        self.width = width
        self.anchor = anchor
        self.powers = _powers(_BASE, PIECE + width)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), PIECE + width)

    def hulls(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each hull of a piece, in order: anchor hash, first window, number of windows, and the
        anchor's place in it."""
        n, k = len(data), self.anchor
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.powers[:n]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)])
        codes = mix((sums[k:] - sums[:-k]) * self.inverse[: n - k + 1])
        # The place in the low bits: of equal hashes the first is least.
        place = np.uint64((1 << 20) - 1)
        ranked = (codes & ~place) | np.arange(len(codes), dtype=np.uint64)
        span = self.width - k + 1
        padded = np.full(-(-len(codes) // span) * span, ~np.uint64(0))
        padded[: len(codes)] = ranked
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.width + 1
        least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
        at = (least & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return codes[at[first]], first, np.diff(np.concatenate([first, [windows]])), at[first] - first


def _bytes_of(batch: pa.RecordBatch, column: str) -> Iterator[memoryview]:
    """The texts of a batch as UTF-8, a null as an empty one."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield memoryview(value.as_buffer() or b"") if value.is_valid else memoryview(b"")


def _hull_maker(width: int, anchor: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _Anchors(width, anchor)
        names = ["key", "hull", "rid", "start", "n", "at", "times"]
        for batch in batches:
            parts, held = [], 0
            for rid, text in zip(batch.column("rid").to_pylist(), _bytes_of(batch, "text")):
                for a in range(0, len(text) - width + 1, PIECE):
                    piece = text[a : a + PIECE + width - 1]
                    key, first, n, at = tool.hulls(np.frombuffer(piece, dtype=np.uint8))
                    ends = (first + n + width - 1).tolist()
                    hull = np.array(
                        [xxhash.xxh3_64_intdigest(piece[i:j]) for i, j in zip(first.tolist(), ends)],
                        dtype=np.uint64,
                    )
                    # Equal hulls one after the other, as in a run of one byte, are one row.
                    fresh = np.ones(len(key), dtype=bool)
                    fresh[1:] = (hull[1:] != hull[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
                    run = np.flatnonzero(fresh)
                    times = np.diff(np.concatenate([run, [len(key)]]))
                    owner = np.full(len(run), rid, dtype=np.int64)
                    parts.append((key[run].view(np.int64), hull[run].view(np.int64), owner, first[run] + a, n[run].astype(np.int16), at[run].astype(np.int16), times))
                    held += len(run)
                    if held >= 1 << 16:
                        yield pa.record_batch([np.concatenate(c) for c in zip(*parts)], names)
                        parts, held = [], 0
            if parts:
                yield pa.record_batch([np.concatenate(c) for c in zip(*parts)], names)

    return make


def hulls_of(documents: DataFrame, width: int, anchor: int) -> DataFrame:
    """(key, hull, rid, start, n, at, times): each hull's anchor and content by hash, its row of
    `documents`, its first window, its number of windows, the anchor's place in it, and how many
    times it follows itself."""
    return documents.select("rid", "text").mapInArrow(
        _hull_maker(width, anchor),
        "key long, hull long, rid long, start long, n short, at short, times long",
    )


# Column-wise construction


class _Files:
    """The symbol before each string, and how many it shares with the string above it, in order.

    A round reads one pair of files from the front and writes the other."""

    def __init__(self) -> None:
        self.pairs = [[tempfile.TemporaryFile(buffering=0) for _ in range(2)] for _ in range(2)]

    def __enter__(self) -> _Files:
        return self

    def __exit__(self, *_) -> None:
        for file in (f for pair in self.pairs for f in pair):
            file.close()

    def begin_round(self) -> None:
        self.pairs.reverse()
        for file in (f for pair in self.pairs for f in pair):
            file.seek(0)

    def read(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(self._whole(f, size), dtype=np.uint8) for f in self.pairs[0])

    @staticmethod
    def _whole(file, size: int) -> bytearray:
        out = bytearray(size)
        view, at = memoryview(out), 0
        while at < size:
            at += file.readinto(view[at:])
        return out

    def write(self, *columns: np.ndarray) -> None:
        for file, column in zip(self.pairs[1], columns):
            rest = memoryview(np.ascontiguousarray(column))
            while len(rest):
                rest = rest[file.write(rest) :]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each pair; no range is empty."""
    if not len(low):
        return np.empty(0, dtype=np.int64)
    sizes = high - low
    begin = np.cumsum(sizes) - sizes
    picked = np.repeat(low - begin, sizes) + np.arange(sizes.sum())
    return np.minimum.reduceat(values[picked], begin).astype(np.int64)


class Collection:
    """The order of all suffixes of some byte strings, built column by column.

    The bytes of the strings are below `END`. Common prefixes are counted up to `most`, 255 at the
    highest. Segment 0 of the order holds the empty suffixes, segment c + 1 those that begin with c.
    """

    def __init__(self, strings: list[bytes], most: int):
        if not 0 < most < 256:
            raise ValueError("common prefixes are counted in one byte")
        self.most = most
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.sizes = np.zeros(END + 1, dtype=np.int64)  # of the segments
        self.counts = np.zeros((END + 1, END + 1), dtype=np.int64)  # of each symbol, by segment

    def shared(self) -> np.ndarray:
        """For each byte of the strings end to end, the most that the suffix from there shares with
        any other suffix, up to `most`."""
        with _Files() as files:
            zeros = np.zeros(len(self.lengths), dtype=np.int64)
            # New suffixes: whose, their segment and place there, what each shares with the one
            # above it and the one below.
            new = (np.arange(len(zeros)), zeros, np.arange(len(zeros)), zeros, zeros)
            for column in range(int(self.lengths.max(initial=0)) + 1):
                new = self._round(files, column, *new)
            files.begin_round()
            return self._walked(files)

    def _round(self, files, column, who, segment, place, above, below):
        """Put the new suffixes of the last round in their places, with the symbols before them,
        and find the places of the suffixes that begin with these symbols."""
        files.begin_round()
        cuts = np.searchsorted(segment, np.arange(END + 2))
        before = np.zeros(END + 1, dtype=np.int64)
        out = []
        for c in np.flatnonzero((self.sizes > 0) | (np.diff(cuts) > 0)).tolist():
            symbols, common = files.read(int(self.sizes[c]))
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                left = self.lengths[who[a:b]] > column
                symbol = np.full(b - a, END, dtype=np.uint8)
                symbol[left] = self.data[self.ends[who[a:b][left]] - column - 1]
                at = place[a:b]
                symbols, common = _inserted(symbols, common, at, symbol, above[a:b], below[a:b])
                self.sizes[c] = len(symbols)
                self.counts[c] += np.bincount(symbol, minlength=END + 1)
                out.append(self._longer(c, before, symbols, common, at, symbol, left, who[a:b]))
            files.write(symbols, common)
            before += self.counts[c]
        if not out:
            return who[:0], segment[:0], place[:0], above[:0], below[:0]
        who, segment, place, above, below = (np.concatenate(x) for x in zip(*out))
        order = np.argsort((segment << 40) | place)
        return who[order], segment[order], place[order], above[order], below[order]

    def _longer(self, c, before, symbols, common, place, symbol, left, who):
        """The suffixes a symbol longer than those at `place`, unless the string has ended."""
        order = np.argsort(symbols, kind="stable")
        first = np.cumsum(self.counts[c]) - self.counts[c]
        active = np.zeros(len(symbols), dtype=bool)
        active[place[left]] = True
        at = np.flatnonzero(active[order])
        here = order[at]
        whose = np.searchsorted(place, here)
        symbol, who = symbol[whose].astype(np.int64), who[whose]
        rank = at - first[symbol]
        # The nearest string above in this segment with the same symbol before it; one in an
        # earlier segment shares that symbol only.
        above = np.where(before[symbol] > 0, 1, 0)
        has = rank > 0
        above[has] = np.minimum(_least(common, order[at[has] - 1] + 1, here[has] + 1) + 1, self.most)
        below = np.ones(len(here), dtype=np.int64)
        has = rank + 1 < self.counts[c][symbol]
        below[has] = np.minimum(_least(common, here[has] + 1, order[at[has] + 1] + 1) + 1, self.most)
        return who, symbol + 1, before[symbol] + rank, above, below

    def _walked(self, files: _Files) -> np.ndarray:
        """Follow each string from its end through the finished order."""
        begin = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        above = np.zeros(total + 1, dtype=np.uint8)
        step = np.zeros(total, dtype=np.int64)
        before = np.zeros(END + 1, dtype=np.int64)
        for c in np.flatnonzero(self.sizes).tolist():
            symbols, common = files.read(int(self.sizes[c]))
            above[begin[c] : begin[c] + len(common)] = common
            order = np.argsort(symbols, kind="stable")
            of = symbols[order].astype(np.int64)
            first = np.cumsum(self.counts[c]) - self.counts[c]
            target = begin[np.minimum(of + 1, END)] + before[of] + np.arange(len(order)) - first[of]
            step[begin[c] + order] = target
            before += self.counts[c]
        most = np.maximum(above[:-1], above[1:])
        out = np.zeros(len(self.data), dtype=np.uint8)
        who = np.arange(len(self.lengths))
        at = who.copy()
        for column in range(int(self.lengths.max(initial=0))):
            more = self.lengths[who] > column
            who, at = who[more], step[at[more]]
            out[self.ends[who] - column - 1] = most[at]
        return out


def _inserted(symbols, common, place, symbol, above, below):
    """The columns of a segment with new rows at `place`."""
    size = len(symbols) + len(place)
    kept = np.ones(size, dtype=bool)
    kept[place] = False
    new_symbols, new_common = np.empty(size, dtype=np.uint8), np.empty(size, dtype=np.uint8)
    new_symbols[kept], new_symbols[place] = symbols, symbol
    new_common[kept] = common
    inside = place + 1 < size
    new_common[place[inside] + 1] = below[inside]
    new_common[place] = above
    return new_symbols, new_common


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true marks."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _numbered(keys: np.ndarray) -> list[bytes]:
    """A mark and the number of each key among the different ones, in digits below the mark."""
    _, number = np.unique(keys, return_inverse=True)
    digits = 2 if number.max(initial=0) < MARK**2 else 8
    places = [MARK**i for i in range(digits)]
    return [bytes([MARK, *(x // p % MARK for p in places)]) for x in number.tolist()]


def _shard_solver(width: int) -> Callable:
    def solve(table: pa.Table) -> pa.Table:
        key, copies, n, core, at = (
            table.column(c).to_numpy() for c in ("key", "copies", "n", "core", "at")
        )
        # The bytes that all hulls of a group share are written as the group's number.
        strings, need = [], width - core
        for i, (body, code) in enumerate(zip(table.column("body").to_pylist(), _numbered(key))):
            strings.append(body[: at[i]] + code + body[at[i] + core[i] :])
            need[i] += len(code)
        shared = Collection(strings, int(need.max(initial=1))).shared()
        row, low, high = [], [], []
        begin = 0
        for i, string in enumerate(strings):
            if copies[i] > 1:
                a, b = np.array([0]), np.array([n[i]])
            else:
                a, b = _runs(shared[begin : begin + n[i]] >= need[i])
            begin += len(string)
            row.append(np.full(len(a), i))
            low.append(a)
            high.append(b)
        picked = table.select(["key", "hull"]).take(pa.array(np.concatenate(row)))
        return picked.append_column("low", pa.array(np.concatenate(low), pa.int64())).append_column(
            "high", pa.array(np.concatenate(high), pa.int64())
        )

    return solve


def _cutter(width: int, windows: int) -> Callable:
    """Hulls to hulls of at most so many windows, dealt by bytes that all their windows share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hull", "offset", "part_key", "part", "copies", "n", "at", "core", "body"]
        kinds = [pa.int64()] * 9 + [pa.binary()]
        for batch in batches:
            for small in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for r in small.to_pylist():
                    at, n = r["at"], r["n"]
                    # Windows are classed by how far before the shared bytes they begin, so equal
                    # ones of different hulls are in one class.
                    for near in range((at - n + 1) // windows * windows, at + 1, windows):
                        a = max(at - near - windows + 1, 0)
                        b = min(at - near, n - 1) + 1
                        body = r["body"][a : b + width - 1]
                        core = width - windows + 1
                        shared = body[at - near - a :][:core]
                        part_key = np.uint64(xxhash.xxh3_64_intdigest(shared, 1)).astype(np.int64)
                        part = np.uint64(xxhash.xxh3_64_intdigest(body)).astype(np.int64)
                        rows.append((r["key"], r["hull"], a, part_key, part, r["copies"], b - a, at - near - a, core, body))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return cut


def repeated_runs(
    hulls: DataFrame, width: int, group: int = GROUP, shard_bytes: int = SHARD_BYTES, cuts=CUTS
) -> DataFrame:
    """(key, hull, low, high): the windows of each hull that occur elsewhere, as runs.

    `hulls` has a row for each different hull: key, hull, copies, n, body, and where in body the
    bytes lie that all hulls of the key share: at, core (their number).
    """
    sizes = hulls.groupBy("key").agg(F.count("*").alias("hulls"))
    large = stage(sizes.filter(F.col("hulls") > group).select("key"), "large-groups")
    cut_here = bool(cuts) and not large.isEmpty()
    rest = hulls.join(large, "key", "left_anti") if cut_here else hulls
    total = rest.agg(F.sum(F.length("body"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(total // shard_bytes + 1)).alias("shard")
    solved = (
        rest.select("key", "hull", "copies", "n", "at", "core", "body", shard)
        .groupBy("shard")
        .applyInArrow(_shard_solver(width), "key long, hull long, low long, high long")
    )
    if not cut_here:
        return solved
    parts = stage(
        hulls.join(large, "key", "left_semi")
        .select("key", "hull", "copies", "n", "at", "body")
        .mapInArrow(
            _cutter(width, cuts[0]),
            "key long, hull long, offset long, part_key long, part long, copies long, n long, at long, core long, body binary",
        ),
        "parts",
    )
    merged = parts.groupBy(F.col("part_key").alias("key"), F.col("part").alias("hull")).agg(
        F.sum("copies").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "at", "core", "body")]
    )
    # A part alone under its shared bytes needs no collection.
    met = merged.groupBy("key").agg((F.count("*") + F.max("copies")).alias("met")).filter("met > 2")
    inner = repeated_runs(
        stage(merged.join(met.select("key"), "key", "left_semi"), "part-hulls"), width, group, shard_bytes, cuts[1:]
    ).select(F.col("key").alias("part_key"), F.col("hull").alias("part"), "low", "high")
    found = parts.select("key", "hull", "offset", "part_key", "part").join(inner, ["part_key", "part"])
    return solved.unionByName(
        found.select("key", "hull", (F.col("offset") + F.col("low")).alias("low"), (F.col("offset") + F.col("high")).alias("high"))
    )


def _body_cutter(width: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary()]
        names = ["key", "hull", "copies", "n", "at", "body"]
        for batch in batches:
            rows, held = [], 0
            for wanted, text in zip(batch.column("wanted"), _bytes_of(batch, "text")):
                for w in wanted.as_py():
                    body = bytes(text[w["start"] : w["start"] + w["n"] + width - 1])
                    rows.append((w["key"], w["hull"], w["copies"], w["n"], w["at"], body))
                    held += len(body)
                    if held > 1 << 20:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return cut


def repeated_spans(
    documents: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, group: int = GROUP, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(rid, spans): the bytes of each row that lie in a repeated string, as an array of (low, high)
    in order of low, which may overlap. `documents` has rid and text; rows that share rid are equal."""
    seen = stage(hulls_of(documents, width, anchor), "hulls")
    keys = (
        seen.groupBy("key")
        .agg(F.sum("times").alias("seen"), F.min("hull").alias("least"), F.max("hull").alias("most"))
        .filter("seen > 1")
        .select("key", (F.col("least") != F.col("most")).alias("mixed"))
    )
    found = stage(seen.join(stage(keys, "anchors"), "key"), "repeated-anchors")
    different = found.filter("mixed").groupBy("key", "hull").agg(
        F.sum("times").alias("copies"), F.min(F.struct("rid", "start", "n", "at")).alias("first")
    )
    wanted = different.groupBy(F.col("first.rid").alias("rid")).agg(
        F.collect_list(F.struct("key", "hull", "copies", "first.start", F.col("first.n").cast("long").alias("n"), F.col("first.at").cast("long").alias("at"))).alias("wanted")
    )
    bodies = (
        documents.select("rid", "text")
        .join(wanted, "rid")
        .select("wanted", "text")
        .mapInArrow(_body_cutter(width), "key long, hull long, copies long, n long, at long, body binary")
        # Equal rows cut the same bodies.
        .groupBy("key", "hull")
        .agg(*[F.any_value(c).alias(c) for c in ("copies", "n", "at", "body")])
        .withColumn("core", F.lit(anchor).cast("long"))
    )
    runs = stage(repeated_runs(stage(bodies, "bodies"), width, group, shard_bytes), "runs")
    whole = found.filter("NOT mixed OR times > 1").select(
        "rid", "start", (F.col("start") + F.col("n") * F.col("times")).alias("end")
    )
    part = found.filter("mixed AND times = 1").join(runs, ["key", "hull"]).select(
        "rid", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end")
    )
    spans = (
        whole.unionByName(part)
        .groupBy("rid", F.col("start").alias("low"))
        .agg((F.max("end") + F.lit(width - 1)).alias("high"))
    )
    return spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))


def merged_spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans given in order of their begin."""
    if not len(low):
        return low, high
    reach = np.maximum.accumulate(high)
    first = np.concatenate([[True], low[1:] > reach[:-1]])
    last = np.concatenate([first[1:], [True]])
    return low[first], reach[last]


def _without_spans(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    for batch in batches:
        rows = []
        for doc_id, spans, text in zip(batch.column("doc_id").to_pylist(), batch.column("spans"), _bytes_of(batch, "text")):
            spans = spans.values if spans.is_valid else None
            low, high = (np.array(spans.field(i)) if spans else np.empty(0, dtype=np.int64) for i in range(2))
            low, high = merged_spans(low, high)
            digest, kept, at = hashlib.sha256(), [], 0
            for a, b in zip([*low.tolist(), len(text)], [*high.tolist(), len(text)]):
                digest.update(text[at:a])
                if with_text:
                    kept.append(text[at:a])
                at = b
            row = (doc_id, len(text), int((high - low).sum()), len(low), digest.hexdigest())
            rows.append((*row, b"".join(kept)) if with_text else row)
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def without_repeats(
    documents: DataFrame,
    width: int = WIDTH,
    anchor: int = ANCHOR,
    group: int = GROUP,
    shard_bytes: int = SHARD_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked for, kept: the bytes that stay (they need not be whole characters).

    A byte is removed if a string of `width` bytes that covers it also begins anywhere else, in the
    same text or another; all strings are judged on the texts as given. A null text is an empty one.
    Texts shorter than `width` lose nothing. Repeated rows are copies of each other and lose all but
    texts that are too short. Rows without doc_id take part like others. Long texts are hashed in
    pieces and compared in hulls, so their length has no bound but that of a row. An empty table
    gives no rows. Other columns are ignored.
    """
    if not 0 < anchor <= width < 256:
        raise ValueError("0 < anchor <= width < 256 is needed")
    known = documents.select("doc_id", "text").withColumn("rid", row_id())
    spans = repeated_spans(known, width, anchor, group, shard_bytes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        known.join(stage(spans, "spans"), "rid", "left")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
        .mapInArrow(lambda batches: _without_spans(batches, with_text), schema + ", kept binary" * with_text)
    )
