"""Packing of tokenised documents into sequences of fixed length: cutting stock by columns.

Documents are tokenised once and cut into pieces of at most `LENGTH` tokens. A histogram of piece
lengths, which has `LENGTH` entries whatever the corpus, is all that reaches the driver. There,
lengths are taken in classes of `GRAIN` tokens, and a linear program finds how often to use which
pattern of classes; columns (patterns) come from a knapsack dynamic program over the dual prices.
The program's solution is rounded down. Patterns that would leave more than `SLACK` tokens empty,
and what rounding leaves, are cut to fill: their pieces are laid end to end and cut at every
`LENGTH` tokens; the rest below one sequence is cut into powers of two, which need no padding.

Pieces are ranked within their length by counts per bucket of hashed ids, so that no length, however
frequent, is ranked in one task. A piece's length and rank give its place by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.native import row_id

LENGTH = 2048
GRAIN = 8
SLACK = 8
#: Rounds of column generation, per class of lengths; each improves the solution.
ROUNDS = 24
BUCKET_ROWS = 50_000
#: Bytes of token ids that a task hands over at a time.
OUT_BYTES = 1 << 21


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str):
    """Token ids of a text as the vocabulary's library gives them.

    The rank file holds the same vocabulary for a faster library, used for texts on whose splitting
    both agree: Latin-1 characters and no name of a special token. It gives up on runs of very many
    blanks; such texts go to the vocabulary's library too.
    """
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = None  # loaded for the first text that needs it
    with open(vocabulary, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(ranks, "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
    )

    def encode(text: str) -> np.ndarray:
        nonlocal slow
        try:
            text.encode("latin-1")
            plain = not any(name in text for name in special)
        except UnicodeEncodeError:
            plain = False
        if plain:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(vocabulary)
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def _tokenizer(vocabulary: str, ranks: str, end: int, length: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        for batch in batches:
            keys = (batch.column("doc_id"), batch.column("rid"))
            rows, starts, totals, ids = [], [], [], []
            size = 0
            for i, text in enumerate(batch.column("text")):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for a in range(0, len(tokens), length):
                    rows.append(i)
                    starts.append(a)
                    totals.append(len(tokens))
                    ids.append(tokens[a : a + length].tobytes())
                size += 4 * len(tokens)
                if size >= OUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(k.take(pa.array(rows, pa.int64())) for k in keys),
                            pa.array(starts, pa.int64()),
                            pa.array(totals, pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "rid", "start", "doc_tokens", "ids"],
                    )
                    rows, starts, totals, ids, size = [], [], [], [], 0
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return tokenise


def pieces(
    documents: DataFrame, vocabulary: str, ranks: str, end: int = 1, length: int = LENGTH
) -> DataFrame:
    """(doc_id, rid, start, doc_tokens, ids, length, crc) of every piece of every document.

    ids are little-endian 32-bit numbers, crc their checksum.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    cut = documents.select("doc_id", row_id().alias("rid"), "text").mapInArrow(
        _tokenizer(vocabulary, ranks, end, length),
        f"doc_id {id_type}, rid long, start long, doc_tokens long, ids binary",
    )
    return cut.withColumns(
        {"length": (F.octet_length("ids") / 4).cast("int"), "crc": F.crc32("ids")}
    )


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes 1..len(prices) with a sum of at most `capacity`."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        sizes = min(room, len(prices))
        values = prices[:sizes] + best[room - sizes : room][::-1]
        k = int(values.argmax())
        if values[k] > best[room - 1] + 1e-12:
            best[room], taken[room] = values[k], k + 1
        else:
            best[room], taken[room] = best[room - 1], 0
    pattern, room = np.zeros(len(prices), dtype=np.int64), capacity
    while room > 0:
        size = taken[room]
        if size:
            pattern[size - 1] += 1
        room -= size or 1
    return float(best[capacity]), pattern


def patterns(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """(pattern, use) of a solution of the linear program, by the revised simplex method.

    demand[s - 1] is the number of pieces of size s. The first basis packs each size alone.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand[sizes - 1]
    whole = float(sizes @ demand[sizes - 1]) / capacity
    for _ in range(rounds * m):
        if use.sum() <= whole * 1.002:
            break
        duals = inverse.sum(axis=0)
        prices = np.zeros(int(sizes.max()))
        prices[sizes - 1] = np.maximum(duals, 0)
        value, pattern = knapsack(prices, capacity)
        if value <= 1 + 1e-9:
            break
        column = pattern[sizes - 1].astype(float)
        change = inverse @ column
        rising = change > 1e-9
        ratio = np.full(m, np.inf)
        ratio[rising] = use[rising] / change[rising]
        leaving = int(ratio.argmin())
        step = ratio[leaving]
        use = np.maximum(use - step * change, 0)
        use[leaving] = step
        basis[:, leaving] = column
        row = inverse[leaving] / change[leaving]
        inverse -= np.outer(change, row)
        inverse[leaving] = row
    found = []
    for k in range(m):
        full = np.zeros(len(demand), dtype=np.int64)
        full[sizes - 1] = basis[:, k].round().astype(np.int64)
        found.append((full, float(use[k])))
    return found


def places(histogram: dict[int, int], length: int = LENGTH, grain: int = GRAIN, slack: int = SLACK):
    """Where pieces go, by length and rank within the length.

    Returns rows (length, low, high, first, per, base, order) for ranks in [low, high): piece `rank`
    belongs to sequence base + (rank + first) // per, after pieces of lower `order`; and rows
    (length, low, at) of the ranks from `low` on that are laid end to end from position `at`; and
    the number of sequences before these; and their total.
    """
    classes = -(-length // grain)
    demand = np.zeros(classes, dtype=np.int64)
    by_class: dict[int, list[int]] = {}
    for size in sorted(histogram):
        demand[-(-size // grain) - 1] += histogram[size]
        by_class.setdefault(-(-size // grain), []).append(size)
    whole = demand[-1]
    partial = demand.copy()
    partial[-1] = 0
    solution = patterns(partial, classes)
    solution.append((np.eye(classes, dtype=np.int64)[-1], float(whole)))
    units = np.arange(1, classes + 1)
    ordered = sorted(solution, key=lambda x: (-int(units @ x[0]), x[0].tolist()))
    used = np.zeros(classes, dtype=np.int64)
    rows, sequences = [], 0
    for pattern, use in ordered:
        if (classes - int(units @ pattern)) * grain > slack:
            continue
        held = np.flatnonzero(pattern)
        times = int(min([use + 1e-6, *((demand[held] - used[held]) // pattern[held])]))
        if times < 1:
            continue
        for order, c in enumerate(held):
            low = int(used[c])
            high = low + times * int(pattern[c])
            used[c] = high
            rows += _by_length(by_class[c + 1], histogram, low, high, int(pattern[c]), sequences, order)
        sequences += times
    tail, at = [], 0
    for c, sizes in by_class.items():
        before = 0
        for size in sizes:
            low = min(max(int(used[c - 1]) - before, 0), histogram[size])
            if low < histogram[size]:
                tail.append((size, low, at))
                at += size * (histogram[size] - low)
            before += histogram[size]
    return rows, tail, sequences, at


def _by_length(sizes, histogram, low, high, per, base, order):
    """Ranks [low, high) of a class as ranks of the lengths in it."""
    before, out = 0, []
    for size in sizes:
        a, b = max(low - before, 0), min(high - before, histogram[size])
        if a < b:
            out.append((size, a, b, before - low, per, base, order))
        before += histogram[size]
    return out


def _ranked(cut: DataFrame, rows: int) -> DataFrame:
    """Rank of each piece within its length, from 0."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("rid", "start"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("rid", "start")
    return (
        keyed.withColumn("nth", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("nth") + F.col("offset"))
        .drop("bucket", "nth", "offset")
    )


def _tail_cuts(total: int, length: int) -> list[int]:
    """Positions that part the last, incomplete stretch into powers of two, largest first."""
    at, out = total - total % length, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return out


def pack(
    documents: DataFrame, vocabulary: str, ranks: str, end: int = 1, length: int = LENGTH
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `vocabulary` and `ranks` are paths on every executor. A document is its token ids and `end`;
    a null or empty text is `end` alone. Pieces of a document do not overlap and leave nothing
    out. Rows without id and repeated rows are packed like any other; which of several equal pieces
    takes which place is open, and changes nothing. Without documents there are no pieces. Other
    columns of the input are not read.
    """
    spark = documents.sparkSession
    cut = stage(pieces(documents, vocabulary, ranks, end, length), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, tail, sequences, total = places(histogram, length)
    slots = spark.createDataFrame(
        rows, "length int, low long, high long, first long, per long, base long, order int"
    )
    ends = spark.createDataFrame(tail, "length int, low long, at long")
    ranked = stage(
        _ranked(cut.drop("ids"), sum(histogram.values())), "ranked-pieces"
    )
    # Both tables have one row per length and pattern, a number that does not depend on the corpus.
    in_slot = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    packed = (
        ranked.join(F.broadcast(slots), "length")
        .filter(in_slot)
        .select(
            "doc_id",
            "start",
            "length",
            F.col("crc").alias("ids_crc32"),
            "doc_tokens",
            (F.col("base") + F.floor((F.col("rank") + F.col("first")) / F.col("per"))).alias("sequence_id"),
            F.struct("order", "rank", "length").alias("turn"),
        )
    )
    row = Window.partitionBy("sequence_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.withColumn("offset", F.coalesce(F.sum("length").over(row), F.lit(0).cast("long")))
    laid = (
        ranked.join(F.broadcast(ends), "length")
        .filter("rank >= low")
        .withColumn("at", F.col("at") + (F.col("rank") - F.col("low")) * F.col("length"))
    )
    return packed.drop("turn").unionByName(_cut_to_fill(laid, cut, sequences, total, length))


def _cut_to_fill(laid: DataFrame, cut: DataFrame, sequences: int, total: int, length: int) -> DataFrame:
    """Pieces laid end to end, cut at the ends of sequences."""
    whole = total - total % length
    marks = F.array(*[F.lit(x).cast("long") for x in _tail_cuts(total, length)]).cast("array<long>")
    stop = F.col("at") + F.col("length")
    here = F.sequence(F.floor(F.col("at") / length), F.floor((stop - 1) / length))
    bounds = F.concat(F.transform(here, lambda k: k * length), marks)
    points = F.array_sort(
        F.array_distinct(
            F.concat(F.array("at"), F.filter(bounds, lambda b: (b > F.col("at")) & (b < stop)))
        )
    )
    parts = (
        laid.withColumn("points", points)
        .select("*", F.posexplode("points").alias("i", "from"))
        .withColumn("to", F.coalesce(F.try_element_at("points", F.col("i") + 2), stop))
    )
    in_tail: Column = F.size(F.filter(marks, lambda b: b <= F.col("from")))
    tail_start = F.array_max(F.filter(marks, lambda b: b <= F.col("from")))
    in_whole = F.col("from") < whole
    placed = parts.withColumns(
        {
            "sequence_id": F.lit(sequences)
            + F.when(in_whole, F.floor(F.col("from") / length)).otherwise(whole // length + in_tail - 1),
            "offset": F.when(in_whole, F.col("from") % length).otherwise(F.col("from") - tail_start),
            "part": (F.col("to") - F.col("from")).cast("int"),
            "skip": (F.col("from") - F.col("at")).cast("int"),
        }
    )
    columns = [
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        F.col("part").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    ]
    kept = placed.filter("part = length").select(*columns)
    split = stage(
        placed.filter("part < length").select(
            "doc_id", "rid", "start", "doc_tokens", "sequence_id", "offset", "part", "skip"
        ),
        "cut-pieces",
    )
    ids = cut.select("rid", "start", "ids").join(
        split.select("rid", "start").distinct(), ["rid", "start"], "left_semi"
    ).dropDuplicates(["rid", "start"])
    own = F.substring("ids", F.col("skip") * 4 + 1, F.col("part") * 4)
    again = split.join(ids, ["rid", "start"]).withColumn("crc", F.crc32(own))
    return kept.unionByName(again.select(*columns))
