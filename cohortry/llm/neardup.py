"""Near-duplicate groups by an inverted join over MinHash coordinates.

1. Every document becomes the set of its distinct word shingles, a key of that set, and a signature
   of `COORDINATES` minima. Documents with equal sets are one class from here on, so exact copies
   cost nothing further however many there are.
2. Classes are posted under (coordinate, value) pairs. A pair of classes at the wanted similarity
   agrees on at least `matches` coordinates but for a chance of `MISS`, so it shares a pair among
   the rarest `COORDINATES - matches + 1` of either: only this prefix is posted. Pairs that only
   one class has are skipped, and frequent pairs, which boilerplate makes, sort behind the prefix.
3. Candidates of a posting list are counted on whole signatures, and those above the match
   threshold are confirmed on the full sets.

A list of n classes is not expanded into n * n pairs. It is first compared with a few of its members
only. Members found to be in one component are not compared again; of the pairs across components,
those are that share one of their rarest shingles early enough, and enough of the rarest ones, for
the wanted similarity to be possible at all (these bounds are exact). Copies that edits have moved too
far from everything thus meet nothing, however large their list. No pair that could join two
components is left out, so the components are those of all links between candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.native import free_name, row_id
from cohortry.llm.text import Texts, mix, one_run, slices, windows

SHINGLE = 5
PERCENT = 85
COORDINATES = 32
MISS = 1e-6
#: Members of a list that all others are compared with first.
HUBS = 2
#: Shingles, beyond those that must hold a common one, by which pairs are sifted.
SIFTED = 96

_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = mix(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def match_threshold(percent: int) -> int:
    """Most coordinates that a pair at `percent` similarity agrees on but for a chance of MISS."""
    p, n, below = percent / 100, COORDINATES, 0.0
    for k in range(n + 1):
        below += comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISS:
            return max(1, k)
    return n


def _sets(texts: Texts, width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    words = texts.words(fold=True)
    runs, bounds = windows(words.hashes, words.bounds, width)
    out = []
    for i in range(len(texts)):
        if bounds[i + 1] > bounds[i]:
            out.append(np.unique(runs[bounds[i] : bounds[i + 1]]))
        else:
            own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            out.append(np.array([one_run(own)] if len(own) else [], dtype=np.uint64))
    return out


def _keys(sets: list[np.ndarray], bounds: np.ndarray) -> pa.Array:
    """128-bit key of each set; null for an empty one."""
    values = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
    halves = []
    for seed in (0x51ED270B, 0x2545F491):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(seed)))])
        halves.append(mix(np.diff(sums[bounds])))
    raw = np.stack(halves, axis=1).tobytes()
    return pa.array(
        [raw[16 * i : 16 * i + 16] if len(s) else None for i, s in enumerate(sets)], pa.binary()
    )


def _list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()), pa.array(values.view(np.int64), pa.int64())
    )


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                sets = _sets(texts, width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                values = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
                full = sizes > 0
                minima = np.empty((int(full.sum()), COORDINATES), dtype=np.uint64)
                if len(values):
                    for k in range(COORDINATES):
                        minima[:, k] = np.minimum.reduceat(
                            (values ^ _XOR[k]) * _ODD[k], bounds[:-1][full]
                        )
                yield pa.RecordBatch.from_arrays(
                    [
                        texts.batch.column("doc_id"),
                        texts.batch.column("rid"),
                        _keys(sets, bounds),
                        pa.array(sizes),
                        _list_array(
                            minima.ravel(),
                            np.concatenate([[0], np.cumsum(full * COORDINATES)]),
                        ),
                    ],
                    ["doc_id", "rid", "key", "n_shingles", "sig"],
                )

    return sign


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                sets = _sets(texts, width)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                values = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
                yield pa.RecordBatch.from_arrays(
                    [_keys(sets, bounds), _list_array(values, bounds)], ["key", "shingles"]
                )

    return make


def _with_rid(documents: DataFrame) -> DataFrame:
    """doc_id, text, and a number to find a row again by; rows of equal id and text share it."""
    return documents.select("doc_id", "text", row_id().alias("rid"))


def signatures(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, rid, key, n_shingles, sig for each row; key null and sig empty without words."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return _with_rid(documents).mapInArrow(
        _signer(width),
        f"doc_id {id_type}, rid long, key binary, n_shingles long, sig array<long>",
    )


def posting_lists(classes: DataFrame, matches: int) -> DataFrame:
    """(code, key): classes under the prefix of their rarest shared (coordinate, value) pairs."""
    postings = classes.select("key", F.posexplode("sig").alias("k", "v")).select(
        "key", F.xxhash64("k", "v").alias("code")
    )
    shared = postings.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")
    # The coordinates a class shares with nobody come first in its prefix, and lead to nobody.
    room = F.lit(COORDINATES - matches + 1 - COORDINATES) + F.size("codes")
    return (
        postings.join(shared, "code")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("codes"))
        .filter(room > 0)
        .select("key", F.explode(F.slice("codes", F.lit(1), room)).alias("c"))
        .select(F.col("c.code").alias("code"), "key")
    )


def _agreements(a: str, b: str) -> Column:
    same = [
        (F.col(f"{a}.sig")[k] == F.col(f"{b}.sig")[k]).cast("int") for k in range(COORDINATES)
    ]
    return sum(same[1:], same[0])


def confirmed(
    pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, matches: int
) -> DataFrame:
    """The pairs (a, b) that agree on enough coordinates and whose full sets are similar enough."""
    left, right = classes.alias("l"), classes.alias("r")
    near = (
        pairs.join(left, F.col("a") == F.col("l.key"))
        .join(right, F.col("b") == F.col("r.key"))
        .filter(
            (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n"))
            & (_agreements("l", "r") >= matches)
        )
        .select("a", "b")
    )
    common = F.size(F.array_intersect("s.shingles", "t.shingles"))
    union = F.size("s.shingles") + F.size("t.shingles") - common
    return (
        near.join(sets.alias("s"), F.col("a") == F.col("s.key"))
        .join(sets.alias("t"), F.col("b") == F.col("t.key"))
        .filter(100 * common >= percent * union)
        .select("a", "b")
    )


def lowest_reachable(edges: DataFrame) -> DataFrame:
    """(v, label): for every end of the edges (a, b), the least vertex that it is connected with.

    Each round takes the least label of the neighbours and then the label of that label, so chains
    shrink by halves; labels are written each round, which also cuts the lineage.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "edges",
    )
    labels = stage(
        both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")),
        "labels",
    )
    while True:
        seen = (
            both.join(labels, F.col("b") == F.col("v"))
            .groupBy("a")
            .agg(F.min("label").alias("low"))
        )
        lower = labels.join(seen, F.col("v") == F.col("a")).select(
            "v", F.col("label").alias("old"), F.least("label", "low").alias("label")
        )
        jump = lower.select(F.col("v").alias("at"), F.col("label").alias("next"))
        labels = stage(
            lower.join(jump, F.col("label") == F.col("at"), "left").select(
                "v", "old", F.least("label", "next").alias("label")
            ),
            "labels",
        )
        if labels.filter("old != label").isEmpty():
            return labels.select("v", "label")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def early_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(s, rank, key, n, size, rarest): the rarest shingles of each member, rank 0 first, as far as
    they can be the first one common with a similar member. Those that only one member has are left
    out. `rarest` has its `size` rarest ones, shortened, less those it has alone."""
    shingles = sets.join(members.select("key"), "key").select("key", F.explode("shingles").alias("s"))
    shared = shingles.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    ordered = (
        shingles.join(shared, "s")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("shared"))
        .join(members.select("key", "n"), "key")
    )
    alone = F.col("n") - F.size("shared")
    size = F.least(F.col("n"), F.floor(F.col("n") * (100 - percent) / 100) + 1 + SIFTED)
    rarest = F.slice("shared", F.lit(1), F.greatest(F.col("size") - F.col("alone"), F.lit(0)).cast("int"))
    short = F.transform(rarest, lambda x: F.hash(x["s"]))
    return (
        ordered.withColumns({"alone": alone, "size": size})
        .withColumn("rarest", short)
        .select("key", "n", "alone", "size", "rarest", F.posexplode("shared").alias("k", "x"))
        .withColumn("rank", F.col("alone") + F.col("k"))
        .filter(100 * (F.col("n") - F.col("rank")) >= percent * F.col("n"))
        .select("key", "n", "size", "rarest", "rank", F.col("x.s").alias("s"))
    )


class _Grouping:
    """Components of the classes in some posting lists."""

    def __init__(self, lists: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, confirm):
        self.lists = lists
        self.classes = classes
        self.sets = sets
        self.percent = percent
        self.confirm = confirm
        self.components = lists.select("key").distinct().withColumn("component", F.col("key"))

    def open_lists(self, lists: DataFrame, name: str, hubs: int) -> DataFrame:
        """Rows of lists with several components, each with some members of its list."""
        posted = lists.join(self.components, "key")
        picked = [F.min_by(F.struct("key", "component"), F.xxhash64("key", F.lit(k))) for k in range(hubs)]
        heads = (
            posted.groupBy(name)
            .agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.array(*picked).alias("hubs"),
            )
            .filter("low != high")
            .select(name, "hubs")
        )
        return posted.join(heads, name)

    def test(self, pairs: DataFrame) -> None:
        """Confirm pairs and merge the components they link."""
        links = stage(self.confirm(pairs.distinct()), "links")
        ends = links
        for end in ("a", "b"):
            ends = ends.join(
                self.components.select(
                    F.col("key").alias(end), F.col("component").alias(f"{end}_in")
                ),
                end,
            )
        joined = lowest_reachable(
            ends.filter("a_in != b_in").select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
        )
        self.components = stage(
            self.components.join(joined, F.col("component") == F.col("v"), "left").select(
                "key", F.coalesce("label", "component").alias("component")
            ),
            "components",
        )

    def test_hubs(self) -> None:
        found = self.open_lists(self.lists, "code", HUBS)
        hubs = found.withColumn("hub", F.explode(F.array_distinct("hubs")))
        apart = F.col("component") != F.col("hub.component")
        self.test(hubs.filter(apart).select(*_ordered(F.col("key"), F.col("hub.key"))))

    def test_across(self) -> None:
        """All pairs across components whose early shingles allow for a link."""
        members = stage(
            self.open_lists(self.lists, "code", 1)
            .select("key")
            .distinct()
            .join(self.classes.select("key", "n"), "key"),
            "members",
        )
        early = stage(early_shingles(members, self.sets, self.percent), "early-shingles")
        known = stage(
            self.open_lists(early, "s", 1)
            .withColumn("main", F.col("hubs")[0]["component"])
            .drop("hubs"),
            "known",
        )
        rest = known.filter("component != main").select(
            *[F.col(c).alias(f"x_{c}") for c in ("s", "key", "component", "n", "rank", "size", "rarest")]
        )
        both = self.percent * (F.col("n") + F.col("x_n"))
        # A similar pair lacks at most so many of either's shingles, so of its rarest ones too.
        lacking = (100 + self.percent) * F.greatest("n", "x_n") - both
        overlap = F.size(F.array_intersect("rarest", "x_rarest"))
        across = known.join(
            rest,
            (F.col("s") == F.col("x_s"))
            & (F.col("component") != F.col("x_component"))
            & ((F.col("component") == F.col("main")) | (F.col("key") < F.col("x_key")))
            & ((100 + self.percent) * (F.col("n") - F.col("rank")) >= both)
            & ((100 + self.percent) * (F.col("x_n") - F.col("x_rank")) >= both)
            & ((100 + self.percent) * (F.least("size", "x_size") - overlap) <= lacking),
        )
        self.test(across.select(*_ordered(F.col("key"), F.col("x_key"))))

    def run(self) -> DataFrame:
        self.test_hubs()
        self.test_across()
        return self.components


def _grouped(documents: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (key, first) of every class: the row that its group is named
    after, as a struct of doc_id (nulls last) and rid."""
    matches = match_threshold(percent)
    rows = stage(signatures(documents, width), "signatures")
    by_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = stage(
        rows.filter("n_shingles > 0")
        .groupBy("key")
        .agg(
            F.max("n_shingles").alias("n"),
            F.min(by_id).alias("first"),
            F.any_value("sig").alias("sig"),
        ),
        "classes",
    )
    lists = stage(posting_lists(classes, matches), "postings")
    wanted = classes.join(lists.select("key").distinct(), "key", "left_semi").select("first.rid")
    found = (
        _with_rid(documents)
        .join(wanted.distinct(), "rid", "left_semi")
        .select("text")
        .mapInArrow(_set_maker(width), "key binary, shingles array<long>")
    )
    sets = stage(
        found.groupBy("key").agg(F.any_value("shingles").alias("shingles")), "sets"
    )
    signed = classes.select("key", "n", "sig")
    components = _Grouping(
        lists,
        classes,
        sets,
        percent,
        lambda pairs: confirmed(pairs, signed, sets, percent, matches),
    ).run()
    labelled = classes.select("key", "first").join(components, "key", "left").select(
        "key", "first", F.coalesce("component", "key").alias("component")
    )
    lowest = labelled.groupBy("component").agg(F.min("first").alias("first"))
    return rows, labelled.drop("first").join(lowest, "component").select("key", "first")


def near_duplicates(
    documents: DataFrame, percent: int = PERCENT, width: int = SHINGLE
) -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id and kept.

    Two documents are linked if 100 * common shingles >= `percent` * all their shingles. component_id
    is the smallest doc_id reachable over links. Texts without words (null, empty, white space only)
    have no shingles and are linked with nothing. A document without id takes part by its text; its
    component_id is the smallest id of the others, or null where there is none, and it is kept only
    in that case. Repeated rows are copies of each other: each keeps its row, and rows that share
    the smallest doc_id are all kept. Empty tables give an empty result. Other columns are ignored.
    """
    rows, groups = _grouped(documents, percent, width)
    of_class = groups.select("key", F.col("first.doc_id").alias("component_id"))
    linked = rows.select("doc_id", "n_shingles", "key").join(of_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_copies(
    documents: DataFrame, percent: int = PERCENT, width: int = SHINGLE
) -> DataFrame:
    """One row of each group of linked documents, all columns.

    The row with the smallest doc_id stays, one without id only if the whole group has none; of
    repeated rows (equal id and text) one. Rows without words are linked with nothing and stay.
    """
    rid = free_name(documents, "__rid")
    rows, groups = _grouped(documents, percent, width)
    of_row = rows.join(groups, "key").groupBy("rid").agg(
        F.any_value(F.col("rid") == F.col("first.rid")).alias("stays"), F.count("*").alias("n")
    )
    marked = stage(of_row.filter("NOT stays OR n > 1").withColumnRenamed("rid", rid), "copies")
    known = documents.withColumn(rid, row_id())
    single = known.join(marked, rid, "left_anti").select(known.columns)
    repeated = known.join(marked.filter("stays"), rid, "left_semi").select(known.columns)
    return single.unionByName(repeated.dropDuplicates([rid])).drop(rid)
