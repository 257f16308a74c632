"""Prefix trie of conversations, with totals over every subtree.

A conversation's turns are numbered, and each of its prefixes gets a hash of 128 bits, by running
values over the table sorted by conversation: every partition runs on its own, and the few
conversations that go on from one partition to the next get what the earlier ones hold. So a
conversation of any length is dealt to many tasks. Equal prefixes are one node.

Totals go up the trie by time-forward processing. Nodes are sorted in reverse level order; a queue
holds the totals sent to nodes that are still to come; each node takes what was sent to it, adds its
own, and sends the sum to its parent, which comes later. A queue that grows large goes to a file in
sorted runs. Nodes with more than `SHARD_ROWS` turns below them form the top of the trie. Every
subtree that hangs below the top lies in one shard, and shards are processed at the same time; the
top follows, from its lowest band of `BAND` levels on, with the sums of what the shard roots send.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.staging import stage

SHARD_ROWS = 1 << 18  # turns below a node that one shard takes
BAND = 1 << 16  # levels of the top that are processed together
QUEUE = 1 << 17  # waiting totals held in memory
#: Fixed value: what lies between words.
BLANKS = r"[\x20\x09-\x0D]+"
NODE = ("depth", "low", "high")

_EMPTY = hashlib.sha256(b"").hexdigest()


# Running values


def _runner(key: str, values: list[str]):
    """Adds the partition, and running place and exclusive-or of `values` within key and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place, so_far = None, 0, [np.int64(0)] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            n, at = len(keys), np.arange(len(keys))
            begin = np.maximum.accumulate(np.where(first, at, 0))
            goes_on = np.logical_or.accumulate(first) == 0  # rows of the key of the batch before
            places = at - begin + 1 + np.where(goes_on, place, 0)
            columns = [pa.array(places), pa.array(np.full(n, part, dtype=np.int32))]
            for i, name in enumerate(values):
                whole = np.bitwise_xor.accumulate(batch.column(name).to_numpy())
                before = np.where(begin > 0, whole[begin - 1], 0)
                run_values = whole ^ np.where(goes_on, so_far[i], before)
                so_far[i] = run_values[-1]
                columns.append(pa.array(run_values))
            last, place = keys[-1], int(places[-1])
            names = [*batch.schema.names, "place", "part", *(f"run_{v}" for v in values)]
            yield pa.record_batch([*batch.columns, *columns], names)

    return run


def running(ordered: DataFrame, key: str, values: list[str]) -> DataFrame:
    """`ordered`, whose partitions follow each other in order of `key`, with the place of each row
    among those of its key from 1, and run_v for each v of `values`: the exclusive-or of all up to
    the row. Key and values are numbers without nulls."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    schema = f"{kinds}, place long, part int" + "".join(f", run_{v} long" for v in values)
    local = stage(ordered.mapInArrow(_runner(key, values), schema), "running")
    names = ["place", *(f"run_{v}" for v in values)]
    ends = local.groupBy("part", key).agg(F.max_by(F.struct(*names), "place").alias("end"))
    # A key that ends a partition may go on in later ones: only such keys have several parts.
    several = ends.groupBy(key).agg(F.count("*").alias("parts")).filter("parts > 1").select(key)
    spread = stage(ends.join(several, key), "carried")
    earlier = spread.select(F.col("part").alias("from_part"), F.col(key).alias("same"), "end")
    carried = (
        spread.select("part", key)
        .join(earlier, (F.col(key) == F.col("same")) & (F.col("from_part") < F.col("part")))
        .groupBy("part", key)
        .agg(
            F.sum("end.place").alias("more_place"),
            *[F.bit_xor(f"end.run_{v}").alias(f"more_{v}") for v in values],
        )
    )
    found = local.join(stage(carried, "carry"), ["part", key], "left")
    zero = F.lit(0).cast("long")
    return found.select(
        *ordered.columns,
        (F.col("place") + F.coalesce("more_place", zero)).alias("place"),
        *[F.col(f"run_{v}").bitwiseXOR(F.coalesce(f"more_{v}", zero)).alias(f"run_{v}") for v in values],
    )


# Conversations


def _hash(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, x, y, words): turns by turn (null first), then role, then text, from 1."""
    blank = F.lit("")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.size(F.array_remove(F.split("text", BLANKS), "")).cast("long")
    return running(
        ordered.select(
            "conv_id", _hash(1, "role", "text").alias("x"), _hash(2, "role", "text").alias("y"), words.alias("words")
        ),
        "conv_id",
        [],
    )


def rebuilt_turns(turns: DataFrame, group: int = 20, choices: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of their group's first conversation, and go on
    with their own after h; h is the checksum of the id modulo `choices`.

    Gives (conv_id) of all, and their turns as (conv_id, step, x, y, words), step from 1.
    """
    checksum = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    known = own.select(
        "conv_id",
        "n",
        F.pmod(checksum, F.lit(choices)).alias("h"),
        (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"),
    )
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    plan = stage(known.join(lengths, "base", "left").select("conv_id", "h", "base", taken), "rebuilt-plan")
    rest = (
        turns.join(plan.select("conv_id", "h", "taken"), "conv_id")
        .filter("place > h")
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("step"), "x", "y", "words")
    )
    heads = turns.filter((F.col("place") < choices) & (F.pmod("conv_id", F.lit(group)) == 0)).select(
        F.col("conv_id").alias("base"), F.col("place").alias("step"), "x", "y", "words"
    )
    begun = plan.join(heads, "base").filter("step <= taken").select("conv_id", "step", "x", "y", "words")
    return plan.select("conv_id"), rest.unionByName(begun)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, low, high, parent_low, parent_high, words): each prefix by its hash."""
    order = ["conv_id", "step"]
    marked = turns.select(
        "conv_id", "step", _hash(3, "step", "x", "y").alias("a"), _hash(4, "step", "x", "y").alias("b"), "words"
    )
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    found = running(ordered, "conv_id", ["a", "b"])
    return found.select(
        "conv_id",
        F.col("step").alias("depth"),
        F.col("run_a").alias("low"),
        F.col("run_b").alias("high"),
        F.col("run_a").bitwiseXOR(F.col("a")).alias("parent_low"),
        F.col("run_b").bitwiseXOR(F.col("b")).alias("parent_high"),
        "words",
    )


# Totals


class SpillingQueue:
    """A priority queue of tuples. Beyond `most` waiting ones it is written to a file as a sorted run."""

    def __init__(self, most: int):
        self.most = most
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, object]] = []  # next of each run, by it
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            file = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, file)
            file.seek(0)
            self.heap = []
            self.spilled += 1
            heapq.heappush(self.runs, (pickle.load(file), self.spilled, file))

    def least(self) -> tuple | None:
        if self.runs and not (self.heap and self.heap[0] <= self.runs[0][0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and not (self.heap and self.heap[0] <= self.runs[0][0]):
            out, number, file = self.runs[0]
            try:
                heapq.heapreplace(self.runs, (pickle.load(file), number, file))
            except EOFError:
                heapq.heappop(self.runs)
                file.close()
            return out
        return heapq.heappop(self.heap)


TOTALS = ("n_children", "n_leaves", "saved_tokens")
_SENT = [pa.field(c, pa.int64()) for c in (*NODE, "parent_low", "parent_high", *TOTALS)]


def _time_forward(queue: int):
    """Nodes in reverse level order, with what has been sent to them so far, to their totals."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue)
        for batch in batches:
            out = []
            columns = [batch.column(f.name).to_pylist() for f in _SENT]
            for depth, low, high, parent_low, parent_high, children, leaves, saved in zip(*columns):
                me = (-depth, low, high)
                while (sent := waiting.least()) is not None and sent[:3] <= me:
                    *to, more_leaves, more_saved = waiting.pop()
                    if tuple(to) == me:  # parents of shard roots are elsewhere
                        children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                leaves = leaves or 1  # nothing below: a leaf itself
                if depth:
                    waiting.push((1 - depth, parent_low, parent_high, leaves, saved))
                out.append((depth, low, high, parent_low, parent_high, children, leaves, saved))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=pa.schema(_SENT))

    return process


_SENT_SCHEMA = ", ".join(f"{f.name} long" for f in _SENT)


def _totals(nodes: DataFrame, shard: list[Column], queue: int) -> DataFrame:
    ordered = nodes.repartition(*shard).sortWithinPartitions(F.desc("depth"), "low", "high")
    return stage(ordered.select(*[f.name for f in _SENT]).mapInArrow(_time_forward(queue), _SENT_SCHEMA), "totals")


def _with_sent(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes with the sums of what their children among `totals` send."""
    upward = totals.select(
        (F.col("depth") - 1).alias("depth"),
        F.col("parent_low").alias("low"),
        F.col("parent_high").alias("high"),
        "n_leaves",
        "saved_tokens",
    )
    sent = (
        upward.join(nodes.select(*NODE), list(NODE), "left_semi")
        .groupBy(*NODE)
        .agg(
            F.count("*").alias("more_children"),
            F.sum("n_leaves").alias("more_leaves"),
            F.sum("saved_tokens").alias("more_saved"),
        )
    )
    zero = F.lit(0).cast("long")
    return nodes.join(sent, list(NODE), "left").select(
        *NODE,
        "parent_low",
        "parent_high",
        (F.col("n_children") + F.coalesce("more_children", zero)).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
    )


def subtree_totals(
    nodes: DataFrame, paths: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND, queue: int = QUEUE
) -> DataFrame:
    """(depth, low, high, ..., n_children, n_leaves, saved_tokens) of every node.

    nodes: NODE, parent_low, parent_high, conv_id (a conversation through it), saved (its own), below
    (turns below it, at least as many as nodes). paths: conv_id, NODE, all prefixes.
    """
    zero = F.lit(0).cast("long")
    start = nodes.select(
        *NODE, "parent_low", "parent_high", "conv_id", "below",
        zero.alias("n_children"), zero.alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    top = stage(start.filter(F.col("below") > shard_rows).drop("conv_id", "below"), "top")
    # The large nodes of a path are its first ones: so many levels lie above its shard root.
    above = paths.join(top.select(*NODE), list(NODE), "left_semi").groupBy("conv_id").agg(F.count("*").alias("large"))
    has_top = not top.isEmpty()
    levels = F.coalesce("large", zero) + (1 if has_top else 0)  # the root is in the top, if there is one
    roots = paths.join(above, "conv_id", "left").filter(F.col("depth") == levels).select(
        "conv_id", F.col("low").alias("shard_low"), F.col("high").alias("shard_high")
    )
    lower = start.filter(F.col("below") <= shard_rows).join(roots, "conv_id", "left")
    done = _totals(lower, [F.coalesce("shard_low", zero), F.coalesce("shard_high", zero)], queue)
    if not has_top:
        return done
    top = stage(_with_sent(top, done), "top-sent")
    below = None
    for number in range(top.agg(F.max("depth")).first()[0] // band, -1, -1):
        inside = top.filter(F.floor(F.col("depth") / band) == number)
        below = _totals(inside if below is None else _with_sent(inside, below), [F.lit(0)], queue)
        done = done.unionByName(below)
    return done


def _end_hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node, in order, one after the other."""
    node, digest = None, None
    for batch in batches:
        out = []
        for depth, low, high, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if (depth, low, high) != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, low, high), hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
    if node:
        yield pa.record_batch([pa.array([x]) for x in (*node, digest.hexdigest())], [*NODE, "ends_sha256"])


def conversation_trie(
    conversations: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND, queue: int = QUEUE
) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their
    own. A null role or text is an empty one, and both take part in whether turns are equal. Rows
    without conv_id belong to no conversation and are left out. Conversations without any turn after
    rebuilding are members of the root only. Long texts are only hashed and counted. The ids that end
    at one node are hashed in order by one task, a row at a time. An empty table gives no rows. Other
    columns are ignored.
    """
    turns = stage(numbered_turns(conversations), "turns")
    known, rebuilt = rebuilt_turns(turns)
    paths = stage(prefixes(rebuilt), "paths")
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("n"))
    zero = F.lit(0).cast("long")
    whole = stage(known.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", zero).alias("n")), "members")
    inner = (
        paths.join(whole, "conv_id")
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            *[F.any_value(c).alias(c) for c in ("parent_low", "parent_high", "words")],
            F.sum(F.col("n") - F.col("depth")).alias("below"),
        )
    )
    root = whole.agg(
        *[zero.alias(c) for c in NODE],
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *[zero.alias(c) for c in ("parent_low", "parent_high", "words")],
        F.sum("n").alias("below"),
    ).filter("n_convs > 0")
    nodes = stage(
        inner.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes"
    )
    totals = subtree_totals(nodes, paths.select("conv_id", *NODE), shard_rows, band, queue)
    last = whole.filter("n = 0").select("conv_id", *[zero.alias(c) for c in NODE]).unionByName(
        paths.join(whole, "conv_id").filter("depth = n").select("conv_id", *NODE)
    )
    ends = (
        last.repartition(*NODE)
        .sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(_end_hasher, "depth long, low long, high long, ends_sha256 string")
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("low").alias("parent_low"),
        F.col("high").alias("parent_high"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        nodes.select(*NODE, "parent_low", "parent_high", "conv_id", "n_convs")
        .join(totals.select(*NODE, *TOTALS), list(NODE))
        .join(ends, list(NODE), "left")
        .join(parents, ["depth", "parent_low", "parent_high"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            *TOTALS,
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )
