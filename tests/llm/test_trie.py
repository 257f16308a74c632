"""The trie of conversations against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortry.llm import queries, trie

ROOT = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % 20, [])[:h] + mine[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own_saved
    return {
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    }


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows(seed):
    """Few different turns, so conversations branch and repeat; nulls, ties, repeats, a long one."""
    rnd = random.Random(seed)
    texts = ["", None, "a b\tc", "é ü", "one two three", "x " * 50]
    rows = []
    for c in [*range(0, 45), 61, 62, 100, 120]:
        for turn in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, rnd.choice([None, turn, turn, 2]), rnd.choice(["u", "u", None]), rnd.choice(texts)))
    rows += [(7, 1, "u", "a b\tc")] * 3 + [(None, 1, "u", "lost"), (None, None, None, None)]
    rows += [(200, k, "u", "same") for k in range(120)] + [(201, k, "u", "same") for k in range(119)] + [(202, k, "u", "same") for k in range(3)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows(3)


@pytest.fixture(scope="module")
def table(spark, rows):
    extra = [(*r, 5, "x") for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, depth long, part string")


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 40}, {"shard_rows": 6, "band": 9, "queue": 3}, {"shard_rows": 0}])
def test_odd_rows(table, rows, settings):
    """All in shards; with a top; a top in bands and spilling queues; everything in the top."""
    assert found(trie.conversation_trie(table, **settings)) == plain(rows)


def test_running_values_go_on_over_partitions(spark):
    keys = [1] * 5 + [2] * 90 + [3] * 5
    rows = spark.createDataFrame([(k, i, i * 7919 % 64) for i, k in enumerate(keys)], "k long, i long, v long")
    ordered = rows.repartitionByRange(7, "k", "i").sortWithinPartitions("k", "i")
    got = sorted((r["i"], r["place"], r["run_v"]) for r in trie.running(ordered, "k", ["v"]).collect())
    for i, place, xor in got:
        first = keys.index(keys[i])
        want = 0
        for j in range(first, i + 1):
            want ^= j * 7919 % 64
        assert (place, xor) == (i - first + 1, want)


def test_queue_spills_in_order():
    rnd = random.Random(2)
    queue, items = trie.SpillingQueue(10), [(rnd.randrange(50), k) for k in range(300)]
    for x in items[:200]:
        queue.push(x)
    got = [queue.pop() for _ in range(50)]
    for x in items[200:]:
        queue.push(x)
    rest = []
    while queue.least() is not None:
        rest.append(queue.pop())
    assert queue.spilled > 5 and got == sorted(items[:200])[:50]
    assert rest == sorted(set(items) - set(got))


def test_empty_table(table):
    assert trie.conversation_trie(table.limit(0)).count() == 0
    assert trie.conversation_trie(table.filter(F.col("conv_id").isNull())).count() == 0


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_conversation_trie(spark, ROOT)) == plain(rows)
