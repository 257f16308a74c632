"""Ranked search against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from cohortry.llm import queries, search

ROOT = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(FOLD)))


def plain(docs, items, best):
    own = [(i, terms(t)) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    total, count = sum(sizes), sum(s > 0 for s in sizes)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (doc, c), n in zip(own, sizes):
            m = 100 - 25 + (25 * n * count) // max(total, 1)
            score = 0
            for w, times in terms(text).items():
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1)))
                    score += times * weight * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:best])]
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def held(spark, docs, items, best):
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id long, rank long")
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in search.search(table, asked, best).collect()]
    assert sorted(got, key=key) == sorted(plain(docs, items, best), key=key)


def random_texts(seed, count):
    rnd = random.Random(seed)
    words = ["the", "The", "né", "日本", "x1"] + [f"w{i}" for i in range(60)]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [" ".join(rnd.choices(words, weights, k=rnd.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize("block", [1 << 19, 60])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_WORDS", block)
    docs = [(i, t) for i, t in enumerate(random_texts(1, 150))]
    docs += [(None, "the w3"), (None, None), (3, ""), (4, "?! -"), (7, docs[7][1]), (7, docs[7][1]), (500, "w3 " * 900)]
    items = [(1, "the THE w1 w1 w30,w31"), (1, "the THE w1 w1 w30,w31"), (1, "w5"), (2, None), (3, ""), (4, "absent"), (None, "né w59 日本")]
    items += [(10 + k, t) for k, t in enumerate(random_texts(2, 12))]
    held(spark, docs, items, 5)


def test_ties_and_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "BATCH_TERMS", 3)
    held(spark, [(9 - i, "same words here") for i in range(9)] + [(20, "words")], [(1, "same here"), (2, "words")], 4)


def test_long_text_is_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE_BYTES", 64)
    monkeypatch.setattr(search, "BLOCK_WORDS", 50)
    held(spark, [(1, " ".join(random_texts(3, 30))), (2, "w1 " + "z" * 500 + " w2")], [(1, "w1 w2 w9"), (2, "z" * 500)], 3)


def test_a_task_holds_one_block(spark, monkeypatch):
    """However many blocks a task reads, they come to it one at a time, and documents few at a time."""

    def alone(made):
        def checked(batches):
            for batch in batches:
                assert batch.num_rows == 1
                yield batch

        return lambda *given: lambda batches: made(*given)(checked(batches))

    for name in ("_counter", "_viewer", "_searcher"):
        monkeypatch.setattr(search, name, alone(getattr(search, name)))
    blocks = search._blocks
    monkeypatch.setattr(search, "_blocks", alone(lambda: blocks)())
    monkeypatch.setattr(search, "BLOCK_WORDS", 60)
    monkeypatch.setattr(search, "PIECE_BYTES", 100, raising=False)
    monkeypatch.setattr(search, "BATCH_BYTES", 1, raising=False)
    docs = list(enumerate(random_texts(5, 60)))
    cloudpickle.register_pickle_by_value(search)  # else the tasks have the module as it is on disk
    try:
        held(spark, docs, [(k, t) for k, t in enumerate(random_texts(6, 8))], 5)
    finally:
        cloudpickle.unregister_pickle_by_value(search)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search.search(docs, items).count() == 0
    full = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert search.search(full, items.limit(0)).count() == 0


def test_chain_bounds():
    """No document brings more than the bound of any beginning of the chain."""
    rnd = np.random.default_rng(4)
    for _ in range(50):
        table = rnd.integers(0, 9, (30, 6)) * (rnd.random((30, 6)) < 0.4)
        joint = np.array([(table[:, i] + table[:, i + 1])[(table[:, i] > 0) & (table[:, i + 1] > 0)].max(initial=0) for i in range(5)])
        bounds = search.chain_bounds(table.max(0), joint)
        sums = np.concatenate([[0], np.cumsum(table.max(0))])
        assert all(table[:, :i].sum(1).max() <= bounds[i] <= sums[i] for i in range(7))


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in queries.op11_ranked_search(spark, ROOT).collect()]
    assert sorted(got) == sorted(plain(docs, items, 20))
