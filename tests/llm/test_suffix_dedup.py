"""Strings that occur more than once, against plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from cohortry.llm import queries, suffix_dedup
from cohortry.llm.suffix_dedup import Collection, without_repeats

ROOT = "/root/testdata/sf0.001"


def plain(texts, width):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + width]) for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[hash(b[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def held(spark, texts, width, **settings):
    rows = [(k if k % 7 else None, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hull string, rid long")
    got = without_repeats(docs, width, with_text=True, **settings).collect()
    want = plain(texts, width)
    assert sorted(
        (r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in got
    ) == sorted((i or -1, *w, hashlib.sha256(w[3]).hexdigest()) for (i, *_), w in zip(rows, want))


@pytest.mark.parametrize("letters", [b"ab", b"abcd", bytes([0, 97, 253])])
def test_order_of_a_collection(letters):
    """Shared prefixes of the built order against all pairs of suffixes."""
    rnd = random.Random(5)
    for _ in range(12):
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(1, 7))]
        ends = [s[i:] for s in strings for i in range(len(s))]
        want = []
        for a, x in enumerate(ends):
            pairs = ([i for i in range(min(len(x), len(y))) if x[i] != y[i]] or [min(len(x), len(y))] for b, y in enumerate(ends) if a != b)
            want.append(min(max((p[0] for p in pairs), default=0), 6))
        assert Collection(strings, 6).shared().tolist() == want


def odd_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(30)}é " for _ in range(400)]
    line = "".join(words[:9])
    texts = ["", None, "short", " ", "a" * 300, "ab" * 200, line * 3, "日本" * 40]
    texts += [line + "".join(rnd.choices(words, k=8)) + line[5:] for _ in range(12)]
    whole = "".join(rnd.choices(words, k=60))
    texts += [whole, whole, whole[:90] + "X" + whole[91:], whole[37:], whole[:-20] + "tail"]
    return texts + ["".join(rnd.choices(words, k=rnd.randint(5, 80))) for _ in range(10)]


def test_odd_texts(spark):
    held(spark, odd_texts(1), 24, anchor=8)
    held(spark, odd_texts(2), 24, anchor=24, shard_bytes=500)


def test_large_groups_are_cut(spark):
    held(spark, odd_texts(3), 24, anchor=8, group=2, shard_bytes=1000)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    held(spark, odd_texts(4), 24, anchor=8)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(docs).count() == 0


def test_registered_query(spark):
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    want = plain([r["text"] for r in rows], 200)
    got = {r["doc_id"]: r for r in queries.op13_suffix_dedup(spark, ROOT).collect()}
    assert len(got) == len(rows) and any(w[1] for w in want)
    for r, (size, removed, spans, kept) in zip(rows, want):
        mine = got[r["doc_id"]]
        assert (mine["n_bytes"], mine["n_removed"], mine["n_spans"]) == (size, removed, spans)
        assert mine["kept_sha256"] == hashlib.sha256(kept).hexdigest()
