"""Quality rules: a few base measures, and a log-likelihood ratio of hashed word n-grams.

Single words and pairs of neighbouring words are hashed into a fixed number of buckets. Two
multinomials over these buckets are compared: one of trusted documents, one of the whole corpus.
The mean log ratio per n-gram says whether a document reads like the trusted ones.

A quarter of all ids, by hash, calibrates. The trusted multinomial is fitted on a sample of at most
`TRUSTED` labelled ids of the other three quarters (a documented bound), found by a top-k of hashed
ids; only this list is broadcast, so the corpus is read where it lies and its text is never shuffled.
The threshold comes from every trusted labelled document of the calibrating quarter, however many: an
exact low quantile of their scores less a margin. The raw multinomial counts every document. What
reaches the driver is one pair of counts per bucket, and the scores at two ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.ranks import keys_at_ranks
from cohortry.functions.staging import stage
from cohortry.llm.text import Texts, mix, slices, windows

BUCKETS = 1 << 16
TRUSTED = 20_000
#: Pseudo-counts of the raw multinomial in the trusted one, per bucket.
PRIOR = 1.0
#: A document is rejected whose score is below this quantile of the calibration scores less the
#: margin (nats per n-gram).
QUANTILE = 0.001
MARGIN = 0.04
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of neighbouring words."""
    words = texts.words(fold=False)
    pairs, bounds = windows(words.hashes, words.bounds, 2)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    grams = np.concatenate([words.hashes, pairs])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([words.owner(), owner])


def _repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that the text has twice or more."""
    runs, run_bounds = windows(hashes, bounds, 3)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(run_bounds))
    keys = runs + mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys) + 1, dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    hit = np.flatnonzero(twice[:-1])
    at = hit - run_bounds[owner[hit]] + bounds[owner[hit]]
    covered = np.zeros(len(hashes) + 3, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    sums = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
    return np.diff(sums[bounds])


def _repeated_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _measure(texts: Texts) -> dict[str, np.ndarray]:
    words = texts.words(fold=False)
    points = (texts.data & 0xC0) != 0x80
    return {
        "n_words": words.count(),
        "word_chars": texts.per_text(words.inside & points),
        "n_symbols": texts.per_text(_SYMBOLS[texts.data]),
        "n_dup_lines": np.array([_repeated_lines(texts.raw(i)) for i in range(len(texts))]),
        "n_repeat_words": _repeated(words.hashes, words.bounds),
    }


def _calibrates(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(4)) == 0


def trusted_sample(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """Ids with quality 1 in all their labels, and which of them calibrate: all of the calibrating
    quarter, and at most `bound` others."""
    good = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .filter("quality = 1")
        .select("doc_id", _calibrates(F.col("doc_id")).alias("calibrate"))
    )
    picked = good.filter(~F.col("calibrate")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return picked.unionByName(good.filter("calibrate"))


def log_ratios(documents: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> np.ndarray:
    """Log of trusted over raw probability of each bucket; zeros where nothing is labelled."""
    fitted = trusted_sample(labels, bound).filter(~F.col("calibrate"))
    trusted = fitted.select("doc_id", F.lit(True).alias("trusted"))
    flagged = documents.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    counts = (
        flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(_count, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    at = counts.column("bucket").to_numpy()
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    raw[at] += counts.column("raw").to_numpy()
    target[at] = counts.column("target").to_numpy()
    share = raw / raw.sum()
    weight = PRIOR * BUCKETS
    return np.log((target + weight * share) / (target.sum() + weight) / share)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for texts in slices(batch):
            bucket, owner = _buckets(texts)
            trusted = np.array(texts.batch.column("trusted"), dtype=bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[trusted[owner]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict(
        {"bucket": at.astype(np.int32), "raw": raw[at], "target": target[at]}
    )


def _failed(measures: dict[str, np.ndarray]) -> np.ndarray:
    words = measures["n_words"]
    return (words < MIN_WORDS) | (100 * measures["n_repeat_words"] > MAX_REPEAT_PERCENT * words)


def _mean_ratio(texts: Texts, ratios: np.ndarray) -> np.ndarray:
    bucket, owner = _buckets(texts)
    grams = np.bincount(owner, minlength=len(texts))
    total = np.bincount(owner, weights=ratios[bucket], minlength=len(texts))
    return total / np.maximum(grams, 1)


def _sieve(ratios: np.ndarray, threshold: float) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                good = ~_failed(_measure(texts)) & (_mean_ratio(texts, ratios) >= threshold)
                yield texts.batch.filter(pa.array(good))

    return keep


def _scorer(ratios: np.ndarray) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                measures = _measure(texts)
                columns = measures | {
                    "llr": _mean_ratio(texts, ratios),
                    "base_failed": _failed(measures),
                }
                out = texts.batch.drop_columns("text")
                for name, values in columns.items():
                    out = out.append_column(name, pa.array(values))
                yield out

    return score


def _scored(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    id_type = documents.schema["doc_id"].dataType.simpleString()
    measures = ", ".join(f"{c} long" for c in MEASURES)
    return documents.select("doc_id", "text").mapInArrow(
        _scorer(ratios), f"doc_id {id_type}, {measures}, llr double, base_failed boolean"
    )


def calibrated_threshold(
    documents: DataFrame, labels: DataFrame, ratios: np.ndarray, bound: int = TRUSTED
) -> float:
    """Lowest score that is kept; without calibration documents none is too low.

    Only texts of the calibrating quarter are scored; the join with labels moves scores, not texts.
    """
    ids = trusted_sample(labels, bound).filter("calibrate").select("doc_id")
    scored = _scored(documents.filter(_calibrates(F.col("doc_id"))), ratios).filter("NOT base_failed")
    seen = stage(
        scored.select("doc_id", "llr")
        .join(ids, "doc_id", "left_semi")
        .select("llr", F.monotonically_increasing_id().alias("nth")),
        "calibration",
    )
    rows = seen.count()
    if not rows:
        return float("-inf")
    at, part = divmod(QUANTILE * (rows - 1), 1)
    ranks = [int(at) + 1, min(int(at) + 2, rows)]
    found = keys_at_ranks(seen, ["llr"], ranks, rows, "nth")
    low, high = (found["llr", rank]["v"] for rank in ranks)
    return low + part * (high - low) - MARGIN


def quality_scores(documents: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """One row per row of `documents`: doc_id, base measures, base_failed, llr and kept.

    Null and empty texts have no words, measures of 0 and an llr of 0; they fail the base rules.
    A null id is measured like any other. Repeated rows give repeated results. Without labels
    every llr is 0, so only the base rules reject. Other columns of the inputs are not read.
    """
    ratios = log_ratios(documents, labels, bound)
    threshold = calibrated_threshold(documents, labels, ratios, bound)
    return _scored(documents, ratios).withColumn(
        "kept", ~F.col("base_failed") & (F.col("llr") >= threshold)
    )


def good_documents(documents: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """The rows of `documents`, all columns, that `quality_scores` keeps; texts are not shuffled.

    Null and empty texts go, as they fail the base rules; rows without id and repeated rows are judged
    like any other. An empty table stays empty. Texts of any length are read whole.
    """
    ratios = log_ratios(documents, labels, bound)
    threshold = calibrated_threshold(documents, labels, ratios, bound)
    return documents.mapInArrow(_sieve(ratios, threshold), documents.schema)
