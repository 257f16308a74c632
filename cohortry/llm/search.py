"""Ranked search over an index of documents, with pairs of terms bounding what a document can score.

The index has a row for each block of neighbouring documents: their ids and lengths, and the
postings of their terms. Nothing of it is shuffled. Blocks are packed values to Spark, and a task
holds one at a time, however many it reads: as arrays of a whole file they filled the heap.

A batch of items is answered in three passes over the blocks:

1. Count the documents of each term.
2. Make the view of each block for these items: postings of their terms, and intersection lists of
   term pairs. The terms of an item are chained from the least to the most weighty, and each two
   that follow each other are such a pair. A list is stored as its joint maximum, the most that the
   two terms bring together in one document; its best documents are scored whole, and the scores of
   all blocks give each item a threshold that its twentieth best document reaches.
3. Skip by maximum score. Let the first terms of the chain be passed over as long as no document can
   reach the threshold by them alone. What a beginning of the chain can bring is bounded by the best
   way of covering it with single maxima and joint maxima of pairs, found by dynamic programming:
   terms that never meet in a document count once, not twice. Documents come from the lists of the
   other terms only; they get the passed-over terms one after the other, and are dropped when what
   is left cannot lift them to the threshold.

Thresholds and bounds only ever skip what cannot be among the best, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.staging import settings, stage
from cohortry.llm.text import SLICE_BYTES, Texts, slices

BEST = 20  # documents listed for an item
BLOCK_WORDS = 1 << 19  # words after which a block of documents is closed
BATCH_TERMS = 1 << 18  # terms of the items that are answered together

READ_ROWS = 64  # rows that a task's reader holds
BATCH_BYTES = 1 << 20  # bytes after which a batch of rows goes to Python
PIECE_BYTES = 1 << 18  # bytes of a piece of a packed value; from half a region on, G1 keeps each array apart

#: Files of blocks: a page for each, in groups of 1 MB. A task's writer and its reader hold one group.
FILE_OF_BLOCKS = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.page.row.count.limit": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size": str(1 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
}

#: Every ASCII character that is no digit and no letter.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x41] = BETWEEN[0x5B:0x61] = BETWEEN[0x7B:0x80] = True

# Fixed values of the score.
WEIGHT_SCALE, TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1000, 10**9, 1000, 12, 25


def _held(spark: SparkSession) -> AbstractContextManager[None]:
    """`READ_ROWS` in a task's reader at once, and `BATCH_BYTES` in what it sends to Python."""
    return settings(
        spark,
        {
            "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS),
            "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        },
    )


def _packed(arrays: dict[str, pa.Array]) -> pa.Array:
    """Arrays as one value, in pieces."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays.values()]
    batch, out = pa.record_batch(lists, list(arrays)), pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
    with pa.ipc.new_stream(out, batch.schema, options=options) as stream:
        stream.write_batch(batch)
    value = out.getvalue().to_pybytes()
    return pa.array([[value[k : k + PIECE_BYTES] for k in range(0, len(value), PIECE_BYTES)]], pa.list_(pa.binary()))


def _unpacked(batch: pa.RecordBatch, name: str, i: int) -> dict[str, pa.Array]:
    options = pa.ipc.IpcReadOptions(use_threads=False)
    lists = pa.ipc.open_stream(b"".join(batch.column(name)[i].as_py()), options=options).read_next_batch()
    return {c: lists.column(c)[0].values for c in lists.schema.names}


def _short(texts: Texts) -> Iterator[Texts]:
    """The same text in parts that end between words, if it is a long one."""
    data, at, size = texts.data, 0, len(texts.data)
    if len(texts) > 1 or size <= 2 * SLICE_BYTES:
        yield texts
        return
    while at < size:
        end = min(at + SLICE_BYTES, size)
        while end < size and not BETWEEN[data[end]]:
            end += 1
        yield Texts(texts.batch, data[at:end], np.array([0, end - at]))
        at = end


class _Block:
    """Documents gathered for a block, and their terms."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # terms, documents, times
        self.held = 0

    def add(self, ids: list, texts: Texts) -> None:
        base = len(self.ids)
        self.ids += ids
        total = np.zeros(len(ids), dtype=np.int64)
        for part in _short(texts):
            words = part.words(True, BETWEEN)
            total += words.count()
            ones = np.ones(len(words.hashes), dtype=np.int64)
            self.parts.append((words.hashes, words.owner() + base, ones))
            self.held += len(ones)
            if self.held > 2 * BLOCK_WORDS:  # a very long text: keep counts, not words
                self.parts = [self.summed()]
                self.held = len(self.parts[0][0])
        self.lengths += total.tolist()

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        term, doc, times = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((doc, term))
        term, doc, times = term[order], doc[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])[: len(term)])
        return term[first], doc[first], np.add.reduceat(times, first) if len(first) else times

    def row(self) -> pa.RecordBatch:
        term, doc, times = self.summed()
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
        terms = {"terms": pa.array(term[first]), "starts": pa.array(np.append(first, len(term)).astype(np.int32))}
        postings = {
            "doc_ids": pa.array(self.ids, pa.int64()),
            "lengths": pa.array(self.lengths, pa.int64()),
            "docs": pa.array(doc.astype(np.int32)),
            "times": pa.array(times.astype(np.int32)),
        }
        sizes = [pa.array([sum(x > 0 for x in self.lengths)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())]
        return pa.record_batch([_packed(terms), _packed(postings), *sizes], ["terms", "postings", "n_docs", "n_words"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        for texts in slices(batch):
            block.add(texts.batch.column("doc_id").to_pylist(), texts)
            if block.held >= BLOCK_WORDS or len(block.ids) >= BLOCK_WORDS:
                yield block.row()
                block = _Block()
    if block.ids:
        yield block.row()


def build_index(documents: DataFrame) -> DataFrame:
    """A row for each block of documents: its different terms by hash and where the postings of each
    begin (packed), doc_ids, lengths and the postings, document of the block and times (packed), and
    the block's numbers of documents with terms and of words."""
    with _held(documents.sparkSession):
        return stage(
            documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
                _blocks, "terms array<binary>, postings array<binary>, n_docs long, n_words long"
            ),
            "search-index",
            FILE_OF_BLOCKS,
        )


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch):
            counts = [{} for _ in range(len(texts))]
            for part in _short(texts):
                words = part.words(True, BETWEEN)
                for owner, term in zip(words.owner().tolist(), words.hashes.view(np.int64).tolist()):
                    counts[owner][term] = counts[owner].get(term, 0) + 1
            yield pa.record_batch(
                [
                    texts.batch.column("item"),
                    pa.array([list(c) for c in counts], pa.list_(pa.int64())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                ["item", "terms", "times"],
            )


def _batches(items: Iterator[Row]) -> Iterator[list[Row]]:
    batch, held = [], 0
    for item in items:
        batch.append(item)
        held += len(item["terms"])
        if held >= BATCH_TERMS:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Query:
    """Some items with the weights of their terms. Small enough to be sent to every task."""

    def __init__(self, items: list[Row], n_docs: int, n_words: int, found: dict[int, int]):
        self.n_docs, self.n_words = n_docs, n_words
        known = np.array(sorted(found), dtype=np.int64).view(np.uint64)
        self.terms = np.sort(known)
        df = np.array([found[int(t)] for t in self.terms.view(np.int64)], dtype=np.int64)
        self.weights = np.array(
            [math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64
        )
        self.items = [r["item"] for r in items]
        self.chains: list[tuple[np.ndarray, np.ndarray]] = []  # terms by number and times, by item
        pairs: dict[tuple[int, int, int, int], int] = {}
        self.pairs_of: list[np.ndarray] = []
        for r in items:
            term = np.array(r["terms"], dtype=np.int64).view(np.uint64)
            times = np.array(r["times"], dtype=np.int64)
            at = np.searchsorted(self.terms, term)
            here = at < len(self.terms)
            here[here] = self.terms[at[here]] == term[here]
            at, times = at[here], times[here]
            order = np.argsort(times * self.weights[at], kind="stable")
            at, times = at[order], times[order]
            self.chains.append((at, times))
            names = zip(at[:-1].tolist(), times[:-1].tolist(), at[1:].tolist(), times[1:].tolist())
            self.pairs_of.append(np.array([pairs.setdefault(p, len(pairs)) for p in names], dtype=np.int64))
        self.pairs = list(pairs)

    def impacts(self, term: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What each posting brings to a score, once."""
        norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * self.n_docs) // max(self.n_words, 1)
        return self.weights[term] * ((TF_SCALE * times) // (TF_UNIT * times + LENGTH_UNIT * norm))


class _View:
    """A block's postings of the terms of a query, by term number."""

    def __init__(self, query: Query, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int):
        self.query = query
        self.starts, self.docs, self.impacts, self.size = starts, docs, impacts, size
        self.most = np.zeros(len(query.terms), dtype=np.int64)
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            self.most[filled] = np.maximum.reduceat(impacts, starts[filled])

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.docs[a:b], self.impacts[a:b]

    def looked_up(self, term: int, wanted: np.ndarray) -> np.ndarray:
        """What the term brings to each wanted document, zero where it does not occur."""
        docs, impacts = self.list(term)
        at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
        return np.where(docs[at] == wanted, impacts[at], 0)

    def joint(self, pair: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The pair's intersection list: documents, and what both terms bring together."""
        a, a_times, b, b_times = pair
        if self.starts[a + 1] - self.starts[a] > self.starts[b + 1] - self.starts[b]:
            a, a_times, b, b_times = b, b_times, a, a_times
        docs, impacts = self.list(a)
        if not len(docs):
            return docs, impacts
        other = self.looked_up(b, docs)
        both = other > 0
        return docs[both], impacts[both] * a_times + other[both] * b_times

    def scores(self, item: int, docs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), dtype=np.int64)
        for term, times in zip(*(x.tolist() for x in self.query.chains[item])):
            if self.most[term]:
                total += times * self.looked_up(term, docs)
        return total


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` highest scores, in no order."""
    return np.argpartition(scores, -count)[-count:] if len(scores) > count else np.arange(len(scores))


def _counter(terms: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed = _unpacked(batch, "terms", i)
                own, sizes = listed["terms"].to_numpy(), np.diff(listed["starts"].to_numpy())
                at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
                here = own[at] == terms if len(own) else np.zeros(len(terms), dtype=bool)
                yield pa.record_batch([pa.array(terms[here].view(np.int64)), pa.array(sizes[at[here]].astype(np.int64))], ["term", "df"])

    return count


def _viewer(query: Query, best: int) -> Callable:
    """Blocks of the index to views with the joint maxima of pairs and scores for the thresholds."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed, postings = _unpacked(batch, "terms", i), _unpacked(batch, "postings", i)
                own, starts = listed["terms"].to_numpy(), listed["starts"].to_numpy()
                at = np.searchsorted(own, query.terms)
                here = at < len(own)
                here[here] = own[at[here]] == query.terms[here]
                sizes = np.zeros(len(query.terms), dtype=np.int64)
                sizes[here] = np.diff(starts)[at[here]]
                new = np.concatenate([[0], np.cumsum(sizes)])
                begin = np.zeros(len(sizes), dtype=np.int64)
                begin[here] = starts[at[here]]
                picked = np.repeat(begin - new[:-1], sizes) + np.arange(new[-1])
                docs = postings["docs"].to_numpy()[picked]
                lengths = postings["lengths"].to_numpy()
                term = np.repeat(np.arange(len(sizes)), sizes)
                impacts = query.impacts(term, postings["times"].to_numpy()[picked].astype(np.int64), lengths[docs])
                view = _View(query, new, docs, impacts, len(lengths))
                joint, heads = np.zeros(len(query.pairs), dtype=np.int64), {}
                for k, pair in enumerate(query.pairs):
                    if view.most[pair[0]] and view.most[pair[2]]:
                        met, together = view.joint(pair)
                        if len(met):
                            joint[k] = together.max()
                            heads[k] = met[_best(together, best)]
                items, scores = [], []
                for item, pairs in enumerate(query.pairs_of):
                    lists = [heads[k] for k in pairs.tolist() if k in heads]
                    if lists:
                        got = view.scores(item, np.unique(np.concatenate(lists)))
                        got = got[_best(got, best)]
                        items += [item] * len(got)
                        scores += got.tolist()
                arrays = {
                    "doc_ids": postings["doc_ids"],
                    "starts": pa.array(new),
                    "docs": pa.array(docs),
                    "impacts": pa.array(impacts),
                    "joint": pa.array(joint),
                }
                reached = [pa.array([items], pa.list_(pa.int32())), pa.array([scores], pa.list_(pa.int64()))]
                yield pa.record_batch([_packed(arrays), *reached], ["view", "items", "scores"])

    return make


def chain_bounds(most: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The most that each beginning of a chain of terms can bring to a document.

    most: of each term; joint: of each two that follow each other, where both occur. A pair brings
    no more than the two apart, and no less than the better of them.
    """
    out = [0]
    for i, single in enumerate(most.tolist()):
        bound = out[-1] + single
        if i and single and most[i - 1]:
            bound = min(bound, out[-2] + max(int(joint[i - 1]), single, int(most[i - 1])))
        out.append(bound)
    return np.array(out, dtype=np.int64)


def top_of_block(view: _View, item: int, joint: np.ndarray, threshold: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block that may be among the item's best, and their scores."""
    chain, times = view.query.chains[item]
    most = view.most[chain] * times
    bounds = chain_bounds(most, joint[view.query.pairs_of[item]])
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    threshold = max(threshold, 1)
    if bounds[-1] < threshold:
        return none
    passed = int(np.searchsorted(bounds, threshold, side="left")) - 1
    lists = [(view.list(t), n) for t, n in zip(chain[passed:].tolist(), times[passed:].tolist())]
    docs = np.concatenate([d for (d, _), _ in lists])
    # Sums of whole numbers below 2 ** 53, so doubles are exact.
    so_far = np.bincount(docs, np.concatenate([i * n for (_, i), n in lists]).astype(np.float64), view.size)
    docs = np.flatnonzero(so_far)
    score = so_far[docs].astype(np.int64)
    if len(score) >= best:
        threshold = max(threshold, int(np.partition(score, -best)[-best]))
    for i in range(passed - 1, -1, -1):
        stay = score + bounds[i + 1] >= threshold
        docs, score = docs[stay], score[stay]
        if most[i] and len(docs):
            score = score + times[i] * view.looked_up(int(chain[i]), docs)
    stay = score >= threshold
    return docs[stay], score[stay]


def _searcher(query: Query, thresholds: dict[int, int], best: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = _unpacked(batch, "view", i)
                ids, joint = arrays["doc_ids"], arrays["joint"].to_numpy()
                view = _View(query, *(arrays[c].to_numpy() for c in ("starts", "docs", "impacts")), len(ids))
                keys = ids.fill_null((1 << 63) - 1).to_numpy()
                items, docs, scores = [], [], []
                for item, name in enumerate(query.items):
                    doc, score = top_of_block(view, item, joint, thresholds.get(item, 0), best)
                    order = np.lexsort((keys[doc], -score))[:best]
                    items.append(np.full(len(order), name, dtype=np.int64))
                    docs.append(doc[order])
                    scores.append(score[order])
                docs = pa.array(np.concatenate(docs))
                yield pa.record_batch(
                    [pa.array(np.concatenate(items)), ids.take(docs), pa.array(np.concatenate(scores))],
                    ["item", "doc_id", "score"],
                )

    return search


def _answers(index: DataFrame, batch: list[Row], n_docs: int, n_words: int, best: int) -> DataFrame:
    """(item, doc_id, score): each block's best documents for the items of a batch."""
    terms = np.unique(np.array([t for r in batch for t in r["terms"]], dtype=np.int64).view(np.uint64))
    with _held(index.sparkSession):
        counted = index.select("terms").mapInArrow(_counter(terms), "term long, df long")
        found = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        query = Query(batch, n_docs, n_words, found)
        views = stage(
            index.select("terms", "postings").mapInArrow(
                _viewer(query, best), "view array<binary>, items array<int>, scores array<long>"
            ),
            "search-views",
            FILE_OF_BLOCKS,
        )
        reached = views.select(F.explode(F.arrays_zip("items", "scores")).alias("x")).select("x.items", "x.scores")
        ranked = F.row_number().over(Window.partitionBy("items").orderBy(F.desc("scores")))
        lowest = reached.withColumn("place", ranked).filter(F.col("place") <= best).filter(F.col("place") == best)
        thresholds = {r["items"]: r["scores"] for r in lowest.collect()}
        return stage(
            views.select("view").mapInArrow(_searcher(query, thresholds, best), "item long, doc_id long, score long"),
            "answers",
        )


def search(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The `best` highest-scoring documents of each item: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; a null text has
    none. Documents without a term do not count and are never found; an item without a term that
    occurs gives no rows. Equal scores go to the lower doc_id; a document without id comes last of
    them. Repeated rows of documents are documents of their own; repeated rows of items (equal id and
    text) are answered once, items that share an id only each for itself. Very long texts are read in
    parts. Either table may be empty. Other columns are ignored.
    """
    index = build_index(documents)
    numbers = index.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_words")]).first()
    asked = stage(
        items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items"
    )
    known = stage(asked.select("item", "text").mapInArrow(_item_terms, "item long, terms array<long>, times array<long>"), "item-terms")
    answers = None
    for batch in _batches(known.toLocalIterator()):
        own = _answers(index, batch, numbers["n_docs"], numbers["n_words"], best)
        answers = own if answers is None else answers.unionByName(own)
    if answers is None:
        answers = items.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
