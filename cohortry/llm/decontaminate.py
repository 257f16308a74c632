"""Benchmark passages in training documents, by a distributed positional inverted index.

Test items are cut into phrases of `WIDTH` words. A first pass counts the test terms in the corpus;
each phrase is then looked up by its two rarest terms only. The index is partitioned by document:
the postings (term, position) of a document lie with it. A second pass takes the postings of the
rarest terms; a phrase can begin at a posting's position less the term's offset in the phrase. The
offset-adjusted lists of its two terms are intersected there, the rest of the phrase is compared,
and the postings that are left are stored.

Terms and phrases are sent to the scans in blocks of at most `BLOCK` rows, the bound of every
broadcast. Neither texts nor postings that match nothing are shuffled. All steps are DataFrame
expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.native import free_name, plain_words, row_id

WIDTH = 10
BLOCK = 100_000


def phrases(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, phrase, words): runs of `width` words of each item; a shorter item is one run."""
    words = items.select("item_id", plain_words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    last = F.greatest(F.size("all") - width, F.lit(0))
    runs = words.select(
        "item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("at")
    ).select("item_id", F.slice("all", F.col("at") + 1, F.lit(width)).alias("words"))
    return runs.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def _blocks(table: DataFrame, key: str, scan) -> DataFrame:
    """`scan` for each block of a staged table, as one table."""
    count = max(1, -(-table.count() // BLOCK))
    parts = [
        scan(F.broadcast(table.filter(F.pmod(F.xxhash64(key), F.lit(count)) == k)))
        for k in range(count)
    ]
    return reduce(DataFrame.unionByName, parts)


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of `terms` occurs in the documents."""
    tokens = documents.select(F.explode(plain_words(F.col("text"))).alias("term"))
    found = _blocks(
        terms,
        "term",
        lambda block: tokens.join(block, "term").groupBy("term").agg(F.count("*").alias("n")),
    )
    return terms.join(found, "term", "left").fillna(0, ["n"])


def lookups(test: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, words, term, place, other, other_place): the two rarest terms of each phrase.

    `place` is a term's offset in the phrase; `other` is null for a phrase of one word.
    """
    placed = test.select("phrase", "words").distinct().select(
        "phrase", "words", F.posexplode("words").alias("place", "term")
    )
    rarest = Window.partitionBy("phrase").orderBy("n", "term", "place")
    return (
        placed.join(counts, "term")
        .withColumn("rank", F.row_number().over(rarest))
        .withColumn("other", F.lead("term").over(rarest))
        .withColumn("other_place", F.lead("place").over(rarest))
        .filter("rank = 1")
        .drop("n", "rank")
    )


def _postings(documents: DataFrame, test: DataFrame, matching) -> DataFrame:
    """Postings (rid, pos) of the rarest terms with their phrases, as far as they are `matching`."""
    terms = stage(test.select(F.explode("words").alias("term")).distinct(), "test-terms")
    keys = stage(lookups(test, stage(term_counts(documents, terms), "term-counts")), "lookups")
    texts = documents.select(row_id().alias("rid"), plain_words(F.col("text")).alias("all"))
    tokens = texts.select("rid", "all", F.posexplode("all").alias("pos", "term"))
    return _blocks(keys, "phrase", lambda block: matching(tokens.join(block, "term"))).distinct()


def phrase_matches(documents: DataFrame, test: DataFrame) -> DataFrame:
    """(rid, phrase, begin, length) of every exact occurrence of the phrases of `test`."""
    begin = F.col("pos") - F.col("place")
    other = F.get("all", begin + F.col("other_place"))
    size = F.size("words")
    same = F.slice("all", F.greatest(begin, F.lit(0)) + 1, size) == F.col("words")

    def matching(found: DataFrame) -> DataFrame:
        met = (begin >= 0) & (F.col("other").isNull() | (other == F.col("other")))
        return found.filter(met & same).select(
            "rid", "phrase", begin.alias("begin"), size.alias("length")
        )

    return _postings(documents, test, matching)


def proximity_matches(documents: DataFrame, test: DataFrame, slop: int = 5) -> DataFrame:
    """(rid, phrase, pos): all words of a phrase, in any order, near its rarest term.

    `pos` is the position of that term; the others lie at most the phrase's length less one and
    `slop` words from it.
    """
    reach = F.size("words") - 1 + slop
    left = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("all", left + 1, F.col("pos") - left + reach + 1)

    def matching(found: DataFrame) -> DataFrame:
        near = F.size(F.array_except("words", around)) == 0
        return found.filter(near).select("rid", "phrase", "pos")

    return _postings(documents, test, matching)


def _covered(matches: DataFrame) -> DataFrame:
    """(rid, n_hit): number of words inside any match."""
    spans = matches.groupBy("rid", "begin").agg(F.max(F.col("begin") + F.col("length")).alias("end"))
    before = Window.partitionBy("rid").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    new = F.greatest(F.col("end") - F.greatest("begin", "reached"), F.lit(0))
    return (
        spans.withColumn("reached", reached).groupBy("rid").agg(F.sum(new).cast("long").alias("n_hit"))
    )


def contamination(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of `documents`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words; so has a text of punctuation. Items without words match
    nothing; items with a null id count towards n_hit only. Repeated rows give repeated results,
    rows without id are judged like others, and repeated items count once. Without documents the
    result is empty; without items nothing is hit. Other columns of the inputs are not read.
    """
    return _contamination(documents, items, width).drop("rid")


def _contamination(documents: DataFrame, items: DataFrame, width: int) -> DataFrame:
    test = stage(phrases(items, width), "phrases")
    matches = stage(phrase_matches(documents, test), "matches")
    named = (
        matches.select("rid", "phrase")
        .distinct()
        .join(test.filter("item_id IS NOT NULL").select("phrase", "item_id"), "phrase")
        .select("rid", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("rid")
        .agg(
            F.count("*").alias("n_items"),
            F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"),
        )
    )
    found = _covered(matches).join(named, "rid", "left")
    sizes = documents.select(
        "doc_id", row_id().alias("rid"), F.size(plain_words(F.col("text"))).cast("long").alias("n_words")
    )
    zero = F.lit(0).cast("long")
    return sizes.join(found, "rid", "left").select(
        "rid",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `documents`, all columns, in which no phrase of an item occurs.

    Null and empty texts, and texts without words, stay; rows without id and repeated rows are judged
    like others. Without items all rows stay. Columns of any name are kept.
    """
    hit = phrase_matches(documents, stage(phrases(items, width), "phrases")).select("rid").distinct()
    rid = free_name(documents, "__rid")
    found = stage(hit.withColumnRenamed("rid", rid), "hits")
    return documents.withColumn(rid, row_id()).join(found, rid, "left_anti").drop(rid).select(documents.columns)
