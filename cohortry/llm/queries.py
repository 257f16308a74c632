"""The registered queries of this package, on whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import (
    chat,
    decontaminate,
    language,
    lm,
    neardup,
    packing,
    quality,
    search,
    secrets,
    suffix_dedup,
    tokens,
    trie,
    urls,
)

# Verdicts and rules of the url query.
URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def fold(modulus: int) -> Column:
    """Remainder of the checksum of doc_id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document whose number is in its path; bad if that document
    is labelled as of low quality or toxic."""
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]+)", 1)
    shown = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return shown.join(labels, "doc_id").select("page_id", bad.alias("bad"))


def op1_language(spark: SparkSession, root: str) -> DataFrame:
    return language.predicted_languages(_table(spark, root, "documents"), fold(4) == 2)


def op2_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_counts(
        _table(spark, root, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op3_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, root, "documents"))


def op4_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, root, "documents"), _table(spark, root, "benchmark")
    )


def op5_chat_texts(spark: SparkSession, root: str) -> DataFrame:
    return chat.chat_texts(_table(spark, root, "conversations"))


def packed(documents: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    out = packing.pack(documents, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return out.withColumn("length", F.col("length").cast("long"))


def op6_packing(spark: SparkSession, root: str) -> DataFrame:
    return packed(_table(spark, root, "documents"))


def op7_url_verdicts(spark: SparkSession, root: str) -> DataFrame:
    pages = _table(spark, root, "pages")
    outcomes = page_outcomes(pages, _table(spark, root, "labels"))
    return urls.url_verdicts(pages, outcomes, URL_RULES)


def op8_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.quality_scores(
        _table(spark, root, "documents"), _table(spark, root, "labels")
    ).select("doc_id", *quality.MEASURES, "base_failed", "kept", "llr")


def op9_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.secret_report(_table(spark, root, "documents"))


def op10_language_model(spark: SparkSession, root: str) -> DataFrame:
    return lm.model_scores(_table(spark, root, "documents"), fold(7) == 2)


def op11_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return search.search(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def op12_conversation_trie(spark: SparkSession, root: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, root, "conversations"))


def op13_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, root, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language,
        op2_token_counts,
        op3_near_duplicates,
        op4_decontamination,
        op5_chat_texts,
        op6_packing,
        op7_url_verdicts,
        op8_quality,
        op9_secrets,
        op10_language_model,
        op11_ranked_search,
        op12_conversation_trie,
        op13_suffix_dedup,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    END AS s
  FROM words
), flat AS (
  SELECT doc_id, unnest(s) AS x FROM shingled
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN shingled l ON l.doc_id = a JOIN shingled r ON r.doc_id = b
  WHERE 100 * c >= 85 * (len(l.s) + len(r.s) - c)
), reach AS (
  SELECT doc_id AS v, doc_id AS low FROM documents
  UNION
  SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.v
), lowest AS (
  SELECT v, min(low) AS component_id FROM reach GROUP BY v
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id,
  doc_id = component_id AS kept
FROM shingled JOIN lowest ON v = doc_id
"""

_DECONTAMINATION = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, starts.n, item_id FROM starts JOIN phrases ON starts.p = phrases.p AND starts.n = phrases.n
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_CHAT_TEXTS = """
WITH whole AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns
  FROM conversations GROUP BY conv_id
), begun AS (
  SELECT DISTINCT turns[1:k] AS p FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM whole)
)
SELECT min(conv_id) AS conv_id, CAST(len(turns) AS BIGINT) AS n_turns, count(*) AS copies,
  array_to_string(list_transform(turns,
    lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS text
FROM whole WHERE turns NOT IN (SELECT p FROM begun) GROUP BY turns
"""

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{{{k}}}'"
    for k, (h, _, p) in enumerate(
        rule.partition("/") for _, rule in sorted(URL_RULES, key=lambda r: -len(r[1]))
    )
)
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1]))
_SUFFIXES = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)


def _strength_sql(groups: str) -> str:
    """Strength of the prior of a level, by moments."""
    low, high = urls.STRENGTH
    return f"""(SELECT CASE WHEN share > 0 THEN least(greatest((1 - share) / share, {low}), {high})
  ELSE {high} END AS strength
  FROM (SELECT (kkn - n * rate * rate - binomial * (g - 1))
      / nullif(binomial * (n - nn / n - (g - 1)), 0) AS share
    FROM (SELECT *, k / n AS rate, (k / n) * (1 - k / n) AS binomial
      FROM (SELECT CAST(count(*) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS n,
        CAST(sum(k) AS DOUBLE) AS k, CAST(sum(n * n) AS DOUBLE) AS nn,
        sum(CAST(k * k AS DOUBLE) / n) AS kkn FROM {groups} WHERE n > 0))))"""


_URL_VERDICTS = rf"""
WITH parsed AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), outcome AS (
  SELECT page_id, max(quality = 0 OR toxic = 1) AS bad
  FROM parsed JOIN labels ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT)
  GROUP BY page_id
), counted AS (
  SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS k
  FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY host
), labels_of AS (
  SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts
  FROM counted
), domains_of AS (
  SELECT host, n, k, CASE WHEN array_to_string(parts[-2:], '.') IN ({_SUFFIXES})
    THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain
  FROM labels_of
), hosts AS (
  SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*\.', '') ELSE domain END
    AS suffix FROM domains_of
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL
), overall AS (
  SELECT (sum(k) + 1) / (sum(n) + 2) AS rate FROM hosts
), of_suffix AS (
  SELECT suffix, (s.strength * rate + k) / (s.strength + n) AS prior
  FROM suffixes, overall, {_strength_sql("suffixes")} s
), of_domain AS (
  SELECT domain, suffix, (s.strength * prior + k) / (s.strength + n) AS prior
  FROM domains JOIN of_suffix USING (suffix), {_strength_sql("domains")} s
), of_host AS (
  SELECT host, n, s.strength, (s.strength * prior + k) / (s.strength + n) AS rate
  FROM hosts JOIN of_domain USING (domain, suffix), {_strength_sql("hosts")} s
)
SELECT page_id, host, path,
  CASE {_FITS.format(*[r for _, r in _BY_LENGTH])} END AS rule,
  CASE {_FITS.format(*[v for v, _ in _BY_LENGTH])}
    WHEN rate - {urls.DEVIATIONS} * sqrt(rate * (1 - rate) / (strength + n + 1)) > {urls.LIMIT}
    THEN 'block' ELSE 'allow' END AS verdict
FROM parsed JOIN of_host USING (host)
"""

_RANKED_SEARCH = rf"""
WITH own AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), totals AS (
  SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_words FROM own
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM own) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(n_docs) AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term
), impacts AS (
  SELECT r, doc_id, term,
    w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n_docs) // n_words))) AS impact
  FROM postings JOIN own USING (r) JOIN weights USING (term), totals
), asked AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), scored AS (
  SELECT item, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score
  FROM (SELECT item, item_id, unnest(t) AS term FROM asked) JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 20
"""

# The checksum is the usual one of 32 bits, four bits at a time.
_NIBBLES = []
for _x in range(16):
    for _ in range(4):
        _x = (_x >> 1) ^ (0xEDB88320 if _x & 1 else 0)
    _NIBBLES.append(_x)

_CONVERSATION_TRIE = rf"""
WITH own AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), digits AS (
  SELECT conv_id, t, list_transform(flatten(list_transform(
    string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c) & 15, ascii(c) >> 4])), lambda n: CAST(n AS BIGINT)) AS n
  FROM own
), marked AS (
  SELECT conv_id, t, xor(list_reduce([4294967295] || n, lambda c, x:
      xor(({_NIBBLES})[CAST(xor(c, x) & 15 AS INTEGER) + 1], c >> 4)), 4294967295) % 4 AS h
  FROM digits
), rebuilt AS (
  SELECT m.conv_id, coalesce(b.t[1:m.h], []) || m.t[m.h + 1:] AS t
  FROM marked m LEFT JOIN own b ON b.conv_id = m.conv_id - m.conv_id % 20
), paths AS (
  SELECT conv_id, t[1:d] AS p, d, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY p
), linked AS (
  SELECT c.*, q.conv_id AS parent_conv_id, CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * len(list_filter(
    regexp_split_to_array((c.p[c.depth])[2], '[ 	-
]+'), lambda w: w <> '')) END AS saved
  FROM nodes c LEFT JOIN nodes q ON c.depth > 0 AND q.depth = c.depth - 1 AND q.p = c.p[1:c.depth - 1]
), children AS (
  SELECT p, (SELECT count(*) FROM linked c WHERE c.depth = q.depth + 1 AND c.p[1:q.depth] = q.p) AS n_children FROM linked q
), below AS (
  SELECT top.p, count(*) FILTER (WHERE sub.n_children = 0) AS n_leaves, sum(sub.saved) AS saved_tokens
  FROM linked top JOIN (SELECT linked.*, n_children FROM linked JOIN children USING (p)) sub
    ON sub.depth >= top.depth AND sub.p[1:top.depth] = top.p GROUP BY top.p
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN children USING (p) JOIN below USING (p)
"""

ORACLE_SQL = {
    "op3_near_duplicates": _NEAR_DUPLICATES,
    "op4_decontamination": _DECONTAMINATION,
    "op5_chat_texts": _CHAT_TEXTS,
    "op7_url_verdicts": _URL_VERDICTS,
    "op11_ranked_search": _RANKED_SEARCH,
    "op12_conversation_trie": _CONVERSATION_TRIE,
}
