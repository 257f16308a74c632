"""Secrets in texts: strong patterns, and weak candidates that complete each other.

Every kind of part is found by one regular expression. Its matches are marked inside the text, the
text is split at the marks, and running lengths of the pieces are the positions, so whole texts are
scanned by expressions alone and only lengths leave the scan.

Parts play one of three roles: access identifier, secret, endpoint. Strong parts (assignments,
access keys, long hexadecimal runs) are reported always. A weak identifier, key-like string or
endpoint is reported only if parts of complementary roles lie in the same scope (a stretch of text
without a blank line), however far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.native import free_name, row_id

# The strong patterns. The second group is the value, and must have so many
# characters; the order of the kinds is the order in reports.
STRONG = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
        6,
    ),
    "access": (r"()(AKIA[A-Z0-9]+)", 20),
    "hex": (r"()([0-9a-f]{24,})", 24),
}
WEAK = {
    "id": (
        r"""((?i:user_?name|user|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9@._-]+)""",
        4,
    ),
    "key": (r"()((?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2})", 32),
    "endpoint": (r"""()((?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|redis|amqp|mongodb)://[^\x00-\x20"'<>]+)""", 8),
}
#: Where a scope ends.
BREAK = (r"()(\n[\x20\t\r]*\n)", 1)
KINDS = [*STRONG, *WEAK]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "key": "secret", "endpoint": "endpoint"}
NEEDS = {"id": ["secret"], "key": ["id"], "endpoint": ["id", "secret"]}

_BEGIN, _VALUE, _END, _OTHER = "\ue000", "\ue001", "\ue002", "\ue003"


def _marked(text: Column, kind: str) -> Column:
    pattern = {**STRONG, **WEAK, "break": BREAK}[kind][0]
    return F.regexp_replace(text, pattern, f"{_BEGIN}$1{_VALUE}$2{_END}")


def parts(documents: DataFrame, kinds: list[str]) -> DataFrame:
    """(rid, kind, begin, end): every match of the kinds; code points, end exclusive."""
    # The marks themselves may occur in a text. Patterns match neither them nor their stand-in.
    plain = F.translate(F.coalesce("text", F.lit("")), _BEGIN + _VALUE + _END, _OTHER * 3)
    texts = documents.select(row_id().alias("rid"), plain.alias("t")).filter("t != ''")
    marked = texts.select(
        "rid",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), _marked(F.col("t"), k).alias("m")) for k in kinds])
        ).alias("x"),
    ).filter(F.col("x.m").contains(_BEGIN))
    pieces = marked.select(
        "rid", F.col("x.kind").alias("kind"), F.posexplode(F.split("x.m", _BEGIN)).alias("k", "piece")
    )
    value_at = F.instr("piece", _VALUE)
    lengths = pieces.select(
        "rid",
        "kind",
        "k",
        (F.length("piece") - F.when(F.col("k") > 0, 2).otherwise(0)).alias("size"),
        (value_at - 1).alias("before"),
        (F.instr("piece", _END) - value_at - 1).alias("value"),
    ).distinct()
    earlier = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    least = F.create_map(
        *[F.lit(x) for k in kinds for x in (k, {**STRONG, **WEAK, "break": BREAK}[k][1])]
    )
    return (
        lengths.withColumn("begin", F.sum("size").over(earlier))
        .filter((F.col("k") > 0) & (F.col("value") >= least[F.col("kind")]))
        .select(
            "rid", "kind", "begin", (F.col("begin") + F.col("before") + F.col("value")).alias("end")
        )
    )


def _scoped(found: DataFrame) -> DataFrame:
    """Parts, less the breaks, with the number of breaks before them in the text."""
    before = Window.partitionBy("rid").orderBy("begin").rangeBetween(Window.unboundedPreceding, 0)
    scope = F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(before)
    return found.withColumn("scope", scope).filter("kind != 'break'")


def linked_weak(found: DataFrame) -> DataFrame:
    """The weak ones among `found` (parts and breaks) that complementary parts accompany.

    A scope is joined to its parts as an interval of the text; what it holds is known before the join,
    so a scope of very many parts is never paired with itself.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    scoped = _scoped(found).withColumn("role", role[F.col("kind")])
    holds = scoped.groupBy("rid", "scope").agg(
        *[F.max(F.col("role") == r).alias(f"has_{r}") for r in ("id", "secret")]
    )
    complete = F.lit(False)
    for kind, needs in NEEDS.items():
        has = F.lit(True)
        for r in needs:
            has = has & F.col(f"has_{r}")
        complete = complete | ((F.col("kind") == kind) & has)
    weak = scoped.filter(F.col("kind").isin(*WEAK)).select("rid", "scope", "kind", "begin", "end")
    return weak.join(holds, ["rid", "scope"]).filter(complete).select("rid", "kind", "begin", "end")


def secret_spans(documents: DataFrame) -> DataFrame:
    """(rid, kind, begin, end): strong parts, and weak parts that are linked."""
    found = stage(parts(documents, [*KINDS, "break"]), "parts")
    return found.filter(F.col("kind").isin(*STRONG)).unionByName(linked_weak(found))


def _report(spans: Column) -> Column:
    label = lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])
    return F.array_join(F.transform(spans, label), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    `spans` lists all spans as kind:start:end, by start and then kind, joined by commas;
    base_sha256 is the digest of this list of the strong ones. Null and empty texts have none: empty
    lists. Rows without id and repeated rows are reported like others; spans of different kinds may
    overlap. Other columns of the input are not read.
    """
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    lists = (
        secret_spans(documents)
        .groupBy("rid")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("begin", order[F.col("kind")].alias("order"), "kind", "end"))
            ).alias("all")
        )
    )
    strong = F.filter("all", lambda s: s["kind"].isin(*STRONG))
    counts = [
        F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")  # noqa: B023
        for k in STRONG
    ]
    found = documents.select("doc_id", row_id().alias("rid")).join(lists, "rid", "left")
    has = F.col("all").isNotNull()
    return found.select(
        "doc_id",
        *[F.when(has, c).otherwise(F.lit(0).cast("long")).alias(f"n_{k}") for k, c in zip(STRONG, counts)],
        F.sha2(F.when(has, _report(strong)).otherwise(""), 256).alias("base_sha256"),
        F.when(has, _report(F.col("all"))).otherwise("").alias("spans"),
    )


def redacted(documents: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """`documents`, all columns, each secret span of the text replaced by `mark`.

    Overlapping and adjoining spans become one mark. Texts without spans, null and empty ones stay as
    they are; rows without id and repeated rows are redacted like others. Columns of any name are kept.
    An empty table stays empty.
    """
    rid, found = free_name(documents, "__rid"), free_name(documents, "__spans")
    lists = (
        secret_spans(documents)
        .groupBy(F.col("rid").alias(rid))
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(found))
    )
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        kept = F.substring("text", (acc["at"] + 1).cast("int"), (s["begin"] - acc["at"]).cast("int"))
        gap = (acc["at"] == 0) | (s["begin"] > acc["at"])
        out = F.when(gap, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def finish(acc):
        return F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(
        F.aggregate(found, state, step, finish)
    )
    return (
        documents.withColumn(rid, row_id())
        .join(lists, rid, "left")
        .withColumn("text", text)
        .drop(rid, found)
    )
