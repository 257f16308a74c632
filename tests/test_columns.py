from datetime import date, datetime

from pyspark.sql import functions as F

from cohortry.functions import columns as c


def test_ratio_and_rounding(frame):
    df = frame([(1, 0, 0.5), (1, 8, -2.5), (None, 2, 2.45)], "a int, b int, x double")
    got = df.select(
        c.ratio(F.col("a"), F.col("b")), c.round_half_away(F.col("x")), c.round_half_away(F.col("x"), 1)
    ).collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 0.5), (0.125, -3.0, -2.5), (None, 2.0, 2.5)]


def test_strip_takes_every_white_space(frame):
    df = frame([("  a b\t\n",), ("　주소 ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(c.strip(F.col("s"))).collect()] == ["a b", "주소", "", None]


def test_local_date_depends_on_zone_not_on_session(spark, frame):
    df = frame([(datetime(2025, 1, 1, 15, 0), date(2025, 1, 1))], "t timestamp_ntz, d date")
    df = df.withColumn("i", F.expr("timestamp'2025-01-01 15:00:00Z'"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(
                *[c.local_date(df, n, "Asia/Seoul") for n in ("t", "i", "d")], c.plain_date(df, "t")
            ).first()
            assert tuple(got) == (date(2025, 1, 2), date(2025, 1, 2), date(2025, 1, 1), date(2025, 1, 1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


DOCS = [
    '{"p": {"k": "[x] y"}}',
    '{"p": {"k": 7}}',
    '{"p": {"k": {"a": 1}}}',
    '{"p": {"k": [1]}}',
    '{"p": {"k": null}}',
    '{"p": {"k": "{not json"}}',
    '{"p": 5}',
    "[1]",
    "broken {",
    None,
]
TEXTS = ["[x] y", "7", None, None, None, "{not json", None, None, None, None]


def test_scalars_of_text_and_variant_documents_agree(frame):
    df = frame([(d,) for d in DOCS], "d string")
    assert [r[0] for r in df.select(c.json_text(df, "d", "$.p.k")).collect()] == TEXTS
    assert [r[0] for r in df.select(*c.json_texts(df, "d", "p", ["k"])).collect()] == TEXTS
    variant = df.select(F.try_parse_json("d").alias("d"))
    assert [r[0] for r in variant.select(c.json_text(variant, "d", "$.p.k")).collect()] == TEXTS
    assert [r[0] for r in variant.select(*c.json_texts(variant, "d", "p", ["k"])).collect()] == TEXTS
