import pytest
from pyspark.sql import functions as F

from cohortry.operators import mart_variants, options, quality
from tests.conftest import rows

ITEMS = "product_event_code string, product_option_id string, sku_code string"
SKUS = "sku_code string, sku_type string, virtual_child_sku_count long"
LINES = (
    "user_id string, event_id string, option_code string, order_qty long, total_revenue double, "
    "offer_type string, artist_id long, artist_name string"
)

# SKU -> (type, versions); option -> SKUs
KINDS = {"p8": ("P", 8), "p5": ("P", 5), "p1": ("P", 1), "p0": ("P", 0), "pn": ("P", None),
         "c": ("C", 3), "n": (None, 4)}
OPTIONS = {"one": ["p8"], "two": ["p8", "p5"], "single": ["p1"], "zero": ["p0"], "nullvc": ["pn"],
           "child": ["c"], "typeless": ["n"], "mixed": ["p8", "c"], "gone": ["missing"]}


@pytest.fixture
def catalogue(frame):
    items = frame([("E", o, s) for o, codes in OPTIONS.items() for s in codes], ITEMS)
    skus = frame([(code, *kind) for code, kind in KINDS.items()], SKUS)
    return items, skus


def line(user="u", option="one", qty=1, revenue=10.0, kind="P_POB", artist=1, event="E"):
    return (user, event, option, qty, revenue, kind, artist, f"A{artist}")


def test_catalogue(catalogue):
    matches = options.option_sku_matches(*catalogue)
    assert matches.count() == 10
    variety = {("E", "one", 8), ("E", "two", 8), ("E", "mixed", 8)}
    tickets = {("E", o) for o in ("zero", "nullvc", "child", "typeless", "mixed")}
    assert {tuple(r) for r in options.option_variety(matches).collect()} == variety
    assert {tuple(r) for r in options.option_is_ticket(matches).collect()} == tickets
    both = options.option_catalog(matches).collect()
    assert {("E", r["option_code"], r["vc"]) for r in both if r["vc"]} == variety
    assert {("E", r["option_code"]) for r in both if r["is_ticket"]} == tickets
    assert len(both) == 8


def matched(frame, catalogue, lines):
    purchases = options.option_purchases(frame(lines, LINES))
    return options.match_options(purchases, options.option_catalog(options.option_sku_matches(*catalogue)))


def test_stats(frame, catalogue):
    got = options.option_stats(
        matched(frame, catalogue, [line(), line(qty=0, revenue=4.0, user="v"), line(option="two", qty=3),
                                   line(option="two", qty=1, revenue=2.0), line(option="child"),
                                   line(option="nowhere"), line(event=None)])
    )
    assert rows(got, "user_id", "option_code", "total_qty", "unit_price", "vc", "qty_ratio") == [
        ("u", "one", 1, 10.0, 8, 0.125),
        ("u", "two", 4, 3.0, 8, 0.5),
        ("v", "one", 0, None, 8, 0.0),
    ]


def test_bulk_buyers(frame, catalogue):
    lines = [line("a", "child", 6), line("a", "child", 4, artist=2), line("b", "child", 9),
             line("c", "child", 5), line("c", "zero", 5), line("d", "one", 50), line("e", "nowhere", 50),
             line("f", "mixed", 10)]
    assert rows(options.bulk_ticket_buyers(matched(frame, catalogue, lines), 10)) == [("a",), ("f",)]


def test_user_purchases(frame):
    lines = [line("a", qty=2, artist=1), line("a", qty=5, artist=2, kind="F_FUNDING"), line("a", artist=None),
             line("b", kind="S_SHOPPING"), line("b", kind=None), line("c", qty=None, artist=None, kind=None)]
    got = options.user_purchases(options.option_purchases(frame(lines, LINES)))
    assert rows(got, "user_id", "distinct_artists", "max_qty", "event_lines") == [
        ("a", 2, 5, 3), ("b", 1, 1, 0), ("c", 0, None, 0)
    ]


def test_price_tiers(frame, rules):
    prices = [49_999.0, 50_000.0, 199_999.0, 200_000.0, None]
    df = frame([(i, p) for i, p in enumerate(prices)], "i int, p double")
    got = df.orderBy("i").select(options.price_tier_threshold(F.col("p"), rules)).collect()
    assert [r[0] for r in got] == [0.5, 0.3, 0.3, 0.2, 0.5]


def test_labels(frame, rules):
    cases = [
        (1.5, 10.0, "Poca Collector"), (1.5001, 10.0, "Challenger"), (0.5, 10.0, "Poca Collector"),
        (0.4999, 10.0, "Beginner"), (0.3, 50_000.0, "Poca Collector"), (0.3, 49_999.0, "Beginner"),
        (0.2, 200_000.0, "Poca Collector"), (0.2, 199_999.0, "Beginner"), (0.5, None, "Poca Collector"),
        (None, 10.0, "Beginner"),
    ]
    stats = frame([(str(i), r, p) for i, (r, p, _) in enumerate(cases)] + [("w", 0.1, 1.0), ("x", None, 1.0)],
                  "user_id string, qty_ratio double, unit_price double")
    certain = frame([("w",), ("w",), ("x",)], "user_id string")
    got = dict(rows(options.label_options(stats, certain, rules), "user_id", "option_label"))
    want = {str(i): label for i, (_, _, label) in enumerate(cases)}
    assert got == {**want, "w": "Challenger", "x": "Challenger"}


def test_second_sku_changes_no_quantity(frame, catalogue):
    items, skus = catalogue
    lines = [line(option="one", qty=3), line("v", "one", 2)]
    before = rows(options.option_stats(matched(frame, catalogue, lines)))
    more = items.unionByName(frame([("E", "one", "p5")], ITEMS))
    assert rows(options.option_stats(matched(frame, (more, skus), lines))) == before


def test_fanout_check(frame, catalogue):
    lines = frame([line(option="one", qty=3), line("v", "two", 2), line("w", "two", 5)], LINES)
    skus = options.option_sku_matches(*catalogue)
    bought = options.option_purchases(lines)
    got = quality.fanout_check(lines, skus, bought)
    assert rows(got, "option_code", "sku_rows", "option_qty", "sku_qty", "fans_out") == [
        ("one", 1, 3, 3, False), ("two", 2, 7, 14, True)
    ]
    assert rows(got, "option_code", "counted_qty", "agrees") == [("one", 3, True), ("two", 7, True)]
    planted = bought.join(skus.filter("sku_type = 'P'"), options.OPTION)
    found = quality.fanout_check(lines, skus, planted)
    assert rows(found.filter("NOT agrees"), "option_code", "counted_qty") == [("two", 14)]


def test_coverage_and_partition(frame):
    variety = frame([("E", "a", 3), ("E", "b", 4), ("E", "c", 5)], "event_id string, option_code string, vc long")
    other = frame([("E", "a", 3), ("E", "b", 9), ("E", "z", 1)],
                  "event_id string, option_code string, candidate_vc long")
    assert tuple(quality.variety_coverage(variety, other).first()) == (3, 2, 1, 2 / 3, 0.5)
    labels = frame([("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "user_id string, dimension_label string")
    assert tuple(quality.partition_check(labels).first()) == (3, 1, 1, 1)


MART = (
    "user_id string, event_id string, option_code string, ip_name string, order_qty long, "
    "total_revenue long, market_type string, data_source string"
)


def test_older_rules_count_a_line_per_sku(frame, catalogue, spark):
    """Same numbers as joining SKUs to the order lines, here done the long way on a small mart."""
    items, skus = catalogue
    choices = [*OPTIONS, "nowhere", None]
    mart = frame(
        [(f"u{i % 5}", None if i % 17 == 0 else "E", choices[i % len(choices)], f"ip{i % 3}", i % 4, i * 10,
          "B2C" if i % 3 else "B2B", "new" if i % 7 else "old") for i in range(200)],
        MART,
    )
    events = frame([("E", 1, "x"), ("E", 2, "x")], "event_id string, artist_id long, album_name string")
    mart.createOrReplaceTempView("m")
    events.createOrReplaceTempView("e")
    items.createOrReplaceTempView("i")
    skus.createOrReplaceTempView("s")
    joined = (
        "m LEFT JOIN i ON m.event_id = product_event_code AND option_code = product_option_id "
        "LEFT JOIN s ON i.sku_code = s.sku_code"
    )
    counts = options.sku_row_counts(items, skus)
    retail = mart_variants.mart_purchases(mart, None, ["B2C"], "new")
    both = mart_variants.mart_purchases(mart, None, ["B2C", "B2B"], "new")

    def want(keep, markets, vc):
        return rows(spark.sql(
            f"SELECT user_id, artist_id, m.event_id, option_code, sum(order_qty), "
            f"try_divide(sum(total_revenue), sum(order_qty)), {vc}, try_divide(sum(order_qty), {vc}) "
            f"FROM {joined} LEFT JOIN e ON m.event_id = e.event_id "
            f"WHERE market_type IN {markets} AND data_source = 'new' AND ({keep}) "
            f"GROUP BY user_id, artist_id, m.event_id, option_code"
        ))

    v2 = mart_variants.option_stats_v2(retail, events, counts)
    assert rows(v2) == want("sku_type = 'P' AND virtual_child_sku_count > 1", "('B2C')",
                            "max(virtual_child_sku_count)")
    v1 = mart_variants.option_stats_v1(both, events, counts)
    assert rows(v1) == want("sku_type IS NULL OR sku_type = 'P'", "('B2C', 'B2B')",
                            "coalesce(max(virtual_child_sku_count), 1)")
    bulk = mart_variants.bulk_ticket_buyers_v2(retail, counts, 5)
    assert rows(bulk) == rows(spark.sql(
        f"SELECT DISTINCT user_id FROM (SELECT user_id FROM {joined} WHERE market_type = 'B2C' "
        "AND data_source = 'new' AND m.event_id IS NOT NULL AND (sku_type IS NULL OR "
        "sku_type = 'C' OR (sku_type = 'P' AND coalesce(virtual_child_sku_count, 0) = 0)) "
        "GROUP BY user_id, m.event_id, option_code HAVING sum(order_qty) >= 5)"
    ))
    matched_only = mart_variants.bulk_ticket_buyers_v2(retail, counts, 1, unmatched_is_ticket=False)
    assert matched_only.count() <= bulk.count() + 5
