from datetime import datetime

import pytest

from cohortry.operators import scores
from tests.conftest import rows

MART = (
    "user_id string, order_no string, total_revenue long, event_id string, option_code string, "
    "order_qty long, ip_name string, market_type string, data_source string, pay_date date"
)


def mart_row(user="u", order="o1", revenue=10, event="e1", market="B2C", source="new"):
    return (user, order, revenue, event, "1", 1, "x", market, source, None)


def test_recency_counts_local_days(frame, rules):
    users = frame(
        [
            (1, datetime(2025, 6, 29, 14, 59), True, False),
            (2, datetime(2025, 6, 29, 15, 0), True, False),
            (3, datetime(2025, 6, 1), False, False),
            (4, datetime(2025, 6, 1), True, True),
            (5, None, True, False),
            (6, datetime(2025, 6, 1), None, False),
        ],
        "id long, last_login timestamp_ntz, is_certified boolean, is_withdrawn boolean",
    )
    assert rows(scores.recency(users, rules)) == [("1", 1), ("2", 0)]


ORDERS = "user_id string, artist_id long, album_name string, total_revenue long"


def test_frequency_worked_example(frame):
    orders = frame(
        [("a", 1, "x", 5), ("a", 1, "y", 5), ("a", 1, "z", 5), ("a", 1, "z", 5), ("a", 2, "x", 5),
         ("a", None, "q", 5), ("a", 3, None, 5), ("b", None, None, 7)],
        ORDERS,
    )
    assert rows(scores.frequency(orders), "user_id", "total_rounds", "total_artists", "f_raw") == [
        ("a", 4, 2, 2.0)
    ]
    assert rows(scores.monetary(orders)) == [("a", 35), ("b", 7)]


def test_one_pass_values_equal_the_separate_operators(frame):
    orders = frame(
        [(f"u{i % 7}", None if i % 5 == 0 else i % 4, None if i % 6 == 0 else f"al{i % 3}", i)
         for i in range(300)],
        ORDERS,
    )
    both = scores.frequency(orders).join(scores.monetary(orders), "user_id")
    names = ["user_id", "total_rounds", "total_artists", "f_raw", "m_raw"]
    assert rows(scores.order_values(orders), *names) == rows(both, *names)


def test_eligible_orders(frame):
    orders = frame(
        [mart_row("u"), mart_row("x"), mart_row(None), mart_row("u", market="ETC"),
         mart_row("u", source="old"), mart_row("u", event="e9", market="B2B")],
        MART,
    )
    events = frame([("e1", 4, "al")], "event_id string, artist_id long, album_name string")
    excluded = frame([("x",)], "user_id string")
    got = scores.eligible_orders(orders, events, excluded, ["B2C", "B2B"], "new")
    assert rows(got, "user_id", "event_id", "artist_id") == [("u", "e1", 4), ("u", "e9", None)]
    nobody = excluded.filter("false")
    assert scores.eligible_orders(orders, events, nobody, ["B2C"], None).count() == 3


def test_base_keeps_all_recency_users(frame):
    recent = frame([("a", 3), ("b", 4)], "user_id string, r_raw long")
    values = frame(
        [("a", 2, 1, 50, 2.0), ("z", 9, 9, 9, 1.0)],
        "user_id string, total_rounds long, total_artists long, m_raw long, f_raw double",
    )
    assert rows(scores.rfm_base(recent, values)) == [("a", 3, 2.0, 50, 2, 1), ("b", 4, 0.0, 0, 0, 0)]


def test_weights(frame):
    scored = frame(
        [("a", 5, 4, 1, 0, 1.0, 10), ("b", 1, 1, 5, 9, 1.5, 90), ("c", 2, 2, 2, 4, 9.0, 11)],
        "user_id string, r_score long, f_score long, m_score long, r_raw long, f_raw double, m_raw long",
    )
    got = rows(scores.weighted_rfm(scored, 0.5, 0.25, 0.25), "user_id", "rfm_weighted")
    assert got == [("a", 3.75), ("b", 2.0), ("c", 2.0)]
    weights = scores.entropy_weights(scored).first()
    assert sum(weights) == pytest.approx(1.0)
    # Spend sets one user apart from the rest, days since login spread evenly.
    assert weights["w_m"] > weights["w_f"] > weights["w_r"] > 0


def test_constant_column_weighs_nothing(spark):
    scored = spark.createDataFrame(
        [(1, 1, 1.0, 5.0), (2, 2, 1.0, 9.0), (3, 7, 1.0, 30.0)],
        "user_id long, r_raw long, f_raw double, m_raw double",
    )
    weights = scores.entropy_weights(scored).first()
    assert weights["w_f"] == 0 and abs(weights["w_r"] + weights["w_m"] - 1) < 1e-9
