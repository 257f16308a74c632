from datetime import date, datetime

from cohortry.operators import crm
from tests.conftest import rows

SCORE = "user_id string, r_raw long, f_raw double, m_raw long, r_score long, f_score long, m_score long"
LABELS = (
    "user_id string, dimension_label string, main_artist_id long, main_artist_name string, "
    "main_artist_gmv long"
)
MART = (
    "user_id string, order_no string, total_revenue double, market_type string, data_source string, "
    "pay_date timestamp_ntz"
)


def test_segment(frame, rules):
    score = frame([("a", 1, 1.0, 5, 5, 4, 3), ("b", 9, 0.0, 1, 1, 1, 1)], SCORE)
    labels = frame([("a", "Shopper", 1, "x", 5), ("z", "Shopper", 1, "x", 5)], LABELS)
    got = crm.user_segment(score, labels, rules)
    assert rows(got, "user_id", "rfm_total", "dimension_label", "main_artist_gmv") == [
        ("a", 12, "Shopper", 5), ("b", 3, "Beginner", None)
    ]
    assert got.first()["updated_at"] == rules.run_ts
    from dataclasses import replace

    unlabelled = crm.user_segment(score, labels, replace(rules, default_label=None))
    assert rows(unlabelled, "user_id", "dimension_label") == [("a", "Shopper"), ("b", None)]


def mart(frame):
    def row(user, order, amount, day, market="B2C", source="new"):
        return (user, order, amount, market, source, datetime(*day))

    return frame(
        [row("1", "o1", 10.0, (2025, 1, 31, 23)), row("1", "o1", 0.5, (2025, 1, 31)),
         row("1", "o2", 4.5, (2025, 3, 1)), row("1", "o3", 2.0, (2025, 3, 9)),
         row("1", "o9", 99.0, (2025, 3, 9), "B2B"), row("1", "o8", 99.0, (2025, 3, 9), source="old"),
         row("x", "o4", 1.0, (2025, 1, 1)), row(None, "o5", 1.0, (2025, 1, 1))],
        MART,
    )


def test_purchase_stats(frame, rules):
    excluded = frame([("x",)], "user_id string")
    assert rows(crm.purchase_stats(mart(frame), excluded, rules)) == [
        ("1", date(2025, 1, 31), date(2025, 3, 9), 3, 17.0, 6.0, 2)
    ]


def test_customer_table(frame, rules):
    users = frame(
        [(1, "a@x", "APP", datetime(2025, 1, 1, 15), datetime(2025, 1, 2, 15), True, False, True),
         (2, "b@x", "WEB", datetime(2025, 1, 1), None, True, True, False),
         (3, "c@x", "WEB", datetime(2025, 1, 1), None, False, False, True)],
        "id long, email string, created_from string, created_at timestamp_ntz, last_login timestamp_ntz, "
        "is_certified boolean, is_withdrawn boolean, is_active boolean",
    )
    info = frame([(1, "KR", 1, datetime(1990, 5, 5, 16))],
                 "user_id long, country_code string, gender_type long, birth timestamp_ntz")
    profile = crm.user_profile(users, info, rules)
    assert rows(profile, "user_id", "signup_date", "last_login", "birth_date", "is_withdrawn") == [
        ("1", date(2025, 1, 2), date(2025, 1, 3), date(1990, 5, 6), False),
        ("2", date(2025, 1, 1), None, None, True),
    ]
    score = frame([("1", 1, 1.0, 5, 5, 4, 3)], SCORE)
    labels = frame([("1", "Shopper", 1, "x", 5)], LABELS)
    got = crm.crm_users(profile, score, labels, crm.purchase_stats(mart(frame), None, rules), rules)
    assert len(got.columns) == 28
    names = ["user_id", "total_orders", "total_gmv", "avg_order_value", "active_months", "r_score",
             "rfm_total", "dimension_label", "first_purchase_date"]
    assert rows(got, *names) == [
        ("1", 3, 17.0, 6.0, 2, 5, 12, "Shopper", date(2025, 1, 31)),
        ("2", 0, 0.0, 0.0, 0, None, None, "Beginner", None),
    ]
