"""Merged segment table and wide customer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import local_date, plain_date, ratio, round_half_away
from cohortry.functions.staging import without_users
from cohortry.operators.scores import market_orders
from cohortry.rules import Rules


def _label(default: str | None) -> Column:
    label = F.col("dimension_label")
    return label if default is None else F.coalesce(label, F.lit(default)).alias("dimension_label")


def _updated_at(rules: Rules) -> Column:
    return F.lit(rules.run_ts.isoformat(sep=" ")).cast("timestamp_ntz").alias("updated_at")


def _total() -> Column:
    return (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total")


def user_segment(score: DataFrame, dimension: DataFrame, rules: Rules) -> DataFrame:
    """Scores with purchase label and main artist, one row per scored user."""
    return score.join(dimension, "user_id", "left").select(
        "user_id",
        "r_raw",
        "f_raw",
        "m_raw",
        "r_score",
        "f_score",
        "m_score",
        _total(),
        _label(rules.default_label),
        "main_artist_id",
        "main_artist_name",
        "main_artist_gmv",
        _updated_at(rules),
    )


def user_profile(users: DataFrame, info: DataFrame, rules: Rules) -> DataFrame:
    """Certified users, those who left included, with local dates and demographics."""
    person = info.select(
        F.col("user_id").alias("id"),
        "country_code",
        "gender_type",
        local_date(info, "birth", rules.tz).alias("birth_date"),
    )
    account = users.filter(F.col("is_certified")).select(
        "id",
        "email",
        "created_from",
        local_date(users, "created_at", rules.tz).alias("signup_date"),
        local_date(users, "last_login", rules.tz).alias("last_login"),
        "is_withdrawn",
        "is_active",
    )
    return account.join(person, "id", "left").select(
        F.col("id").cast("string").alias("user_id"),
        "email",
        "created_from",
        "signup_date",
        "last_login",
        "birth_date",
        "country_code",
        "gender_type",
        "is_withdrawn",
        "is_active",
    )


def purchase_stats(orders: DataFrame, excluded: DataFrame | None, rules: Rules) -> DataFrame:
    """First and last day, orders, spend and active months of retail buyers.

    Lines are summed per order and month first, so that distinct counts repeat few rows. Users are
    dropped after the aggregate, when there is one row each.
    """
    lines = market_orders(orders, rules.retail_markets, rules.order_source)
    day = plain_date(orders, "pay_date")
    spent, count = F.col("spent"), F.col("total_orders")
    months = lines.groupBy("user_id", "order_no", F.trunc(day, "MONTH").alias("month")).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.sum("total_revenue").alias("spent")
    )
    users = months.groupBy("user_id").agg(
        F.min("first_day").alias("first_purchase_date"),
        F.max("last_day").alias("last_purchase_date"),
        F.count_distinct("order_no").alias("total_orders"),
        F.sum("spent").alias("spent"),
        F.count_distinct("month").alias("active_months"),
    )
    kept = users if excluded is None else without_users(users, excluded)
    return kept.select(
        "user_id",
        "first_purchase_date",
        "last_purchase_date",
        "total_orders",
        round_half_away(spent).alias("total_gmv"),
        round_half_away(ratio(spent, count)).alias("avg_order_value"),
        "active_months",
    )


def crm_users(
    profile: DataFrame, score: DataFrame, dimension: DataFrame, stats: DataFrame, rules: Rules
) -> DataFrame:
    """Every certified user with purchases, scores and label. All joins share one key."""
    wide = (
        profile.join(score.select("user_id", "r_raw", "f_raw", "m_raw", "r_score", "f_score", "m_score"), "user_id", "left")
        .join(dimension, "user_id", "left")
        .join(stats, "user_id", "left")
    )
    bought = ("total_orders", "total_gmv", "avg_order_value", "active_months")
    return wide.select(
        *profile.columns,
        "first_purchase_date",
        "last_purchase_date",
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in bought],
        "r_raw",
        "f_raw",
        "m_raw",
        "r_score",
        "f_score",
        "m_score",
        _total(),
        _label(rules.customer_default_label),
        "main_artist_id",
        "main_artist_name",
        "main_artist_gmv",
        _updated_at(rules),
    )
