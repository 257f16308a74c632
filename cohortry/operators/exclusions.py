"""Users whose purchases say nothing about themselves: staff, and those who buy for others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import json_texts, plain_date, strip
from cohortry.operators.scores import market_orders, with_event
from cohortry.rules import Rules


def shared_address_buyers(orders: DataFrame, rules: Rules) -> DataFrame:
    """Users with several customer codes at one and the same shipping address."""
    paid = orders.filter(
        F.col("payment_status").isin(*rules.paid_payments)
        & F.col("user_id").isNotNull()
        & F.col("shipping_information").isNotNull()
    )
    shipping = paid.select(
        "user_id",
        *json_texts(orders, "shipping_information", "information", ["address", "detail_address"]),
    ).select(
        "user_id",
        strip(F.col("address")).alias("address"),
        strip(F.col("detail_address")).alias("code"),
    )
    # The tests stay inside the aggregate: as a filter they would be pushed down to the documents,
    # and every document parsed once per test.
    named = F.when((F.col("address") != "") & (F.col("code") != ""), F.col("code"))
    return (
        shipping.groupBy("user_id", "address")
        .agg(F.count_distinct(named).alias("codes"))
        .filter(F.col("codes") >= rules.agent_min_codes)
        .select(F.col("user_id").cast("string").alias("user_id"))
        .distinct()
    )


def multi_artist_buyers(orders: DataFrame, events: DataFrame, rules: Rules) -> DataFrame:
    """Retail users who bought from several artists since a given day."""
    recent = market_orders(orders, rules.retail_markets, None).filter(
        (plain_date(orders, "pay_date") >= F.lit(rules.agent_since)) & F.col("user_id").isNotNull()
    )
    known = events.filter(F.col("artist_id").isNotNull())
    return (
        with_event(recent.select("user_id", "event_id").distinct(), known, "inner")
        .groupBy("user_id")
        .agg(F.count_distinct("artist_id").alias("artists"))
        .filter(F.col("artists") >= rules.agent_min_artists)
        .select("user_id")
    )


def purchasing_agents(shared_address: DataFrame, multi_artist: DataFrame) -> DataFrame:
    """Users found by both tests."""
    return shared_address.join(multi_artist, "user_id", "left_semi").distinct()


def excluded_users(internal: DataFrame, agents: DataFrame) -> DataFrame:
    """Internal accounts and purchasing agents, each user once."""
    both = internal.select("user_id").unionByName(agents.select("user_id"))
    return both.filter(F.col("user_id").isNotNull()).distinct()
