"""The two older rule sets, which read the order mart instead of the order documents.

They join SKUs to order lines, so a line counts once per matching SKU. The counts per option are
known beforehand (`sku_row_counts`): quantities are summed first and then multiplied, which gives
the same numbers without ever repeating a line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import ratio
from cohortry.functions.staging import without_users
from cohortry.operators.options import OPTION, label_options
from cohortry.operators.rollup import (
    V1_PRIORITY,
    artist_labels,
    main_artist_columns,
    top_artist,
    user_labels,
)
from cohortry.operators.scores import market_orders, with_event
from cohortry.rules import COLLECTOR, Rules


def mart_purchases(
    orders: DataFrame, excluded: DataFrame | None, markets: Sequence[str], source: str | None
) -> DataFrame:
    """Mart lines summed per user, option and artist name."""
    purchases = (
        market_orders(orders, markets, source)
        .groupBy("user_id", *OPTION, "ip_name")
        .agg(
            F.sum("order_qty").alias("total_qty"),
            F.sum("total_revenue").alias("total_revenue"),
            F.max("order_qty").alias("max_qty"),
            F.count_if(F.col("event_id") != "").alias("event_lines"),
        )
    )
    return purchases if excluded is None else without_users(purchases, excluded)


def _per_option(purchases: DataFrame, events: DataFrame) -> DataFrame:
    by_artist = with_event(purchases, events).groupBy("user_id", "artist_id", *OPTION)
    return by_artist.agg(
        F.sum("total_qty").alias("total_qty"), F.sum("total_revenue").alias("total_revenue")
    )


def _stats(options: DataFrame, rows: str, vc: str) -> DataFrame:
    quantity = F.col("total_qty") * F.col(rows)
    return options.filter(F.col(rows) > 0).select(
        "user_id",
        "artist_id",
        *OPTION,
        quantity.alias("total_qty"),
        ratio(F.col("total_revenue") * F.col(rows), quantity).alias("unit_price"),
        F.col(vc).alias("vc"),
        ratio(quantity, F.col(vc)).alias("qty_ratio"),
    )


def option_stats_v2(purchases: DataFrame, events: DataFrame, counts: DataFrame) -> DataFrame:
    """Quantities of options with random versions, counted once per matching SKU."""
    options = _per_option(purchases, events).join(counts, OPTION)
    return _stats(options, "variety_rows", "vc")


def option_stats_v1(purchases: DataFrame, events: DataFrame, counts: DataFrame) -> DataFrame:
    """Quantities of all options but those with child SKUs only; unknown versions count as one."""
    options = _per_option(purchases, events).join(counts, OPTION, "left")
    filled = options.withColumns(
        {
            "parent_rows": F.coalesce(F.col("parent_rows"), F.lit(1)),
            "parent_vc": F.coalesce(F.col("parent_vc"), F.lit(1)),
        }
    )
    return _stats(filled, "parent_rows", "parent_vc")


def bulk_ticket_buyers_v2(
    purchases: DataFrame, counts: DataFrame, min_qty: int, unmatched_is_ticket: bool = True
) -> DataFrame:
    """Users with many of one ticket option, counted once per matching SKU.

    An option without any SKU counts as a ticket here.
    """
    known = purchases.filter(F.col("event_id").isNotNull())
    options = known.groupBy("user_id", *OPTION).agg(F.sum("total_qty").alias("qty"))
    rows = F.coalesce(F.col("ticket_rows"), F.lit(1 if unmatched_is_ticket else 0))
    return (
        options.join(counts, OPTION, "left")
        .filter((rows > 0) & (F.col("qty") * rows >= min_qty))
        .select("user_id")
        .distinct()
    )


def user_purchases_v2(purchases: DataFrame) -> DataFrame:
    """As `user_purchases`, by artist name, with any event id making an event line."""
    names = purchases.groupBy("user_id", "ip_name").agg(
        F.max("max_qty").alias("max_qty"), F.sum("event_lines").alias("event_lines")
    )
    return names.groupBy("user_id").agg(
        F.count("ip_name").alias("distinct_artists"),
        F.max("max_qty").alias("max_qty"),
        F.sum("event_lines").alias("event_lines"),
    )


def main_artist_v2(purchases: DataFrame, events: DataFrame) -> DataFrame:
    """The artist each user spent most on, by the event's artist, under the mart's artist name."""
    spent = (
        with_event(purchases, events)
        .filter(F.col("artist_id").isNotNull())
        .groupBy("user_id", "artist_id")
        .agg(F.max("ip_name").alias("artist_name"), F.sum("total_revenue").alias("gmv"))
    )
    return main_artist_columns(top_artist(spent))


def final_dimension_v1(stats: DataFrame, winners: DataFrame, rules: Rules) -> DataFrame:
    """First rule set: the user's most frequent label is the dimension."""
    labelled = label_options(stats, winners, rules, rules.v1_challenger_ratio, COLLECTOR)
    labels = user_labels(artist_labels(labelled, V1_PRIORITY), V1_PRIORITY)
    return labels.withColumnRenamed("user_label", "dimension_label")
