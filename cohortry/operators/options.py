"""Option catalogue, purchases per option, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import ratio
from cohortry.rules import (
    BEGINNER,
    CHALLENGER,
    CHILD_SKU,
    EVENT_OFFERS,
    PARENT_SKU,
    POCA_COLLECTOR,
    Rules,
)

OPTION = ["event_id", "option_code"]


def has_variety() -> Column:
    """A SKU of a random product: it names how many versions there are."""
    return (F.col("sku_type") == PARENT_SKU) & (F.col("vc") > 1)


def _is_ticket() -> Column:
    no_versions = F.coalesce(F.col("vc"), F.lit(0)) == 0
    return (
        F.col("sku_type").isNull()
        | (F.col("sku_type") == CHILD_SKU)
        | ((F.col("sku_type") == PARENT_SKU) & no_versions)
    )


def _sku_rows(items: DataFrame, skus: DataFrame, how: str) -> DataFrame:
    options = items.select(
        F.col("product_event_code").alias("event_id"),
        F.col("product_option_id").alias("option_code"),
        "sku_code",
    )
    kinds = skus.select("sku_code", "sku_type", F.col("virtual_child_sku_count").alias("vc"))
    return options.join(kinds, "sku_code", how).select(*OPTION, "sku_type", "vc")


def option_sku_matches(items: DataFrame, skus: DataFrame) -> DataFrame:
    """Options with each of their SKUs. An option repeats, so never join this to order lines."""
    return _sku_rows(items, skus, "inner")


def option_variety(matches: DataFrame) -> DataFrame:
    """Number of random versions of an option, one row per option that has any."""
    return matches.filter(has_variety()).groupBy(*OPTION).agg(F.max("vc").alias("vc"))


def option_is_ticket(matches: DataFrame) -> DataFrame:
    """Options sold as lottery tickets, one row each."""
    return matches.filter(_is_ticket()).select(*OPTION).distinct()


def option_catalog(matches: DataFrame) -> DataFrame:
    """Versions and ticket mark of every option in one row, so purchases are joined once."""
    return matches.groupBy(*OPTION).agg(
        F.max(F.when(has_variety(), F.col("vc"))).alias("vc"),
        F.max(F.coalesce(_is_ticket(), F.lit(False))).alias("is_ticket"),
    )


def sku_row_counts(items: DataFrame, skus: DataFrame, partitions: int | None = None) -> DataFrame:
    """How often a line of the option repeats in the older rule sets, which join SKUs to lines. With
    `partitions`, rows lie by option in that many."""
    parent = F.col("sku_type").isNull() | (F.col("sku_type") == PARENT_SKU)
    rows = _sku_rows(items, skus, "left")
    return (
        (rows if partitions is None else rows.repartition(partitions, *OPTION))
        .groupBy(*OPTION)
        .agg(
            F.count_if(has_variety()).alias("variety_rows"),
            F.max(F.when(has_variety(), F.col("vc"))).alias("vc"),
            F.count_if(_is_ticket()).alias("ticket_rows"),
            F.count_if(parent).alias("parent_rows"),
            F.max(F.when(parent, F.col("vc"))).alias("parent_vc"),
        )
    )


def option_purchases(lines: DataFrame) -> DataFrame:
    """Order lines summed per user, artist and option: the grain every label rule starts from.

    The only shuffle of the lines; partial sums first, so repeated buyers travel as one row. Only
    numbers are aggregated: a text such as the artist's name would turn the hash aggregate into a
    sort of all lines, and follows from the artist anyway.
    """
    return lines.groupBy("user_id", "artist_id", *OPTION).agg(
        F.sum("order_qty").alias("total_qty"),
        F.sum("total_revenue").alias("total_revenue"),
        F.max("order_qty").alias("max_qty"),
        F.count_if(F.col("offer_type").isin(*EVENT_OFFERS)).alias("event_lines"),
    )


def match_options(purchases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Purchases with the versions and ticket mark of their option. Both sides have one row a key."""
    return purchases.join(catalog, OPTION, "left")


def option_stats(matched: DataFrame) -> DataFrame:
    """Quantity, unit price and quantity per version for options with random versions."""
    return matched.filter(F.col("vc").isNotNull()).select(
        "user_id",
        "artist_id",
        *OPTION,
        "total_qty",
        ratio(F.col("total_revenue"), F.col("total_qty")).alias("unit_price"),
        "vc",
        ratio(F.col("total_qty"), F.col("vc")).alias("qty_ratio"),
    )


def bulk_ticket_buyers(matched: DataFrame, min_qty: int) -> DataFrame:
    """Users with many of one and the same ticket option."""
    return (
        matched.filter(F.col("is_ticket") & F.col("event_id").isNotNull())
        .groupBy("user_id", *OPTION)
        .agg(F.sum("total_qty").alias("qty"))
        .filter(F.col("qty") >= min_qty)
        .select("user_id")
        .distinct()
    )


def user_purchases(purchases: DataFrame) -> DataFrame:
    """Distinct artists, largest line and number of event lines per user."""
    artists = purchases.groupBy("user_id", "artist_id").agg(
        F.max("max_qty").alias("max_qty"), F.sum("event_lines").alias("event_lines")
    )
    return artists.groupBy("user_id").agg(
        F.count("artist_id").alias("distinct_artists"),
        F.max("max_qty").alias("max_qty"),
        F.sum("event_lines").alias("event_lines"),
    )


def price_tier_threshold(unit_price: Column, rules: Rules) -> Column:
    """Share of the versions a collector buys: the dearer the option, the smaller. Null is cheap."""
    threshold = F.lit(rules.lowest_tier_threshold)
    for floor, share in sorted(rules.price_tiers):
        threshold = F.when(unit_price >= floor, share).otherwise(threshold)
    return threshold


def label_options(
    stats: DataFrame,
    certain: DataFrame,
    rules: Rules,
    challenger_ratio: float | None = None,
    collector: str = POCA_COLLECTOR,
) -> DataFrame:
    """Label every user option. Users in `certain` (winners, bulk buyers) are always challengers."""
    limit = rules.challenger_ratio if challenger_ratio is None else challenger_ratio
    threshold = price_tier_threshold(F.col("unit_price"), rules)
    known = certain.select("user_id").distinct().withColumn("_certain", F.lit(True))
    label = (
        F.when(F.col("_certain") | (F.col("qty_ratio") > limit), CHALLENGER)
        .when(F.col("qty_ratio") >= threshold, collector)
        .otherwise(BEGINNER)
    )
    return (
        stats.join(known, "user_id", "left")
        .withColumn("option_label", label)
        .drop("_certain")
    )


def label_purchases(matched: DataFrame, certain: DataFrame, rules: Rules) -> DataFrame:
    """Purchases with their option's label, null for options without random versions."""
    measured = matched.withColumns(
        {
            "unit_price": ratio(F.col("total_revenue"), F.col("total_qty")),
            "qty_ratio": ratio(F.col("total_qty"), F.col("vc")),
        }
    )
    labelled = label_options(measured, certain, rules)
    return labelled.withColumn("option_label", F.when(F.col("vc").isNotNull(), F.col("option_label")))
