"""Checks on the intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import ratio
from cohortry.operators.options import OPTION, has_variety


def fanout_check(lines: DataFrame, matches: DataFrame, purchases: DataFrame) -> DataFrame:
    """Quantity per option as bought, as a join of order lines with SKUs would count it, and as the
    label rules do count it.

    `purchases` is the table the labels are made from, `lines` what it was summed from; `agrees` is
    false where the two differ. All sides are summed per option first, so repeated lines are never
    produced.
    """
    rows = matches.filter(has_variety()).groupBy(*OPTION).agg(F.count("*").alias("sku_rows"))
    bought = lines.groupBy(*OPTION).agg(F.sum("order_qty").alias("option_qty"))
    counted = purchases.groupBy(*OPTION).agg(F.sum("total_qty").alias("counted_qty"))
    return bought.join(rows, OPTION).join(counted, OPTION, "left").select(
        *OPTION,
        "sku_rows",
        "option_qty",
        (F.col("option_qty") * F.col("sku_rows")).alias("sku_qty"),
        (F.col("sku_rows") > 1).alias("fans_out"),
        "counted_qty",
        F.col("option_qty").eqNullSafe(F.col("counted_qty")).alias("agrees"),
    )


def variety_coverage(variety: DataFrame, candidate: DataFrame) -> DataFrame:
    """How far another source of version counts covers and agrees with the one in use.

    `candidate` has one row per option with its count in `candidate_vc`.
    """
    both = variety.join(candidate.select(*OPTION, "candidate_vc"), OPTION, "left")
    counts = both.agg(
        F.count("*").alias("options"),
        F.count("candidate_vc").alias("covered"),
        F.count_if(F.col("vc") == F.col("candidate_vc")).alias("agreeing"),
    )
    return counts.withColumns(
        {
            "coverage": ratio(F.col("covered"), F.col("options")),
            "agreement": ratio(F.col("agreeing"), F.col("covered")),
        }
    )


def partition_check(dimension: DataFrame) -> DataFrame:
    """Whether every user has exactly one label."""
    users = dimension.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count("dimension_label").alias("labels")
    )
    return users.agg(
        F.count("*").alias("users"),
        F.count_if((F.col("n") == 1) & (F.col("labels") == 1)).alias("one_label"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("labels") == 0).alias("unlabelled"),
    )
