"""Labels from option to artist to user, main artist, and the dimension table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.rules import (
    ALBUM_COLLECTOR,
    BEGINNER,
    CHALLENGER,
    COLLECTOR,
    NOT_CLASSIFIED,
    POCA_COLLECTOR,
    SHOPPER,
    Rules,
)

PRIORITY = (CHALLENGER, POCA_COLLECTOR, BEGINNER)
V1_PRIORITY = (CHALLENGER, COLLECTOR, BEGINNER)


def mode_with_priority(
    df: DataFrame, keys: Sequence[str], label: str, priority: Sequence[str], out: str
) -> DataFrame:
    """Most frequent label per key; of equally frequent ones the first in `priority`.

    `priority` names every label that occurs. One count per label, so one combined aggregate and
    neither a sort nor a list per group.
    """
    counts = df.groupBy(*keys).agg(*_label_counts(label, priority))
    return counts.select(*keys, _most_frequent(priority).alias(out))


def _label_counts(label: str, priority: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(label) == name).alias(f"_n{i}") for i, name in enumerate(priority)]


def _most_frequent(priority: Sequence[str]) -> Column:
    """The label of the highest of the counts, the first in `priority` of equal ones."""
    columns = [F.col(f"_n{i}") for i in range(len(priority))]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    chosen = F.lit(priority[-1])
    for count, name in reversed(list(zip(columns, priority))):
        chosen = F.when(count == best, name).otherwise(chosen)
    return chosen


def _any_label(priority: Sequence[str]) -> Column:
    return F.greatest(*[F.col(f"_n{i}") for i in range(len(priority))]) > 0


def artist_totals(labelled: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """One row per user and artist (null is one) with all that users are judged by: gmv, max_qty,
    event_lines and artist_label (null without labelled options).

    `labelled` has a row per user, artist and option. This is its only grouping; users follow from
    the artists' rows.
    """
    totals = labelled.groupBy("user_id", "artist_id").agg(
        F.sum("total_revenue").alias("gmv"),
        F.max("max_qty").alias("max_qty"),
        F.sum("event_lines").alias("event_lines"),
        *_label_counts("option_label", priority),
    )
    label = F.when(F.col("artist_id").isNotNull() & _any_label(priority), _most_frequent(priority))
    return totals.select("user_id", "artist_id", "gmv", "max_qty", "event_lines", label.alias("artist_label"))


def user_totals(totals: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """One row per user: distinct_artists, max_qty, event_lines, user_label (null without labelled
    artists) and top_gmv, the most spent on one artist. Numbers only, so no group is sorted."""
    known = F.col("artist_id").isNotNull()
    users = totals.groupBy("user_id").agg(
        F.count("artist_id").alias("distinct_artists"),
        F.max("max_qty").alias("max_qty"),
        F.sum("event_lines").alias("event_lines"),
        F.max(F.when(known, F.col("gmv"))).alias("top_gmv"),
        *_label_counts("artist_label", priority),
    )
    label = F.when(_any_label(priority), _most_frequent(priority))
    return users.select(
        "user_id", "distinct_artists", "max_qty", "event_lines", "top_gmv", label.alias("user_label")
    )


def main_artist_of(totals: DataFrame, users: DataFrame, names: DataFrame) -> DataFrame:
    """The artist each user spent most on, the lowest id of equal ones.

    In two steps on numbers: the highest spend, known from `users`, and then the least id of the
    artists that reach it. Both tables lie by user, so their join moves nothing.
    """
    best = (
        totals.filter(F.col("artist_id").isNotNull())
        .join(users.select("user_id", "top_gmv"), "user_id")
        .filter(F.col("gmv").eqNullSafe(F.col("top_gmv")))
        .groupBy("user_id")
        .agg(F.min("artist_id").alias("artist_id"), F.max("gmv").alias("gmv"))
    )
    return main_artist_columns(best.join(names, "artist_id", "left"))


def artist_labels(labelled: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """Label per user and artist from the user's option labels."""
    known = labelled.filter(F.col("artist_id").isNotNull())
    return mode_with_priority(
        known, ["user_id", "artist_id"], "option_label", priority, "artist_label"
    )


def user_labels(by_artist: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """Label per user from the user's artist labels."""
    return mode_with_priority(by_artist, ["user_id"], "artist_label", priority, "user_label")


def final_dimension(
    purchases: DataFrame, labels: DataFrame, certain: DataFrame, rules: Rules, variant: str = "v3"
) -> DataFrame:
    """One purchase label per buyer; the first rule that holds decides.

    `certain` holds the winners and bulk buyers. Variant "v2" caps album collectors differently
    and leaves event buyers without an option label unclassified.
    """
    if variant not in ("v2", "v3"):
        raise ValueError(f"unknown variant {variant!r}")
    known = certain.select("user_id").distinct().withColumn("_certain", F.lit(True))
    few_each = (
        F.col("max_qty") <= rules.album_max_qty
        if variant == "v3"
        else F.col("max_qty") < rules.v2_album_qty_below
    )
    label = (
        F.when((F.col("user_label") == CHALLENGER) | F.col("_certain"), CHALLENGER)
        .when((F.col("distinct_artists") >= rules.album_min_artists) & few_each, ALBUM_COLLECTOR)
        .when(F.col("user_label") == POCA_COLLECTOR, POCA_COLLECTOR)
        .when(F.col("event_lines") == 0, SHOPPER)
    )
    if variant == "v2":
        label = label.when(F.col("user_label").isNull() & (F.col("event_lines") > 0), NOT_CLASSIFIED)
    return (
        purchases.join(labels, "user_id", "left")
        .join(known, "user_id", "left")
        .select("user_id", label.otherwise(BEGINNER).alias("dimension_label"))
    )


def top_artist(spent: DataFrame) -> DataFrame:
    """The row of highest `gmv` per user; of equal ones the lowest artist id. Null comes last."""
    order = F.struct(F.col("gmv").isNull(), -F.col("gmv"), F.col("artist_id"))
    rest = [name for name in spent.columns if name != "user_id"]
    top = spent.groupBy("user_id").agg(F.min_by(F.struct(*rest), order).alias("top"))
    return top.select("user_id", "top.*")


def main_artist(purchases: DataFrame, names: DataFrame) -> DataFrame:
    """The artist each user spent most on."""
    spent = (
        purchases.filter(F.col("artist_id").isNotNull())
        .groupBy("user_id", "artist_id")
        .agg(F.sum("total_revenue").alias("gmv"))
    )
    return main_artist_columns(top_artist(spent).join(names, "artist_id", "left"))


def main_artist_columns(top: DataFrame) -> DataFrame:
    return top.select(
        "user_id",
        F.col("artist_id").alias("main_artist_id"),
        F.col("artist_name").alias("main_artist_name"),
        F.col("gmv").alias("main_artist_gmv"),
    )


def user_dimension(dimension: DataFrame, artist: DataFrame) -> DataFrame:
    """Purchase label and main artist per user."""
    return dimension.join(artist, "user_id", "left")
