"""Recency, frequency and monetary values per user, and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import local_date, ratio
from cohortry.functions.ranks import ntile_scores
from cohortry.functions.staging import without_users
from cohortry.rules import Rules


def recency(users: DataFrame, rules: Rules) -> DataFrame:
    """Days since the last login of certified users who have not left."""
    active = users.filter(
        F.col("last_login").isNotNull() & F.col("is_certified") & ~F.col("is_withdrawn")
    )
    days = F.datediff(F.lit(rules.as_of), local_date(users, "last_login", rules.tz))
    return active.select(F.col("id").cast("string").alias("user_id"), days.cast("long").alias("r_raw"))


def market_orders(orders: DataFrame, markets: Sequence[str], source: str | None) -> DataFrame:
    """Mart order lines of the given markets, optionally from one order source only."""
    kept = orders.filter(F.col("market_type").isin(*markets))
    return kept if source is None else kept.filter(F.col("data_source") == source)


def with_event(orders: DataFrame, events: DataFrame, how: str = "left") -> DataFrame:
    """Add the artist and album of each line's event."""
    return orders.join(events.select("event_id", "artist_id", "album_name"), "event_id", how)


def eligible_orders(
    orders: DataFrame,
    events: DataFrame,
    excluded: DataFrame | None,
    markets: Sequence[str],
    source: str | None = None,
) -> DataFrame:
    """Order lines that count for the scores, with artist and album."""
    lines = market_orders(without_users(orders, excluded), markets, source)
    return with_event(lines, events).select(
        "user_id", "order_no", "total_revenue", "event_id", "artist_id", "album_name"
    )


def event_spend(orders: DataFrame) -> DataFrame:
    """Spend per user and event: what `order_values` needs of the lines, before events are joined."""
    return orders.groupBy("user_id", "event_id").agg(F.sum("total_revenue").alias("total_revenue"))


def order_values(orders: DataFrame) -> DataFrame:
    """Frequency and monetary value per user in one pass over the order lines.

    Grouping level by level (album, artist, user) combines on the map side each time, so a user
    with very many lines arrives as few rows, and distinct counts need no row duplication.
    """
    albums = orders.groupBy("user_id", "artist_id", "album_name").agg(
        F.sum("total_revenue").alias("spent")
    )
    album_of_artist = F.when(F.col("artist_id").isNotNull(), F.col("album_name"))
    artists = albums.groupBy("user_id", "artist_id").agg(
        F.count(album_of_artist).alias("rounds"), F.sum("spent").alias("spent")
    )
    users = artists.groupBy("user_id").agg(
        F.sum("rounds").alias("total_rounds"),
        F.count_if(F.col("rounds") > 0).alias("total_artists"),
        F.sum("spent").alias("m_raw"),
    )
    return users.withColumn("f_raw", ratio(F.col("total_rounds"), F.col("total_artists")))


def frequency(orders: DataFrame) -> DataFrame:
    """Rounds per artist: distinct (artist, album) pairs over distinct artists."""
    known = orders.filter(F.col("artist_id").isNotNull() & F.col("album_name").isNotNull())
    rounds = known.select("user_id", "artist_id", "album_name").distinct()
    artists = rounds.groupBy("user_id", "artist_id").agg(F.count("*").alias("rounds"))
    users = artists.groupBy("user_id").agg(
        F.sum("rounds").alias("total_rounds"), F.count("*").alias("total_artists")
    )
    return users.withColumn("f_raw", ratio(F.col("total_rounds"), F.col("total_artists")))


def monetary(orders: DataFrame) -> DataFrame:
    """Sum of payments per user."""
    return orders.groupBy("user_id").agg(F.sum("total_revenue").alias("m_raw"))


def rfm_base(recent: DataFrame, *values: DataFrame) -> DataFrame:
    """Every recency user with F and M values; users without orders get 0."""
    base = recent
    for part in values:
        base = base.join(part, "user_id", "left")
    return base.select(
        "user_id",
        "r_raw",
        *[
            F.coalesce(F.col(name), F.lit(0)).alias(name)
            for name in ("f_raw", "m_raw", "total_rounds", "total_artists")
        ],
    )


def ntile_score(
    df: DataFrame, value: str, k: int, id: str = "user_id", reverse: bool = False
) -> DataFrame:
    """Exact k-tile of `value` over the whole table as column `<value>_tile`."""
    return ntile_scores(df, {f"{value}_tile": (value, reverse)}, k, id)


def rfm_score(base: DataFrame, k: int = 5) -> DataFrame:
    """Scores 1..k of paying users: few days since login, many rounds and high spend score high."""
    scored = ntile_scores(
        base.filter(F.col("m_raw") > 0),
        {"r_score": ("r_raw", True), "f_score": ("f_raw", False), "m_score": ("m_raw", False)},
        k,
    )
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.withColumn("rfm_total_raw", total)


def weighted_rfm(scored: DataFrame, w_r: float, w_f: float, w_m: float) -> DataFrame:
    """Weighted sum of the three scores."""
    weighted = F.col("r_score") * w_r + F.col("f_score") * w_f + F.col("m_score") * w_m
    return scored.withColumn("rfm_weighted", weighted)


def entropy_weights(scored: DataFrame) -> DataFrame:
    """Weights by the entropy method: a value that sets users further apart weighs more.

    Values are scaled to 0..1 with 1 the best (days since login run back). Two aggregates, one row.
    """
    names = ("r_raw", "f_raw", "m_raw")
    bounds = scored.agg(
        F.count("*").alias("n"),
        *[F.min(name).cast("double").alias(f"{name}_min") for name in names],
        *[F.max(name).cast("double").alias(f"{name}_max") for name in names],
    ).first()

    def scaled(name: str) -> Column:
        low, high = bounds[f"{name}_min"], bounds[f"{name}_max"]
        gap = F.col(name) - low if name != "r_raw" else high - F.col(name)
        return F.try_divide(gap.cast("double"), F.lit(high) - F.lit(low))

    sums = scored.agg(
        *[F.sum(scaled(name)).alias(f"{name}_sum") for name in names],
        *[
            F.sum(F.when(scaled(name) > 0, scaled(name) * F.log(scaled(name))).otherwise(0.0)).alias(
                f"{name}_log"
            )
            for name in names
        ],
    )

    def spread(name: str) -> Column:
        total = F.col(f"{name}_sum")
        entropy = F.log(total) - F.try_divide(F.col(f"{name}_log"), total)
        return 1.0 - F.try_divide(entropy, F.log(F.lit(bounds["n"])))

    # A column that is the same for all tells nobody apart and weighs nothing.
    spreads = sums.select(*[F.coalesce(spread(name), F.lit(0.0)).alias(name) for name in names])
    everything = F.col("r_raw") + F.col("f_raw") + F.col("m_raw")
    return spreads.select(
        *[F.try_divide(F.col(name), everything).alias("w_" + name[0]) for name in names]
    )
