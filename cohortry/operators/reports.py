"""Aggregate reports on the segment and customer tables.

Every report groups first; totals, shares and orderings then work on the few rows that are left. A
grouped report is stated once, as keys, figures and what is done with its rows. It can be made alone,
or with all others of its table by grouping sets, which read the table once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import ratio, round_half_away
from cohortry.functions.staging import stage
from cohortry.rules import CHALLENGER

# Upper ends of the score and recency bands.
RFM_BANDS = ((3, "Hibernating"), (6, "At Risk"), (9, "Potential"), (12, "Loyal"), (15, "Champions"))
RECENCY_BANDS = ((30, "0-30"), (90, "31-90"), (180, "91-180"), (365, "181-365"), (None, "366+"))


def _avg(name: str, digits: int = 0) -> Column:
    return round_half_away(F.avg(name), digits)


def _share(counts: DataFrame) -> DataFrame:
    """Percent of all users, over the already grouped rows."""
    total = F.sum("user_cnt").over(Window.partitionBy())
    return counts.withColumn("pct", ratio(F.col("user_cnt") * 100, total))


def _band(value: Column, bands: Sequence[tuple[int | None, str]]) -> Column:
    label = F.lit(None).cast("string")
    for top, name in reversed(bands):
        label = F.lit(name) if top is None else F.when(value <= top, name).otherwise(label)
    return label


#: Keys that are made from columns of the table.
_BANDS = {"rfm_band": ("rfm_total", RFM_BANDS), "recency_band": ("r_raw", RECENCY_BANDS)}


@dataclass(frozen=True)
class Report:
    """Figures per group of `keys`; `finish` is what is done with the grouped rows."""

    keys: tuple[str, ...]
    figures: Callable[[], dict[str, Column]]
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bands = {k: _band(F.col(_BANDS[k][0]), _BANDS[k][1]) for k in keys if k in _BANDS}
    return df.withColumns(bands) if bands else df


def made(df: DataFrame, report: Report) -> DataFrame:
    """One report."""
    figures = [figure.alias(name) for name, figure in report.figures().items()]
    return report.finish(_keyed(df, report.keys).groupBy(*report.keys).agg(*figures))


def made_together(df: DataFrame, reports: Mapping[str, Report]) -> dict[str, DataFrame]:
    """All reports of one table, by name. It is read once; what is staged has one row per group."""
    keys = list(dict.fromkeys(key for report in reports.values() for key in report.keys))
    sets = list(dict.fromkeys(frozenset(report.keys) for report in reports.values()))
    # The grouping id has a bit per key, the first key's the highest, set where a row is not grouped by it.
    numbers = {s: sum((key not in s) << k for k, key in enumerate(reversed(keys))) for s in sets}
    grouped = (
        _keyed(df, keys)
        .groupingSets([[F.col(key) for key in keys if key in s] for s in sets], *keys)
        .agg(
            F.grouping_id().alias("_set"),
            *[
                figure.alias(f"{name}__{column}")
                for name, report in reports.items()
                for column, figure in report.figures().items()
            ],
        )
    )
    held = stage(grouped, "reports")
    return {
        name: report.finish(
            held.filter(F.col("_set") == numbers[frozenset(report.keys)]).select(
                *report.keys, *[F.col(f"{name}__{column}").alias(column) for column in report.figures()]
            )
        )
        for name, report in reports.items()
    }


def scored_users(crm: DataFrame) -> DataFrame:
    """Customers with scores, that is buyers."""
    return crm.filter(F.col("r_score").isNotNull())


def _users_and(figures: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
    return lambda: {"user_cnt": F.count("*"), **figures()}


def _spend() -> dict[str, Column]:
    return {"avg_gmv": _avg("m_raw")}


def _largest(k: int) -> Callable[[DataFrame], DataFrame]:
    def finish(rows: DataFrame) -> DataFrame:
        known = rows.filter(F.col("main_artist_name").isNotNull())
        return known.orderBy(F.desc("user_cnt"), "main_artist_name", "dimension_label").limit(k)

    return finish


def _best_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("avg_rfm"), "dimension_label")


_SCORES = ("r_score", "f_score", "m_score")
_DETAIL = ("dimension_label", *_SCORES, "rfm_total", "main_artist_name")

DETAIL = Report(
    _DETAIL,
    _users_and(
        lambda: {
            "avg_days_since_login": _avg("r_raw"),
            "avg_rounds_per_artist": _avg("f_raw", 1),
            "avg_gmv": _avg("m_raw"),
            "avg_rfm_total": _avg("rfm_total", 1),
        }
    ),
    lambda rows: rows.orderBy(F.desc("avg_rfm_total"), *_DETAIL),
)


def _summary(top_score: int = 5) -> Report:
    return Report(
        ("dimension_label",),
        _users_and(
            lambda: {
                "avg_rfm": _avg("rfm_total", 1),
                "avg_gmv": _avg("m_raw"),
                "avg_days_since_login": _avg("r_raw"),
                "avg_rounds_per_artist": _avg("f_raw", 1),
                "pct_active": ratio(F.count_if(F.col("r_score") == top_score) * 100, F.count("*")),
            }
        ),
        _best_first,
    )


DISTRIBUTION = Report(_SCORES, _users_and(dict), lambda rows: rows.orderBy(*_SCORES))
RFM_BAND = Report(("rfm_band",), _users_and(_spend), lambda rows: rows.withColumnRenamed("rfm_band", "band"))
RECENCY_BAND = Report(
    ("recency_band",), _users_and(_spend), lambda rows: _share(rows.withColumnRenamed("recency_band", "band"))
)
CHECK = Report(
    ("dimension_label",),
    _users_and(lambda: {"avg_rfm": _avg("rfm_total", 1), "avg_gmv": _avg("total_gmv")}),
    _best_first,
)
SHARE = Report(
    ("dimension_label",),
    _users_and(
        lambda: {
            "avg_rfm": _avg("rfm_total", 1),
            "avg_gmv": _avg("m_raw"),
            "avg_days_since_login": _avg("r_raw"),
        }
    ),
    _share,
)
SIGNUP = Report(("created_from",), _users_and(_spend), _share)
COUNTRY = Report(("country_code",), _users_and(_spend), _share)


def _top_artists(k: int = 20) -> Report:
    return Report(("main_artist_name", "dimension_label"), _users_and(_spend), _largest(k))


def segment_reports(segment: DataFrame) -> dict[str, DataFrame]:
    """All reports on the segment table, by one scan of it."""
    return made_together(
        segment,
        {
            "summary": _summary(),
            "detail": DETAIL,
            "score_distribution": DISTRIBUTION,
            "top_artists": _top_artists(),
            "rfm_bands": RFM_BAND,
            "recency_bands": RECENCY_BAND,
        },
    )


def customer_reports(crm: DataFrame) -> dict[str, DataFrame]:
    """All reports on the scored users of the customer table, by one scan of it."""
    return made_together(
        scored_users(crm),
        {
            "segment_check": CHECK,
            "dimension_share": SHARE,
            "by_signup_service": SIGNUP,
            "by_country": COUNTRY,
            "main_artists": _top_artists(),
        },
    )


def segment_check(crm: DataFrame) -> DataFrame:
    """Users, mean total score and mean spend per label."""
    return made(scored_users(crm), CHECK)


def segment_detail(segment: DataFrame) -> DataFrame:
    """Averages per label, score combination and main artist."""
    return made(segment, DETAIL)


def segment_summary(segment: DataFrame, top_score: int = 5) -> DataFrame:
    """Averages per label, and the percentage of users with the best recency score."""
    return made(segment, _summary(top_score))


def score_distribution(segment: DataFrame) -> DataFrame:
    """Users per score combination."""
    return made(segment, DISTRIBUTION)


def top_main_artists(segment: DataFrame, k: int = 20) -> DataFrame:
    """The k largest (main artist, label) groups with mean spend."""
    return made(segment, _top_artists(k))


def total_users(summary: DataFrame) -> DataFrame:
    """Users over all labels."""
    return summary.agg(F.sum("user_cnt").alias("total_users"))


def persona_scorecard(summary: DataFrame, personas: DataFrame) -> DataFrame:
    """Every persona with its label's figures; a label nobody has counts 0."""
    shares = _share(summary).select(
        "dimension_label", "user_cnt", "pct", "avg_rfm", "avg_gmv", "avg_days_since_login"
    )
    return personas.join(shares, "dimension_label", "left").fillna({"user_cnt": 0, "pct": 0.0})


def persona_actions(segment: DataFrame, actions: DataFrame) -> DataFrame:
    """Planned actions per label with the number of users each one would reach."""
    return planned_actions(segment.groupBy("dimension_label").agg(F.count("*").alias("user_cnt")), actions)


def planned_actions(summary: DataFrame, actions: DataFrame) -> DataFrame:
    """`persona_actions` from a table that has the users of each label."""
    reach = summary.select("dimension_label", "user_cnt")
    return actions.join(reach, "dimension_label", "left").fillna({"user_cnt": 0})


def kpi_totals(crm: DataFrame) -> DataFrame:
    """Users, buyers, users who left, and spend, in one row."""
    buyer = F.col("r_score").isNotNull()
    return crm.agg(
        F.count("*").alias("users"),
        F.count_if(buyer).alias("buyers"),
        F.count_if(~buyer).alias("non_buyers"),
        F.count_if("is_withdrawn").alias("withdrawn"),
        F.sum("total_gmv").alias("total_gmv"),
        round_half_away(F.avg(F.when(buyer, F.col("total_gmv")))).alias("avg_buyer_gmv"),
        ratio(F.count_if(buyer) * 100, F.count("*")).alias("pct_buyers"),
    )


def dimension_share(crm: DataFrame) -> DataFrame:
    """Share and averages of scored users per label."""
    return made(scored_users(crm), SHARE)


def winner_rate(dimension: DataFrame, winners: DataFrame, label: str = CHALLENGER) -> DataFrame:
    """How many users with `label` have really won."""
    won = winners.select("user_id").distinct().withColumn("_won", F.lit(True))
    return (
        dimension.filter(F.col("dimension_label") == label)
        .join(won, "user_id", "left")
        .agg(F.count("*").alias("user_cnt"), F.count_if("_won").alias("winner_cnt"))
        .withColumn("pct", ratio(F.col("winner_cnt") * 100, F.col("user_cnt")))
    )


def rfm_bands(segment: DataFrame) -> DataFrame:
    """Users and mean spend per band of the total score."""
    return made(segment, RFM_BAND)


def recency_bands(segment: DataFrame) -> DataFrame:
    """Users, share and mean spend per band of days since the last login."""
    return made(segment, RECENCY_BAND)


def by_signup_service(crm: DataFrame) -> DataFrame:
    """Buyers per service they signed up with."""
    return made(scored_users(crm), SIGNUP)


def by_country(crm: DataFrame) -> DataFrame:
    """Buyers per country."""
    return made(scored_users(crm), COUNTRY)


def main_artist_top(crm: DataFrame, k: int = 20) -> DataFrame:
    """`top_main_artists` on the scored users of the customer table."""
    return top_main_artists(scored_users(crm), k)
