import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.functions import ranks
from cohortry.operators.scores import ntile_score, rfm_score


def native(df, value, k):
    return df.withColumn("want", F.ntile(k).over(Window.orderBy(value, "user_id")))


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 23, 24, 25])
def test_small_pools_equal_native(frame, n):
    df = frame([(f"u{i}", (i * 7) % 4) for i in range(n)], "user_id string, v int")
    got = {r["user_id"]: r["v_tile"] for r in ntile_score(df, "v", 5).collect()}
    assert got == {r["user_id"]: r["want"] for r in native(df, "v", 5).collect()}


def test_one_value_for_all(frame):
    df = frame([(f"u{i:03}", 1.0) for i in range(101)], "user_id string, v double")
    got = ntile_score(df, "v", 5).orderBy("user_id").collect()
    assert [r["v_tile"] for r in got] == [1] * 21 + [2] * 20 + [3] * 20 + [4] * 20 + [5] * 20


@pytest.mark.parametrize("hot", [0.0, 0.4, 0.95])
def test_narrowed_ranges_equal_native(frame, hot):
    """Small limits force many narrowing rounds; a hot value holds most rows; nulls come first."""
    rng = random.Random(7)
    data = [
        (f"u{i}", 3.0 if rng.random() < hot else rng.choice([None, rng.random() * 9, 8.5]), -i % 11)
        for i in range(6_000)
    ]
    df = frame(data, "user_id string, v double, w int")
    got = ranks.ntile_scores(
        df, {"a": ("v", False), "b": ("w", True)}, 7, sample_rows=60, range_rows=90
    )
    both = native(got, "v", 7).withColumn(
        "want_b", 8 - F.ntile(7).over(Window.orderBy("w", "user_id"))
    )
    assert both.filter((F.col("a") != F.col("want")) | (F.col("b") != F.col("want_b"))).count() == 0
    assert {r["count"] for r in got.groupBy("a").count().collect()} <= {857, 858}


def test_wrong_proposals_are_corrected(frame, monkeypatch):
    """Keys proposed far from the wanted rank only cost rounds."""
    real = ranks._propose

    def skewed(df, keys, targets, sample_rows, seed):
        proposal = real(df, keys, targets, sample_rows, seed)
        if seed > 2:
            return proposal
        lowest = df.agg(F.min(F.struct(F.col("v").alias("v"), F.col("user_id").alias("i"))))
        key = lowest.first()[0]
        from pyspark.sql import Row

        return Row(**{name: key for name in proposal.asDict()})

    monkeypatch.setattr(ranks, "_propose", skewed)
    df = frame([(f"u{i}", (i * 37) % 500) for i in range(1_000)], "user_id string, v long")
    got = ranks.ntile_scores(df, {"a": ("v", False)}, 5, sample_rows=40, range_rows=50)
    assert native(got, "v", 5).filter("a != want").count() == 0


def test_scores_are_read_without_moving_users(frame):
    base = frame(
        [(f"u{i}", i % 9, i / 3, 1 + i % 5, 1, 1) for i in range(40)],
        "user_id string, r_raw long, f_raw double, m_raw long, total_rounds long, total_artists long",
    )
    plan = rfm_score(base)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_score_direction_and_buyers_only(frame):
    base = frame(
        [(f"u{i}", i, float(i), i, 1, 1) for i in range(6)],
        "user_id string, r_raw long, f_raw double, m_raw long, total_rounds long, total_artists long",
    )
    got = {r["user_id"]: r for r in rfm_score(base).collect()}
    assert "u0" not in got and len(got) == 5
    assert (got["u1"]["r_score"], got["u1"]["f_score"], got["u1"]["m_score"]) == (5, 1, 1)
    assert (got["u5"]["r_score"], got["u5"]["rfm_total_raw"]) == (1, 11)
