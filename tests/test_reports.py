from cohortry.operators import reports
from cohortry.operators.personas import ACTIONS, PERSONAS, default_actions, default_personas
from tests.conftest import rows


def test_bands(frame):
    totals = [3, 4, 6, 7, 9, 10, 12, 13, 15]
    df = frame([(t, 10 * t) for t in totals], "rfm_total long, m_raw long")
    assert rows(reports.rfm_bands(df)) == [
        ("At Risk", 2, 50.0), ("Champions", 2, 140.0), ("Hibernating", 1, 30.0), ("Loyal", 2, 110.0),
        ("Potential", 2, 80.0),
    ]
    days = [-1, 30, 31, 90, 91, 180, 181, 365, 366, 9999]
    df = frame([(d, 1) for d in days], "r_raw long, m_raw long")
    assert {r["band"]: (r["user_cnt"], r["pct"]) for r in reports.recency_bands(df).collect()} == {
        "0-30": (2, 20.0), "31-90": (2, 20.0), "91-180": (2, 20.0), "181-365": (2, 20.0), "366+": (2, 20.0)
    }


SEGMENT = (
    "dimension_label string, r_score long, f_score long, m_score long, rfm_total long, r_raw long, "
    "f_raw double, m_raw long, main_artist_name string"
)


def segment(frame):
    return frame(
        [("Challenger", 5, 5, 5, 15, 1, 2.0, 100, "x"), ("Challenger", 4, 5, 5, 14, 4, 1.5, 101, "y"),
         ("Beginner", 1, 1, 1, 3, 300, 0.0, 5, None), ("Beginner", 5, 1, 1, 7, 2, 0.5, 6, "x")],
        SEGMENT,
    )


def test_segment_reports(spark, frame):
    df = segment(frame)
    summary = reports.segment_summary(df)
    assert [tuple(r) for r in summary.collect()] == [
        ("Challenger", 2, 14.5, 101.0, 3.0, 1.8, 50.0), ("Beginner", 2, 5.0, 6.0, 151.0, 0.3, 50.0)
    ]
    assert reports.total_users(summary).first()[0] == 4
    assert reports.score_distribution(df).count() == 4
    assert reports.segment_detail(df).count() == 4
    top = reports.top_main_artists(df, 2)
    assert [tuple(r) for r in top.collect()] == [("x", "Beginner", 1, 6.0), ("x", "Challenger", 1, 100.0)]
    cards = reports.persona_scorecard(summary, default_personas(spark))
    got = {r["dimension_label"]: (r["user_cnt"], r["pct"], r["avg_rfm"]) for r in cards.collect()}
    assert len(got) == len(PERSONAS)
    assert got["Challenger"] == (2, 50.0, 14.5) and got["Shopper"] == (0, 0.0, None)
    actions = reports.persona_actions(df, default_actions(spark))
    assert actions.count() == len(ACTIONS)
    assert {r["user_cnt"] for r in actions.collect()} == {0, 2}


def test_customer_reports(frame):
    crm = frame(
        [("1", "Challenger", 5, 15, 1, 100, 90.0, "APP", "KR", False, "x"),
         ("2", "Beginner", 1, 3, 400, 5, 5.0, "WEB", None, True, None),
         ("3", "Beginner", None, None, None, None, 0.0, "WEB", "JP", False, None)],
        "user_id string, dimension_label string, r_score long, rfm_total long, r_raw long, m_raw long, "
        "total_gmv double, created_from string, country_code string, is_withdrawn boolean, "
        "main_artist_name string",
    )
    assert tuple(reports.kpi_totals(crm).first()) == (3, 2, 1, 1, 95.0, 48.0, 200 / 3)
    assert rows(reports.segment_check(crm)) == [("Beginner", 1, 3.0, 5.0), ("Challenger", 1, 15.0, 90.0)]
    assert rows(reports.by_country(crm)) == [(None, 1, 5.0, 50.0), ("KR", 1, 100.0, 50.0)]
    assert rows(reports.by_signup_service(crm)) == [("APP", 1, 100.0, 50.0), ("WEB", 1, 5.0, 50.0)]
    assert {r["pct"] for r in reports.dimension_share(crm).collect()} == {50.0}
    assert rows(reports.main_artist_top(crm)) == [("x", "Challenger", 1, 100.0)]
    won = frame([("1",), ("1",), ("9",)], "user_id string")
    assert tuple(reports.winner_rate(crm, won).first()) == (1, 1, 100.0)
    nobody = reports.winner_rate(crm.filter("false"), won)
    assert tuple(nobody.first()) == (0, 0, None)


def test_all_reports_of_a_table_in_one_scan(spark, tmp_path, frame, monkeypatch):
    """The same rows as one by one; the table is scanned once, and null keys are no totals."""
    data = [
        ("Challenger", 5, 5, 5, 15, 1, 2.0, 100, "x", "APP", None, 90.0),
        ("Challenger", 4, 5, 5, 14, 4, 1.5, 101, "y", None, "KR", 91.0),
        ("Beginner", 1, 1, 1, 3, 300, 0.0, 5, None, "WEB", "JP", 5.0),
        (None, 5, 1, 1, 7, 2, 0.5, 6, "x", "WEB", "KR", 6.0),
        ("Beginner", None, None, None, None, None, None, None, None, "WEB", None, 0.0),
    ]
    schema = f"{SEGMENT}, created_from string, country_code string, total_gmv double"
    frame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    plans, keep = [], reports.stage

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(reports, "stage", noted)
    together = reports.segment_reports(table) | reports.customer_reports(table)
    assert [plan.count("FileScan parquet") for plan in plans] == [1, 1]
    alone = {
        "summary": reports.segment_summary,
        "detail": reports.segment_detail,
        "score_distribution": reports.score_distribution,
        "top_artists": reports.top_main_artists,
        "rfm_bands": reports.rfm_bands,
        "recency_bands": reports.recency_bands,
        "segment_check": reports.segment_check,
        "dimension_share": reports.dimension_share,
        "by_signup_service": reports.by_signup_service,
        "by_country": reports.by_country,
        "main_artists": reports.main_artist_top,
    }
    assert alone.keys() == together.keys()
    for name, report in alone.items():
        assert together[name].columns == report(table).columns
        assert rows(together[name]) == rows(report(table)), name
        assert not any(f.startswith(f"file:{tmp_path}") for f in together[name].inputFiles())
    summary = together["summary"]
    assert rows(reports.planned_actions(summary, default_actions(spark))) == rows(
        reports.persona_actions(table, default_actions(spark))
    )


def test_reports_of_empty_tables(frame):
    empty = frame([], f"{SEGMENT}, created_from string, country_code string, total_gmv double")
    for report in (reports.segment_reports(empty) | reports.customer_reports(empty)).values():
        assert report.count() == 0
