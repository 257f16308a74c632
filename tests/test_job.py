"""The whole job on star-schema tables, compared with SQL, and on tables with hot keys."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import TABLES, difference, duck
from cohortry.functions import inputs, staging
from cohortry.operators import crm, exclusions, options, scores
from cohortry.operators.personas import default_actions, default_personas
from cohortry.plans import Segmentation, run
from cohortry.plans.segmentation import parquet_writer, table_writer, write_reports
from cohortry.sources import Sources
from cohortry.sources.tables import NAMES
from cohortry.sources.star import STAR_RULES, star_sources

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def check(spark, con, root, name):
    frame = entry.queries()[name](spark, root)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    cursor = con.execute(entry.oracle_sql()[name])
    header = [d[0] for d in cursor.description]
    return difference(got, pd.DataFrame(cursor.fetchall(), columns=header, dtype=object))


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_every_query_has_sql():
    assert set(entry.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, ROOT, name) is None


@pytest.fixture(scope="module")
def hot_root(spark, tmp_path_factory):
    """The smallest tables with a third of the lines on one order, part and supplier, of one user."""
    root = str(tmp_path_factory.mktemp("hot"))
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    key = con.execute(
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '4' "
        "AND o_orderkey % 12 = 1 ORDER BY 1 LIMIT 1"
    ).fetchone()[0]
    con.execute(
        f"UPDATE lineitem SET l_orderkey = {key}, l_suppkey = 1, l_returnflag = 'R', "
        "l_partkey = CASE WHEN l_linenumber < 6 THEN 5 ELSE l_partkey END WHERE l_partkey % 3 = 0"
    )
    con.execute(f"UPDATE orders SET o_custkey = 3 WHERE o_orderkey % 3 = 0 OR o_orderkey = {key}")
    for table in TABLES:
        con.execute(f"COPY {table} TO '{root}/{table}.parquet' (FORMAT parquet)")
    return root


@pytest.mark.parametrize(
    "name", ["order_lines", "rfm_score", "user_dimension", "final_dimension_v2", "crm_users"]
)
def test_hot_keys_equal_sql(spark, hot_root, name):
    assert check(spark, duck(hot_root), hot_root, name) is None


def test_hot_keys_without_broadcast(spark, hot_root):
    """The same when every join has to shuffle."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    entry.forget()
    try:
        spark.conf.set(name, -1)
        assert check(spark, duck(hot_root), hot_root, "user_segment") is None
    finally:
        spark.conf.set(name, before)
        entry.forget()


def test_job_writes_and_replaces_its_tables(spark, tmp_path):
    out = str(tmp_path)
    tables = star_sources(spark, ROOT)
    folder = staging.stage_root(spark).removeprefix("file://")
    before = os.listdir(folder) if os.path.isdir(folder) else []
    first = run(tables, STAR_RULES, parquet_writer(out)).collect()
    assert os.listdir(folder) == before  # nothing staged is left behind, nothing else is lost
    again = run(tables, STAR_RULES, parquet_writer(out)).collect()
    assert first == again and sum(r["user_cnt"] for r in first) == 131
    score = spark.read.parquet(f"{out}/user_rfm_score")
    segment = spark.read.parquet(f"{out}/user_rfm_segment")
    customers = spark.read.parquet(f"{out}/crm_users")
    assert score.columns == ["user_id", "r_raw", "f_raw", "m_raw", "r_score", "f_score", "m_score"]
    assert segment.count() == score.count() == 131
    assert customers.filter("r_score IS NOT NULL").count() == 131
    assert customers.select("user_id").distinct().count() == customers.count()
    labels = spark.read.parquet(f"{out}/user_rfm_dimension")
    assert labels.select("user_id").distinct().count() == labels.count() == 135


def test_catalog_tables_reports_and_older_rules(spark, tmp_path):
    tables = star_sources(spark, ROOT)
    for name in NAMES:
        getattr(tables, name).createOrReplaceTempView(f"in_{name}")
    named = Sources.from_catalog(spark, {name: f"in_{name}" for name in NAMES})
    spark.sql(f"CREATE DATABASE IF NOT EXISTS mart LOCATION '{tmp_path}/mart.db'")
    write = table_writer("mart")
    summary = run(named, STAR_RULES, write, labels="v2").collect()
    assert sum(r["user_cnt"] for r in summary) == 131
    assert "N/A" in {r["dimension_label"] for r in spark.table("mart.user_rfm_dimension").collect()}
    for _ in range(2):
        stored = write_reports(
            spark.table("mart.user_rfm_segment"),
            spark.table("mart.crm_users"),
            default_personas(spark),
            default_actions(spark),
            write,
            Segmentation(named, STAR_RULES, labels="v2"),
        )
    assert spark.table("mart.report_kpi_totals").first()["users"] == spark.table("mart.crm_users").count()
    assert spark.table("mart.report_winner_rate").count() == 1 and len(stored) == 16
    assert spark.table("mart.report_total_users").first()[0] == 131
    assert stored["personas"].count() == 5 and stored["by_country"].count() > 1
    spark.sql("DROP DATABASE mart CASCADE")


def test_hot_keys_are_split_in_line_joins(spark):
    """Adaptive execution splits the hot partitions of every join that has to move order lines."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    id = F.col("id")
    mart = staging.stage(
        spark.range(0, 400_000, 1, 4).select(
            F.when(id % 3 == 0, 0).otherwise(F.xxhash64("id") % 50_000).cast("string").alias("user_id"),
            id.alias("order_no"),
            F.concat(F.lit("E"), F.when(id % 5 < 2, 0).otherwise(id % 997)).alias("event_id"),
            F.xxhash64("id").alias("total_revenue"),
            F.lit("B2C").alias("market_type"),
            F.lit("new").alias("data_source"),
        ),
        "hot",
    )
    events = spark.range(997).select(
        F.concat(F.lit("E"), id).alias("event_id"),
        (id % 50).alias("artist_id"),
        F.concat(F.lit("A"), id % 7).alias("album_name"),
    )
    excluded = spark.range(5, 50_000, 97).select(id.cast("string").alias("user_id"))
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        lines = scores.eligible_orders(mart, events, excluded, ["B2C"], "new")
        done = lines.agg(F.count("*"), F.sum(F.xxhash64(*lines.columns) % 1000))
        assert done.collect()[0][0] == mart.join(excluded, "user_id", "left_anti").count()
        plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("SortMergeJoin(skew=true)") == 2
    finally:
        for name in small:
            spark.conf.unset(name)


def test_blocks_delete_their_own_stages_only(spark):
    rows = spark.range(3)
    first, second = [], []
    with staging.recorded_stages(second):
        with staging.recorded_stages(first):
            one = staging.stage(rows, "one")
        two = staging.stage(rows, "two")
        with staging.temporary_stages(spark):
            three = staging.stage(rows, "three")
    assert (len(first), len(second)) == (1, 1) and one.count() == 3
    staging.drop_stages(spark, first)
    assert two.count() == 3 and first == []
    with pytest.raises(Exception):
        three.count()
    staging.drop_stages(spark, second)


def test_two_jobs_at_once(spark):
    def job(n):
        with staging.temporary_stages(spark):
            table = staging.stage(spark.range(n), "job")
            together.wait(60)
            if n == 1:
                return table.count()
            first.result(60)  # the other block has ended and cleaned up
            return table.count()

    together = threading.Barrier(2)
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(job, 1)
        second = pool.submit(job, 2)
        assert (first.result(60), second.result(60)) == (1, 2)


def test_forget_deletes_what_was_staged(spark):
    entry.forget()
    entry.queries()["offer_lookup"](spark, ROOT)
    entry.queries()["winners"](spark, ROOT).count()
    folder = staging.stage_root(spark).removeprefix("file://")
    kept = len(os.listdir(folder))
    staged = len(entry._staged)
    entry.forget()
    assert staged > 0 and len(os.listdir(folder)) == kept - staged


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}/kept.db'")
    bad = spark.range(4).select(F.assert_true(F.col("id") < 2).cast("string").alias("id"))
    for write in (parquet_writer(str(tmp_path)), table_writer("kept")):
        write(spark.range(3), "t")
        with pytest.raises(Exception):
            write(bad, "t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == spark.table("kept.t").count() == 3
    assert [d for d in os.listdir(tmp_path) if d.startswith("_t")] == []
    assert write(spark.range(5), "t").count() == 5
    shown = spark.sql("SHOW TABLES IN kept").filter("NOT isTemporary").collect()
    assert [r["tableName"] for r in shown] == ["t"]
    spark.sql("DROP DATABASE kept CASCADE")


def test_lines_are_summed_before_they_are_joined(spark):
    """Without broadcasts, the first aggregate of mart lines lies below every join and Expand."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    tables = star_sources(spark, ROOT)
    mart = staging.stage(tables.order_mart, "mart")
    try:
        spark.conf.set(name, -1)
        lines = scores.market_orders(mart, ["B2C"], None)
        spend = scores.order_values(scores.with_event(scores.event_spend(lines), tables.event_mart))
        several = exclusions.multi_artist_buyers(mart, tables.event_mart, STAR_RULES)
        stats = crm.purchase_stats(mart, None, STAR_RULES)
        for df in (spend, several, stats):
            steps = df._jdf.queryExecution().executedPlan().toString().splitlines()
            scan = next(k for k, line in enumerate(steps) if "market_type" in line and "FileScan" in line)
            above = [s for s in steps[:scan] if "HashAggregate" in s or "Join" in s or "Expand" in s]
            assert "HashAggregate" in above[-1]
    finally:
        spark.conf.set(name, before)


def test_oldest_rules_as_a_job(spark):
    job = Segmentation(star_sources(spark, ROOT), STAR_RULES, labels="v1")
    newest = Segmentation(star_sources(spark, ROOT), STAR_RULES)
    assert job.build_dimension().columns == newest.build_dimension().columns
    want = job.final_dimension_v1().select("user_id", "dimension_label").collect()
    assert sorted(want) == sorted(job.dimension.select("user_id", "dimension_label").collect())
    assert job.crm_users.count() == newest.crm_users.count()


def test_totals_need_no_labels(spark):
    job = Segmentation(star_sources(spark, ROOT), STAR_RULES)
    staged = []
    with staging.recorded_stages(staged):
        job.kpi_totals()
    assert staged == []


def test_sources_open_only_what_is_used(frame):
    asked = []

    def load(name):
        asked.append(name)
        return frame([("1",)], "user_id string")

    tables = Sources(load)
    assert tables.internal_accounts is tables.internal_accounts
    assert asked == ["internal_accounts"]
    with pytest.raises(AttributeError):
        tables.unknown


def test_checkpoint_folder_of_the_session_is_used(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return "hdfs://shared/checkpoints/" if name == staging.CHECKPOINT_DIR else default

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    app = spark.sparkContext.applicationId
    assert staging.stage_root(Session()) == f"hdfs://shared/checkpoints/cohortry/{app}"


def test_new_inputs_are_noticed_and_large_ones_widen_shuffles(spark, tmp_path):
    root = str(tmp_path / "in")
    spark.range(5).write.parquet(f"{root}/a.parquet")
    before = inputs.input_state(spark, root)
    spark.range(6).write.parquet(f"{root}/b.parquet")
    assert inputs.input_state(spark, root) != before
    inputs.fit_shuffles(spark, before["bytes"])
    assert spark.conf.get(inputs.INITIAL_PARTITIONS, None) is None
    try:
        inputs.fit_shuffles(spark, 100 << 40)
        assert spark.conf.get(inputs.INITIAL_PARTITIONS) == str((100 << 40) // inputs.PARTITION_BYTES)
    finally:
        spark.conf.unset(inputs.INITIAL_PARTITIONS)


def test_no_user_table_moves_to_one_task(spark):
    """No single-partition exchange below the scores, labels and customer table."""
    job = Segmentation(star_sources(spark, ROOT), STAR_RULES)
    for df in (job.build_dimension(), job.build_segment(), job.build_crm(), job.rfm_base()):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    lines = job.paid_lines()
    plan = options.option_purchases(lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "EvalPython" not in plan
