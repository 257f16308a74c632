"""Tables that are published together, and the checks on inputs that a run makes on the way."""

import os
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortry.functions import inputs, staging
from cohortry.functions.lookups import RepeatedKeys
from cohortry.plans import Segmentation
from cohortry.plans.segmentation import publish
from cohortry.rules import AGENTS, INTERNAL
from cohortry.sinks import FolderReleases, TableReleases
from cohortry.sources import Sources
from cohortry.sources.contracts import BrokenContract
from cohortry.sources.star import STAR_RULES, star_sources
from cohortry.sources.tables import NAMES

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
TABLES = ("user_rfm_score", "user_rfm_dimension", "user_rfm_segment", "crm_users")


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """Rows of the tables of an ordinary run, and its facts."""
    store = FolderReleases(spark, f"file://{tmp_path_factory.mktemp('plain')}")
    facts = publish(star_sources(spark, ROOT), STAR_RULES, store)
    return {name: rows_of(store.read(name)) for name in TABLES}, facts


def rows_of(df):
    return sorted(map(str, df.collect()))


def frames(spark, **changed):
    tables = star_sources(spark, ROOT)
    return Sources.from_frames({name: changed.get(name, getattr(tables, name)) for name in NAMES})


@pytest.fixture(params=["folder", "catalog"])
def store(request, spark, tmp_path):
    if request.param == "folder":
        yield FolderReleases(spark, f"file://{tmp_path}")
        return
    spark.sql(f"CREATE DATABASE rel LOCATION '{tmp_path}/rel.db'")
    yield TableReleases(spark, "rel")
    spark.sql("DROP DATABASE rel CASCADE")


def test_a_release_is_published_as_a_whole(spark, store):
    with pytest.raises(LookupError):
        store.read("a")
    for k in (1, 2):
        with store.begin() as release:
            release.write(spark.range(k), "a", most=F.max("id"))
            if store.current():
                assert store.read("a").count() == k - 1
            release.write(spark.range(10 * k), "b")
    assert store.read("a").count() == 2 and store.read("b").count() == 20
    assert store.facts() == {"a.rows": 2, "a.most": 1, "b.rows": 20}
    first, second = store.published()
    assert store.current() == second and store.read("a", first).count() == 1


def test_a_failed_release_leaves_the_old_one(spark, store):
    with store.begin() as release:
        release.write(spark.range(3), "a")
    bad = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    for k in range(2):
        with pytest.raises(Exception, match="no"):
            with store.begin() as release:
                release.write(spark.range(9), "a")
                release.write(bad, "b")
    assert store.read("a").count() == 3 and len(store.published()) == 1
    if isinstance(store, FolderReleases):
        assert len(os.listdir(store.root.removeprefix("file://") + "/releases")) == 1
    else:
        assert {t.name for t in spark.catalog.listTables("rel")} == {
            "current_release", "a", "release_facts", f"a__{store.current()}", f"release_facts__{store.current()}"
        }


def test_only_the_latest_releases_are_kept(spark, store):
    for k in range(4):
        with store.begin() as release:
            release.write(spark.range(k), "a")
    old, new = store.published()
    assert (store.read("a", old).count(), store.read("a", new).count()) == (2, 3)
    if isinstance(store, FolderReleases):
        assert sorted(os.listdir(store.root.removeprefix("file://") + "/releases")) == [old, new]


def test_readers_never_see_tables_of_two_runs(spark, tmp_path):
    store = FolderReleases(spark, f"file://{tmp_path}", keep=3)
    errors, seen, stop = [], set(), threading.Event()

    def read():
        while not stop.is_set():
            try:
                name = store.current()
                if name:
                    pair = [store.read(t, name).agg(F.max("id")).first()[0] for t in "ab"]
                    assert pair[0] == pair[1]
                    seen.add(pair[0])
            except Exception as e:
                errors.append(e)
            time.sleep(0.01)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 5):
        with store.begin() as release:
            for table in "ab":
                release.write(spark.range(k, k + 1), table)
    time.sleep(0.5)
    stop.set()
    reader.join()
    assert not errors and max(seen) == 4


def test_the_job_publishes_four_tables_and_facts(spark, tmp_path, monkeypatch):
    store = FolderReleases(spark, f"file://{tmp_path}")
    folder = staging.stage_root(spark).removeprefix("file://")
    before = os.listdir(folder) if os.path.isdir(folder) else []
    tables = [t.name for t in spark.catalog.listTables()]
    monkeypatch.setattr(inputs, "PARTITION_BYTES", 1000)
    facts = publish(star_sources(spark, ROOT), STAR_RULES, store)
    assert spark.conf.get(inputs.INITIAL_PARTITIONS, None) is None
    assert os.listdir(folder) == before and [t.name for t in spark.catalog.listTables()] == tables
    assert facts == store.facts()
    for table in TABLES:
        assert store.read(table).count() == facts[f"{table}.rows"] > 0
    assert facts["user_rfm_segment.rows"] == facts["crm_users.buyers"] == 131
    assert facts["commerce_orders.documents"] > 0 == facts["commerce_orders.unread"]
    assert {k: v for k, v in facts.items() if k.endswith(".repeated")} == {
        f"{t}.repeated": 0 for t in ("event_mart", "event_data", "products", "artists", "user_info")
    }

    def fails(*_):
        raise RuntimeError("third table")

    monkeypatch.setattr(Segmentation, "build_segment", fails)
    with pytest.raises(RuntimeError):
        publish(star_sources(spark, ROOT), STAR_RULES, store)
    assert len(store.published()) == 1 and store.read("crm_users").count() == facts["crm_users.rows"]


@pytest.mark.parametrize("table, key", [("event_mart", "event_id"), ("event_data", "id"), ("products", "id"), ("artists", "id"), ("user_info", "user_id")])
def test_repeated_keys_are_found_and_multiply_nothing(spark, tmp_path, plain, table, key):
    """A planted row whose key is there already, with other values that sort last."""
    clean = star_sources(spark, ROOT)
    whole = getattr(clean, table)
    keys = [r[0] for r in whole.select(key).orderBy(key).limit(3).collect()]
    greater = [
        (F.col(c) + 1_000_000 if kind == "bigint" else F.concat(F.col(c), F.lit("~")) if kind == "string" else F.col(c)).alias(c)
        if c != key else F.col(c)
        for c, kind in whole.dtypes
    ]
    planted = whole.unionByName(whole.filter(F.col(key).isin(keys)).select(*greater))
    store = FolderReleases(spark, f"file://{tmp_path}")
    facts = publish(frames(spark, **{table: planted}), STAR_RULES, store)
    assert {k: v for k, v in facts.items() if k.endswith(".repeated") and v} == {f"{table}.repeated": 3}
    assert {name: rows_of(store.read(name)) for name in TABLES} == plain[0]
    strict = Segmentation(frames(spark, **{table: planted}), replace(STAR_RULES, fail_on_repeated_keys=True))
    with pytest.raises(RepeatedKeys, match=table), staging.temporary_stages(spark):
        strict.events, strict.offers, strict.user_info


def test_inputs_of_other_types_are_cast_or_set_aside(spark, tmp_path, plain):
    clean = star_sources(spark, ROOT)
    numbers = clean.order_mart.withColumn("user_id", F.col("user_id").cast("long")).withColumn("note", F.lit("x"))
    texts = clean.products.select(F.col("id").cast("string").alias("id"), F.col("artist_id").cast("double").alias("artist_id"))
    odd = spark.createDataFrame([("x7", 1.0), ("8", 1.5), (None, 2.0), ("99999999999999999999", None)], "id string, artist_id double")
    store = FolderReleases(spark, f"file://{tmp_path}")
    facts = publish(frames(spark, order_mart=numbers, products=texts.unionByName(odd)), STAR_RULES, store)
    assert {name: rows_of(store.read(name)) for name in TABLES} == plain[0]
    assert facts["rejected_rows.rows"] == 3 and "rejected_rows.rows" not in plain[1]
    aside = sorted(tuple(r) for r in store.read("rejected_rows").collect())
    assert aside == [
        ("products", "artist_id is no bigint", '{"id":"8","artist_id":"1.5"}'),
        ("products", "id is no bigint", '{"id":"99999999999999999999"}'),
        ("products", "id is no bigint", '{"id":"x7","artist_id":"1.0"}'),
    ]


def test_tables_that_cannot_be_read_are_named(spark):
    clean = star_sources(spark, ROOT)
    with pytest.raises(BrokenContract, match="skus: column sku_type is missing"):
        frames(spark, skus=clean.skus.drop("sku_type")).skus
    with pytest.raises(BrokenContract, match="winner_list is bigint"):
        frames(spark, winner_groups=spark.range(1).select(F.col("id").alias("winner_list"))).winner_groups
    assert frames(spark, skus=clean.skus.withColumn("more", F.lit(1))).skus.columns == clean.skus.columns


def test_each_table_leaves_out_its_own_users(spark):
    """Internal accounts only, agents only, nobody: as in the scores run by hand and the customer table."""
    tables = star_sources(spark, ROOT)
    internal = {r["user_id"] for r in tables.internal_accounts.collect()}
    agents = {r["user_id"] for r in Segmentation(tables, STAR_RULES).agents.collect()}
    rules = replace(STAR_RULES, score_exclusions=(INTERNAL,), customer_exclusions=(AGENTS,), label_exclusions=())
    job = Segmentation(tables, rules)
    buyers = {r["user_id"] for r in Segmentation(tables, STAR_RULES, exclude=False).purchase_stats().collect()}
    assert {r["user_id"] for r in job.purchase_stats().collect()} == buyers - agents
    values = {r["user_id"] for r in Segmentation(tables, STAR_RULES, exclude=False).order_values().collect()}
    assert {r["user_id"] for r in job.order_values().collect()} == values - internal
    assert job.excluded is None and internal - agents and agents & buyers
    with pytest.raises(ValueError, match="unknown"):
        job.left_out(("friends",))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_joins_move_nothing_and_sort_no_group(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with staging.temporary_stages(spark):
            job = Segmentation(star_sources(spark, ROOT), STAR_RULES)
            wide = plan_of(job.build_crm())
            assert wide.count("SortMergeJoin") == 3 and "Exchange" not in wide
            assert "Exchange" not in plan_of(job.user_totals())
            assert "SortAggregate" not in plan_of(job.main_artist()) + plan_of(job.build_dimension())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
