"""Written intermediate tables.

Joins of the segmentation carry no broadcast hint. The planner broadcasts a side if its size is
below `spark.sql.autoBroadcastJoinThreshold`; it knows the size of a table it reads, and that is
what staging a derived table gives it. A larger side is shuffled, and adaptive execution splits
the partitions of hot keys.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Before the names of staged tables of the catalog, in lists of what was staged.
TABLE = "table:"
#: Spark's setting that deletes the shuffle files of a query at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}
_block: ContextVar[list[str] | None] = ContextVar("stages of the current block", default=None)


def stage_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, below the cluster's checkpoint folder."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.TemporaryDirectory(prefix="cohortry-")
        root = "file://" + _local_dirs[app].name
    return f"{root.rstrip('/')}/cohortry/{app}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a block of work; its own come back after it."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _tidy(spark: SparkSession) -> AbstractContextManager[None]:
    """Delete the shuffle files of the queries in this block as soon as each has ended."""
    return settings(spark, {TIDY: "true"})


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` once, with the writer's `options`, and read it back.

    Cuts the lineage, survives the loss of executors, fixes the rows for later passes, and gives
    the planner the true size of the table. Nothing needs the shuffle files behind it any more, so
    they go when it is written and a chain of stages takes the disk of its largest step.
    """
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written = _block.get()
    if written is not None:
        written.append(path)
    with _tidy(df.sparkSession):
        df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_of(spark: SparkSession) -> int:
    """How many buckets `stage_by` makes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _initial_partitions(spark))


def stage_by(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
    """Stage `df` with the rows of each key together; `dealt` if its rows already lie so in `buckets_of`
    partitions, and need not be shuffled once more.

    Joins and groupings by the keys of tables staged so need no shuffle: the planner knows the buckets.
    It learns them from the catalog, where the table stands under a name of its own until it is
    dropped with its files.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    table = f"cohortry_stage_{uuid.uuid4().hex}"
    written = _block.get()
    if written is not None:
        written += [path, TABLE + table]
    buckets = buckets_of(spark)
    with _tidy(spark):
        # Shuffled by the key, every task writes whole buckets.
        rows = df if dealt else df.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def _initial_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0)


@contextmanager
def recorded_stages(paths: list[str]) -> Iterator[None]:
    """Add the paths of the tables that this block stages to `paths`."""
    token = _block.set(paths)
    try:
        yield
    finally:
        _block.reset(token)


def drop_stages(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables and empty the list."""
    while paths:
        name = paths.pop()
        if name.startswith(TABLE):
            spark.sql(f"DROP TABLE IF EXISTS {name.removeprefix(TABLE)}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged within the block at its end, also when it fails.

    Every block knows its own tables only, so jobs of several threads leave each other's alone.
    """
    paths: list[str] = []
    try:
        with recorded_stages(paths):
            yield
    finally:
        drop_stages(spark, paths)


def without_users(df: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Drop the rows of excluded users, and rows without a user."""
    known = df.filter(F.col("user_id").isNotNull())
    if excluded is None:
        return known
    return known.join(excluded.select("user_id"), "user_id", "left_anti")
