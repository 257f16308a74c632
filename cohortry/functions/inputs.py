"""What a run learns from the listing of its input files: their state, and how wide to shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

PARTITIONS = "spark.sql.shuffle.partitions"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes of input files for each partition. Files are packed: in memory, as rows of a sort or a hash
#: table, they take some twenty times as much.
PARTITION_BYTES = 16 << 20
#: Bytes up to which small partitions of a shuffle are merged, packed as well.
MERGED = "8m"


def input_state(spark: SparkSession, root: str) -> Row:
    """Number, bytes and a fingerprint of the parquet files below `root`, from their listing only."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
    )
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.sum(mark).alias("mark"),
    ).first()


def fit_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Start shuffles of large inputs with enough partitions to fit in memory.

    Adaptive execution merges the ones that turn out small, by their packed size. Spark's own bound for that
    lets a task take millions of rows, which it has to spill, so a smaller one is set. A bound that the
    session has set stays.
    """
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, MERGED)
    wanted = input_bytes // PARTITION_BYTES
    if wanted > int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get(PARTITIONS)):
        spark.conf.set(INITIAL_PARTITIONS, wanted)


def table_bytes(tables: Iterable[DataFrame]) -> int:
    """Bytes of the files that the tables are read from, from their listing only. Tables that share
    a file count it once."""
    files, spark = set(), None
    for df in tables:
        files.update(df.inputFiles())
        spark = df.sparkSession
    if not files:
        return 0
    listed = spark.read.format("binaryFile").load(sorted(files))
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


@contextmanager
def fitted_shuffles(spark: SparkSession, tables: Iterable[DataFrame]) -> Iterator[None]:
    """`fit_shuffles` for a block of work on some tables; the session's settings come back after it."""
    before = {name: spark.conf.get(name, None) for name in (INITIAL_PARTITIONS, ADVISORY)}
    fit_shuffles(spark, table_bytes(tables))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
