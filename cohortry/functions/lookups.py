"""Lookup tables with one row per key.

Orders are joined to lookup tables. A key that stands there twice would repeat every line that has
it, and count its money twice. So each lookup is grouped by its key before it is joined, which moves
the lookup and never the lines, and how many keys had to be merged is counted while that is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortry.functions.staging import stage


class RepeatedKeys(ValueError):
    """A lookup table has several rows for a key."""

    def __init__(self, table: str, keys: int, rows: int):
        super().__init__(f"{table}: {keys} keys have several rows, {rows} in all")
        self.table, self.keys, self.rows = table, keys, rows


class Lookups:
    """Lookup tables with unique keys, and what was found in them.

    Of a repeated key the least row counts, in order of the columns asked for (null first). Rows
    without a key can't be joined and are left out. With `count` the tables are staged and repeated
    keys counted while they are written; with `fail` such a key is an error.
    """

    def __init__(self, fail: bool = False, count: bool = False):
        self.fail = fail
        self.count = count or fail
        #: By table: keys with several rows.
        self.repeated: dict[str, int] = {}

    def unique(self, df: DataFrame, table: str, key: str, columns: list[str]) -> DataFrame:
        """(key, columns) with one row per key."""
        least = F.min(F.struct(*columns)) if columns else F.lit(None)
        grouped = (
            df.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(least.alias("_least"), F.count("*").alias("_rows"))
        )
        picked = [key, *[F.col(f"_least.{c}").alias(c) for c in columns]]
        if not self.count:
            return grouped.select(*picked)
        seen = Observation()
        several = F.col("_rows") > 1
        counted = grouped.observe(
            seen,
            F.count_if(several).alias("keys"),
            F.coalesce(F.sum(F.when(several, F.col("_rows"))), F.lit(0)).alias("rows"),
        )
        written = stage(counted.select(*picked), f"lookup-{table}")
        found = seen.get
        self.repeated[table] = found["keys"]
        if self.fail and found["keys"]:
            raise RepeatedKeys(table, found["keys"], found["rows"])
        return written
