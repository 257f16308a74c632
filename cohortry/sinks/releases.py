"""Tables that are published together.

A release is a set of tables made by one run. They are written once, to places of their own, and
nobody sees them until one last step makes the release the current one. If anything fails before
that step the release is deleted, and readers keep the tables of the one before. A reader asks for
the current release once and then reads tables of that release only, so it never mixes two runs.
The latest few releases are kept for readers that are still at work.

What a run learns about its tables while it writes them, such as their rows, is stored with them.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Name of the table of facts of a release.
FACTS = "release_facts"


class Release:
    """A release in the making. Published at the end of its `with` block, deleted if that fails."""

    def __init__(self, store: Releases, name: str):
        self.store = store
        self.name = name
        self.facts: dict[str, int] = {}
        self.tables: list[str] = []

    def write(self, df: DataFrame, table: str, **facts: Column) -> DataFrame:
        """Store a table of the release and return it as read back. Its rows are counted on the way,
        and so is every aggregate of `facts`."""
        seen = Observation()
        counted = df.observe(
            seen, F.count(F.lit(1)).alias("rows"), *[value.alias(name) for name, value in facts.items()]
        )
        self.tables.append(table)
        self.store._write(counted, self.name, table)
        self.facts |= {f"{table}.{name}": value for name, value in seen.get.items()}
        return self.store.read(table, self.name)

    def __enter__(self) -> Release:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                rows = sorted(self.facts.items())
                facts = self.store.spark.createDataFrame(rows, "fact string, value long")
                self.store._write(facts.coalesce(1), self.name, FACTS)
                self.store._publish(self.name, self.tables)
                return
        except BaseException:
            self.store._delete(self.name)
            raise
        self.store._delete(self.name)


class Releases(ABC):
    """The releases of one place."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        if keep < 1:
            raise ValueError("the current release has to be kept")
        self.spark = spark
        self.keep = keep

    def begin(self) -> Release:
        """A new release, later than all published ones."""
        latest = max((int(name.split("_")[0]) for name in self.published()), default=0)
        return Release(self, f"{latest + 1:012d}_{uuid.uuid4().hex[:12]}")

    def current(self) -> str | None:
        """Name of the release that readers should use; null before the first one."""
        return max(self.published(), default=None)

    def facts(self, release: str | None = None) -> dict[str, int]:
        return {r["fact"]: r["value"] for r in self.read(FACTS, release).collect()}

    def _release(self, release: str | None) -> str:
        found = release or self.current()
        if found is None:
            raise LookupError("nothing has been published yet")
        return found

    @abstractmethod
    def published(self) -> list[str]:
        """Names of the published releases that are kept."""

    @abstractmethod
    def read(self, table: str, release: str | None = None) -> DataFrame:
        """A table of a release, by default of the current one."""

    @abstractmethod
    def _write(self, df: DataFrame, release: str, table: str) -> None: ...

    @abstractmethod
    def _publish(self, release: str, tables: list[str]) -> None: ...

    @abstractmethod
    def _delete(self, release: str) -> None: ...


class FolderReleases(Releases):
    """Parquet folders below `root`.

    A release is published by creating one empty file whose name holds its name. Creating a file is
    one step in every store, and there is nothing in it that could be read half-written.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        super().__init__(spark, keep)
        self.root = root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def published(self) -> list[str]:
        files, folder = self._files(), self._path("published")
        if not files.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isFile())

    def read(self, table: str, release: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/releases/{self._release(release)}/{table}")

    def _write(self, df: DataFrame, release: str, table: str) -> None:
        df.write.parquet(f"{self.root}/releases/{release}/{table}")

    def _publish(self, release: str, tables: list[str]) -> None:
        files = self._files()
        files.mkdirs(self._path("published"))
        files.create(self._path("published", release), False).close()
        for old in self.published()[: -self.keep]:
            files.delete(self._path("published", old), False)
            self._delete(old)

    def _delete(self, release: str) -> None:
        self._files().delete(self._path("releases", release), True)


class TableReleases(Releases):
    """Tables of a database of the session catalog, named after table and release.

    The view `current_release` names the published releases; replacing it is the one step that
    publishes. For SQL written by hand each table also has a view of its own name, turned to the new
    release right after; several of these views read together may be of two releases for a moment,
    `read` never is.
    """

    POINTER = "current_release"

    def __init__(self, spark: SparkSession, database: str, keep: int = 2):
        super().__init__(spark, keep)
        self.database = database

    def published(self) -> list[str]:
        pointer = f"{self.database}.{self.POINTER}"
        if not self.spark.catalog.tableExists(pointer):
            return []
        return sorted(r["release"] for r in self.spark.table(pointer).collect())

    def read(self, table: str, release: str | None = None) -> DataFrame:
        return self.spark.table(f"{self.database}.{table}__{self._release(release)}")

    def _write(self, df: DataFrame, release: str, table: str) -> None:
        df.write.saveAsTable(f"{self.database}.{table}__{release}")

    def _view(self, name: str, query: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{name} AS {query}")

    def _publish(self, release: str, tables: list[str]) -> None:
        known = [*self.published(), release]
        rows = ", ".join(f"('{name}')" for name in known[-self.keep :])
        self._view(self.POINTER, f"SELECT * FROM VALUES {rows} AS t(release)")
        for table in [*tables, FACTS]:
            self._view(table, f"SELECT * FROM {self.database}.{table}__{release}")
        for old in known[: -self.keep]:
            self._delete(old)

    def _delete(self, release: str) -> None:
        for table in self.spark.catalog.listTables(self.database):
            if table.name.endswith(f"__{release}"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{table.name}")
