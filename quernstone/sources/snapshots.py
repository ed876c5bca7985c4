"""Tables of the store as Parquet snapshots below a folder.

A snapshot of a table is a folder of its own; a write makes a new one and then
replaces the small file that names the current one, so readers see the old or
the new table and never a part. Paths are given to Spark, and the names are
written by Spark too, so the folder may be in any store that Spark knows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.schemas import SCHEMA_VERSION, TABLES, TRAINING_TABLES
from quernstone.sources import migrations


class Store:
    """Named tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, str] | None = None
        self._turn = 0

    def _names(self) -> dict[str, str]:
        """Table (and version) to its current snapshot, as of when this was opened and
        what it has written since; the last row of a name counts."""
        if self._known is None:
            rows = self._listed()
            self._known = {r["name"]: r["value"] for r in rows}
            self._turn = max((r["turn"] + 1 for r in rows), default=0)
        return self._known

    def _listed(self) -> list:
        path = f"{self.folder}/_current"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        rows = self.spark.read.schema("name string, value string, turn long").json(path)
        return rows.orderBy("turn").collect()  # a row for each write

    def _note(self, **values: str) -> None:
        names = self._names()
        rows = [(k, str(v), self._turn) for k, v in values.items()]
        self.spark.createDataFrame(rows, "name string, value string, turn long").coalesce(1).write.mode("append").json(f"{self.folder}/_current")
        names.update((k, str(v)) for k, v in values.items())
        self._turn += 1

    def fresh(self) -> bool:
        return not self._names()

    def version(self) -> int:
        return int(self._names().get("version", 0))

    def tables(self) -> list[str]:
        return sorted(k for k in self._names() if k != "version")

    def read(self, name: str) -> DataFrame:
        """The table, empty if it was never written."""
        place = self._names().get(name)
        return self.spark.read.parquet(f"{self.folder}/{place}") if place else self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Replaces a table; its old snapshot stays readable."""
        place = f"{name}/{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.folder}/{place}")
        self._note(**{name: place})
        return self.read(name)

    def open(self) -> Store:
        """Brings the store to the current schema, through migrations if it is older."""
        if self.fresh():
            self._note(version=str(SCHEMA_VERSION))
        elif self.version() < SCHEMA_VERSION:
            moved = migrations.migrate({n: self.read(n) for n in self.tables()}, self.version())
            for name, df in moved.items():
                self.write(name, df)
            self._note(version=str(SCHEMA_VERSION))
        elif self.version() > SCHEMA_VERSION:
            raise ValueError(f"the store has version {self.version()}, newer than {SCHEMA_VERSION}")
        return self


def export_training(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables that training needs; refuses a folder that has them."""
    for name in TRAINING_TABLES:
        if name in tables:
            tables[name].write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): what an export holds."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def binary_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def chosen_sources(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose path matches an include glob and no exclude glob; it is an error
    if none does."""

    def like(globs: list[str]):
        found = F.lit(False)
        for g in globs:
            found = found | F.col("path").rlike("^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r"\.[]{}()+-^$|" else c) for c in g.replace("**/", "\0")).replace("\0", "(?:.*/)?") + "$")
        return found

    out = files.where(like(include) & ~like(exclude))
    if out.isEmpty():
        raise ValueError(f"no file matches {include} without {exclude}")
    return out
