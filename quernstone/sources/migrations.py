"""Migrations of the store: a step for each version, tables to tables.

Steps run in order, each on what the one before returned; after the last, foreign
keys are audited, and a store that fails the audit is not written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.schemas import SCHEMA_VERSION, TABLES

Tables = dict[str, DataFrame]


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def with_column(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    """df with a column of nulls, unless it has the column."""
    return df if has_column(df, name) else df.withColumn(name, F.lit(None).cast(kind))


def _adds(*names: str) -> Callable[[Tables], Tables]:
    """A step that adds empty tables."""

    def step(tables: Tables) -> Tables:
        spark = next(iter(tables.values())).sparkSession
        return tables | {n: spark.createDataFrame([], TABLES[n]) for n in names if n not in tables}

    return step


def _column(table: str, name: str) -> Callable[[Tables], Tables]:
    def step(tables: Tables) -> Tables:
        return tables | {table: with_column(tables[table], name, TABLES[table][name].dataType)} if table in tables else tables

    return step


def _legacy_run(tables: Tables) -> Tables:
    """Events from before there were runs belong to one run, number 1."""
    events = tables.get("events")
    if events is None or has_column(events, "run_id"):
        return _adds("runs")(tables)
    spark = events.sparkSession
    first = events.agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n"))
    run = first.where("n > 0").select(
        F.lit(1).cast("long").alias("id"), F.lit("legacy").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("tool", "tool_version")],
        F.lit("unknown").alias("code_version"), F.lit("{}").alias("params"), F.lit(None).cast("long").alias("seed"), "started_at", "ended_at", F.lit("ok").alias("status"),
    )
    runs = spark.createDataFrame([], TABLES["runs"]).unionByName(run)
    return tables | {"runs": runs, "events": events.withColumn("run_id", F.lit(1).cast("long"))}


STEPS: dict[int, Callable[[Tables], Tables]] = {
    1: _legacy_run,
    2: _column("functions", "library"),
    3: _adds("basic_blocks"),
    4: _adds("corpus_binaries", "ground_truth"),
    5: _adds("function_code"),
    6: _column("ground_truth", "decl_file"),
    7: _adds("dataset_split"),
    8: _adds("measurements"),
    9: _adds("corpus_gaps"),
    10: _column("ground_truth", "abi"),
}
#: (table, column) to the table whose id it names.
FOREIGN_KEYS = {
    ("functions", "binary_id"): "binaries",
    ("events", "run_id"): "runs",
    ("events", "binary_id"): "binaries",
    ("function_code", "function_id"): "functions",
    ("ground_truth", "binary_id"): "binaries",
    ("measurements", "run_id"): "runs",
}


def broken_keys(tables: Tables) -> list[str]:
    """Foreign keys with values that are not there."""
    broken = []
    for (table, column), other in FOREIGN_KEYS.items():
        if table in tables and other in tables and column in tables[table].columns:
            ids = tables[other].select(F.col("id").alias(column))
            if not tables[table].where(F.col(column).isNotNull()).join(ids, column, "left_anti").isEmpty():
                broken.append(f"{table}.{column}")
    return broken


def migrate(tables: Tables, version: int, to: int = SCHEMA_VERSION) -> Tables:
    """tables of a version as those of a later one."""
    for step in range(version + 1, to + 1):
        tables = STEPS[step](tables)
    if broken := broken_keys(tables):
        raise ValueError(f"foreign keys without their rows: {', '.join(broken)}")
    return tables
