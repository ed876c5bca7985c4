"""Measurements that a run records, and the tables that are made of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.schemas import TABLES

METRICS = ("queries", "recall_at_1", "recall_at_10", "mrr", "median_rank")


def task_params(split: str, query_level: str, pool_level: str, seed: int, fingerprint: str) -> str:
    """What a retrieval task was, for the run that measures it."""
    return json.dumps({"split": split, "query_level": query_level, "pool_level": pool_level, "seed": seed, "fingerprint": fingerprint})


def record(measurements: DataFrame, results: DataFrame, run_id: int, split: str, now: Column | None = None) -> DataFrame:
    """measurements and a row for each method of results (method, metrics…), numbered
    after the last; methods are few, so one task numbers them."""
    last = measurements.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    kept = [c for c in results.columns if c != "method"]
    rows = results.select("method", F.to_json(F.struct(*kept)).alias("metrics"), F.row_number().over(Window.orderBy("method")).alias("n")).crossJoin(F.broadcast(last))
    rows = rows.select((F.col("last") + F.col("n")).alias("id"), F.lit(run_id).cast("long").alias("run_id"), F.lit(split).alias("split"), "method", "metrics", (now if now is not None else F.current_timestamp()).cast("timestamp").alias("recorded_at"))
    return measurements.select(*TABLES["measurements"].names).unionByName(rows)


def read_metric(measurements: DataFrame, path: str, name: str) -> DataFrame:
    """measurements with a number out of their JSON, null where it lacks it."""
    return measurements.withColumn(name, F.get_json_object("metrics", f"$.{path}").cast("double"))


def by_strength(results: DataFrame) -> DataFrame:
    """Methods from the weakest to the strongest, by MRR, then by name."""
    return results.orderBy("mrr", "method")


def package_table(per_package: DataFrame, methods: list[str]) -> DataFrame:
    """(package, queries, a column of MRR for each method): the largest package first."""
    wide = per_package.groupBy("package").pivot("method", methods).agg(F.max("mrr"))
    size = per_package.groupBy("package").agg(F.max("queries").alias("queries"))
    return size.join(wide, "package").orderBy(F.desc("queries"), "package")


def histogram(rows: DataFrame, by: str, top: int = 15) -> DataFrame:
    """(value, n): the commonest values, the first of equally common ones first."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(top)


def run_summaries(summaries: DataFrame, groups: list[str], seeds: list[int]) -> DataFrame:
    """(group, seed, mrr): a row for each run that was planned, null for one that has
    left no summary. summaries: group, seed, metrics (JSON)."""
    spark = summaries.sparkSession
    planned = spark.createDataFrame([(g, s) for g in groups for s in seeds], "group string, seed long")
    found = summaries.select("group", F.col("seed").cast("long").alias("seed"), F.get_json_object("metrics", "$.mrr").cast("double").alias("mrr"))
    return planned.join(found, ["group", "seed"], "left")


def drawn_totals(summaries: DataFrame) -> DataFrame:
    """(run_id, drawn, complete): the pairs of levels that a run drew, summed over its
    map of counts, and whether that is all of its steps. summaries: run_id, drawn
    (map of pair of levels to count), steps, batch."""
    pairs = F.aggregate(F.map_values("drawn"), F.lit(0).cast("long"), lambda s, x: s + x)
    return summaries.select("run_id", pairs.alias("drawn"), (pairs == F.col("steps") * F.col("batch")).alias("complete"))
