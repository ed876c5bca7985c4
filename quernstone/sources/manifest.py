"""The package manifest (TOML) as a table, and the names of binaries."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.schemas import LEVELS

FIELDS = "name string, version string, url string, license string, domain string, include array<string>, exclude array<string>, depends array<string>"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each package and each of its dependencies, which name it in
    depends_of. A manifest is a file that people write, so the driver reads it."""
    rows: list[tuple] = []

    def add(entry: dict, of: str | None) -> None:
        depends = entry.get("depends", [])
        rows.append((*(entry.get(k) for k in ("name", "version", "url", "license", "domain")), entry.get("include", []), entry.get("exclude", []), [x["name"] for x in depends], of))
        for x in depends:
            add(x, entry["name"])

    for entry in tomllib.loads(Path(path).read_text()).get("package", []):
        add(entry, None)
    return spark.createDataFrame(rows, FIELDS + ", depends_of string")


def binary_paths(packages: DataFrame) -> DataFrame:
    """(name, opt_level, debug_path, stripped_path) of each package at each level."""
    grid = packages.select("name", F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("opt_level"))
    stem = F.concat_ws("-", "name", "opt_level")
    return grid.select("name", "opt_level", F.concat(F.lit("debug/"), stem, F.lit(".dll")).alias("debug_path"), F.concat(F.lit("stripped/"), stem, F.lit(".dll")).alias("stripped_path"))
