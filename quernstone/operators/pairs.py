"""Pairs of functions to compare, and what surrounds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.picks import seeded_order
from quernstone.operators.sampling import ordinal_within
from quernstone.operators.vocab import IDENTITY


def both_levels(rows: DataFrame, query_level: str = "O0", pool_level: str = "O3") -> DataFrame:
    """(identity, query_id, pool_id) of identities at both levels; of rows with one
    identity and level that of the largest id."""
    side = lambda level, name: rows.where(F.col("opt_level") == level).groupBy(*IDENTITY).agg(F.max("function_id").alias(name))
    return side(query_level, "query_id").join(side(pool_level, "pool_id"), IDENTITY)


def sample_pairs(rows: DataFrame, count: int = 3000, seed: int = 0) -> DataFrame:
    """count true pairs, in an order that the seed gives."""
    return both_levels(rows).orderBy(seeded_order(seed, *IDENTITY), *IDENTITY).limit(count)


def sample_false_pairs(rows: DataFrame, count: int = 300, seed: int = 0) -> DataFrame:
    """count pairs of one package with different names.

    In each package the O0 rows, in one hash order, meet the O3 rows of the same
    ordinal in another, in turns; equal names are left out. So no row meets more
    than one, and no package all of its pairs.
    """

    def numbered(level: str, name: str, salt: int) -> DataFrame:
        here = rows.where(F.col("opt_level") == level)
        placed = ordinal_within(here.select("package", "function_id", "name"), ["package"], [seeded_order(salt, "function_id"), F.col("function_id")], "ordinal")
        return placed.select("package", F.col("function_id").alias(f"{name}_id"), F.col("name").alias(f"{name}_name"), "ordinal")

    q, k = numbered("O0", "query", 2 * seed), numbered("O3", "pool", 2 * seed + 1)
    sizes = k.groupBy("package").agg(F.count("*").alias("n"))
    turned = q.join(sizes, "package").withColumn("ordinal", F.col("ordinal") % F.col("n"))
    pairs = turned.join(k, ["package", "ordinal"]).where("query_name <> pool_name")
    return pairs.orderBy(seeded_order(seed, "query_id", "pool_id"), "query_id").select("package", "query_id", "pool_id").limit(count)


def siblings(rows: DataFrame) -> DataFrame:
    """(package, decl_file, opt_level, n, first_names): functions by file, with the
    first ten of their names; the members themselves stay rows."""
    here = ["package", "decl_file", "opt_level"]
    rows = rows.where("decl_file IS NOT NULL").select(*here, "name", "function_id", F.pmod(F.xxhash64("function_id"), F.lit(64)).alias("_b"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*here, *by).orderBy("name", "function_id"))
    # the first ten of each part of a file hold the first ten of the file
    few = rows.withColumn("_p", place("_b")).where("_p <= 10").withColumn("_p", place()).where("_p <= 10")
    first = few.groupBy(*here).agg(F.array_sort(F.collect_list("name")).alias("first_names"))
    return rows.groupBy(*here).agg(F.count("*").alias("n")).join(first, here)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Packages whose split differs between two assignments, or is in one only."""
    one, two = before.select("package", F.col("split").alias("old")), after.select("package", F.col("split").alias("new"))
    return one.join(two, "package", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def merged(families: DataFrame) -> DataFrame:
    """(name, implementation) of all families; it is an error if two of them give a
    name different implementations."""
    kinds = families.groupBy("name").agg(F.count_distinct("implementation").alias("n"), F.min("implementation").alias("implementation"))
    clash = F.raise_error(F.concat(F.lit("two implementations of "), F.col("name")))
    return kinds.select("name", F.when(F.col("n") > 1, clash).otherwise(F.col("implementation")).alias("implementation"))


def local_run(checkpoints: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(checkpoint, run_id, label): the one training run that fits all keys, or none.
    A checkpoint of elsewhere keeps the number that it came with."""
    train = runs.where("kind = 'train'").select(F.col("id").alias("run_id"), *[F.col(k).alias(f"_{k}") for k in keys])
    fits = [checkpoints[k].eqNullSafe(train[f"_{k}"]) for k in keys]
    found = checkpoints.join(train, fits, "left").groupBy("checkpoint", "came_with").agg(F.count("run_id").alias("n"), F.min("run_id").alias("run_id"))
    one = F.when(F.col("n") == 1, F.col("run_id"))
    label = F.when(F.col("n") == 1, F.format_string("encoder (run %d)", "run_id")).otherwise(F.format_string("encoder (run %d elsewhere)", "came_with"))
    return found.select("checkpoint", one.alias("run_id"), label.alias("label"))


def to_rescan(binaries: DataFrame, corpus: DataFrame, code: DataFrame, only_corpus: bool = False, skip_existing: bool = False) -> DataFrame:
    """Binaries whose listings are to be made: all but debug sides."""
    debug = corpus.where(~F.col("stripped")).select(F.col("binary_id").alias("id"))
    rows = binaries.join(debug, "id", "left_anti")
    if only_corpus:
        rows = rows.join(corpus.select(F.col("binary_id").alias("id")), "id", "left_semi")
    if skip_existing:
        rows = rows.join(code.select(F.col("binary_id").alias("id")).distinct(), "id", "left_anti")
    return rows


def resumable(corpus: DataFrame, binaries: DataFrame, files: DataFrame) -> DataFrame:
    """Registered binaries whose file on disk still has the stored hash."""
    stored = corpus.join(binaries.select(F.col("id").alias("binary_id"), "path", "sha256"), "binary_id")
    return stored.join(files.select("path", F.col("sha256").alias("_now")), "path").where("sha256 = _now").drop("_now")
