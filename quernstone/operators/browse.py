"""Browsing: filtered functions, rendered signatures, headers and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.listing import lines
from quernstone.functions.picks import index_pick, quantile_index, seeded_order

ORDER = ("package", "opt_level", "address", "function_id")


def find_functions(rows: DataFrame, function_id: int | None = None, package: str | None = None, opt_level: str | None = None, name: str | None = None, has_truth: bool | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """Rows that pass the filters given, in order; the filters reach the scan."""
    for column, value in (("function_id", function_id), ("package", package), ("opt_level", opt_level), ("name", name)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if has_truth is not None:
        rows = rows.where(F.col("name").isNotNull() if has_truth else F.col("name").isNull())
    if eligible is not None:
        rows = rows.join(eligible.select("function_id").distinct(), "function_id", "left_semi")
    return rows.orderBy(*[c for c in ORDER if c in rows.columns])


def sample_functions(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k rows without replacement, or all if there are no more."""
    return rows.orderBy(seeded_order(seed, "function_id"), "function_id").limit(k)


def signature(name: Column, return_type: Column, params: Column) -> Column:
    """``T name(a, b)``; void for no parameters, a message without truth."""
    listed = F.when(F.size(F.coalesce(params, F.array().cast("array<string>"))) == 0, "void").otherwise(F.array_join(params, ", "))
    return F.when(name.isNull(), "(no ground truth)").otherwise(F.concat(F.coalesce(return_type, F.lit("void")), F.lit(" "), name, F.lit("("), listed, F.lit(")")))


def header(package: Column, level: Column, address: Column, byte_hash: Column) -> Column:
    return F.concat_ws("  ", package, level, F.concat(F.lit("0x"), F.lower(F.hex(address))), F.substring(byte_hash, 1, 12))


def summary_line(function_id: Column, package: Column, level: Column, n_instructions: Column, name: Column) -> Column:
    return F.format_string("%8d  %-20s %s %6d  %s", function_id, package, level, n_instructions, F.coalesce(name, F.lit("-")))


def shown_listing(listing: Column, most: int = 40) -> Column:
    """The first lines, and how many more there are."""
    found = lines(listing)
    more = F.size(found) - most
    return F.when(more > 0, F.concat(F.slice(found, 1, most), F.array(F.concat(F.lit("... "), more.cast("string"), F.lit(" more"))))).otherwise(found)


def with_listing(rows: DataFrame, code: DataFrame) -> DataFrame:
    """rows (function_id) with their listing, the empty text for those without code."""
    found = rows.join(code.select("function_id", "listing"), "function_id", "left")
    return found.withColumn("listing", F.coalesce("listing", F.lit("")))


def split_report(rows: DataFrame) -> DataFrame:
    """Counts and instruction percentiles of each split; percentiles are picks."""
    identity = F.struct("package", "decl_file", "name")
    sums = rows.groupBy("split").agg(F.count("*").alias("functions"), F.count_distinct("package").alias("packages"), F.count_distinct(identity).alias("identities"), F.count_distinct("content").alias("contents"), F.max("n_instructions").alias("most"))
    at = {f"p{int(q * 100)}": quantile_index(q) for q in (0.5, 0.9, 0.99)}
    return sums.join(index_pick(rows, ["split"], "n_instructions", at), "split")
