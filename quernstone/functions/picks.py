"""Element picks from sorted values, by index rather than by interpolation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_pick(df: DataFrame, keys: list[str], value: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group, the elements of the sorted values at 0-based indexes.

    at: column name to a function of the group's count. Values are counted first,
    so that what is sorted is the distinct values, not the rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    spread = counted.withColumn("_end", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(group))
    here = lambda i: (F.col("_end") > i) & (F.col("_end") - F.col("_n") <= i)
    return spread.groupBy(*keys).agg(*[F.max(F.when(here(index(F.col("_all"))), F.col(value))).alias(name) for name, index in at.items()])


def quantile_index(q: float) -> Callable[[Column], Column]:
    """min(n - 1, int(q * n))."""
    return lambda n: F.least(n - 1, F.floor(F.lit(q) * n))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def uniform(*parts: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) from the md5 of the parts, joined by :."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def seeded_order(seed: int, *parts: str) -> Column:
    """A reproducible order: the md5 of the seed and the parts, joined by :."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
