"""Training samples: subsets, pairs, masks and false negatives.

Randomness is the order or the value of an md5 of seed and ids, so a sample does
not depend on partitions; prefixes of one seed are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.picks import seeded_order, uniform
from quernstone.operators.vocab import IDENTITY, MASK, SPECIALS

EPOCH_STEP = 1000003
IGNORED = -100


def epoch_seed(seed: int, epoch: int) -> int:
    return seed * EPOCH_STEP + epoch


def ordinal(rows: DataFrame, order: list[Column], name: str, buckets: int = 256) -> DataFrame:
    """rows numbered from 1 in the order of its first column, a hexadecimal hash.

    The hash's first digits make buckets; counts of the buckets give where each
    begins, so no task sorts all rows.
    """
    part = rows.withColumn("_b", F.substring(order[0], 1, 2))
    sizes = part.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 256 rows
    starts = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return part.withColumn("_r", inside).join(F.broadcast(starts), "_b").withColumn(name, F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def ordinal_within(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows numbered from 0 within the groups of by, in the order of a hexadecimal
    hash: in two levels, so that a group that a third of all rows are in is numbered
    in many tasks."""
    part = rows.withColumn("_h", order[0]).withColumn("_b", F.substring("_h", 1, 2))
    sizes = part.groupBy(*by, "_b").agg(F.count("*").alias("_n"))  # at most 256 for each group
    starts = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *order[1:]))
    return part.withColumn("_r", inside).join(starts, [*by, "_b"]).withColumn(name, F.col("_r") + F.col("_before") - 1).drop("_h", "_b", "_r", "_before")


def subset(rows: DataFrame, fraction: float, unit: str, seed: int = 0) -> DataFrame:
    """The rows of a fraction of the identities, or of the packages; at least one."""
    keys = IDENTITY if unit == "identity" else ["package"]
    groups = rows.select(*keys).distinct()
    placed = ordinal(groups, [seeded_order(seed, *keys), *map(F.col, keys)], "place")
    total = groups.agg(F.count("*").alias("n"))  # one row
    kept = placed.crossJoin(F.broadcast(total)).where(F.col("place") <= F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("n")).cast("long")))
    return rows.join(kept.select(*keys), keys, "left_semi")


def first_of_content(rows: DataFrame) -> DataFrame:
    """Of rows with equal content that of the least id."""
    least = rows.groupBy("content").agg(F.min(F.struct("function_id", *[c for c in rows.columns if c not in ("function_id", "content")])).alias("r"))
    return least.select("content", "r.*")


def mask_tokens(encoded: DataFrame, vocab: DataFrame, rate: float = 0.15, seed: int = 0) -> DataFrame:
    """(function_id, position, input_id, label) of the tokens that may be masked.

    An exact share of a function's tokens is chosen, at least one: 80 in 100 become
    the mask, 10 a token drawn from the vocabulary, 10 stay. Others have no label.
    """
    open_tokens = encoded.where(F.col("token_id") > MASK)
    here = ["function_id", "position"]
    order = Window.partitionBy("function_id").orderBy(seeded_order(seed, *here), "position")
    n = F.count("*").over(Window.partitionBy("function_id"))
    placed = open_tokens.withColumn("place", F.row_number().over(order)).withColumn("n", n)
    chosen = F.col("place") <= F.least("n", F.greatest(F.lit(1), F.bround(F.lit(rate) * F.col("n")).cast("long")))
    roll, draw = uniform(F.lit("roll"), F.lit(str(seed)), *here), uniform(F.lit("token"), F.lit(str(seed)), *here)
    size = vocab.agg(F.count("*").alias("size"))  # one row
    drawn = (len(SPECIALS) + F.floor(draw * (F.col("size") - len(SPECIALS)))).cast("int")
    rows = placed.crossJoin(F.broadcast(size))
    value = F.when(~chosen, F.col("token_id")).when(roll < 0.8, F.lit(MASK)).when(roll < 0.9, drawn).otherwise(F.col("token_id"))
    return rows.select(*here, value.alias("input_id"), F.when(chosen, F.col("token_id")).otherwise(F.lit(IGNORED)).alias("label"))


def paired_identities(rows: DataFrame) -> DataFrame:
    """Identities that two levels or more have."""
    return rows.groupBy(*IDENTITY).agg(F.count_distinct("opt_level").alias("levels")).where("levels >= 2")


def batched(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with batch and slot, in the order of an id. Ids are counted by range
    first, so that no task sorts all rows."""
    spread = rows.withColumn("_range", F.floor(F.col(order) / 100_000))
    counts = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = spread.withColumn("_i", inside).join(starts, "_range").withColumn("_i", F.col("_i") + F.col("_before") - 1)
    return numbered.withColumn("batch", F.floor(F.col("_i") / size).cast("int")).withColumn("slot", (F.col("_i") % size).cast("int")).drop("_range", "_before", "_i")


def false_negatives(slots: DataFrame) -> DataFrame:
    """(batch, slot, other): keys of a batch that would count against a slot although
    their content is that of its query or of its own key."""
    keys = slots.select("batch", F.col("slot").alias("other"), F.col("key_content").alias("content"))
    own = slots.select("batch", "slot", F.explode(F.array_distinct(F.array("query_content", "key_content"))).alias("content"))
    return own.join(keys, ["batch", "content"]).where("slot <> other").select("batch", "slot", "other").distinct()


def identical_share(rows: DataFrame) -> DataFrame:
    """One row: the expected share of drawn pairs of levels with equal content."""
    views = rows.groupBy(*IDENTITY, "opt_level", "content").agg(F.count("*").alias("n"))
    size = views.groupBy(*IDENTITY, "opt_level").agg(F.sum("n").alias("level_rows"))
    levels = size.groupBy(*IDENTITY).agg(F.count("*").alias("levels"), F.collect_list(F.struct("opt_level", "level_rows")).alias("sizes")).where("levels >= 2")
    weighed = views.join(size, [*IDENTITY, "opt_level"]).join(levels.select(*IDENTITY, "levels"), IDENTITY)
    # equal content at two levels: (sum of shares)^2 - sum of squares, over ordered pairs
    share = F.col("n") / F.col("level_rows")
    per = weighed.groupBy(*IDENTITY, "content", "levels").agg((F.sum(share) ** 2 - F.sum(share**2)).alias("same"))
    each = per.groupBy(*IDENTITY, "levels").agg((F.sum("same") / (F.col("levels") * (F.col("levels") - 1))).alias("p"))
    return each.agg(F.count("*").alias("identities"), F.avg("p").alias("expected"))


def period_batches(rows: DataFrame, order: str, steps: int) -> DataFrame:
    """rows with the period that their place in the whole stream falls in."""
    return batched(rows, order, steps).withColumnsRenamed({"batch": "period", "slot": "step"})


def padded(ids: Column, length: Column | int, pad: int = 0) -> tuple[Column, Column]:
    """ids filled up to a length, and the mask of what is no filling."""
    missing = F.greatest((F.lit(length) if isinstance(length, int) else length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad), missing)), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))


def last_keys(keys: DataFrame, size: int, step: str = "step") -> DataFrame:
    """The newest keys, as a first-in first-out queue of a size holds them."""
    return keys.orderBy(F.desc(step), F.desc("slot")).limit(size)
