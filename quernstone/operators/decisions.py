"""Rules that decide experiments, over histories of runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATE = 0.75
MARGIN = 0.005


def learning_rate(step: Column, rate: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine to a tenth."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, rate * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(rate * (0.1 + 0.45 * (1 + F.cos(math.pi * progress))))


def run_rows(history: DataFrame, steps: int) -> DataFrame:
    """(run, seed, mrr, best_step, final_step, complete, late_gain): the best of each
    run, and by how much it beats the best of its first three quarters. Rows of
    before training, with epoch -1, count for the best alone."""
    trained = F.col("epoch") >= 0
    early = F.max(F.when(trained & (F.col("step") <= LATE * steps), F.col("mrr")))
    return history.groupBy("run", "seed").agg(
        F.max("mrr").alias("mrr"),
        F.max_by("package_mrr", F.struct("mrr", -F.col("step"))).alias("package_mrr"),
        F.max_by("step", F.when(trained, F.struct("mrr", -F.col("step")))).alias("best_step"),
        F.coalesce(F.max(F.when(trained, F.col("step"))), F.lit(0)).alias("final_step"),
        F.coalesce(F.max_by("step", F.when(trained, F.col("epoch"))) == steps, F.lit(False)).alias("complete"),
        (F.max(F.when(trained, F.col("mrr"))) - early).alias("late_gain"),
    )


def _cell(run: str, seed: int, column: str) -> Column:
    return F.max(F.when((F.col("run") == run) & (F.col("seed") == seed), F.col(column)))


def _curve(rows: DataFrame) -> DataFrame:
    """One row: the gains of all data over half of it, and what is missing."""
    need = [("full", 0), ("full", 1), ("identity-0.5", 0), ("package-0.5", 0), ("package-0.5", 1)]
    there = sum((F.coalesce(_cell(r, s, "complete").cast("int"), F.lit(0)) for r, s in need), F.lit(0))
    full0, full1 = _cell("full", 0, "mrr"), _cell("full", 1, "mrr")
    return rows.agg(
        (F.lit(len(need)) - there).alias("missing"),
        (full0 - _cell("identity-0.5", 0, "mrr")).alias("identity_gain"),
        ((full0 - _cell("package-0.5", 0, "mrr") + full1 - _cell("package-0.5", 1, "mrr")) / 2).alias("package_gain"),
        F.abs(full0 - full1).alias("seed_spread"),
        F.greatest(_cell("full", 0, "late_gain"), _cell("full", 1, "late_gain")).alias("late_gain"),
    )


def curve_verdict(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: what more data would be worth; no decision while runs are missing."""
    c = _curve(rows)
    decision = F.when(F.col("package_gain") > threshold, "more packages help").when(F.col("identity_gain") > threshold, "only more functions help").otherwise("flattened")
    c = c.withColumn("decision", F.when(F.col("missing") == 0, decision))
    return c.withColumn("provisional", F.when(F.col("missing") == 0, (F.col("late_gain") > threshold / 2) & (F.col("decision") == "flattened")))


def short_curve_verdict(rows: DataFrame, threshold: float) -> DataFrame:
    """The same with a second threshold, twice the first."""
    larger = F.greatest("identity_gain", "package_gain")
    decision = F.when(larger <= threshold, "levelled off").when(larger <= 2 * threshold, "still climbing below a doubling's worth").when(F.col("package_gain") >= F.col("identity_gain"), "more packages still help").otherwise("only more functions help")
    c = _curve(rows).withColumn("decision", F.when(F.col("missing") == 0, decision))
    open_end = (F.col("late_gain") > threshold / 2) & (F.col("decision") == "levelled off")
    return c.withColumn("provisional", F.when(F.col("missing") == 0, (F.col("seed_spread") > threshold) | open_end))


def share_verdict(results: DataFrame, baseline: str = "none") -> DataFrame:
    """(share, mean_mrr, qualified, margin): shares that beat the baseline by more
    than a margin under every seed of it, without dropping as much elsewhere.

    results: share, seed, mrr, package_mrr, others (MRRs of the other tasks, null
    where a task is missing). The margin is twice the baseline's spread.
    """
    base = results.where(F.col("share") == baseline)
    spread = base.agg(F.greatest(F.lit(MARGIN), 2 * (F.max("mrr") - F.min("mrr"))).alias("margin"), F.count_distinct("seed").alias("seeds"))  # one row
    other = base.select("seed", F.col("mrr").alias("b"), F.col("package_mrr").alias("bp"), F.col("others").alias("bo"))
    rows = results.where(F.col("share") != baseline).join(other, "seed").crossJoin(F.broadcast(spread))
    kept = F.forall(F.zip_with("others", "bo", lambda x, y: x.isNull() | y.isNull() | (x >= y - F.col("margin"))), lambda x: x)
    good = (F.col("mrr") - F.col("b") > F.col("margin")) & (F.col("package_mrr") >= F.col("bp") - F.col("margin")) & kept
    sums = rows.groupBy("share").agg(F.avg("mrr").alias("mean_mrr"), F.bool_and(good).alias("good"), F.count("*").alias("n"), F.max("margin").alias("margin"), F.max("seeds").alias("seeds"))
    return sums.select("share", "mean_mrr", (F.col("good") & (F.col("n") == F.col("seeds"))).alias("qualified"), "margin")


def full_verdict(rows: DataFrame) -> DataFrame:
    """One row: whether pre-training helps. rows: group (pretrained, random), seed,
    mrr, package_mrr, late_gain."""
    of = lambda f, g, c: f(F.when(F.col("group") == g, F.col(c)))
    pre, ran = "pretrained", "random"
    sums = rows.agg(
        *[(of(F.max, g, "mrr") - of(F.min, g, "mrr")).alias(f"spread_{g}") for g in (pre, ran)],
        *[F.count_if(F.col("group") == g).alias(f"n_{g}") for g in (pre, ran)],
        (of(F.avg, pre, "mrr") - of(F.avg, ran, "mrr")).alias("gain"),
        (of(F.avg, pre, "package_mrr") - of(F.avg, ran, "package_mrr")).alias("package_gain"),
        F.max("late_gain").alias("late_gain"),
    )
    m = sums.withColumn("margin", F.greatest(F.lit(MARGIN), F.col(f"spread_{pre}"), F.col(f"spread_{ran}")))
    result = F.when((F.col("gain") > F.col("margin")) & (F.col("package_gain") >= -F.col("margin")), "helps").when(-F.col("gain") > F.col("margin"), "hurts").otherwise("no measured difference")
    enough = (F.col(f"n_{pre}") >= 2) & (F.col(f"n_{ran}") >= 2)
    open_end = (F.col("late_gain") > F.col("margin") / 2) & (F.abs("gain") <= F.col("margin"))
    return m.select("margin", "gain", "package_gain", F.when(enough, result).alias("result"), F.when(enough, open_end).alias("provisional"))


def early_stopping(history: DataFrame, patience: int) -> DataFrame:
    """(run, seed, best_step, best, stopped_at): the running best and the step after
    which it was not beaten for patience rows; null if training ran out."""
    order = Window.partitionBy("run", "seed").orderBy("step")
    before = F.max("mrr").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("better", F.coalesce(F.col("mrr") > before, F.lit(True)))
    since = F.count_if("better").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", since)
    waited = F.row_number().over(Window.partitionBy("run", "seed", "island").orderBy("step")) - 1
    rows = rows.withColumn("waited", waited)
    stop = rows.groupBy("run", "seed").agg(F.min(F.when(F.col("waited") >= patience, F.col("step"))).alias("stopped_at"))
    kept = rows.join(stop, ["run", "seed"]).where(F.col("better") & (F.col("stopped_at").isNull() | (F.col("step") <= F.col("stopped_at"))))
    return kept.groupBy("run", "seed").agg(F.max_by("step", "step").alias("best_step"), F.max_by("mrr", "step").alias("best"), F.max("stopped_at").alias("stopped_at"))
