"""Queries of reports, rendering and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.picks import index_pick, quantile_index
from quernstone.operators import browse, decisions
from quernstone.plans.bindings import NEEDS, SQL, event_log, table
from quernstone.plans.catalogue import query
from quernstone.plans.dataset_queries import FIXED, eligible, fixed_splits

_PICK = "list_sort(list({0}))[(least(count(*) - 1, floor({1} * count(*))::BIGINT) + 1)::INT]"


@query("index_percentiles", f"SELECT package, {_PICK.format('n_instructions', 0.5)} AS p50, {_PICK.format('n_instructions', 0.9)} AS p90, {_PICK.format('n_instructions', 0.99)} AS p99 FROM eligible GROUP BY package", "eligible")
def index_percentiles(spark, d):
    return index_pick(eligible(spark, d), ["package"], "n_instructions", {"p50": quantile_index(0.5), "p90": quantile_index(0.9), "p99": quantile_index(0.99)})


@query(
    "split_report",
    f"WITH s AS ({FIXED}) SELECT split, count(*) AS functions, count(DISTINCT package) AS packages, count(DISTINCT (package, decl_file, name)) AS identities, count(DISTINCT content) AS contents, max(n_instructions) AS most, {_PICK.format('n_instructions', 0.5)} AS p50, {_PICK.format('n_instructions', 0.9)} AS p90, {_PICK.format('n_instructions', 0.99)} AS p99 FROM eligible JOIN s USING (package) GROUP BY split",
    "eligible",
)
def split_report(spark, d):
    rows = eligible(spark, d)
    return browse.split_report(rows.join(F.broadcast(fixed_splits(rows)), "package"))


@query("signature_render", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '(no ground truth)' WHEN p_partkey % 3 = 0 THEN p_type || ' ' || p_name || '(void)' ELSE p_type || ' ' || p_name || '(' || p_brand || ', int)' END AS signature FROM part")
def signature_render(spark, d):
    params = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.lit("int")))
    name = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", browse.signature(name, F.col("p_type"), params).alias("signature"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Runs of training from events: five runs by user, an evaluation each ten steps."""
    names = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(s).alias("seed")) for r, s in RUNS])
    e = event_log(spark, d)
    rows = e.select(F.element_at(names, (F.col("event_id") % len(RUNS)).cast("int") + 1).alias("r"), (F.floor(F.col("event_id") / len(RUNS)) % 40 * 10 + 10).cast("int").alias("step"), "value")
    per = rows.groupBy("r.run", "r.seed", "step").agg(F.round(F.max("value") / 1000, 6).alias("mrr"))
    return per.withColumn("epoch", (F.col("step") / 10 - 1).cast("int")).withColumn("package_mrr", F.col("mrr"))


RUNS = [("full", 0), ("full", 1), ("identity-0.5", 0), ("package-0.5", 0), ("package-0.5", 1)]
STEPS = 400
SQL["history"] = f"SELECT {[r for r, _ in RUNS]}[(event_id % 5 + 1)::INT] AS run, {[s for _, s in RUNS]}[(event_id % 5 + 1)::INT]::INT AS seed, (event_id // 5 % 40 * 10 + 10)::INT AS step, round(max(value) / 1000, 6) AS mrr FROM events GROUP BY 1, 2, 3"
SQL["run_row"] = f"SELECT run, seed, max(mrr) AS mrr, arg_max(step, (mrr, -step)) AS best_step, max(step) AS final_step, max(step) = {STEPS} AS complete, max(mrr) - max(mrr) FILTER (step <= {0.75 * STEPS}) AS late_gain FROM history GROUP BY ALL"
SQL["cells"] = "SELECT max(mrr) FILTER (run = 'full' AND seed = 0) AS f0, max(mrr) FILTER (run = 'full' AND seed = 1) AS f1, max(mrr) FILTER (run = 'identity-0.5') AS i0, max(mrr) FILTER (run = 'package-0.5' AND seed = 0) AS p0, max(mrr) FILTER (run = 'package-0.5' AND seed = 1) AS p1, max(late_gain) FILTER (run = 'full') AS late, 5 - count(*) FILTER (complete) AS missing FROM run_row"
NEEDS |= {"run_row": ["history"], "cells": ["run_row"]}


@query("curve_late_gain", "SELECT run, seed, mrr, best_step, final_step, complete, round(late_gain, 6) AS late_gain FROM run_row", "run_row")
def curve_late_gain(spark, d):
    return decisions.run_rows(history(spark, d), STEPS).select("run", "seed", "mrr", "best_step", "final_step", "complete", F.round("late_gain", 6).alias("late_gain"))


@query(
    "curve_verdict",
    "SELECT CASE WHEN missing > 0 THEN NULL WHEN (f0 - p0 + f1 - p1) / 2 > 0.0148 THEN 'more packages help' WHEN f0 - i0 > 0.0148 THEN 'only more functions help' ELSE 'flattened' END AS decision, round(f0 - i0, 6) AS identity_gain, round((f0 - p0 + f1 - p1) / 2, 6) AS package_gain FROM cells",
    "cells",
)
def curve_verdict(spark, d):
    out = decisions.curve_verdict(decisions.run_rows(history(spark, d), STEPS), 0.0148)
    return out.select("decision", F.round("identity_gain", 6).alias("identity_gain"), F.round("package_gain", 6).alias("package_gain"))


@query(
    "short_curve_verdict",
    "SELECT CASE WHEN missing > 0 THEN NULL WHEN greatest(f0 - i0, (f0 - p0 + f1 - p1) / 2) <= 0.01 THEN 'levelled off' WHEN greatest(f0 - i0, (f0 - p0 + f1 - p1) / 2) <= 0.02 THEN 'still climbing below a doubling''s worth' WHEN (f0 - p0 + f1 - p1) / 2 >= f0 - i0 THEN 'more packages still help' ELSE 'only more functions help' END AS decision, CASE WHEN missing = 0 THEN abs(f0 - f1) > 0.01 OR (late > 0.005 AND greatest(f0 - i0, (f0 - p0 + f1 - p1) / 2) <= 0.01) END AS provisional FROM cells",
    "cells",
)
def short_curve_verdict(spark, d):
    return decisions.short_curve_verdict(decisions.run_rows(history(spark, d), STEPS), 0.01).select("decision", "provisional")


@query(
    "share_verdict",
    """WITH r AS (SELECT CASE run WHEN 'full' THEN 'none' ELSE run END AS share, seed, mrr FROM run_row WHERE run <> 'identity-0.5'), m AS (SELECT greatest(0.005, 2 * (max(mrr) - min(mrr))) AS margin FROM r WHERE share = 'none')
    SELECT a.share, round(avg(a.mrr), 6) AS mean_mrr, bool_and(a.mrr - b.mrr > margin AND a.mrr >= b.mrr - margin) AS qualified, round(max(margin), 6) AS margin FROM r a JOIN r b ON a.seed = b.seed AND b.share = 'none' CROSS JOIN m WHERE a.share <> 'none' GROUP BY a.share""",
    "run_row",
)
def share_verdict(spark, d):
    rows = decisions.run_rows(history(spark, d), STEPS).where("run <> 'identity-0.5'")
    rows = rows.select(F.when(F.col("run") == "full", "none").otherwise(F.col("run")).alias("share"), "seed", "mrr", "package_mrr", F.array(F.col("mrr")).alias("others"))
    out = decisions.share_verdict(rows)
    return out.select("share", F.round("mean_mrr", 6).alias("mean_mrr"), "qualified", F.round("margin", 6).alias("margin"))


@query(
    "full_verdict",
    """WITH r AS (SELECT CASE run WHEN 'full' THEN 'pretrained' ELSE 'random' END AS g, seed, mrr, late_gain FROM run_row WHERE run <> 'identity-0.5'),
    c AS (SELECT greatest(0.005, max(mrr) FILTER (g = 'pretrained') - min(mrr) FILTER (g = 'pretrained'), max(mrr) FILTER (g = 'random') - min(mrr) FILTER (g = 'random')) AS margin, avg(mrr) FILTER (g = 'pretrained') - avg(mrr) FILTER (g = 'random') AS gain FROM r)
    SELECT round(margin, 6) AS margin, round(gain, 6) AS gain, CASE WHEN gain > margin THEN 'helps' WHEN -gain > margin THEN 'hurts' ELSE 'no measured difference' END AS result FROM c""",
    "run_row",
)
def full_verdict(spark, d):
    rows = decisions.run_rows(history(spark, d), STEPS).where("run <> 'identity-0.5'")
    rows = rows.withColumn("group", F.when(F.col("run") == "full", "pretrained").otherwise("random"))
    return decisions.full_verdict(rows).select(F.round("margin", 6).alias("margin"), F.round("gain", 6).alias("gain"), "result")


@query("lr_schedule", "SELECT step, round(CASE WHEN step < 100 THEN 0.0003 * (step + 1) / 100 ELSE 0.0003 * (0.1 + 0.45 * (1 + cos(pi() * least(1.0, (step - 100) / 900.0)))) END, 9) AS rate FROM (SELECT DISTINCT event_id AS step FROM events)")
def lr_schedule(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("step")).distinct().select("step", F.round(decisions.learning_rate(F.col("step"), 0.0003, 100, 1000), 9).alias("rate"))


@query(
    "early_stopping",
    """WITH b AS (SELECT *, coalesce(mrr > max(mrr) OVER (PARTITION BY run, seed ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM history),
    i AS (SELECT *, count(*) FILTER (better) OVER (PARTITION BY run, seed ORDER BY step) AS island FROM b),
    w AS (SELECT *, row_number() OVER (PARTITION BY run, seed, island ORDER BY step) - 1 AS waited FROM i),
    s AS (SELECT run, seed, min(step) FILTER (waited >= 5) AS stopped_at FROM w GROUP BY ALL)
    SELECT run, seed, arg_max(step, step) AS best_step, arg_max(mrr, step) AS best, max(stopped_at) AS stopped_at FROM w JOIN s USING (run, seed) WHERE better AND (stopped_at IS NULL OR step <= stopped_at) GROUP BY run, seed""",
    "history",
)
def early_stopping(spark, d):
    return decisions.early_stopping(history(spark, d), 5)


@query("conversation_turns", "SELECT conv_id, count(*) AS turns, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS gapless FROM conversations GROUP BY conv_id")
def conversation_turns(spark, d):
    gapless = (F.min("turn") == 0) & (F.max("turn") == F.count("*") - 1) & (F.count_distinct("turn") == F.count("*"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), gapless.alias("gapless"))


@query("labelled_documents", "SELECT quality, toxic, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def labelled_documents(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))
