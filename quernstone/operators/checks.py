"""Integrity checks: each returns (subject, detail) for what is wrong.

All are joins and aggregates over whole tables; none looks up one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.store import MEASUREMENT_NAME, stored_levels
from quernstone.schemas import LEVELS

Tables = dict[str, DataFrame]


def _out(df: DataFrame, subject: Column | str, *details: Column | str) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(text(subject).alias("subject"), F.concat_ws(" ", *map(text, details)).alias("detail"))


def dangling_links(t: Tables, kinds: dict[str, str]) -> DataFrame:
    """Links to entities that are not there, or of no known kind. kinds: to tables."""
    known = [t[name].select(F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id")) for kind, name in kinds.items()]
    every = known[0]
    for more in known[1:]:
        every = every.unionByName(more)
    lost = t["event_links"].join(every, ["entity_kind", "entity_id"], "left_anti")
    return _out(lost, "event_id", "entity_kind", "entity_id", "role")


def orphan_events(t: Tables) -> DataFrame:
    """Events of runs that are still marked as running."""
    open_runs = t["runs"].where("status = 'running'").select(F.col("id").alias("run_id"), "kind")
    return _out(t["events"].join(open_runs, "run_id"), F.col("id"), "run_id", "kind")


def seq_gaps(t: Tables) -> DataFrame:
    """Binaries whose sequence is not 1, 2, 3 and so on, with the first wrong place.

    Sums find the suspects, and only their events are numbered. Nothing else keeps
    a sequence number from being there twice, so distinct ones are counted too.
    """
    sums = t["events"].groupBy("binary_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.count_distinct("seq").alias("kinds"))
    suspects = sums.where("low <> 1 OR high <> n OR kinds <> n").select("binary_id")
    order = Window.partitionBy("binary_id").orderBy("seq")
    placed = t["events"].join(suspects, "binary_id", "left_semi").select("binary_id", "seq", F.row_number().over(order).alias("place"))
    first = placed.where("place <> seq").groupBy("binary_id").agg(F.min(F.struct("place", "seq")).alias("f"))
    return _out(first, "binary_id", F.col("f.place"), F.col("f.seq"))


def unfinished_runs(t: Tables) -> DataFrame:
    return _out(t["runs"].where("status = 'running'"), "id", "kind")


def code_orphans(t: Tables) -> DataFrame:
    """Listings without a function, or of another binary than their function's."""
    own = t["functions"].select(F.col("id").alias("function_id"), F.col("binary_id").alias("owner"))
    lost = t["function_code"].join(own, "function_id", "left").where(F.col("owner").isNull() | (F.col("owner") != F.col("binary_id")))
    return _out(lost, "function_id", "binary_id", F.coalesce(F.col("owner").cast("string"), F.lit("none")))


def truth_binding(t: Tables) -> DataFrame:
    """Truth bound to a function of another binary."""
    own = t["functions"].select(F.col("id").alias("function_id"), F.col("binary_id").alias("owner"))
    return _out(t["ground_truth"].join(own, "function_id").where("owner <> binary_id"), "id", "binary_id", "owner")


def twin_links(t: Tables) -> DataFrame:
    """Twins that are not there, or on the same side."""
    twin = t["corpus_binaries"].select(F.col("binary_id").alias("twin_id"), F.col("stripped").alias("other"))
    wrong = t["corpus_binaries"].where("twin_id IS NOT NULL").join(twin, "twin_id", "left").where("other IS NULL OR other = stripped")
    return _out(wrong, "binary_id", F.when(F.col("other").isNull(), "twin missing").otherwise("twin on the same side"))


def split_groups(t: Tables) -> DataFrame:
    return _out(t["dataset_split"].join(t["corpus_binaries"].select("package").distinct(), "package", "left_anti"), "package", "split")


def measurement_runs(t: Tables) -> DataFrame:
    runs = t["runs"].select(F.col("id").alias("run_id"))
    return _out(t["measurements"].join(runs, "run_id", "left_anti"), "id", "method")


def measurement_names(t: Tables) -> DataFrame:
    """Names that say another run than their own, or one that trained nothing."""
    named = r"^encoder \(run (\d+)\)$"
    rows = t["measurements"].where(F.col("method").startswith("encoder"))
    own, of = F.regexp_extract("method", MEASUREMENT_NAME, 1), F.regexp_extract("method", named, 1)
    rows = rows.withColumn("own", own).withColumn("of", of)
    training = t["runs"].where("kind = 'train'").select(F.col("id").cast("string").alias("of"), F.lit(True).alias("trained"))
    wrong = rows.join(training, "of", "left").where(((F.col("own") != "") & (F.col("own") != F.col("run_id").cast("string"))) | ((F.col("of") != "") & F.col("trained").isNull()))
    return _out(wrong, "id", "run_id", "method")


def corpus_duplicates(t: Tables) -> DataFrame:
    counts = t["corpus_binaries"].groupBy("package", "opt_level", "stripped").agg(F.count("*").alias("n")).where("n > 1")
    return _out(counts, "package", "opt_level", "stripped", "n")


def _absent(t: Tables) -> DataFrame:
    """(package, opt_level) that a package of the corpus should have and has not."""
    packages = t["corpus_binaries"].select("package").distinct()
    grid = packages.withColumn("opt_level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    return grid.join(stored_levels(t["corpus_binaries"]), ["package", "opt_level"], "left_anti")


def corpus_completeness(t: Tables) -> DataFrame:
    missing = _absent(t).join(t["corpus_gaps"].select("package", "opt_level").distinct(), ["package", "opt_level"], "left_anti")
    return missing.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("opt_level")), " ").alias("detail")).select(F.col("package").alias("subject"), "detail")


def stale_gaps(t: Tables) -> DataFrame:
    return _out(t["corpus_gaps"].join(stored_levels(t["corpus_binaries"]), ["package", "opt_level"], "left_semi"), "package", "opt_level")


DEFAULT_KINDS = {"function": "functions", "basic_block": "basic_blocks", "string": "strings"}
#: Name to severity and check. Warnings never fail a run of the checks.
CHECKS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    "dangling_links": ("defect", lambda t: dangling_links(t, {k: v for k, v in DEFAULT_KINDS.items() if v in t})),
    "orphan_events": ("defect", orphan_events),
    "seq_gaps": ("defect", seq_gaps),
    "unfinished_runs": ("warning", unfinished_runs),
    "code_orphans": ("defect", code_orphans),
    "truth_binding": ("defect", truth_binding),
    "twin_links": ("defect", twin_links),
    "split_groups": ("defect", split_groups),
    "measurement_runs": ("defect", measurement_runs),
    "measurement_names": ("defect", measurement_names),
    "duplicates": ("defect", corpus_duplicates),
    "completeness": ("warning", corpus_completeness),
    "stale_gaps": ("warning", stale_gaps),
}


def summary(t: Tables) -> DataFrame:
    """(check, severity, n) of all checks."""
    out = None
    for name, (severity, check) in CHECKS.items():
        one = check(t).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def passed(t: Tables) -> bool:
    """Whether no defect was found."""
    return summary(t).where("severity = 'defect' AND n > 0").isEmpty()
