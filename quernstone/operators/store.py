"""The event-sourced store: runs, entities, events and their sequence.

A change is a new snapshot: functions take DataFrames and return DataFrames, and
sources.snapshots writes them. Rows have no order of their own, so operators that
number rows say by what order they do.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.schemas import LEVELS, RUN_STATUS

MEASUREMENT_NAME = r"^encoder-(\d+)(-start)?$"


def start_run(runs: DataFrame, run_id: int, kind: str, started_at, params: str = "{}", code_version: str = "unknown", seed: int | None = None, tool: str | None = None) -> DataFrame:
    row = runs.sparkSession.createDataFrame([(run_id, kind, tool, None, code_version, params, seed, started_at, None, "running")], runs.schema)
    return runs.unionByName(row)


def finish_run(runs: DataFrame, run_id: int, status: str, ended_at) -> DataFrame:
    if status not in RUN_STATUS[1:]:
        raise ValueError(f"a run does not end as {status}")
    mine = F.col("id") == run_id
    return runs.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "ended_at": F.when(mine, F.lit(ended_at)).otherwise(F.col("ended_at"))})


def set_run_tool_version(runs: DataFrame, run_id: int, version: str) -> DataFrame:
    return runs.withColumn("tool_version", F.when(F.col("id") == run_id, version).otherwise(F.col("tool_version")))


def append_events(existing: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """batch with seq: for each binary it goes on from the last there is, without
    gaps, in the order given."""
    last = existing.groupBy("binary_id").agg(F.max("seq").alias("_last"))
    here = F.row_number().over(Window.partitionBy("binary_id").orderBy(*order))
    return batch.withColumn("_n", here).join(last, "binary_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_last")


def explode_links(events: DataFrame) -> DataFrame:
    """(event_id, entity_kind, entity_id, role) of events with an array of links."""
    return events.select("event_id", F.explode("links").alias("l")).select("event_id", "l.entity_kind", "l.entity_id", "l.role").distinct()


def edges(links: DataFrame) -> DataFrame:
    """(event_id, source, target): the subject and target roles of an event joined."""
    side = lambda role, name: links.where(F.col("role") == role).select("event_id", F.col("entity_id").alias(name))
    return side("subject", "source").join(side("target", "target"), "event_id")


def stale(started: Column, now, minutes: int) -> Column:
    return started < F.lit(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def close_stale_runs(runs: DataFrame, now, minutes: int = 60) -> DataFrame:
    """runs, those that have been running longer than minutes failed at now."""
    old = (F.col("status") == "running") & stale(F.col("started_at"), now, minutes)
    changed = {"status": F.when(old, "failed").otherwise(F.col("status"))}
    if "ended_at" in runs.columns:
        changed["ended_at"] = F.when(old, F.lit(now)).otherwise(F.col("ended_at"))
    return runs.withColumns(changed)


def active_runs(runs: DataFrame, kind: str, now, minutes: int) -> DataFrame:
    return runs.where((F.col("status") == "running") & (F.col("kind") == kind) & (F.col("started_at") > F.lit(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Distinct incoming keys with first_seen: whether the store lacks them."""
    known = existing.select(*key, F.lit(False).alias("first_seen")).distinct()
    return incoming.select(*key).distinct().join(known, key, "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(True)))


def with_ids(rows: DataFrame, after: int, partition: list[str], order: list[str], name: str = "id") -> DataFrame:
    """rows numbered from after + 1 within a partition, in an order."""
    return rows.withColumn(name, F.lit(after) + F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def import_addresses(imports: DataFrame) -> DataFrame:
    """Distinct (binary_id, library, name) with negative addresses, which no code has."""
    each = imports.select("binary_id", "library", "name").distinct()
    return each.withColumn("address", (-F.row_number().over(Window.partitionBy("binary_id").orderBy("library", "name"))).cast("long"))


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of each key that new has are its rows in new."""
    return replace_rows(old, new, [key])


def renamed(method: Column, old_run: Column, new_run: Column) -> Column:
    """A measurement's name under its run's new number, if it carries the old one."""
    number = F.regexp_extract(method, MEASUREMENT_NAME, 1)
    new = F.concat(F.lit("encoder-"), new_run.cast("string"), F.regexp_extract(method, MEASUREMENT_NAME, 2))
    return F.when(number == old_run.cast("string"), new).otherwise(method)


RUN_KEY = ["code_version", "started_at", "kind"]


def fresh_runs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote runs that the store lacks by their natural key, with new_id after the
    last local id, in the order of the remote ones. Empty parts of a key are equal."""
    match = [local[k].eqNullSafe(remote[k]) for k in RUN_KEY]
    unseen = remote.join(local.select(*RUN_KEY), match, "left_anti")
    last = local.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    # imports are as many as one project's runs; ranges of ids keep the sort spread
    spread = unseen.withColumn("_range", F.floor(F.col("id") / 100_000))
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    numbered = spread.withColumn("_r", inside).join(before, "_range").crossJoin(F.broadcast(last))
    return numbered.withColumn("new_id", F.col("last") + F.col("_before") + F.col("_r")).drop("_range", "_r", "_before", "last")


def link_twins(corpus: DataFrame) -> DataFrame:
    """corpus with twin_id: of the same owner and level, the least id of the other side."""
    keys = ["package", "owner", "opt_level"]
    least = corpus.groupBy(*keys, "stripped").agg(F.min("binary_id").alias("twin_id")).withColumn("stripped", ~F.col("stripped"))
    return corpus.drop("twin_id").join(least, [*keys, "stripped"], "left")


def duplicate_registrations(corpus: DataFrame, side: list[str] = ["package", "opt_level", "stripped"]) -> DataFrame:  # noqa: B006
    """Registrations that a newer one of the same package, level and side repeats.
    The newest is a sum with map-side combining, joined back, so a side that many
    share does not meet in one task."""
    newest = corpus.groupBy(*side).agg(F.max("binary_id").alias("_newest"))
    return corpus.join(newest, side).where(F.col("binary_id") < F.col("_newest")).drop("_newest")


def unregister(corpus: DataFrame, gone: DataFrame) -> DataFrame:
    """corpus without the binaries of gone, and without links to them."""
    ids = gone.select(F.col("binary_id").alias("_gone")).distinct()
    left = corpus.join(ids, corpus.binary_id == ids._gone, "left_anti")
    cut = left.join(ids, F.col("twin_id") == F.col("_gone"), "left")
    return cut.withColumn("twin_id", F.when(F.col("_gone").isNull(), F.col("twin_id"))).drop("_gone")


def stored_levels(corpus: DataFrame) -> DataFrame:
    """(package, opt_level) with both sides."""
    sides = corpus.groupBy("package", "opt_level").agg(F.count_distinct("stripped").alias("sides"))
    return sides.where("sides = 2").select("package", "opt_level")


def complete_packages(corpus: DataFrame) -> DataFrame:
    """Packages with both sides at every level."""
    levels = stored_levels(corpus).where(F.col("opt_level").isin(*LEVELS))
    return levels.groupBy("package").agg(F.count_distinct("opt_level").alias("levels")).where(F.col("levels") == len(LEVELS)).select("package")


class GapError(ValueError):
    """A gap that may not be recorded or removed."""


def record_gap(gaps: DataFrame, corpus: DataFrame, package: str, level: str, reason: str, now) -> DataFrame:
    """gaps and one more, if it is true and new."""
    if level not in LEVELS:
        raise GapError(f"{level} is no level; levels are {', '.join(LEVELS)}")
    if not (reason or "").strip():
        raise GapError("a gap is recorded with its reason")
    own = corpus.where(F.col("package") == package)
    if own.isEmpty():
        raise GapError(f"the corpus has nothing of {package}")
    if not stored_levels(own).where(F.col("opt_level") == level).isEmpty():
        raise GapError(f"{package} {level} is stored")
    if not gaps.where((F.col("package") == package) & (F.col("opt_level") == level)).isEmpty():
        raise GapError(f"{package} {level} is recorded already")
    return gaps.unionByName(gaps.sparkSession.createDataFrame([(package, level, reason.strip(), now)], gaps.schema))


def remove_gap(gaps: DataFrame, package: str, level: str) -> DataFrame:
    here = (F.col("package") == package) & (F.col("opt_level") == level)
    if gaps.where(here).isEmpty():
        raise GapError(f"no gap is recorded for {package} {level}")
    return gaps.where(~here)


def match_truth(truth: DataFrame, functions: DataFrame) -> DataFrame:
    """truth with function_id of the internal function at its address, or null."""
    own = functions.where(~F.col("is_external")).select("binary_id", "address", F.col("id").alias("function_id"))
    return truth.drop("function_id").join(own, ["binary_id", "address"], "left")


def history(measurements: DataFrame, split: str | None = None, method: str | None = None, limit: int = 40) -> DataFrame:
    """The newest measurements."""
    for column, value in (("split", split), ("method", method)):
        if value is not None:
            measurements = measurements.where(F.col(column) == value)
    return measurements.orderBy(F.desc("id")).limit(limit)


def short_commit(version: Column) -> Column:
    """Seven digits, with * for a dirty tree; ? for none."""
    dirty = version.endswith("-dirty")
    return F.when(F.coalesce(version, F.lit("")) == "", "?").otherwise(F.concat(F.substring(F.regexp_replace(version, "-dirty$", ""), 1, 7), F.when(dirty, "*").otherwise("")))


def block_counts(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(function_id, n_blocks) of each function, 0 for one without blocks."""
    counts = blocks.groupBy("function_id").agg(F.count("*").cast("int").alias("n_blocks"))
    return functions.select("function_id").join(counts, "function_id", "left").na.fill(0, ["n_blocks"])


def function_index(functions: DataFrame) -> DataFrame:
    """(binary_id, address, function_id) of a binary's own functions."""
    return functions.where(~F.col("is_external")).select("binary_id", "address", F.col("id").alias("function_id"))


def import_index(functions: DataFrame) -> DataFrame:
    """(binary_id, library, name, function_id) of what a binary imports."""
    return functions.where(F.col("is_external")).select("binary_id", "library", F.col("raw_name").alias("name"), F.col("id").alias("function_id"))


def kept_strings(strings: DataFrame, references: DataFrame, min_length: int = 4, only_referenced: bool = True) -> DataFrame:
    """Strings long enough and, unless told otherwise, referred to by some function."""
    rows = strings.where(F.col("length") >= min_length)
    return rows.join(references.select(F.col("string_id").alias("id")), "id", "left_semi") if only_referenced else rows


def code_version(folder: str = ".") -> str:
    """The commit that a folder is at, with -dirty if files differ from it; unknown
    where there is no repository."""

    def git(*command: str) -> str:
        return subprocess.run(["git", "-C", folder, *command], capture_output=True, text=True, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD") + ("-dirty" if git("status", "--porcelain", "--untracked-files=no") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def splits_locked(runs: DataFrame) -> bool:
    """Whether a training run has used the splits."""
    return not runs.where(F.col("kind") == "train").isEmpty()
