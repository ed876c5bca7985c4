"""Command line over a store: python -m quernstone.cli COMMAND FOLDER."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernstone.functions.listing import call_count, content_key, import_set, mnemonics, tokens
from quernstone.operators import browse, checks, dataset, measurements, retrieval, store, training, verify, vocab
from quernstone.schemas import LEVELS, TABLES, TRAINING_TABLES
from quernstone.sources.manifest import load_manifest
from quernstone.sources.snapshots import Store, export_training
from quernstone.streaming.ingest import working_folder


def joined_rows(s: Store):
    """Functions with a matched truth, their place in the corpus and their code."""
    corpus = s.read("corpus_binaries").select("binary_id", "package", "opt_level")
    truth = s.read("ground_truth").where("function_id IS NOT NULL").select("function_id", "binary_id", "name", "decl_file")
    return truth.join(corpus, "binary_id").join(s.read("function_code").drop("binary_id"), "function_id")


def function_rows(s: Store, min_instructions: int = 8):
    """Candidates of a store with tokens and content, made once and written: they feed
    many plans, and how a listing becomes tokens is a large expression."""
    rows = dataset.candidate_rows(joined_rows(s), min_instructions).withColumn("tokens", tokens(F.col("listing")))
    rows = _written(s, rows, "tokens")
    return _written(s, rows.withColumn("content", content_key(F.col("tokens"))), "function-rows")


def _written(s: Store, rows, name: str):
    path = working_folder(s.spark, name)
    rows.write.parquet(path)
    return s.spark.read.parquet(path)


def samples(s: Store, split: str | None):
    """Eligible rows of a split with what the rankers read."""
    rows = dataset.eligible_rows(function_rows(s))
    if split:
        rows = rows.join(s.read("dataset_split").where(F.col("split") == split).select("package"), "package", "left_semi")
    blocks = s.read("basic_blocks").groupBy("function_id").agg(F.count("*").cast("int").alias("n_blocks"))
    rows = rows.join(blocks, "function_id", "left").na.fill(0, ["n_blocks"])
    text = F.col("listing")
    rows = rows.withColumns({"imports": import_set(text), "n_calls": call_count(text), "tokens": mnemonics(text, 4)})
    return _written(s, rows.drop("listing"), "samples")  # rankers read them many times over


def cmd_check(s: Store, a) -> int:
    if a.close_stale:
        s.write("runs", store.close_stale_runs(s.read("runs"), now(), a.stale_minutes))
    found = checks.summary({t: s.read(t) for t in TABLES})
    found.orderBy("check").show(50, False)
    return int(not found.where("severity = 'defect' AND n > 0").isEmpty())


def cmd_dataset(s: Store, a) -> int:
    candidates = function_rows(s)
    rows = dataset.eligible_rows(candidates)
    if a.assign:
        if store.splits_locked(s.read("runs")) and not a.force:
            print("a training run has used the splits; --force assigns them anew")
            return 1
        domains = load_manifest(s.spark, a.manifest).select(F.col("name").alias("package"), "domain") if a.manifest else None
        found = dataset.assign_splits(dataset.package_sizes(rows), domains)
        s.write("dataset_split", found.withColumn("assigned_at", F.current_timestamp()))
    splits = s.read("dataset_split").select("package", "split")
    dataset.report(joined_rows(s), candidates, rows, splits).orderBy("measure").show(100, False)
    leak = dataset.leakage(candidates, splits).first()
    print(f"content that would leak without deduplication: {leak['prevented']}; that leaks: {leak['leaked']}")
    return int(leak["leaked"] > 0)


def fingerprint(s: Store, rows) -> str:
    """The 16 digits of eligible rows as they are split now."""
    return dataset.fingerprint(rows, s.read("dataset_split").select("package", "split")).first()[0]


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


def cmd_baselines(s: Store, a) -> int:
    queries, pool, gold = retrieval.retrieval_task(samples(s, a.split), a.query_level, a.pool_level)
    named = queries.select(F.col("function_id").alias("query_id"), "package")
    out = per = None
    for name in a.methods or retrieval.SCORERS:
        ranked = retrieval.evaluate(name, queries, pool, gold).persist()  # a row for each query
        one = retrieval.metrics(ranked).withColumn("method", F.lit(name))
        by = retrieval.metrics(ranked.join(named, "query_id"), ["package"]).withColumn("method", F.lit(name))
        out, per = (one, by) if out is None else (out.unionByName(one), per.unionByName(by))
    measurements.by_strength(out).show(20, False)
    measurements.package_table(per, list(a.methods or retrieval.SCORERS)).show(200, False)
    if a.record:
        runs = s.read("runs")
        number = runs.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        params = measurements.task_params(a.split, a.query_level, a.pool_level, a.seed, fingerprint(s, dataset.eligible_rows(function_rows(s))))
        s.write("runs", store.finish_run(store.start_run(runs, number, "baselines", now(), params, store.code_version(), a.seed), number, "ok", now()))
        s.write("measurements", measurements.record(s.read("measurements"), out, number, a.split))
    return 0


def cmd_vocab(s: Store, a) -> int:
    eligible = dataset.eligible_rows(function_rows(s))
    rows = training.train_functions(eligible, s.read("dataset_split"))
    vocab.save(vocab.build_vocab(rows, a.min_functions), a.out, a.min_functions, {"fingerprint": fingerprint(s, eligible)})
    return 0


def _shown(report, out: str | None) -> int:
    """A report on the screen and, if asked for, as JSON lines in a folder."""
    report.show(200, False)
    if out:
        report.coalesce(1).write.json(out)  # a row for each bucket
    return 0


def cmd_verify_v0(s: Store, a) -> int:
    attempts, chains = (s.spark.read.parquet(x) for x in (a.attempts, a.chains))
    return _shown(verify.layer_report(verify.three_layers(attempts, chains)).orderBy("layer", F.desc("pairs"), "bucket", "agreement"), a.out)


def cmd_verify_r0(s: Store, a) -> int:
    tasks, loads, compared = (s.spark.read.parquet(x) for x in (a.tasks, a.loads, a.compared))
    return _shown(verify.r0_report(verify.false_pair_verdicts(tasks, loads, compared)).orderBy("verdict", "unjudged"), a.out)


def cmd_refresh_truth(s: Store, a) -> int:
    """Truths read anew replace those of their binaries, matched to functions by address."""
    truth = store.match_truth(s.spark.read.parquet(a.truth), s.read("functions"))
    names = TABLES["ground_truth"].names
    s.write("ground_truth", store.replace_partition(s.read("ground_truth").select(*names), truth.select(*names), "binary_id"))
    kept = s.read("ground_truth")
    print(f"truths: {kept.count()}; matched: {kept.where('function_id IS NOT NULL').count()}")
    return 0


def cmd_inspect(s: Store, a) -> int:
    rows = browse.find_functions(joined_rows(s), a.id, a.package, a.opt, a.name)
    rows = browse.sample_functions(rows, a.sample, a.seed) if a.sample else rows
    shown = F.array_join(browse.shown_listing(F.col("listing"), a.lines), "\n")
    line = browse.summary_line(F.col("function_id"), F.col("package"), F.col("opt_level"), F.col("n_instructions"), F.col("name"))
    for r in rows.select(line.alias("line"), shown.alias("listing")).limit(a.most).collect():
        print(r["line"] if a.list else f"{r['line']}\n\n{r['listing']}\n")
    return 0


def cmd_measurements(s: Store, a) -> int:
    store.history(s.read("measurements"), a.split, a.method, a.limit).show(a.limit, False)
    return 0


def cmd_prune_corpus(s: Store, a) -> int:
    gone = store.duplicate_registrations(s.read("corpus_binaries"))
    gone.show(100, False)
    if a.apply:
        s.write("corpus_binaries", store.unregister(s.read("corpus_binaries"), gone).select(*TABLES["corpus_binaries"].names))
    return 0


def cmd_export_training(s: Store, a) -> int:
    export_training({t: s.read(t) for t in TRAINING_TABLES}, a.out)
    return 0


def cmd_import_runs(s: Store, a) -> int:
    fresh = store.fresh_runs(s.read("runs"), Store(s.spark, a.remote).read("runs"))
    fresh.select("id", "new_id", "kind", "started_at").show(100, False)
    if a.apply:
        remote = Store(s.spark, a.remote).read("measurements")
        ids = fresh.select(F.col("id").alias("run_id"), "new_id")
        moved = remote.join(ids, "run_id").withColumn("method", store.renamed(F.col("method"), F.col("run_id"), F.col("new_id")))
        last = s.read("measurements").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        moved = store.with_ids(moved.drop("run_id").withColumnRenamed("new_id", "run_id"), last, [], ["id"]).select(*TABLES["measurements"].names)
        s.write("measurements", s.read("measurements").unionByName(moved))
        s.write("runs", s.read("runs").unionByName(fresh.drop("id").withColumnRenamed("new_id", "id").select(*TABLES["runs"].names)))
    return 0


def cmd_corpus_gap(s: Store, a) -> int:
    gaps = s.read("corpus_gaps")
    if a.action == "add":
        s.write("corpus_gaps", store.record_gap(gaps, s.read("corpus_binaries"), a.package, a.level, a.reason, datetime.datetime.now()))
    elif a.action == "remove":
        s.write("corpus_gaps", store.remove_gap(gaps, a.package, a.level))
    s.read("corpus_gaps").orderBy("package", "opt_level").show(200, False)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernstone")
    commands = top.add_subparsers(required=True)

    def add(name, run, *options):
        p = commands.add_parser(name)
        p.add_argument("folder")
        for flags, more in options:
            p.add_argument(*flags, **more)
        p.set_defaults(run=run)

    yes = {"action": "store_true"}
    add("check", cmd_check, (["--close-stale"], yes), (["--stale-minutes"], {"type": int, "default": 60}))
    add("dataset", cmd_dataset, (["--assign"], yes), (["--force"], yes), (["--manifest"], {}))
    add("baselines", cmd_baselines, (["--split"], {"default": "test"}), (["--query-level"], {"default": "O0", "choices": LEVELS}), (["--pool-level"], {"default": "O3", "choices": LEVELS}), (["--methods"], {"nargs": "*", "choices": list(retrieval.SCORERS)}), (["--record"], yes), (["--seed"], {"type": int, "default": 0}))
    add("verify-v0", cmd_verify_v0, (["--attempts"], {"required": True}), (["--chains"], {"required": True}), (["--out"], {}))
    add("verify-r0", cmd_verify_r0, (["--tasks"], {"required": True}), (["--loads"], {"required": True}), (["--compared"], {"required": True}), (["--out"], {}))
    add("refresh-truth", cmd_refresh_truth, (["truth"], {}))
    add("vocab", cmd_vocab, (["out"], {}), (["--min-functions"], {"type": int, "default": 5}))
    add("inspect", cmd_inspect, (["--id"], {"type": int}), (["--package"], {}), (["--opt"], {"choices": LEVELS}), (["--name"], {}), (["--sample"], {"type": int}), (["--seed"], {"type": int, "default": 1}), (["--lines"], {"type": int, "default": 40}), (["--list"], yes), (["--most"], {"type": int, "default": 50}))
    add("measurements", cmd_measurements, (["--split"], {}), (["--method"], {}), (["--limit"], {"type": int, "default": 40}))
    add("prune-corpus", cmd_prune_corpus, (["--apply"], yes))
    add("export-training", cmd_export_training, (["out"], {}))
    add("import-runs", cmd_import_runs, (["remote"], {}), (["--apply"], yes))
    add("corpus-gap", cmd_corpus_gap, (["action"], {"choices": ["add", "remove", "list"]}), (["--package"], {}), (["--level"], {}), (["--reason"], {}))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quernstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return a.run(Store(spark, a.folder).open(), a)


if __name__ == "__main__":
    sys.exit(main())
