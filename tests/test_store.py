import datetime
import time

import pytest
from pyspark.sql import functions as F

from quernstone.operators import checks, retrieval, store
from quernstone.plans import retrieval_queries
from quernstone.schemas import SCHEMA_VERSION, TABLES
from quernstone.sources import migrations, shared
from quernstone.sources.manifest import binary_paths, load_manifest
from quernstone.sources.snapshots import Store, binary_hashes, chosen_sources, export_training

T0 = datetime.datetime(2024, 1, 1)


def healthy(spark):
    make = lambda name, rows: spark.createDataFrame(rows, TABLES[name])
    runs = [(i, "train" if i == 2 else "scan", None, None, "v1", "{}", None, T0 + datetime.timedelta(minutes=i), T0, "ok") for i in (1, 2)]
    sides = [(10 * lv + s, "p", None, "gcc", f"O{lv}", bool(s), 10 * lv + 1 - s) for lv in range(4) for s in (0, 1)]
    return {
        "runs": make("runs", runs),
        "functions": make("functions", [(i, 1, 16 * i, 4, None, None, False, False) for i in range(3)]),
        "basic_blocks": make("basic_blocks", []),
        "strings": make("strings", []),
        "events": make("events", [(i, 1, 1, i + 1, T0, "observation.function", "{}") for i in range(3)]),
        "event_links": make("event_links", [(i, "function", i, "subject") for i in range(3)]),
        "function_code": make("function_code", [(0, 1, 9, 30, "h", "x")]),
        "ground_truth": make("ground_truth", [(0, 1, 0, 0, "f", None, None, None, None, None)]),
        "corpus_binaries": make("corpus_binaries", sides),
        "dataset_split": make("dataset_split", [("p", "train", T0)]),
        "measurements": make("measurements", [(1, 2, "val", "encoder-2", "{}", T0), (2, 2, "val", "encoder (run 2)", "{}", T0), (3, 1, "val", "bm25", "{}", T0)]),
        "corpus_gaps": make("corpus_gaps", []),
    }


FAULTS = {
    "dangling_links": ("event_links", [(1, "function", 99, "target"), (1, "mystery", 0, "subject")], 2),
    "unfinished_runs": ("runs", [(3, "scan", None, None, None, None, None, T0, None, "running")], 1),
    "code_orphans": ("function_code", [(99, 1, 9, 30, "h", "x"), (1, 2, 9, 30, "h", "x")], 2),
    "truth_binding": ("ground_truth", [(9, 2, 1, 0, "f", None, None, None, None, None)], 1),
    "twin_links": ("corpus_binaries", [(90, "p", None, "gcc", "O0", False, 98), (91, "p", None, "gcc", "O0", False, 0)], 2),
    "split_groups": ("dataset_split", [("gone", "test", T0)], 1),
    "measurement_runs": ("measurements", [(9, 99, "val", "bm25", "{}", T0)], 1),
    "measurement_names": ("measurements", [(9, 1, "val", "encoder-2-start", "{}", T0), (10, 1, "val", "encoder (run 1)", "{}", T0)], 2),
    "duplicates": ("corpus_binaries", [(90, "p", None, "gcc", "O0", False, None)], 1),
    "completeness": ("corpus_binaries", [(90, "q", None, "gcc", "O0", False, None)], 1),
    "stale_gaps": ("corpus_gaps", [("p", "O1", "why", T0)], 1),
}


def test_healthy_tables_pass(spark):
    assert checks.passed(healthy(spark))
    assert {r["n"] for r in checks.summary(healthy(spark)).collect()} == {0}


@pytest.mark.parametrize("name", FAULTS)
def test_each_check_finds_its_fault(spark, name):
    t = healthy(spark)
    table, rows, n = FAULTS[name]
    t[table] = t[table].unionByName(spark.createDataFrame(rows, TABLES[table]))
    assert checks.CHECKS[name][1](t).count() == n


@pytest.mark.parametrize("seqs, want", [((1, 2, 3), None), ((2, 3), "1 2"), ((1, 2, 4), "3 4"), ((1, 2, 2, 4), "3 2")])
def test_gaps_in_a_sequence(spark, seqs, want):
    events = spark.createDataFrame([(i, 5, 1, s, T0, "x", "{}") for i, s in enumerate(seqs)], TABLES["events"])
    got = [r["detail"] for r in checks.seq_gaps({"events": events}).collect()]
    assert got == ([want] if want else [])


def test_orphans_are_of_running_runs_only(spark):
    t = healthy(spark)
    t["runs"] = t["runs"].withColumn("status", F.when(F.col("id") == 1, "running").otherwise("failed"))
    assert checks.orphan_events(t).count() == 3


def test_many_events(spark):
    events = spark.range(10_000).select(F.col("id"), (F.col("id") % 7).alias("binary_id"), F.lit(1).alias("run_id"), (F.floor(F.col("id") / 7) + 1).alias("seq"))
    assert checks.seq_gaps({"events": events}).count() == 0


def test_append_goes_on(spark):
    old = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "binary_id long, seq long")
    new = spark.createDataFrame([(1, 30), (1, 20), (3, 5), (2, 9)], "binary_id long, at long")
    got = {(r["binary_id"], r["at"]): r["seq"] for r in store.append_events(old, new, ["at"]).collect()}
    assert got == {(1, 20): 3, (1, 30): 4, (3, 5): 1, (2, 9): 2}


def test_runs(spark):
    runs = store.start_run(spark.createDataFrame([], TABLES["runs"]), 1, "scan", T0)
    later = T0 + datetime.timedelta(minutes=61)
    assert store.active_runs(runs, "scan", later, 60).count() == 0 and store.active_runs(runs, "scan", later, 62).count() == 1
    assert store.close_stale_runs(runs, later, 60).first()["status"] == "failed"
    assert store.close_stale_runs(runs, later, 62).first()["status"] == "running"
    assert store.finish_run(store.set_run_tool_version(runs, 1, "9"), 1, "ok", later).first()["status"] == "ok"
    with pytest.raises(ValueError):
        store.finish_run(runs, 1, "running", later)


def test_gaps_are_refused(spark):
    t = healthy(spark)
    corpus, none = t["corpus_binaries"].where("opt_level <> 'O3'"), t["corpus_gaps"]
    gaps = store.record_gap(none, corpus, "p", "O3", " too large ", T0)
    assert gaps.first()["reason"] == "too large"
    for args in (("p", "O9", "x"), ("p", "O3", " "), ("q", "O3", "x"), ("p", "O1", "x")):
        with pytest.raises(store.GapError):
            store.record_gap(none, corpus, *args, T0)
    with pytest.raises(store.GapError):
        store.record_gap(gaps, corpus, "p", "O3", "again", T0)
    assert store.remove_gap(gaps, "p", "O3").isEmpty()
    with pytest.raises(store.GapError):
        store.remove_gap(none, "p", "O3")


def test_prune_and_unregister(spark):
    t = healthy(spark)["corpus_binaries"]
    more = t.unionByName(spark.createDataFrame([(90, "p", None, "gcc", "O0", False, 1)], TABLES["corpus_binaries"]))
    gone = store.duplicate_registrations(more)
    assert [r["binary_id"] for r in gone.collect()] == [0]
    left = store.unregister(more, gone)
    assert left.count() == 8 and left.where("binary_id = 1").first()["twin_id"] is None


def test_import_is_idempotent_and_renumbers(spark):
    key = lambda i, day: (i, "v", T0 + datetime.timedelta(days=day), "train")
    schema = "id long, code_version string, started_at timestamp, kind string"
    local = spark.createDataFrame([key(1, 0), key(7, 1)], schema)
    remote = spark.createDataFrame([key(1, 0), key(2, 5), key(9, 6)], schema)
    got = {r["id"]: r["new_id"] for r in store.fresh_runs(local, remote).collect()}
    assert got == {2: 8, 9: 9}
    assert store.fresh_runs(remote, remote).isEmpty()
    names = spark.createDataFrame([("encoder-2", 2), ("encoder-2-start", 2), ("encoder-22", 2), ("bm25", 2)], "m string, r long")
    assert [r[0] for r in names.select(store.renamed(F.col("m"), F.col("r"), F.lit(8))).collect()] == ["encoder-8", "encoder-8-start", "encoder-22", "bm25"]
    short = spark.createDataFrame([("0123456789",), ("0123456789-dirty",), ("",), (None,)], "v string")
    assert [r[0] for r in short.select(store.short_commit(F.col("v"))).collect()] == ["0123456", "0123456*", "?", "?"]


def test_store_on_disk(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    assert s.fresh() and s.open().version() == SCHEMA_VERSION and s.read("runs").isEmpty()
    runs = healthy(spark)["runs"]
    s.write("runs", runs)
    s.write("runs", s.read("runs").where("id = 1"))
    assert Store(spark, f"{tmp_path}/store").open().read("runs").count() == 1 and s.tables() == ["runs"]
    export_training({"dataset_split": healthy(spark)["dataset_split"]}, f"{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)already exists"):
        export_training({"dataset_split": healthy(spark)["dataset_split"]}, f"{tmp_path}/out")


def test_migrations_from_the_first_shape(spark):
    old = {
        "binaries": spark.createDataFrame([(1, "p", "s", None, T0)], TABLES["binaries"]),
        "events": healthy(spark)["events"].drop("run_id"),
        "functions": healthy(spark)["functions"].drop("library"),
    }
    new = migrations.migrate(old, 0)
    assert new["runs"].first()["kind"] == "legacy" and {r["run_id"] for r in new["events"].collect()} == {1}
    assert "library" in new["functions"].columns and "abi" in new["ground_truth"].columns and new["corpus_gaps"].isEmpty()
    old["functions"] = old["functions"].withColumn("binary_id", F.lit(9).cast("long"))
    with pytest.raises(ValueError, match="functions.binary_id"):
        migrations.migrate(old, 0)


def test_manifest_and_files(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[package]]\nname = "a"\nversion = "1"\ndomain = "d"\ninclude = ["*.c"]\n[[package.depends]]\nname = "z"\nversion = "2"\n')
    rows = load_manifest(spark, f"{tmp_path}/m.toml")
    assert {r["name"]: (r["depends"], r["depends_of"]) for r in rows.collect()} == {"a": (["z"], None), "z": ([], "a")}
    assert binary_paths(rows).count() == 8
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.c").write_text("x")
    assert binary_hashes(spark, f"{tmp_path}/src").first()["sha256"].startswith("2d711642")
    files = spark.createDataFrame([("src/a.c",), ("src/test/b.c",), ("src/a.h",)], "path string")
    assert [r["path"] for r in chosen_sources(files, ["src/**/*.c"], ["src/test/*"]).collect()] == ["src/a.c"]
    with pytest.raises(ValueError):
        chosen_sources(files, ["*.rs"], [])


def test_a_stream_goes_on_over_many_batches(spark, tmp_path):
    """More batches than lie between two whole tables of last sequences."""
    import time

    from quernstone.streaming.ingest import EventAppender, Progress, append_stream, appended

    appender = EventAppender(spark, f"{tmp_path}/table", ["n"])
    appender.WHOLE = 4
    for i in range(11):
        batch = spark.createDataFrame([(i % 3, i), (7, i), (7, i + 100)], "binary_id long, n long")
        appender(batch, i)
        if i in (4, 8):
            appender(batch, i)  # a batch that is run again leaves the same rows
    rows = spark.read.parquet(f"{tmp_path}/table/rows").collect()
    by = {}
    for r in rows:
        by.setdefault(r["binary_id"], []).append(r["seq"])
    assert {k: sorted(v) for k, v in by.items()} == {7: list(range(1, 23)), 0: [1, 2, 3, 4], 1: [1, 2, 3, 4], 2: [1, 2, 3]}

    told, listener = [], None
    listener = Progress(lambda batches, n: told.append((batches, n)))
    spark.streams.addListener(listener)
    spark.createDataFrame([(1, 1), (2, 1)], "binary_id long, n long").write.parquet(f"{tmp_path}/in")
    append_stream(spark.readStream.schema("binary_id long, n long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["n"]).awaitTermination()
    for _ in range(50):
        if told:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert told[-1][1] == 2 and appended(spark, f"{tmp_path}/out").count() == 2


def test_code_version(tmp_path):
    from quernstone.operators import store

    assert store.code_version(str(tmp_path)) == "unknown"


def shuffled(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}


def shuffled_since(spark, before):
    for _ in range(50):  # deleted beside the next work
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    return shuffled(spark) - before


def test_freed_shuffles_are_those_of_what_is_stored(spark):
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).persist()
    assert kept.count() == 7
    before, rows = shuffled(spark), spark.range(3000).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("m"))
    with shared.shuffles_freed(spark):
        out = shared.stored(rows.join(kept, "k"), "few")
    assert not shuffled_since(spark, before) and spark.conf.get(shared.FREED, None) is None
    assert {tuple(r) for r in out.collect()} == {(k, 6, 143 if k < 6 else 142) for k in range(7)} and kept.count() == 7
    kept.unpersist()
    with pytest.raises(Exception), shared.shuffles_freed(spark):
        shared.stored(spark.range(3).select(F.raise_error(F.lit("no"))), "none")
    assert spark.conf.get(shared.FREED, None) is None


def test_a_retrieval_task_and_its_classes_leave_no_shuffle_on_disk(spark, sf_dir):
    before = shuffled(spark)
    queries, pool = retrieval_queries.narrow_task(spark, sf_dir, "imports")
    assert not shuffled_since(spark, before)
    scores = retrieval.score_jaccard(queries, pool)
    assert not shuffled_since(spark, before)
    count = scores.count()
    assert count and scores.count() == count  # what is returned keeps its own
