"""The seven steps from stored tables to metrics, through the command line."""

import datetime
import json

import pytest

from quernstone import cli
from quernstone.schemas import TABLES
from quernstone.sources.snapshots import Store

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four packages of six functions at two levels; O3 bodies are shorter."""
    place = str(tmp_path_factory.mktemp("store"))
    s = Store(spark, place).open()
    binaries, corpus, functions, truth, code = [], [], [], [], []
    for p in range(4):
        for level in (0, 3):
            for stripped in (False, True):
                b = 100 * p + 10 * level + stripped
                binaries.append((b, f"p{p}-{level}-{stripped}", f"sha{b}", "x86", T0))
                corpus.append((b, f"pack{p}", "1", "gcc", f"O{level}", stripped, b + (1 if not stripped else -1)))
                if not stripped:
                    continue
                for f in range(6):
                    i = 10 * b + f
                    ops = ["mov", "add", "cmp", "lea", "xor", "sub", "shl"]
                    body = [f"{k}\t{ops[(p * 5 + f * 3 + k * (f + p + 1)) % 7]}\tRAX 0x{k}\t" for k in range(14 - level)]
                    functions.append((i, b, 16 * f, 64, None, None, False, False))
                    truth.append((i, b, i, 16 * f, f"f{f}", "int", ["int"], f"/work/pack{p}/a.c", 1, None))
                    code.append((i, b, len(body), 64, f"h{i}", "\n".join(body)))
    for name, rows in (("binaries", binaries), ("corpus_binaries", corpus), ("functions", functions), ("ground_truth", truth), ("function_code", code)):
        s.write(name, spark.createDataFrame(rows, TABLES[name]))
    return place


def test_from_tables_to_metrics(spark, folder, tmp_path, capsys):
    assert cli.main(["check", folder]) == 0
    assert cli.main(["dataset", folder, "--assign"]) == 0
    splits = {r["package"]: r["split"] for r in Store(spark, folder).read("dataset_split").collect()}
    assert len(splits) == 4 and {"train", "val", "test"} == set(splits.values())
    assert cli.main(["vocab", folder, f"{tmp_path}/v.json", "--min-functions", "1"]) == 0
    assert cli.main(["baselines", folder, "--methods", "bm25"]) == 0
    assert "bm25" in capsys.readouterr().out
    assert cli.main(["baselines", folder, "--methods", "bm25", "import-jaccard", "--record"]) == 0
    recorded = Store(spark, folder).read("measurements").collect()
    assert {(r["id"], r["method"], r["split"]) for r in recorded} == {(1, "bm25", "test"), (2, "import-jaccard", "test")}
    assert 0 < json.loads(recorded[0]["metrics"])["mrr"] <= 1
    run = Store(spark, folder).read("runs").first()
    params = json.loads(run["params"])
    assert run["status"] == "ok" and params["query_level"] == "O0" and params["fingerprint"] == json.loads((tmp_path / "v.json").read_text())["source"]["fingerprint"]
    assert cli.main(["export-training", folder, f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/function_code").count() == 48
    assert cli.main(["corpus-gap", folder, "add", "--package", "pack0", "--level", "O1", "--reason", "not built"]) == 0
    assert Store(spark, folder).read("corpus_gaps").count() == 1


def test_truth_is_refreshed(spark, folder, tmp_path, capsys):
    truth = Store(spark, folder).read("ground_truth").where("binary_id = 1")
    moved = truth.withColumn("address", truth.address + 16).withColumn("function_id", truth.function_id * 0)
    moved.write.parquet(f"{tmp_path}/truth")
    before = Store(spark, folder).read("ground_truth").count()
    assert cli.main(["refresh-truth", folder, f"{tmp_path}/truth"]) == 0
    rows = Store(spark, folder).read("ground_truth").where("binary_id = 1").collect()
    assert len(rows) == 6 and sum(r["function_id"] is None for r in rows) == 1  # the last lies past all functions
    assert f"truths: {before}; matched: {before - 1}" in capsys.readouterr().out


def test_verify_reports(spark, folder, tmp_path, capsys):
    frame = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    attempts = [(1, "bare", "fault", None), (1, "stubbed", "completed", "agreed"), (1, "chained", "chain_failed", None), (2, "bare", "load_failed", None)]
    frame("attempts", attempts, "pair_id long, layer string, bucket string, agreement string")
    frame("chains", [(1, "Q"), (1, "K")], "pair_id long, side string")
    assert cli.main(["verify-v0", folder, "--attempts", f"{tmp_path}/attempts", "--chains", f"{tmp_path}/chains", "--out", f"{tmp_path}/v0"]) == 0
    report = {(r["layer"], r["bucket"]): (r["pairs"], r["abandoned"]) for r in spark.read.json(f"{tmp_path}/v0").collect()}
    assert report == {("bare", "fault"): (1, 0), ("stubbed", "completed"): (1, 0), ("chained", "completed"): (1, 1), **{(x, "load_failed"): (1, 0) for x in ("bare", "stubbed", "chained")}}
    frame("tasks", [(1,), (2,)], "pair_id long")
    frame("loads", [(2, "OSError")], "pair_id long, error string")
    frame("compared", [(1, "refuted", False)], "pair_id long, verdict string, forced_only boolean")
    assert cli.main(["verify-r0", folder, "--tasks", f"{tmp_path}/tasks", "--loads", f"{tmp_path}/loads", "--compared", f"{tmp_path}/compared"]) == 0
    assert "load failed: OSError" in capsys.readouterr().out
    frame("none", [], "pair_id long, error string")
    with pytest.raises(Exception, match="pair was not judged: 2"):
        cli.main(["verify-r0", folder, "--tasks", f"{tmp_path}/tasks", "--loads", f"{tmp_path}/none", "--compared", f"{tmp_path}/compared"])
