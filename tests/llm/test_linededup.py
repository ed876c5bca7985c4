import random
from collections import defaultdict

from quernstone.llm.linededup import SPACE, LineRuns, drop_repeated_lines, line_keys


def brute(docs):
    holders = defaultdict(set)
    key = lambda line: line.encode().strip(SPACE).lower().decode()
    for doc, text in docs:
        if doc is not None and text is not None:
            for line in text.split("\n"):
                if len(key(line)) >= 40:
                    holders[key(line)].add(doc)
    often = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return {doc: "\n".join(x for x in (text or "").split("\n") if doc is None or often.get(key(x), doc) == doc) for doc, text in docs}


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line number {i} " + "é" * 30 for i in range(6)] + ["x" * 39, "y" * 40, "short"]
    docs = [(i, "\n".join(rng.choice([str.upper, str, lambda x: f" {x}\t"])(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    want = brute(docs)
    for batches in (1, 4):
        got = {r["doc_id"]: r for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches).collect()}
        assert {k: r["kept"] for k, r in got.items()} == want
        assert all(r["n_lines"] - r["n_dropped"] == len([x for x in r["kept"].split("\n")]) or not r["kept"] for r in got.values())


def test_runs_are_merged_by_level(spark):
    runs = LineRuns(spark, fan_in=2)
    line = "a" * 50
    for batch in range(3):
        keys = line_keys(spark.createDataFrame([(batch, line), (batch + 10, f"{line}{batch}")], "doc_id long, text string"))
        run = runs.add(keys)
        assert run.where("fresh").count() == (2 if batch == 0 else 1)
    assert [len(x) for x in runs.levels] == [1, 1]
    total = {r["n_docs"]: r["last_doc"] for r in runs.totals().collect()}
    assert total[3] == 2 and runs.totals().count() == 4
    assert [x.count() for x in runs.all_runs()] == [1, 3] and [x.count() for x in runs.later] == [1, 1]  # a key is in one run


def test_a_batch_meets_the_runs_without_a_shuffle_of_theirs(spark):
    runs = LineRuns(spark, fan_in=2, buckets=4)
    frame = lambda i: line_keys(spark.createDataFrame([(i, f"{j} " * 40) for j in range(20)], "doc_id long, text string"))
    runs.add(frame(0))
    one, other = runs.all_runs()[0], runs._written(runs.all_runs()[0].where("false"), "line_run", False)
    hint = lambda df: df.hint("merge")  # noqa: E731 - as large tables are joined
    plan = hint(one).join(hint(other), ["key_high", "key_low"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", "z")], "doc_id long, text string, KEPT string, `drop` string, lost_by string")
    got = drop_repeated_lines(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "drop", "lost_by", "kept", "n_lines", "n_dropped", "kept_sha256"])
    assert got.first()["kept"] == "a" and got.first()["drop"] == "y"


def test_odd_rows(spark, odd, none):
    got = drop_repeated_lines(odd, "r_").collect()
    assert len(got) == 11 and all(r["r_n_dropped"] == 0 for r in got)
    assert {r["r_n_lines"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert drop_repeated_lines(none).count() == 0
