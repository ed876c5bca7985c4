import math

import pytest
from pyspark.sql import functions as F

from quernstone.functions import calling
from quernstone.operators import measurements, sampling, training, verify
from quernstone.schemas import TABLES

ROW = "function_id long, package string, decl_file string, name string, opt_level string, tokens array<string>, content string"


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for p, n in (("a", 40), ("b", 12), ("c", 5)):
        for f in range(n):
            for level in (0, 1, 3):
                out.append((len(out), p, f"/w/{p}.c", f"f{f}", f"O{level}", [f"t{f % 3}"], f"x{f}" if f % 2 else f"x{f}-{level}"))
    return spark.createDataFrame(out, ROW)


def test_guards(spark, rows):
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "package string, split string")
    assert training.load_examples(rows, splits, "val").count() == 36
    assert {r["package"] for r in training.train_functions(rows, splits).collect()} == {"a"}
    with pytest.raises(training.GuardError, match="test"):
        training.load_examples(rows, splits, "test")
    training.check_vocabulary({"fingerprint": "abc"}, "abc")
    with pytest.raises(training.GuardError, match="build it anew"):
        training.check_vocabulary({"fingerprint": "abc"}, "abd")


def test_schedule_is_a_round_robin(rows):
    """Against the rule played out over lists: 57 identities, batches of 10, quota 2."""
    got = {}
    for r in training.schedule(rows, batch=10, per_package=2, seed=1).collect():
        got.setdefault(r["batch"], {})[r["slot"]] = (r["package"], r["name"])
    assert sorted(got) == list(range(5)) and all(sorted(b) == list(range(10)) for b in got.values())
    assert len({x for b in got.values() for x in b.values()}) == 50
    left = {"a": 40, "b": 12, "c": 5}
    for b in range(5):
        turn, slots, at = [], [got[b][i][0] for i in range(10)], 0
        while at < 10:  # each visit takes two, or what is left of the package or of the batch
            p, n = slots[at], min(2, left[slots[at]], 10 - at)
            assert slots[at : at + n] == [p] * n
            left[p] -= n
            at += n
            turn.append(p)
        live = {p for p in turn}
        assert turn[: len(live)] == list(dict.fromkeys(turn))  # all visited once before any twice
    assert sampling.ordinal_within(rows, ["package"], [F.md5("content"), F.col("function_id")], "n").groupBy("package").agg(F.count_distinct("n").alias("d"), F.max("n").alias("m")).where("d <> m + 1").count() == 0


def test_drawn_pairs(rows):
    pairs = training.drawn_pairs(rows, seed=3, eval_pair_share=1.0).collect()
    assert len(pairs) == 57 and {frozenset((r["query_level"], r["key_level"])) for r in pairs} == {frozenset(("O0", "O3"))}
    free = training.drawn_pairs(rows, seed=3)
    assert {r["query_level"] for r in free.collect()} == {"O0", "O1", "O3"}
    share = training.drawn_identical_share(free).first()
    assert share["pairs"] == 57 and share["identical"] == pytest.approx(sum(int(r["name"][1:]) % 2 for r in free.collect()) / 57)


def test_losses_by_hand(spark):
    logits = [(0, 0, 0, 1.0, True, True), (0, 0, 1, 0.5, False, False), (0, 0, 2, 9.0, False, True), (0, 1, 0, 0.0, False, False), (0, 1, 1, 2.0, True, False)]
    got = training.info_nce(spark.createDataFrame(logits, "batch int, slot int, key int, logit double, target boolean, removed boolean"), 0.5).first()["loss"]
    assert got == pytest.approx((math.log(math.exp(2) + math.exp(1)) - 2 + math.log(1 + math.exp(4)) - 4) / 2)
    with pytest.raises(ValueError):
        training.info_nce(None, 0)
    rows = spark.createDataFrame([([1000.0, 999.0], 0), ([0.0, 0.0], 1), ([5.0, 1.0], -100)], "logit array<double>, label int")
    loss = training.mlm_loss(rows).first()
    assert loss["positions"] == 2 and loss["loss"] == pytest.approx((math.log(1 + math.exp(-1)) + math.log(2)) / 2)


def test_queue_windows_and_padding(spark):
    batch = spark.createDataFrame([(0, "n", "q", "k"), (1, "m", "r", "r")], "slot int, identity string, query_content string, key_content string")
    queue = spark.createDataFrame([(0, "x", "k"), (1, "m", "z"), (2, "y", "y")], "place int, identity string, content string")
    got = {tuple(r) for r in training.queue_excluded(batch, queue, 4).collect()}
    assert got == {(0, 0), (1, 1), (0, 3), (1, 3)}
    ids = spark.createDataFrame([(i, list(range(10, 10 + n)), i % 2) for i, n in enumerate((0, 3, 8, 20))], "id long, ids array<int>, batch int")
    shown = {r["id"]: r["w"] for r in ids.select("id", training.window_of(F.col("ids"), 4, "id").alias("w")).collect()}
    assert shown[0] == [1] and shown[1] == [1, 10, 11, 12]
    assert all(len(shown[i]) == 5 and shown[i][1:] == list(range(shown[i][1], shown[i][1] + 4)) for i in (2, 3))
    wide = {r["id"]: r for r in training.collated(ids.withColumn("labels", F.col("ids")), "ids", "labels").collect()}
    assert wide[1]["ids"] == [10, 11, 12] + [0] * 17 and wide[1]["attention"] == [1] * 3 + [0] * 17 and wide[1]["labels"][3:] == [-100] * 17 and len(wide[0]["ids"]) == 8


def test_float_bits(spark):
    import struct

    values = [0.0, 1.0, -1.0, 0.5, 3.5, -123456.789, 1e6, 2.0**-20, 999999.9999999999, 0.1, 7.999999999999999]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for size, letters in ((4, "<fI"), (8, "<dQ")):
        got = [r[0] % (1 << 64) for r in frame.select(calling.float_bits(F.col("x"), F.lit(size))).collect()]
        assert got == [struct.unpack("<" + letters[2], struct.pack(letters[:2], v))[0] for v in values]
    assert len(spark.range(1).select(calling.float_values(F.lit(8), 3, F.lit(0)).alias("v")).first()["v"]) == 9


def test_measurements(spark):
    results = spark.createDataFrame([("b", 10, 0.5), ("a", 10, 0.25)], "method string, queries long, mrr double")
    one = measurements.record(spark.createDataFrame([], TABLES["measurements"]), results, 3, "val")
    two = measurements.record(one, results, 4, "val")
    assert [(r["id"], r["run_id"], r["method"]) for r in two.orderBy("id").collect()] == [(1, 3, "a"), (2, 3, "b"), (3, 4, "a"), (4, 4, "b")]
    assert [r["method"] for r in measurements.by_strength(results).collect()] == ["a", "b"]
    assert measurements.read_metric(two, "nothing", "x").where("x IS NOT NULL").count() == 0
    per = spark.createDataFrame([("p", "a", 3, 0.1), ("p", "b", 3, 0.2), ("q", "a", 9, 0.3)], "package string, method string, queries long, mrr double")
    assert [tuple(r) for r in measurements.package_table(per, ["a", "b"]).collect()] == [("q", 9, 0.3, None), ("p", 3, 0.1, 0.2)]


def test_positions_are_u_shaped():
    at = verify.flip_positions(400, 5)
    assert at == verify.flip_positions(400, 5) != verify.flip_positions(400, 6)
    assert all(0 <= x <= 1 for x in at) and sum(x < 0.1 or x > 0.9 for x in at) > 300
