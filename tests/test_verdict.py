import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import calling, fill
from quernstone.operators import decisions, verdict, verify

OUT = "pair_id long, input_idx int, variant int, side string, seed string, status string, ret_int long, invented boolean"


def one_case(spark, kind="int", q=(1, 1), k=(1, 1), status="completed", invented=False, bytes_=4, differs=False, effect=None):
    values = {("Q", "A"): q[0], ("Q", "B"): q[1], ("K", "A"): k[0], ("K", "B"): k[1]}
    rows = [(1, 0, 0, s, e, status if (s, e) == ("K", "B") else "completed", v, invented) for (s, e), v in values.items()]
    outcomes = spark.createDataFrame(rows, OUT)
    returns = spark.createDataFrame([(1, kind, 0 if kind in ("void", "pointer") else 255)], "pair_id long, kind string, mask long")
    memory = spark.createDataFrame([(1, 0, 0, bytes_, differs)], "pair_id long, input_idx int, variant int, compared_bytes int, differs boolean")
    effects = spark.createDataFrame([(1, 0, 0, effect)] if effect else [], "pair_id long, input_idx int, variant int, effect string")
    r = verdict.judge_inputs(outcomes, returns, memory, effects).first()
    return r["verdict"], r["reason"]


@pytest.mark.parametrize(
    "facts, want",
    [
        ({}, ("survived", "agreed on this input")),
        ({"status": "fault", "differs": True}, ("inconclusive", "K fault")),
        ({"k": (2, 2)}, ("refuted", "return value differs")),
        ({"k": (257, 257)}, ("survived", "agreed on this input")),
        ({"k": (2, 2), "invented": True}, ("inconclusive", verdict.INVENTED)),
        ({"q": (1, 2), "differs": True}, ("inconclusive", verdict.INVENTED)),
        ({"differs": True}, ("refuted", "written memory differs")),
        ({"differs": True, "invented": True}, ("inconclusive", verdict.INVENTED)),
        ({"effect": "calls"}, ("refuted", "calls")),
        ({"effect": "calls", "invented": True}, ("survived", "agreed on this input")),
        ({"q": (1, 2)}, ("inconclusive", "return depended on the fill")),
        ({"kind": "void", "bytes_": 0}, ("inconclusive", "neither produced anything observable")),
        ({"kind": "pointer", "k": (9, 9)}, ("survived", "agreed on this input")),
        ({"bytes_": 0}, ("survived", "agreed on this input")),
    ],
)
def test_rules_in_order(spark, facts, want):
    assert one_case(spark, **facts) == want


def test_combination_of_fills_and_inputs(spark):
    r, s, i = "refuted", "survived", "inconclusive"
    cases = {1: [(r, r)], 2: [(r, s)], 3: [(i, s)], 4: [(i, i)], 5: [(s, s), (r, r), (s, s)], 6: [(i, i), (s, i)]}
    rows = [(p, n, v, x, f"{x}{v}", "fault" if x == i else None) for p, inputs in cases.items() for n, fills in enumerate(inputs) for v, x in enumerate(fills)]
    judged = spark.createDataFrame(rows, "pair_id long, input_idx int, variant int, verdict string, reason string, status string")
    combined = verdict.combine_variants(judged)
    first = {x["pair_id"]: x["verdict"] for x in combined.where("input_idx = 0").collect()}
    assert first == {1: r, 2: i, 3: s, 4: i, 5: s, 6: i}
    forced = spark.createDataFrame([(4, s), (1, s)], "pair_id long, verdict string")
    out = {x["pair_id"]: (x["verdict"], x["forced_only"], x["inputs"]) for x in verdict.compare(combined, forced).collect()}
    assert out == {1: (r, False, 1), 2: (i, False, 1), 3: (s, False, 1), 4: (s, True, 1), 5: (r, False, 2), 6: (s, False, 2)}
    buckets = {x["pair_id"]: (x["bucket"], x["agreement"]) for x in verdict.v0_buckets(verdict.compare(combined), combined).collect()}
    assert buckets[4] == ("fault", None) and buckets[2] == ("unjudged", None) and buckets[1] == ("completed", "disagreed")


def test_effects(spark):
    names = ["_lock", "_lock", "printf", "fputs", "strlen"]
    calls = spark.createDataFrame([(1, 0, 0, "Q", "A", n) for n in names], "pair_id long, input_idx int, variant int, side string, seed string, name string")
    assert verdict.effects(calls).first()["effects"] == "_lock=2,stream output=2"
    assert verdict.effects(calls, calls.limit(1)).isEmpty()
    other = calls.withColumn("side", F.lit("K")).where("name <> 'strlen'")
    assert [tuple(r) for r in verdict.name_differences(calls.unionByName(other)).collect()] == [(1, "strlen", 1, 0)]


def test_garbage_spreads_in_one_pass():
    page = np.arange(verdict.PAGE) % 251
    moved = page.copy()
    moved[9] += 1
    base = 3 * verdict.PAGE
    stores = [(base + 0, 8, False), (base + 4, 8, False)]
    bad = verdict.garbage_of({base: page}, {base: moved}, stores)
    assert bad == {(base, i) for i in range(4, 12)}  # the earlier, overlapping store isn't looked at again
    assert verdict.garbage_of({base: page}, {base: moved}, stores[::-1]) == {(base, i) for i in range(12)}
    assert len(verdict.garbage_of({base: page}, {}, [])) == verdict.PAGE
    assert verdict.garbage_of({base: page}, {base: page}, [(base + 4094, 4, True)]) == {(base, 4094), (base, 4095), (base + verdict.PAGE, 0), (base + verdict.PAGE, 1)}


def test_foreign_pointers():
    value = (0x1400_0010).to_bytes(8, "little")
    mine = dict(enumerate(b"\xff\xff" + value + b"\xff"))
    theirs = {o: 255 for o in mine}
    assert verdict.foreign_offsets(mine, theirs, [(0x1400_0000, 0x1500_0000)]) == set(range(2, 10))
    assert verdict.foreign_offsets({**mine, 3: 9}, theirs, [(0, 1)]) == set()
    del mine[5]
    assert verdict.foreign_offsets(mine, theirs, [(0x1400_0000, 0x1500_0000)]) == set()


def test_fill_is_traced_back(spark):
    rng = np.random.default_rng(3)
    offset = rng.integers(0, fill.GAMMA // 8, 40) * 8
    moved = rng.integers(-1024, 1025, 40)
    words = fill.fill_word(offset, 5) + moved.astype(np.int64).view(np.uint64)
    found, apart = fill.origin_of(words, np.full(40, 5))
    assert found.tolist() == offset.tolist() and apart.tolist() == moved.tolist()
    assert fill.origin_of(np.array([12345], np.uint64), np.array([7]))[0].tolist() == [-1]
    assert fill.fill_bytes(4096, 0)[:8].tobytes() == (4096 * fill.GOLDEN % (1 << 64)).to_bytes(8, "little")
    frame = spark.createDataFrame([(int(words.view(np.int64)[0]), 5)], "address long, seed long")
    assert frame.select(fill.fill_origin("address", "seed").alias("o")).first()["o"]["offset"] == offset[0]


def test_census_needs_every_fill(spark):
    runs = [(1, 0, v, s, e) for v in (0, 1) for s, e in verdict.RUNS]
    outcomes = spark.createDataFrame([(*r, "completed", 0, False) for r in runs], OUT)
    seen = lambda f: spark.createDataFrame([(*r, "x", f(r)) for r in runs], "pair_id long, input_idx int, variant int, side string, seed string, observation string, value string")
    facts = lambda f: tuple(verdict.settled(outcomes, seen(f)).select("comparable", "differs").first())
    assert facts(lambda r: r[3]) == (True, True)
    assert facts(lambda r: r[3] if r[2] else "same") == (True, False)
    assert facts(lambda r: r[4]) == (False, False)


def test_flips_at_matching_places(spark):
    rows = [(1, s, n, 10 - n if n else None) for s, m in (("Q", 6), ("K", 4)) for n in range(m)]
    branches = spark.createDataFrame(rows, "pair_id long, side string, count long, selectivity long")
    got = {tuple(r) for r in verdict.corresponding_flips(branches, [0.0, 0.01, 0.5, 1.0]).collect()}
    assert got == {(1, 5, 3), (1, 3, 2), (1, 1, 1)}


ABI = "struct<return:struct<kind:string,size:int,signed:boolean>,params:array<struct<kind:string,size:int,signed:boolean>>,variadic:boolean>"


def test_placement(spark):
    p = lambda kind, size: (kind, size, False)
    rows = [
        (1, (p("struct", 24), [p("float", 8), p("struct", 8), p("struct", 12), p("int", 4)], False)),
        (2, (p("void", None), [], True)),
        (3, (p("int", 4), [p("struct", 0)], False)),
        (4, (p("int", 4), [p("float", 16)], False)),
        (5, (p("complex", 16), [], False)),
        (6, None),
    ]
    frame = spark.createDataFrame(rows, f"i int, abi {ABI}")
    why = [r[0] for r in frame.orderBy("i").select(calling.decline_reason(F.col("abi"))).collect()]
    assert why == [None, "variadic", "aggregate of no size", "float wider than 8 bytes", "kind not supported", "no signature"]
    slots = frame.where("i = 1").select(calling.slots(F.col("abi")).alias("s")).first()["s"]
    assert [(s["position"], s["register"], s["stack_offset"], s["by_reference"], s["size"]) for s in slots] == [(1, "xmm1", None, False, 8), (2, "int2", None, False, 8), (3, "int3", None, True, 8), (4, None, 0, False, 4)]
    masks = spark.createDataFrame([("int", 1), ("int", 4), ("int", 8), ("void", None), ("pointer", 8)], "k string, s int")
    assert [r[0] for r in masks.select(calling.return_mask(F.col("k"), F.col("s"))).collect()] == [255, (1 << 32) - 1, -1, 0, 0]


def test_values_and_names(spark):
    row = spark.createDataFrame([(4, True, "rhash_final"), (1, False, "a_init"), (2, True, "plain")], "s int, g boolean, n string")
    values = [r[0] for r in row.select(calling.boundary_values(F.col("s"), F.col("g"), 1, F.lit(0))).collect()]
    assert values[0][:5] == [0, 1, (1 << 32) - 1, 1 << 31, (1 << 31) - 1] and values[1][:4] == [0, 1, 255, 127]
    names = [r[0] for r in row.select(calling.candidate_names(F.col("n"))).collect()]
    assert names[0][0] == "rhash_init" and len(names[0]) == 11 and names[1:] == [[], []]
    vectors = spark.createDataFrame([([[1, 2], [5]],), ([],)], "v array<array<long>>")
    assert [r[0] for r in vectors.select(calling.input_vectors(F.col("v"))).collect()] == [[[1, 5], [2, 5]], [[]]]
    near = spark.createDataFrame([(255, 1, 1), (255, 1, 2)], "a long, b long, s int")
    assert [r[0] for r in near.select(calling.selectivity(F.col("a"), F.col("b"), F.col("s"))).collect()] == [2, 254]


def test_decisions(spark):
    names = [("full", 0), ("full", 1), ("identity-0.5", 0), ("package-0.5", 0), ("package-0.5", 1)]
    make = lambda values, late=0.0, done=True: spark.createDataFrame([(r, s, float(v), late, done) for (r, s), v in zip(names, values)], "run string, seed int, mrr double, late_gain double, complete boolean")
    say = lambda f, *a: f(make(*a), 0.01).select("decision", "provisional").first()
    assert tuple(say(decisions.curve_verdict, [0.5, 0.5, 0.5, 0.4, 0.4])) == ("more packages help", False)
    assert tuple(say(decisions.curve_verdict, [0.5, 0.5, 0.4, 0.5, 0.5])) == ("only more functions help", False)
    assert tuple(say(decisions.curve_verdict, [0.5, 0.5, 0.5, 0.5, 0.5], 0.1)) == ("flattened", True)
    assert tuple(say(decisions.curve_verdict, [0.5] * 4)) == (None, None)
    assert tuple(say(decisions.short_curve_verdict, [0.5, 0.5, 0.485, 0.5, 0.5])) == ("still climbing below a doubling's worth", False)
    assert tuple(say(decisions.short_curve_verdict, [0.5, 0.52, 0.5, 0.5, 0.52])) == ("levelled off", True)
    history = spark.createDataFrame([("r", 0, e, s, m, m) for e, s, m in ((-1, 0, 0.1), (0, 10, 0.3), (1, 20, 0.4), (2, 40, 0.5))], "run string, seed int, epoch int, step int, mrr double, package_mrr double")
    r = decisions.run_rows(history, 40).first()
    assert (r["mrr"], r["best_step"], r["complete"]) == (0.5, 40, True) and r["late_gain"] == pytest.approx(0.1)
    stop = decisions.early_stopping(spark.createDataFrame([("r", 0, s, m) for s, m in enumerate([0.1, 0.3, 0.2, 0.25, 0.9])], "run string, seed int, step int, mrr double"), 2).first()
    assert (stop["best_step"], stop["stopped_at"]) == (1, 3)
    full = lambda pre, ran: decisions.full_verdict(spark.createDataFrame([(g, i, v, v, 0.0) for g, vs in (("pretrained", pre), ("random", ran)) for i, v in enumerate(vs)], "group string, seed int, mrr double, package_mrr double, late_gain double")).first()["result"]
    assert [full([0.6, 0.6], [0.5, 0.5]), full([0.4, 0.4], [0.5, 0.5]), full([0.5, 0.6], [0.5, 0.5]), full([0.5], [0.4, 0.4])] == ["helps", "hurts", "no measured difference", None]


def test_garbage_of_sides_equals_that_of_flat_tables(spark):
    import random as rnd

    random, nested, writes, stores = rnd.Random(4), [], [], []
    for pair in range(40):
        pages = []
        for page in (verdict.PAGE, 3 * verdict.PAGE)[: random.choice([1, 1, 1, 2])]:
            a = bytes(random.randrange(2) for _ in range(12))
            seen = [a, bytes(x ^ (random.random() < 0.1) for x in a)]
            seen[1] = None if random.random() < 0.05 else seen[1]
            pages.append((page, *[None if x is None else bytearray(x) for x in seen]))
            for seed, content in zip("AB", seen):
                writes += [(pair, 0, 0, "Q", seed, page, o, (content[o] if o < 12 else 0)) for o in range(verdict.PAGE) if content is not None]
        moved = [(random.choice(pages)[0] + random.randrange(8), random.randrange(1, 5), random.random() < 0.1) for _ in range(random.randrange(6))]
        if pair == 7:
            moved.append((2 * verdict.PAGE - 2, 4, True))  # over the end of a page
        nested.append((pair, 0, 0, "Q", pages, moved))
        stores += [(pair, 0, 0, "Q", "A", i, *m) for i, m in enumerate(moved)]
    sides = spark.createDataFrame(nested, "pair_id long, input_idx int, variant int, side string, pages array<struct<page:long,a:binary,b:binary>>, stores array<struct<address:long,size:long,partial:boolean>>")
    flat = verdict.garbage_bytes(spark.createDataFrame(writes, "pair_id long, input_idx int, variant int, side string, seed string, page long, offset int, byte int"), spark.createDataFrame(stores, "pair_id long, input_idx int, variant int, side string, seed string, ord int, address long, size int, partial boolean"))
    got = verdict.garbage_of_sides(sides)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flat.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_foreign_of_pages_equals_that_of_flat_tables(spark):
    import random as rnd

    random, nested, flat = rnd.Random(5), [], []
    word = (0x1_4000_0000 + 77).to_bytes(8, "little")
    for pair in range(60):
        sides = []
        for side in "QK":
            parts, start = [], random.randrange(4)
            for _ in range(random.randrange(3)):
                content = bytes(random.randrange(256) for _ in range(random.randrange(6))) + random.choice([word, b"", word[:5]]) + bytes(random.randrange(6))
                parts.append((start, bytearray(content)))
                flat += [(pair, 0, 0, 0, side, start + i, b) for i, b in enumerate(content)]
                start += len(content) + random.choice([0, 0, 2])  # parts may touch
            sides.append(parts if parts or random.random() < 0.5 else None)
        nested.append((pair, 0, 0, 0, *sides))
    flat += [(99, 0, 0, 0, s, verdict.PAGE - 8 + i, b) for s in "QK" for i, b in enumerate(word)]
    nested.append((99, 0, 0, 0, *[[(verdict.PAGE - 8, bytearray(word))]] * 2))
    ranges, part = [(0x1_4000_0000, 0x1_5000_0000)], "array<struct<start:int,content:binary>>"
    want = verdict.foreign_pointer_bytes(spark.createDataFrame(flat, "pair_id long, input_idx int, variant int, page long, side string, offset int, byte int"), ranges)
    got = verdict.foreign_of_pages(spark.createDataFrame(nested, f"pair_id long, input_idx int, variant int, page long, q {part}, k {part}"), ranges)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


PART = "stores array<struct<address:long,size:int>>, garbage array<int>, content array<int>"


def sides_of_pages(spark):
    import random as rnd

    random, rows = rnd.Random(6), []
    for pair in range(40):
        for page in (0, verdict.PAGE):
            for side in "QK":
                stores = [(page - 3 + random.randrange(10), random.randrange(5)) for _ in range(random.randrange(4))]
                rows.append((pair, 0, 0, page, side, stores, random.choice([None, [2], [1, 4]]), [random.randrange(3) for _ in range(14)]))
    rows = [(*r[:5], [s for s in r[5] if s[0] >= 0], *r[6:]) for r in rows]
    return rows, spark.createDataFrame(rows, f"pair_id long, input_idx int, variant int, page long, side string, {PART}")


def flat_stable(spark, rows):
    run = "pair_id long, input_idx int, variant int, side string, page long"
    touched = {(*r[:3], r[4], r[3], b - r[3]) for r in rows for a, n in r[5] for b in range(a, a + n) if 0 <= b - r[3] < verdict.PAGE}
    garbage = [(*r[:3], r[4], r[3], o) for r in rows for o in r[6] or []]
    writes = [(*r[:3], r[4], r[3], o, b) for r in rows for o, b in enumerate(r[7])]
    return verdict.stable_writes(*[spark.createDataFrame(sorted(x), f"{run}, offset int{y}") for x, y in ((touched, ""), (garbage, ""), (writes, ", byte int"))])


def test_stable_of_pages_equals_that_of_flat_tables(spark):
    rows, pages = sides_of_pages(spark)
    columns = ["pair_id", "side", "page", "offset", "byte"]
    got = verdict.stable_of_pages(pages)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, flat_stable(spark, rows).select(columns).collect())) != []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_compared_of_pages_equals_that_of_flat_tables(spark):
    rows, pages = sides_of_pages(spark)
    pages.createOrReplaceTempView("sides_of_pages")
    both = spark.sql("SELECT pair_id, input_idx, variant, page, max(CASE WHEN side = 'Q' THEN struct(stores, garbage, content) END) AS q, max(CASE WHEN side = 'K' THEN struct(stores, garbage, content) END) AS k, CASE WHEN pair_id % 3 = 0 THEN array(4) END AS foreign FROM sides_of_pages GROUP BY ALL")
    foreign = spark.createDataFrame([(p, 0, 0, page, 4) for p in range(0, 40, 3) for page in (0, verdict.PAGE)], "pair_id long, input_idx int, variant int, page long, offset int")
    want = verdict.compared_memory(flat_stable(spark, rows), foreign)
    assert sorted(map(tuple, verdict.compared_of_pages(both).collect())) == sorted(map(tuple, want.collect())) != []


def test_changed_of_runs_equals_that_of_flat_tables(spark):
    import random as rnd

    random, nested, stores, pages, base = rnd.Random(7), [], [], [], verdict.INPUT_BASE
    for pair in range(40):
        mine = [(base + b * verdict.BUFFER_STRIDE, bytearray(random.choice([1, 1, 2]) for _ in range(8))) for b in range(random.randrange(3))]
        moved = [(base + random.randrange(3) * verdict.BUFFER_STRIDE + random.randrange(10), random.randrange(4)) for _ in range(random.randrange(3))]
        runs = [(s, e, [1] if s == "K" and pair % 2 else None) for s, e in verdict.RUNS]
        if not mine and not moved:
            continue
        nested.append((pair, 0, 0, moved, mine, runs))
        stores += [(pair, 0, 0, s, e, *m) for s, e, _ in runs for m in moved]
        pages += [(pair, 0, 0, s, e, *p) for s, e, _ in runs for p in mine]
    run = "pair_id long, input_idx int, variant int, side string, seed string"
    initial = spark.createDataFrame([(0, base + b * verdict.BUFFER_STRIDE, bytearray(b"\1" * 8)) for b in range(2)], "variant int, page long, content binary")
    copies = spark.createDataFrame([(p, "K", 1) for p in range(1, 40, 2)], "pair_id long, side string, buffer int")
    want = verify.changed_buffers(spark.createDataFrame(stores, f"{run}, address long, size int"), spark.createDataFrame(pages, f"{run}, page long, content binary"), initial, copies)
    held = spark.createDataFrame(nested, "pair_id long, input_idx int, variant int, stores array<struct<address:long,size:int>>, pages array<struct<page:long,content:binary>>, runs array<struct<side:string,seed:string,copies:array<int>>>")
    out = lambda df: sorted((*r[:5], tuple(r[5])) for r in df.select("pair_id", "input_idx", "variant", "side", "seed", "changed").collect())
    assert out(verify.changed_of_runs(held, initial)) == out(want)
    assert any(r[5] for r in out(want))
