import pytest
from pyspark.sql import functions as F

from quernstone.operators import dataset, sampling, training, vocab

COLUMNS = "function_id long, package string, decl_file string, name string, opt_level string, n_instructions int, tokens array<string>, content string"


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for p in range(6):
        for f in range(4):
            for level in ("O0", "O1", "O3"):
                i = len(out)
                tokens = [f"t{(p * 7 + f * 3 + k) % 11}" for k in range(8)] + [level]
                out.append((i, f"p{p}", f"/work/p{p}/a.c", f"f{f}", level, 9, tokens, f"c{p}-{f}-{level}"))
        out.append((100 + p, f"p{p}", "/opt/mingw-w64-crt/x.c", "crt", "O0", 9, ["a"], "crt"))
        out.append((200 + p, f"p{p}", f"/work/p{p}/b.c", "same", "O0", 9, ["b"], "same" if p < 2 else f"s{p}"))
        out.append((300 + p, f"p{p}", f"C:\\p{p}\\_deps\\z.c", "dep", "O0", 9, ["d"], f"d{p}"))
        out.append((400 + p, f"p{p}", None, "none", "O0", 9, ["n"], f"n{p}"))
        out.append((500 + p, f"p{p}", f"/work/p{p}/a.c", "tiny", "O0", 2, ["n"], f"y{p}"))
    return spark.createDataFrame(out, COLUMNS)


def test_files_are_excluded_with_reasons(rows):
    got = {r["decl_file"]: r["reasons"] for r in dataset.excluded_files(rows).collect()}
    assert got == {"/opt/mingw-w64-crt/x.c": "shared+toolchain", **{f"C:\\p{p}\\_deps\\z.c": "dependency" for p in range(6)}}


def test_candidates_and_eligible(rows):
    candidates = dataset.candidate_rows(rows)
    assert candidates.count() == 6 * 13
    assert {r["content"] for r in dataset.duplicate_keys(candidates).collect()} == {"same"}
    assert dataset.eligible_rows(candidates).count() == 6 * 13 - 2


def test_result_does_not_depend_on_partitions(rows):
    one, many = (sorted(map(tuple, dataset.eligible_rows(dataset.candidate_rows(rows.repartition(n))).select("function_id", "content").collect())) for n in (1, 7))
    assert one == many
    assert dataset.row_digest(rows.repartition(1), "function_id").first() == dataset.row_digest(rows.repartition(7), "function_id").first()


def test_splits_hold_whole_packages(spark):
    sizes = spark.createDataFrame([(f"p{i:02}", 100 - i) for i in range(20)], "package string, functions long")
    got = {r["package"]: r["split"] for r in dataset.assign_splits(sizes).collect()}
    assert len(got) == 20 and sorted(got.values()).count("val") >= 3 and list(got.values()).count("test") >= 3
    for n, want in ((1, {"train"}), (2, {"train", "val"}), (3, {"train", "val", "test"})):
        few = {r["split"] for r in dataset.assign_splits(sizes.limit(n)).collect()}
        assert "train" in few and len(few) == len(want)
    domains = spark.createDataFrame([(f"p{i:02}", f"d{i % 3}") for i in range(18)], "package string, domain string")
    by = dataset.assign_splits(sizes, domains).join(domains, "package").groupBy("domain").agg(F.collect_set("split").alias("s"))
    assert all(set(r["s"]) == {"train", "val", "test"} for r in by.collect())


def test_quotas_round_half_to_even():
    assert dataset._quotas(10) == {"val": 2, "test": 2} and dataset._quotas(2) == {"test": 1} and dataset._quotas(1) == {}


def test_leakage_and_copies(spark, rows):
    candidates = dataset.candidate_rows(rows)
    splits = spark.createDataFrame([(f"p{p}", "train" if p % 2 else "test") for p in range(6)], "package string, split string")
    assert tuple(dataset.leakage(candidates, splits).first()) == (1, 0)
    assert [tuple(r) for r in dataset.vendored_copies(candidates, floor=0).collect()] == [("p0", "p1", 1)]
    before = dataset.fingerprint(candidates, splits).first()[0]
    assert len(before) == 16 and before != dataset.fingerprint(candidates.limit(5), splits).first()[0]


def test_vocabulary(spark, rows, tmp_path):
    words = vocab.build_vocab(rows, 6)
    again = vocab.build_vocab(rows.repartition(7), 6)
    assert words.orderBy("id").collect() == again.orderBy("id").collect()
    tokens = [r["token"] for r in words.orderBy("id").collect()]
    assert tuple(tokens[:5]) == vocab.SPECIALS and "d" not in tokens[:5]
    vocab.save(words, f"{tmp_path}/v.json", 6, {})
    assert vocab.load(spark, f"{tmp_path}/v.json").orderBy("id").collect() == words.orderBy("id").collect()
    (tmp_path / "bad.json").write_text('{"format": 1, "tokens": ["[CLS]"]}')
    with pytest.raises(ValueError):
        vocab.load(spark, f"{tmp_path}/bad.json")
    with pytest.raises(ValueError):
        vocab.build_vocab(rows, 0)
    odd = spark.createDataFrame([(1, ["t1", "IMPORT:x", "what"])], "function_id long, tokens array<string>")
    encoded = vocab.encode(odd, words)
    ids = [r["token_id"] for r in encoded.orderBy("position").collect()]
    assert ids[0] >= 5 and ids[1:] == [vocab.RARE_IMPORT, vocab.UNK]
    c = vocab.coverage(encoded, odd).first()
    assert (c["tokens"], c["functions_with_fallback"]) == (3, 1.0) and c["unk_rate"] == pytest.approx(1 / 3)


def test_masks_are_exact(rows):
    words = vocab.build_vocab(rows, 1)
    masked = sampling.mask_tokens(vocab.encode(rows, words), words, rate=0.25, seed=2)
    per = masked.groupBy("function_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") != -100).alias("k")).collect()
    assert all(r["k"] == min(r["n"], max(1, round(0.25 * r["n"]))) for r in per)
    assert masked.where("label = -100 AND input_id = 2").count() == 0
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, sampling.mask_tokens(vocab.encode(rows.repartition(5), words), words, rate=0.25, seed=2).collect()))


def test_subsets_are_nested(rows):
    small, large = ({r["function_id"] for r in sampling.subset(rows, f, "identity", 3).collect()} for f in (0.25, 0.5))
    assert small < large
    assert len({r["package"] for r in sampling.subset(rows, 0.0, "package").collect()}) == 1


def test_pairs_and_false_negatives(spark, rows):
    paired = rows.where("opt_level <> 'O1' OR name = 'f1'")
    batches = training.pair_batches(paired, batch=5, seed=4).collect()
    # 24 identities of six packages: four full batches of five, at most one of a package's in a turn
    assert len(batches) == 20 and {(r["batch"], r["slot"]) for r in batches} == {(b, s) for b in range(4) for s in range(5)}
    assert len({(r["package"], r["decl_file"], r["name"]) for r in batches}) == 20
    assert all(r["query_id"] != r["key_id"] and r["query_level"] != r["key_level"] for r in batches)
    first = [r["package"] for r in sorted(batches, key=lambda r: r["slot"]) if r["batch"] == 0]
    assert len(set(first)) == 5  # a quota of one, from packages that all have some left
    slots = spark.createDataFrame([(0, 0, "x", "y"), (0, 1, "z", "x"), (0, 2, "w", "y"), (1, 0, "x", "x")], "batch int, slot int, query_content string, key_content string")
    assert {tuple(r) for r in sampling.false_negatives(slots).collect()} == {(0, 0, 1), (0, 0, 2), (0, 2, 0)}
    same = spark.createDataFrame([(1, "p", "f", "n", "O0", "x"), (2, "p", "f", "n", "O1", "x"), (3, "p", "f", "n", "O2", "y")], "function_id long, package string, decl_file string, name string, opt_level string, content string")
    assert sampling.identical_share(same).first()["expected"] == pytest.approx(1 / 3)


def test_eligible_rows_by_a_number_of_the_package_need_no_sort(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i % 11 else None, i % 3 if i % 11 else None, str(i % 7 if i % 2 else i).encode()) for i in range(60)], "function_id long, package string, number long, content binary")
    by_name, by_number = (sorted(map(tuple, dataset.eligible_rows(rows, group=g).select("function_id").collect())) for g in ("package", "number"))
    assert by_name == by_number and 0 < len(by_name) < 60
    assert "SortAggregate" not in dataset.eligible_rows(rows, group="number")._jdf.queryExecution().executedPlan().toString()
