import random

import pyarrow as pa

import corpus_pipeline
from quernstone.llm import packing
from quernstone.llm.common import table


def documents(spark):
    rng = random.Random(8)
    syllables = {"aa": ["the", "ing", "th", "wh", "or"], "bb": ["sch", "ung", "eit", "ver", "in"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    shared = text("aa", 30)
    rows = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        rows.append((i, text(lang, 60) + (f"\n{shared}" if i < 10 else ""), lang, f"s{i % 3}"))
    rows += [(100, rows[20][1], "aa", "s"), (101, "12 34 %% 5", "aa", "s"), (102, None, None, "s"), (103, text("bb", 40), "bb", "s")]
    return rows, shared


def test_stages_take_effect(spark, tmp_path):
    rows, shared = documents(spark)
    item = rows[30][1].split()[:20]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["language"]) == {r[0] for r in rows} - {101, 102}
    assert sum(shared in r["text"] for r in seen["lines"].values()) == 1 and shared in seen["lines"][9]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"].values())
    assert set(seen["lines"]) - set(seen["near_copies"]) == {100}
    assert set(seen["near_copies"]) - set(seen["benchmark"]) == {30}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["benchmark"])
    tokens = packing.TokenBytes(packing.tokenizer_path())
    assert all(sum(p["length"] for p in packed if p["doc_id"] == i) == len(tokens.encode(pa.array([r["text"]]))[0]) // 4 + 1 for i, r in list(seen["benchmark"].items())[:5])


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "none of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd.withColumn("lang", F.lit("xx")), odd.limit(0).withColumn("lang", F.lit("xx"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "sequences":
                assert out.columns == docs.columns
            assert out.count() <= docs.count() or name == "sequences"
