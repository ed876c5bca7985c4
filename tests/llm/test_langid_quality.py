import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import langid, quality
from quernstone.llm.fastbytes import PowerTable

SMALL = langid.Settings(samples=200, epochs=4, filters=6, embedding=4)


def corpus(spark, n=240):
    rng = random.Random(2)
    syllables = {"aa": ["the", "ing", "th", "wh"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["ción", "ñe", "llo", "qu"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 90))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_fold(spark):
    docs = corpus(spark)
    net = langid.fit(docs, SMALL)
    rows = langid.predict(docs.withColumn("fold", langid.fold()), net).collect()
    held = [r for r in rows if r["fold"] == 2]
    assert all(r["fold"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows)
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pair_tables_are_the_convolution(spark):
    rng = np.random.default_rng(1)
    for widths in ((2, 3, 4), (1, 3)):
        net = langid.train([b"abcabc", b"xyzxyz"] * 8, ["a", "b"] * 8, langid.Settings(widths=widths, filters=3, window=32, epochs=1))
        data = rng.integers(0, 256, (37, 32), dtype=np.uint8)
        x = langid._columns(net, data)
        z = np.maximum((x.reshape(-1, x.shape[2]) @ net.filters).reshape(*x.shape[:2], -1).max(1) + net.bias, 0) @ net.out + net.out_bias
        want = z - np.log(np.exp(z).sum(1, keepdims=True))
        assert np.allclose(langid.log_probabilities(net, data, langid.pair_tables(net)), want, atol=1e-4)


def test_languages_of_odd_rows(spark, odd, none):
    net = langid.fit(corpus(spark), SMALL)
    got = {r["doc_id"]: r for r in langid.predict(odd, net, "l_").collect()}
    assert len(got) == 10 and all(got[i]["l_lang_pred"] == "und" and got[i]["l_score"] == 0 for i in (3, 4, 5))
    assert got[6]["l_lang_pred"] in net.languages and got[8]["l_lang_pred"] in net.languages
    assert langid.predict(none, net).count() == 0
    nothing = langid.fit(none.withColumn("lang", F.lit("x")), SMALL)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(4)
    s = quality.Settings(buckets=32, rank=3)
    size = quality.STATISTICS + 32
    machine = quality.Machine(s, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, 3)))
    stats, places, shares = quality.features(b"Some words and some more, some 12.\nAnd lines", 32, PowerTable())
    x = np.zeros(size)
    x[: quality.STATISTICS], x[quality.STATISTICS + places] = stats, shares
    z = 0.1 + machine.weights @ x + sum(machine.vectors[i] @ machine.vectors[j] * x[i] * x[j] for i in range(size) for j in range(i + 1, size))
    assert abs(quality.score_of(machine, (stats, places, shares)) - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_of_held_out_rows(spark, odd, none):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "words", "more"]) + (".", "", "")[i % 3] for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) if good else " ".join(f"{w}%%%" for w in words), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1000, None), (None, 1)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    truth = {r[0]: r[2] for r in rows}
    held = quality.score(docs, machine).where(langid.fold() == 2).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    got = quality.score(odd, machine, "q_").collect()
    assert len(got) == 11 and all(0 <= r["q_score"] <= 1 and r["q_predicted"] == (r["q_score"] >= 0.7) for r in got)
    assert len({r["q_score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert quality.score(none, machine).count() == 0
    assert quality.score(odd, quality.fit(none, labels)).count() == 11
