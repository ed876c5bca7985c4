import random

from quernstone.llm.decontaminate import decontaminate, words_of

SCHEMA = "item_id long, text string"


def brute(text, items, window=13):
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item_id, item in items:
        w = words_of((item or "").encode())
        if item_id is None or not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item_id)
    return len(words), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "cc", "Dé", "e1", "ß"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 14, 20]))) for i in range(12)] + [(3, "a cc"), (99, "..."), (None, "a"), (98, None)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100, "x " + items[3][1] + " y"), (101, None), (102, "?!")]
    for bound in (32 << 20, 40):  # one block, and many
        out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, SCHEMA), max_pattern_bytes=bound)
        got = {r["doc_id"]: r for r in out.collect()}
        for doc, t in docs:
            n, hit, found = brute(t, items)
            r = got[doc]
            assert (r["n_words"], r["n_hit"], list(r["items"])) == (n, hit, found)
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_offsets_lead_to_the_original(spark):
    docs = spark.createDataFrame([(1, "Né: ONE -- two, three! end")], "doc_id long, text string")
    r = decontaminate(docs, spark.createDataFrame([(1, "one two three")], SCHEMA)).first()
    assert r["text"][r["hit_starts"][0] : r["hit_ends"][0]] == "ONE -- two, three"


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one")], SCHEMA)
    got = decontaminate(odd, items).collect()
    assert len(got) == 11 and sum(r["contaminated"] for r in got) == 3
    assert decontaminate(none, items).count() == 0
    empty = decontaminate(odd, spark.createDataFrame([], SCHEMA)).collect()
    assert len(empty) == 11 and not any(r["contaminated"] for r in empty)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y", "z")], "doc_id long, text string, ITEMS string, word_starts string, `drop` string")
    items = spark.createDataFrame([(1, "one"), (2, "two")], SCHEMA)
    for bound in (32 << 20, 1):
        got = decontaminate(docs, items, max_pattern_bytes=bound)
        assert sorted(got.columns) == sorted(["doc_id", "text", "word_starts", "drop", "n_words", "items", "hit_starts", "hit_ends", "n_hit", "n_items", "contaminated"])
        r = got.first()
        assert list(r["items"]) == [1, 2] and r["word_starts"] == "y" and r["n_hit"] == 2
