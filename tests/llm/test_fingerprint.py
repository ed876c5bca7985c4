import hashlib
import random

import numpy as np

from quernstone.llm import fingerprint as fp


def brute(text, gram, window):
    hashes = fp.gram_hashes(fp.points_of(text), gram)
    if not len(hashes):
        return []
    size, out = min(window, len(hashes)), set()
    for i in range(len(hashes) - size + 1):
        best = max(range(i, i + size), key=lambda j: (-int(hashes[j]), j))
        out.add((best, int(hashes[best])))
    return sorted(out)


def test_against_brute_force(monkeypatch):
    rng = random.Random(2)
    for n in [*range(0, 40), 100, 500]:
        text = "".join(rng.choice("abé𝄞") for _ in range(n))
        for gram, window in ((1, 1), (3, 4), (5, 7), (32, 64)):
            position, value = fp.winnow(fp.points_of(text), gram, window)
            assert list(zip(position.tolist(), value.tolist())) == brute(text, gram, window)
    monkeypatch.setattr(fp, "BLOCK", 37)
    position, value = fp.winnow(fp.points_of(text), 3, 8)
    assert list(zip(position.tolist(), value.tolist())) == brute(text, 3, 8)


def test_shared_passages_are_found():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(fp.WINDOW + fp.GRAM - 1)
    for _ in range(30):
        a, b = text(rng.randint(0, 300)) + passage + text(50), text(rng.randint(0, 300)) + passage + text(80)
        assert np.intersect1d(fp.winnow(fp.points_of(a))[1], fp.winnow(fp.points_of(b))[1]).size


def test_short_texts_stay_like_their_edited_copies():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    for n in [*range(19, 100), 150, 400]:
        likes = []
        for _ in range(20):
            a, b = text(n), text(n)
            marks = [fp.winnow(fp.points_of(x))[1] for x in (a, fp.edited(a, b), b)]
            likes.append(fp.likeness(*marks[:2]))
            assert likes[-1] > 0 and fp.likeness(marks[0], marks[2]) < 0.1
        assert n < 50 or np.mean(likes) > 0.4


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        changed = fp.edited(text, after)
        marks = [fp.winnow(fp.points_of(x))[1] for x in (text, changed, after)]
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.as_string(marks[0]), fp.as_string(marks[1]), fp.likeness(*marks[:2]), fp.likeness(marks[0], marks[2])))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_next_documents_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i * 3, "".join(rng.choice("abcd ") for _ in range(rng.choice([0, 1, 3, 50, 400])))) for i in range(50)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4000, 7, 1):
        check(rows, fp.compare_with_next(frame.repartition(5), rows_per_range=size).collect())


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for size in (4000, 2):
        check(rows, fp.compare_with_next(odd, rows_per_range=size).collect())
    assert fp.compare_with_next(none).count() == 0
    assert len(fp.fingerprints(odd).where("doc_id = 6").first()["chosen_positions"]) > 100


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spark.createDataFrame([(1, "x" * 500), (2, "x" * 500), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fp.compare_with_next(rows).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert got[3]["near_next"] == 1.0 and got[4]["n_chars"] == 0
