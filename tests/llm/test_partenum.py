import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import partenum
from quernstone.llm.fastbytes import PowerTable, shingle_hashes
from quernstone.llm.graph import components
from quernstone.llm.partenum import linked, near_duplicates, signatures, sketch_allows


def words(text):
    return [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 900), st.floats(0, 0.25), st.floats(0, 0.25), st.integers(0, 1 << 30))
def test_similar_sets_share_a_signature(size, gone, new, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * 2)
    b = np.unique(np.concatenate([a[rng.random(len(a)) >= gone], rng.integers(0, 1 << 63, int(new * size), dtype=np.uint64)]))
    if len(b) and linked(a, b):
        assert len(np.intersect1d(signatures(a), signatures(b)))
        sketch = lambda h: np.frombuffer(partenum.sketch_of(h), np.uint8)
        assert sketch_allows(np.array([len(a)]), sketch(a)[None], np.array([len(b)]), sketch(b)[None])[0]


def test_shingle_hashes_tell_sets_apart():
    table = PowerTable()
    same = [b"A b  c d e f", b"a B c\nd\te f "]
    assert len({shingle_hashes(x, 5, table).tobytes() for x in same}) == 1
    assert len(shingle_hashes(b"a b c", 5, table)) == 1 and not len(shingle_hashes(b" \n", 5, table))
    assert len(shingle_hashes(b"a a a a a a a a", 5, table)) == 1


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 6, 9, 15, 40, 120]))]
        for _ in range(rng.randint(1, 7)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            docs.append((n, rng.choice([" ", "\n", "  "]).join(copy[: len(copy) - rng.choice([0, 0, 1, 3])])))
            n += 1
    want = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame).collect()} == want


def test_links_that_no_leader_has_are_found(spark):
    """A chain of neighbours: ends don't link with the leader, only with each other."""
    text = [f"t{i}" for i in range(300)]
    docs = [(i, " ".join(text[8 * i : 8 * i + 120])) for i in range(20)]
    want = brute(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) == 1


def test_block_pairs_find_every_pair_that_may_link(spark):
    sets = [(i, 10, bytes([10] + [0] * (partenum.SKETCH - 1))) for i in range(9)]
    groups = spark.createDataFrame([(1, i, i // 2) for i in range(9)], "signature long, doc_id long, component long")
    found = partenum.block_pairs(groups, spark.createDataFrame(sets, "doc_id long, n_shingles long, sketch binary"), block=2)
    got = {(r["a"], r["b"]) for r in found.collect()}
    assert got == {(a, b) for a in range(9) for b in range(a + 1, 9) if a // 2 != b // 2}


def test_pairs_leave_one_of_the_signatures_that_they_share(spark):
    """Groups of the same members: only the least has pairs; with others, all pairs are found."""
    sets = spark.createDataFrame([(i, 10, bytes([10] + [0] * (partenum.SKETCH - 1))) for i in range(6)], "doc_id long, n_shingles long, sketch binary")
    members = {s: range(6) for s in range(20, 40)} | {3: [0, 1], 50: [2, 5]}
    groups = spark.createDataFrame([(s, i, i) for s, each in members.items() for i in each], "signature long, doc_id long, component long")
    want = {(a, b) for a in range(6) for b in range(a + 1, 6)}
    found = partenum.block_pairs(groups, sets)
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    # before they are made distinct, as few leave as there are
    from unittest.mock import patch

    with patch.object(type(found), "distinct", lambda self: self):
        assert partenum.block_pairs(groups, sets).count() == len(want)


def test_components(spark):
    links = [(5, 4), (4, 9), (9, 1), (7, 8), (3, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 4: 1, 5: 1, 9: 1, 7: 7, 8: 7, **{i: 20 for i in range(20, 26)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == 11
    assert got[1][1] == got[2][1] == 1 and got[3] == (0, 3) and got[5] == (0, 5) and got[7] == (1, 7) and got[None] == (1, None)
    assert near_duplicates(none).count() == 0
