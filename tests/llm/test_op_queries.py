"""The ten queries over whole tables, against their SQL or a plain version of each."""

import hashlib
import html as entities
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex

from quernstone.llm import fingerprint, langid, packing, quality, tokencount
from quernstone.llm.oracles import ORACLES
from quernstone.llm.queries import QUERIES

NO_SQL = {"op1_token_counts", "op3_fingerprints", "op4_best_fit_packing", "op7_quality", "op8_language_id", "op10_html_text"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == want


def test_all_others_have_a_plain_version():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_token_counts(spark, sf_dir, docs):
    """Best segmentations by a table over all cuts of each pre-token."""
    scores = tokencount.log_probabilities(tokencount.vocabulary_path())
    longest, known = max(map(len, scores)), {}

    def tokens(word):
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                found = [(best[end - n][0] + scores[word[end - n : end]], -best[end - n][1] - 1) for n in range(1, min(end, longest) + 1) if word[end - n : end] in scores]
                score, fewest = max(found)
                best.append((score, -fewest))
            known[word] = best[-1][1]
        return known[word]

    rows = QUERIES["op1_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        found = regex.findall(tokencount.pre_token_pattern(), docs[r["doc_id"]]["text"] or "")
        assert (r["n_pretokens"], r["n_tokens"]) == (len(found), sum(tokens(x.encode()) for x in found))


def test_fingerprints(spark, sf_dir, docs):
    """Winnowing window by window over hashes made gram by gram, in Python's integers."""
    most = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ x >> 27) * 0x94D049BB133111EB & most
        return x ^ x >> 31

    def marks(text):
        size = min(fingerprint.GRAM, len(text))
        grams = [mixed(sum((ord(c) + 1) * pow(fingerprint.MULTIPLIER, j, 1 << 64) for j, c in enumerate(text[i : i + size])) + size & most) >> 24 for i in range(len(text) - size + 1)] if text else []
        chosen = {}
        for i in range(max(1, len(grams) - fingerprint.WINDOW + 1)):
            window = grams[i : i + fingerprint.WINDOW]
            if window:
                at = i + max(j for j, h in enumerate(window) if h == min(window))
                chosen[at] = grams[at]
        return [chosen[i] for i in sorted(chosen)]

    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    shown = lambda m: "".join(f"{h & 0xFFFFFFFF:08x}" for h in m)
    ids = sorted(docs)
    text = {i: docs[i]["text"] or "" for i in ids}
    rows = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, sf_dir).collect()}
    assert sorted(rows) == ids
    for at, i in enumerate(ids):
        after = text[ids[(at + 1) % len(ids)]]
        n = len(text[i]) // 4
        changed = text[i][: len(text[i]) - n] + after[:n]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text[i]), hashlib.sha256(changed.encode()).hexdigest())
        if len(text[i]) < 6000:  # the plain version is slow
            mark, other = marks(text[i]), marks(changed)
            assert r["fingerprint"] == shown(mark) and r["edited_fingerprint"] == shown(other)
            assert r["near_edited"] == pytest.approx(like(mark, other))
            if len(after) < 6000:
                assert r["near_next"] == pytest.approx(like(mark, marks(after)))


def test_packing(spark, sf_dir, docs):
    """Pieces by the tokenizer alone, places without gaps, and as few sequences as the tokens allow."""
    tokenizer = packing.TokenBytes(packing.tokenizer_path()).tokenizer
    rows = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    want = set()
    for i, d in docs.items():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for piece, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.add((i, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == math.ceil(sum(r["length"] for r in rows) / 4096)


def test_quality(spark, sf_dir, docs):
    """Scores by a sum over all pairs of features, and folds by Python's crc32."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    rows = QUERIES["op7_quality"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    table = quality.PowerTable()
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.7)
    for r in rows[:12]:
        stats, places, shares = quality.features((docs[r["doc_id"]]["text"] or "").encode(), machine.settings.buckets, table)
        x = np.concatenate([(stats - machine.mean) / machine.spread, shares])[:60]  # the first features, all pairs
        at = np.concatenate([np.arange(quality.STATISTICS), quality.STATISTICS + places])[:60]
        z = machine.bias + sum(machine.weights[a] * y for a, y in zip(at, x))
        z += sum(machine.vectors[at[i]] @ machine.vectors[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i + 1, len(x)))
        if len(places) + quality.STATISTICS <= 60:
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect()}
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) >= 0.9 * len(right)


def test_language_id(spark, sf_dir, docs):
    """The forward pass filter by filter and place by place, over all windows of a text."""
    net = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    s, widest = net.settings, max(net.settings.widths)

    def plain(raw):
        total = np.zeros(len(net.languages))
        for at in range(0, len(raw), s.window):
            part = raw[at : at + s.window]
            x = net.embed[np.frombuffer(part.ljust(s.window, b"\0"), np.uint8)]
            pooled = [max(float((x[i : i + widest].ravel() * net.filters[:, f]).sum()) for i in range(s.window - widest + 1)) for f in range(net.filters.shape[1])]
            z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
            total += (z - z.max() - math.log(np.exp(z - z.max()).sum())) * len(part) / s.window
        mean = total / max(1, len(raw) / s.window)
        p = np.exp(mean - mean.max())
        return net.languages[int(p.argmax())], p.max() / p.sum()

    rows = QUERIES["op8_language_id"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    checked = 0
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        assert r["held_out"] == held_out(r["doc_id"])
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(text) < 1500 and checked < 15:
            checked += 1
            name, score = plain(text.encode())
            assert r["score"] == pytest.approx(score, abs=1e-3) and (r["lang_pred"] == name or score < 0.51)
    assert checked == 15
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(right) >= 0.9 * len(right)


def test_signs_that_are_no_letters(spark):
    net = langid.train([b"abc", b"xyz"] * 4, ["a", "b"] * 4, langid.Settings(epochs=1))
    rows = spark.createDataFrame([(0, "½ ² Ⅷ ①"), (1, "1 ª"), (2, "́"), (3, "ー"), (4, "12 é")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] == "und" for r in langid.predict(rows, net).collect()}
    assert got == {i: not any(c.isalpha() for c in t) for i, t in [(r["doc_id"], r["text"]) for r in rows.collect()]}


def test_html_text(spark, sf_dir):
    """The pages' one article, cut out by its tags and taken apart with expressions."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op10_html_text"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        page = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<br>", " ", page[1] if page else ""))
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks]
        want = "\n".join(x for x in lines if x)
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])
