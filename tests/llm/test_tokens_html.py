import itertools
import math

import pyarrow as pa
import regex

from quernstone.llm import htmltext, tokencount


def brute(word, scores):
    """The best segmentation of all, by score, then fewer tokens."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        places = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(places, places[1:])]
        if all(p in scores for p in parts):
            total = 0.0
            for p in parts:
                total += scores[p]
            if best is None or (total, -len(parts)) > best:
                best = (total, -len(parts))
    return -best[1]


def test_trie_against_all_segmentations():
    tokens = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"aa", b"cab"]
    scores = {t: -math.log(2 + 3 * i % 7) * len(t) ** 0.5 - 0.01 * i for i, t in enumerate(tokens)}
    for most in (1_000_000, 20):
        trie = tokencount.PreTokenTrie(scores, most)
        words = {bytes(w) for n in range(1, 8) for w in itertools.product(b"abc", repeat=n)}
        found = trie.counts(words)
        assert found == {w: brute(w, scores) for w in words} == {w: trie._long(w) for w in words}


def test_prefixes_are_shared():
    trie = tokencount.PreTokenTrie({bytes([b]): -1.0 for b in range(256)})
    assert trie.counts({b"prefix-one"}) == {b"prefix-one": 10}
    n = trie.nodes
    trie.counts({b"prefix-one", b"prefix-two"})
    assert trie.nodes == n + 3


def test_words_longer_than_the_trie_takes():
    scores = {bytes([b]): -2.0 for b in range(256)} | {b"ab": -1.0, b"x" * 100: -3.0}
    trie = tokencount.PreTokenTrie(scores)
    assert trie.counts({b"ab" * 40, b"x" * 250, b"ab" * 32, b""[:0] + b"c"}) == {b"ab" * 40: 40, b"x" * 250: 52, b"ab" * 32: 32, b"c": 1}
    assert trie.nodes == 65


def test_counts_of_texts(odd, none):
    path, pattern = tokencount.vocabulary_path(), tokencount.pre_token_pattern()
    scores = tokencount.log_probabilities(path)
    assert abs(math.fsum(map(math.exp, scores.values())) - 1) < 1e-9
    plain = tokencount.PreTokenTrie(scores)
    texts = ["don't  stop\n\n now", "a\x1cb", "tabs\t\tand   spaces ", "", None, "é𝄞 12345%%%", " lead", " ", "plain words here", "a \n b", "no\nbreak space x" * 30]
    counter = tokencount.TokenCounter(path, pattern, 5)
    for column in (pa.array(texts), pa.array(texts).slice(3), pa.array([], pa.string())):
        for text, pre, n in zip(column.to_pylist(), *counter.count(column), strict=True):
            found = regex.findall(pattern, text or "")
            assert (pre, n) == (len(found), sum(plain._long(x.encode()) for x in found))
    got = {r["doc_id"]: r for r in tokencount.token_counts(odd).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[6]["n_pretokens"] == 90_001 and got[7]["n_tokens"] >= 1
    assert tokencount.token_counts(none).count() == 0


def test_article_without_what_stands_beside_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
    <header>Site name</header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><div class="ad">Buy &amp; sell now</div>
    <div id="cookie-notice">We use cookies</div><article><h1>Heading  &amp;amp; more</h1><p>First   paragraph of the <b>art</b>icle,
    with enough text to count for something.<br>Yes.<p>As.</p><!-- no --><ul><li>one<li>two</ul><form><input><button>Send</button></form>
    <div class="comments"><p>A reader said that this is a long comment about nothing at all.</p></div></article>
    <aside class="sidebar"><p>Related things that are long enough to look like text here.</p></aside><footer>&copy; me</footer></body></html>"""
    assert htmltext.main_lines(page) == ["Heading &amp; more", "First paragraph of the article, with enough text to count for something. Yes.", "As.", "one", "two"]


def test_region_by_ratio_where_nothing_is_named():
    links = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(8))
    page = f"<body><div>{links}</div><div id=c><p>{'Long text of the story. ' * 20}</p><p>Short.</p><p>{'And more of the story. ' * 20}</p></div><div>{links}</div></body>"
    got = htmltext.main_lines(page)
    assert len(got) == 3 and got[1] == "Short."


def test_ratio_tools():
    assert htmltext.smoothed([]) == [] and abs(sum(htmltext.smoothed([0, 0, 1, 0, 0])) - 1) < 1e-9
    assert htmltext.main_lines("") == [] and htmltext.main_lines("<p>") == [] and htmltext.main_lines("text <b>only") == ["text only"]
    assert htmltext.main_lines("<p>a</b></p></div><p>b &lt;c&gt;") == ["a", "b <c>"]


def test_pages_as_rows(spark):
    rows = [(1, "u", "<p>one</p>", 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<p>one</p>", 5), (1, "u", "<p>one</p>", 5), (4, "u", "<p>" + "word " * 50_000, 5)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert [r["n_chars"] for r in sorted(got, key=lambda r: r["n_chars"])] == [0, 0, 3, 3, 3, 249_999]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_regions_keep_the_whole_article():
    words = "The harbour lay quiet that morning and the boats had not yet gone out to sea. "
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav>'
    foot = "<footer><p>Imprint and terms</p></footer>"
    page = lambda body: f"<html><body>{nav}{body}{foot}</body></html>"
    intro, text = words.strip(), (words * 6).strip()
    assert htmltext.main_lines(page(f"<div id=c><h1>Title</h1><div><p>{intro}</p></div><div><p>{text}</p><p>{text}</p></div></div>")) == ["Title", intro, text, text]
    assert htmltext.main_lines(page(f"<article><p>{text}</p></article><article><p>{text}</p><p>{intro}</p></article><article><p>Short.</p></article>")) == [text, text, intro, "Short."]
    for name in ("has-sidebar", "no-sidebar", "with-banner", "no-comments"):
        assert htmltext.main_lines(page(f'<div class="{name}"><h1>Title</h1><p>{text}</p><p>{intro}</p></div>')) == ["Title", text, intro]
    assert htmltext.main_lines(page(f'<div class="sidebar"><p>{intro}</p></div><div><h1>Title</h1><p>{text}</p></div>')) == ["Title", text]
    assert htmltext.main_lines(page(f'<article><p>{intro}</p></article><div class="sidebar"><p>{text}</p><p>{text}</p></div>')) == [intro]


def test_words_of_names_lose_no_article():
    text = ("Fifty words are enough for a story of the harbour and its boats, " * 6).strip()
    nav = '<nav><a href="/">Home</a><a href="/b">Blog</a></nav>'
    links = '<a href="/1">One more thing to read</a> <a href="/2">And another one</a>'
    for name in sorted(htmltext.BESIDE_WORDS):
        for also in (f"{name}-article", f"story {name}-story", f"has-{name}"):
            page = f'<body>{nav}<div class="{also}"><h1>T</h1><p>{text}</p></div><div class="share-price">12 up</div></body>'
            assert htmltext.main_lines(page)[:2] == ["T", text], also
        # inside an article: what is mostly links goes, other text stays
        page = f'<body>{nav}<article><h1>T</h1><p>{text}</p><div id="{name}-results"><p>Short but of the article.</p></div><div class="{name}-story">{links}</div><p>{text}</p></article></body>'
        assert htmltext.main_lines(page) == ["T", text, "Short but of the article.", text], name
        # a container named by such words alone goes, but for the one that holds the article
        assert htmltext.main_lines(f'<body>{nav}<article><h1>T</h1><div class="{name}">Buy this now.</div><p>{text}</p></article></body>') == ["T", text]
    for name in sorted(htmltext.BESIDE_WORDS - htmltext.COMMENT_WORDS):
        assert htmltext.main_lines(f'<body>{nav}<article><h1>T</h1><div class="{name}"><p>{text}</p><p>{text}</p></div><p>End.</p></article></body>') == ["T", text, text, "End."]


def test_trees_of_blocks_against_a_walk_over_the_tree():
    """Random pages: an article of random blocks between what stands beside it."""
    import random

    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("harbour boat quiet morning sea wind gull rope stone light".split()) for _ in range(n))

    def blocks(depth):
        """(html, lines) of a random tree."""
        html, lines = "", []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.3:
                inner, found = blocks(depth - 1)
                tag = rng.choice(["div", "section", "blockquote"])
                html += f"<{tag}>{inner}</{tag}>"
                lines += found
            elif rng.random() < 0.2:
                html += f'<div class="{rng.choice(["ad", "sidebar", "newsletter-box"])}">{words(4)}</div>'
            elif rng.random() < 0.15:
                html += f"<script>{words(5)}</script><!-- {words(3)} -->"
            else:
                text = words(rng.randint(12, 40))
                html += rng.choice(["<p>{}</p>", "<p>{}", "<div>\n {}\n</div>", "<p><b>{}</b></p>"]).format(text.replace(" ", rng.choice([" ", "  ", "\n"]), 1))
                lines.append(text)
        return html, lines

    for _ in range(200):
        body, lines = blocks(3)
        tail, more = words(60), words(50)
        page = f"<html><body><nav><a href=/>{words(2)}</a></nav><article><h1>Title</h1>{body}<p>{tail}</p><p>{more}</p></article><footer>{words(5)}</footer></body></html>"
        assert htmltext.main_lines(page) == ["Title", *lines, tail, more]
