"""Main text of web pages by text-to-tag ratios.

The events of the standard library's streaming parser are gathered into lines,
one for each block-level stretch of the page, with the characters of text and
the tags of each. The text-to-tag ratio of the lines is smoothed with a Gaussian,
and lines are clustered by a threshold, the standard deviation of the smoothed
ratios. The article or main element in which the lines of the content cluster hold
most text, with the other articles, is the content region; on pages without, it is
the lowest container of all those lines. All its lines are kept, however short, but for
those inside menus, headers, footers, asides, notices, adverts, forms and reader comments.

Elements say so by their name. A word of a class, id or role only lowers what a
container weighs: one whose name is made of such words alone stands beside the
article unless it holds most of the content cluster, one that has other words in
its name only if its text is mostly links.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernstone.llm.common import append_columns, texts

#: Names of elements by what they are.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button title".split())
BESIDE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that another of their kind, or a block, ends when their end tag is missing.
CLOSED_BY = {
    "p": frozenset("p div ul ol dl table section article main aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre hr address figure fieldset details".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Those of readers' comments, which may hold articles of their own.
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
#: Words of class, id and role attributes of what stands beside an article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing social comment comments reply replies disqus respond related recommended recommendations pagination pager login search toolbar complementary contentinfo dialog".split()
)
#: Words that say nothing of what a container holds.
PLACE_WORDS = frozenset("area bar block bottom box button buttons col column container global group holder inner item items js left link links list module outer page panel primary region right row secondary section site slot strip text top unit user widget wrap wrapper zone".split())
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SPACES = re.compile(r"\s+")
SIGMA, RADIUS = 1.0, 2


@dataclass
class Line:
    text: str
    tags: int
    path: tuple[int, ...]
    linked: int


class LineReader(HTMLParser):
    """Lines of a page with the containers that they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, number, unseen
        self.kinds: dict[int, str] = {0: ""}
        self.beside: set[int] = set()  # numbers of containers beside the article
        self.doubtful: set[int] = set()  # those of them that only the words of a name say so of
        self.hinted: set[int] = set()  # containers that have such words among others
        self.parts: list[str] = []
        self.tags = self.numbers = self.in_link = self.link_chars = 0

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.parts)).strip(" ")
        self.parts.clear()
        if text:
            self.lines.append(Line(text, self.tags, tuple(n for _, n, _ in self.stack), self.link_chars))
            self.tags = self.link_chars = 0

    def handle_starttag(self, tag, attrs):
        if self.stack[-1][2]:
            if tag not in VOID:
                self._push(tag, True)
            return
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            if self.stack[-1][0] in INLINE:  # an inline element that was never ended
                while self.stack[-1][0] in INLINE:
                    self.stack.pop()
            while self.stack[-1][0] in CLOSED_BY and tag in CLOSED_BY[self.stack[-1][0]]:
                self.stack.pop()
        if tag in ("main", "article"):  # what holds the article isn't beside it
            self.beside -= self.doubtful.intersection(n for _, n, _ in self.stack)
        self._push(tag, tag in UNSEEN or self._hidden(attrs))
        self._place(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _push(self, tag: str, unseen: bool) -> None:
        self.numbers += 1
        self.kinds[self.numbers] = tag
        self.stack.append((tag, self.numbers, unseen or self.stack[-1][2]))

    @staticmethod
    def _hidden(attrs) -> bool:
        return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v) for k, v in attrs)

    def _place(self, tag: str, attrs) -> None:
        """Notes whether the container just begun stands beside the article."""
        if tag in BESIDE or tag == "header" and not any(name in ("article", "main") for name, _, _ in self.stack):
            self.beside.add(self.numbers)  # an article's own header holds its title
        elif tag not in ("html", "body", "main", "h1"):
            beside = COMMENT_WORDS if tag in ("article", "header") else BESIDE_WORDS
            names = [x for k, v in attrs if k in ("class", "id", "role") and v for x in v.split()]
            told = [w for w in ({w.lower() for w in WORD.findall(x)} for x in names) if not w.isdisjoint(beside)]
            sure = [w for w in told if w <= beside | PLACE_WORDS]
            if sure:
                self.beside.add(self.numbers)
                if all(w.isdisjoint(COMMENT_WORDS) for w in sure):
                    self.doubtful.add(self.numbers)
            elif told:
                self.hinted.add(self.numbers)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                if tag not in INLINE and not self.stack[-1][2]:
                    self.flush()
                if tag in INLINE and any(name not in INLINE for name, _, _ in self.stack[at + 1 :]):
                    return  # a stray end tag doesn't end blocks
                del self.stack[at:]
                break
            if self.stack[at][0] in ("article", "main", "body", "table") and tag in INLINE | {"p", "li"}:
                break
        self.tags += not self.stack[-1][2]

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.parts.append(data)
            if any(name == "a" for name, _, _ in self.stack):
                self.link_chars += len(data)

    def close(self):
        super().close()
        self.flush()


def smoothed(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing; beyond the ends there is nothing."""
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    total = sum(weights)
    out = [0.0] * len(values)
    for i in range(len(values)):
        low, high = max(0, i - radius), min(len(values), i + radius + 1)
        out[i] = sum(values[j] * weights[j - i + radius] for j in range(low, high)) / total
    return out


def deviation(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))


def weights(content: list[Line], linked: bool = False) -> dict[int, int]:
    """The characters of lines in each container, or those of them in links."""
    weight: dict[int, int] = {}
    for x in content:
        for n in x.path:
            weight[n] = weight.get(n, 0) + (x.linked if linked else len(x.text))
    return weight


def main_lines(html: str) -> list[str]:
    """The lines of the content region, in page order."""
    reader = LineReader()
    reader.feed(html)
    reader.close()
    if not reader.lines:
        return []
    ratios = smoothed([(len(x.text) - x.linked) / (x.tags + 1) for x in reader.lines])
    threshold = deviation(ratios)
    cluster = [x for x, r in zip(reader.lines, ratios) if r >= threshold]
    shown = lambda rows: [x for x in rows if reader.beside.isdisjoint(x.path)]
    if reader.hinted:  # their words count if links do too
        held, links = weights(reader.lines), weights(reader.lines, linked=True)
        reader.beside |= {n for n in reader.hinted if links.get(n, 0) * 2 > held.get(n, 0)}
    if reader.doubtful:  # the most of an article isn't beside it
        held = weights(cluster)
        own = {n: m for x in cluster for i, n in enumerate(x.path) if n in reader.doubtful for m in x.path[:i] if reader.kinds[m] in ("article", "main")}
        reader.beside -= {n for n, m in own.items() if held[n] * 2 > held[m]}
    lines = shown(reader.lines)
    content = shown(cluster) or lines
    weight = weights(content)
    region = max((n for n in weight if reader.kinds[n] in ("article", "main")), key=lambda n: (weight[n], n), default=None)
    if region is not None and weight[region] * 4 >= weight[0]:
        parts = {region}
        if reader.kinds[region] == "article":  # and those with content, or right beside it
            above = {n: x.path[i - 1] for x in lines for i, n in enumerate(x.path) if reader.kinds[n] == "article"}
            parts |= {n for n in above if n in weight or above[n] == above[region]}
        return [x.text for x in lines if not parts.isdisjoint(x.path)]
    # a container with most of the cluster isn't beside the article, whatever its class says
    weight = weights([x for x in cluster if not (reader.beside - reader.doubtful).intersection(x.path)])
    held = {n for n in reader.doubtful if weight.get(n, 0) * 2 > weight.get(0, 0)}
    if not lines and not held:  # a word of an attribute, or a form, around the whole page
        weight = weights(cluster)
        held = {n for n in reader.beside if weight.get(n, 0) == weight.get(0) and reader.kinds[n] not in BESIDE - {"form"}}
    reader.beside -= held
    lines = shown(reader.lines)
    content = shown(cluster) or lines
    if not lines:
        return []
    content = [x for x in content if x.linked * 2 <= len(x.text)] or content  # smoothing raises links next to long text
    # the lowest container of all content, and those above it whose other lines aren't mostly links
    path = content[0].path
    for x in content:
        path = path[: next((i for i, (m, n) in enumerate(zip(path, x.path)) if m != n), min(len(path), len(x.path)))]
    at = len(path) - 1
    while at > 0 and reader.kinds[path[at - 1]] not in ("", "html", "body"):
        other = [x for x in lines if path[at - 1] in x.path and path[at] not in x.path]
        if sum(x.linked for x in other) * 2 > sum(len(x.text) for x in other):
            break
        at -= 1
    if reader.kinds[path[at]] not in ("div", "section", "td", "body", "html", "") and sum(path[at] in x.path for x in lines) == 1:
        at -= 1  # a line of its own has its neighbours beside it
    return [x.text for x in lines if path[at] in x.path]


def extract(pages: DataFrame, column: str = "html", keep_html: bool = False) -> DataFrame:
    """pages with text, the main text, and n_chars, its code points.

    White space inside a block is one space and blocks are joined by \\n. A null
    or empty page, and one without text, has an empty text. Repeated rows get
    equal results, and long pages are read whole; a table without rows gives none.
    A column of pages whose name is that of a new column is replaced.
    """

    def make():
        def step(batch):
            found = ["\n".join(main_lines(x)) for x in texts(batch, column)]
            return [found, [len(x) for x in found]]

        return step

    return append_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, () if keep_html else (column,))
