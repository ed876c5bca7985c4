"""Benchmark decontamination with an Aho-Corasick automaton.

The 13-word windows of all benchmark items, lower-cased and joined by one
space, go into one automaton. A document is normalised alike and scanned once;
each occurrence marks the words that it covers, and the marked words lead back
to code points of the original text.

The automaton is sent to the executors, so its patterns have a proven bound:
items are taken in blocks of at most ``max_pattern_bytes`` of patterns. An
ordinary benchmark is one block. With more, each block is a scan of the texts that
leaves only the hits of those that have any, by the hash of the text, and the hits
of all blocks meet the documents at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import BROADCAST_ROWS, append_columns, own_prefix, raw_texts, stored, worker_state

WINDOW = 13
#: A-Z become lower case; all that is no word becomes a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

HITS = T.ArrayType(T.LongType(), False)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """Windows of an item; an item with fewer words, but not none, is one."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def pattern_blocks(items: DataFrame, window: int, max_pattern_bytes: int) -> Iterator[dict[bytes, list[int]]]:
    """Pattern to item ids, in blocks of bounded size; items arrive one at a time."""
    block: dict[bytes, list[int]] = {}
    held = 0
    for item_id, text in items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        for pattern in windows_of(words_of(text.encode()), window):
            block.setdefault(pattern, []).append(item_id)
            held += len(pattern)
        if held > max_pattern_bytes:
            yield block
            block, held = {}, 0
    if block:
        yield block


def automaton(patterns: dict[bytes, list[int]], key: str):
    """The automaton of the patterns, built once in a worker."""
    import ahocorasick

    def build():
        built = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            built.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, ids))
        built.make_automaton()
        return built

    return worker_state("automaton", (key,), build)


def word_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Code point offsets in the original of runs of words, ends exclusive."""
    data = np.frombuffer(raw.translate(NORMAL), np.uint8)
    inside = np.concatenate(([False], data != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return points[edges[0::2][starts]].tolist(), points[edges[1::2][ends - 1]].tolist()


NAMES = ("items", "word_starts", "word_ends", "hit_starts", "hit_ends")


def _scan(df: DataFrame, patterns: dict[bytes, list[int]], n_words: str, names: list[str], earlier: bool, drop: tuple[str, ...]) -> DataFrame:
    """df with the count of words and NAMES, called names, of what occurs of the
    patterns and, if there are such columns, of what was found earlier."""
    key = hashlib.sha256(repr(sorted(patterns.items())).encode()).hexdigest()
    fields = [T.StructField(n_words, T.LongType()), *(T.StructField(x, HITS) for x in names)]

    def make():
        machine = automaton(patterns, key) if patterns else None

        def step(batch):
            out: list[list] = [[] for _ in fields]
            old = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names] if earlier else None
            for row, raw in enumerate(raw_texts(batch)):
                words = words_of(raw)
                items, *runs = ([], [], [], [], []) if old is None else [x[row] or [] for x in old]
                found = []
                if machine is not None and words:
                    normal = b" " + b" ".join(words) + b" "
                    found = list(machine.iter(normal.decode("latin-1")))
                if found or runs[0]:
                    covered = np.zeros(len(words) + 1, np.int64)
                    np.add.at(covered, runs[0], 1)
                    np.add.at(covered, runs[1], -1)
                    if found:
                        spaces = np.cumsum(np.frombuffer(normal, np.uint8) == 0x20)
                        last = spaces[[e for e, _ in found]] - 1
                        np.add.at(covered, last - [n for _, (n, _) in found], 1)
                        np.add.at(covered, last, -1)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(covered) > 0))))
                    runs = [edges[0::2].tolist(), edges[1::2].tolist(), *word_spans(raw, edges[0::2], edges[1::2])]
                    items = sorted({i for _, (_, ids) in found for i in ids}.union(items))
                for x, y in zip(out, (len(words), items, *runs)):
                    x.append(y)
            return out

        return step

    return append_columns(df, fields, make, drop, stateful=True)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    prefix: str = "",
    keep_text: bool = True,
    window: int = WINDOW,
    percent: int = 5,
    max_pattern_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with what of it occurs in the items.

    New columns, each behind prefix: n_words; n_hit, words inside an occurrence
    of a window; n_items and items, the item ids with occurring windows, in
    order; hit_starts and hit_ends, code point offsets in the original of the
    runs of hit words; contaminated, n_hit > 0 and n_hit of at least percent %
    of n_words. keep_text=False leaves the text out.

    A null or empty text has no words. Items that lack an id or a text, or have
    no words, never occur; rows of one item id are one item. Repeated documents
    get equal rows, long texts are scanned whole, an empty table gives an empty
    one. A column of docs whose name is that of a new column, whatever the case of
    its letters, is replaced; all others stay.
    """
    own = own_prefix(docs)
    names = [f"{prefix}items", f"{own}starts", f"{own}ends", f"{prefix}hit_starts", f"{prefix}hit_ends"]
    blocks = pattern_blocks(items, window, max_pattern_bytes)
    block, later = next(blocks, {}), next(blocks, None)
    drop = () if keep_text else ("text",)
    if later is None:
        df = _scan(docs, block, f"{prefix}n_words", names, False, drop)
    else:
        named = docs.withColumn(f"{own}key", F.sha2("text", 256))
        inner = [f"{own}{x}" for x in NAMES]  # names that no column of docs has
        hits = None
        while block is not None:
            one = _scan(named.select(f"{own}key", "text"), block, f"{own}n", inner, False, ("text",)).where(F.size(inner[0]) > 0)
            one = stored(one.drop(f"{own}n").dropDuplicates([f"{own}key"]), "benchmark-hits")
            hits = one if hits is None else hits.unionByName(one)
            block, later = later, next(blocks, None)
        hits = hits.groupBy(f"{own}key").agg(*[F.flatten(F.collect_list(x)).alias(x) for x in inner])
        few = hits.count() <= BROADCAST_ROWS
        df = named.join(F.broadcast(hits) if few else hits, f"{own}key", "left").drop(f"{own}key")
        df = _scan(df, {}, f"{prefix}n_words", inner, True, drop)
        clash = {n.lower() for n in names}
        df = df.drop(*[c for c in df.columns if c.lower() in clash]).withColumnsRenamed(dict(zip(inner, names)))
    found, starts, ends = names[:3]
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    covered = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumns({f"{prefix}n_hit": covered, f"{prefix}n_items": F.size(found).cast("long")})
    return df.withColumn(f"{prefix}contaminated", (hit > 0) & (100 * hit >= percent * words)).drop(starts, ends)
