"""Document fingerprints by winnowing.

Every k-gram of code points is hashed with a rolling (prefix-sum) polynomial. In
each window of w consecutive hashes the least is chosen, the rightmost of equal
ones, and kept with its position. So any passage of w + k - 1 code points that
two texts share has a chosen hash in both, and nothing shorter than k ever
matches.

The query compares each document with its successor in the order of doc_id.
Ranges of ids are dealt to tasks, and the first document of a range is also
dealt to the range before it, so one shuffle brings neighbours together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import append_columns, map_batches, slices, texts, worker_state
from quernstone.llm.fastbytes import mixed, powers

#: Short, so that a text of a line or two still has several hashes: whatever is
#: left of one of 19 code points when its last quarter is replaced shares one.
GRAM = 8
WINDOW = 8
#: Grams that are hashed at a time; positions in them fit into 24 bits.
BLOCK = 1 << 20
#: Ranges of ids at most, which bounds what the plan holds of their ends; beyond
#: that they get longer. A task goes through its range a slice at a time.
MOST_RANGES = 100_000
MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(MULTIPLIER, n), powers(pow(MULTIPLIER, -1, 1 << 64), n)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """The 40-bit hash of each gram; a text shorter than that, but not empty, is one."""
    if not len(points):
        return np.empty(0, np.uint64)
    size = min(gram, len(points))
    up, down = (x[: len(points)] for x in _powers(1 << (len(points) - 1).bit_length()))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    n = len(points) - size + 1
    return mixed((total[size:] - total[:n]) * down[:n] + np.uint64(size)) >> np.uint64(24)


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that are chosen, by position. Fewer grams than a
    window, but not none, are one window."""
    chosen, n = [], max(len(points) - gram + 1, min(len(points), 1))
    for at in range(0, max(n - window + 1, min(n, 1)), BLOCK):
        last = min(at + BLOCK + window - 1, n)
        hashes = gram_hashes(points[at : last + gram - 1], gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        keys, width = (hashes << np.uint64(24)) | (np.uint64((1 << 24) - 1) - place), 1
        least = keys
        while width < min(window, len(hashes)):  # doubling, then one overlapping step
            step = min(width, min(window, len(hashes)) - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        keep = np.ones(len(least), bool)
        keep[1:] = least[1:] != least[:-1]
        key = least[keep]
        chosen.append((at + ((1 << 24) - 1 - (key & np.uint64((1 << 24) - 1)).astype(np.int64)), key >> np.uint64(24)))
    if not chosen:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    position, value = (np.concatenate(x) for x in zip(*chosen))
    if len(chosen) > 1:
        keep = np.concatenate(([True], position[1:] != position[:-1]))
        position, value = position[keep], value[keep]
    return position, value


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def as_string(values: np.ndarray) -> str:
    """The chosen hashes in order, as hexadecimal digits of their lower 32 bits."""
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes as a fraction of all; two empty fingerprints are equal."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with chosen_positions and chosen_hashes. A null or empty text has none.
    A column of docs whose name is that of a new column is replaced."""
    from pyspark.sql import types as T

    kind = T.ArrayType(T.LongType(), False)

    def make():
        def step(batch):
            found = [winnow(points_of(x), gram, window) for x in texts(batch)]
            return [[p.tolist() for p, _ in found], [h.astype(np.int64).tolist() for _, h in found]]

        return step

    return append_columns(docs, [T.StructField("chosen_positions", kind), T.StructField("chosen_hashes", kind)], make)


def edited(text: str, after: str) -> str:
    """text with its last quarter replaced by as much of the start of after."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranges(docs: DataFrame, rows_per_range: int) -> list[int]:
    """Least ids of the ranges that documents are dealt by, from a scan of ids."""
    row = docs.agg(F.count("*"), F.min("doc_id")).first()
    n = min(-(-row[0] // rows_per_range), MOST_RANGES)
    if n < 2 or row[1] is None:
        return []
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))})
    heads = docs.where("doc_id IS NOT NULL").groupBy(place_among(cuts, F.col("doc_id")).alias("part")).agg(F.min("doc_id").alias("head")).collect()
    return sorted(r["head"] for r in heads)


def _longs(values: Iterable[int]) -> Column:
    """A constant array, from one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def place_among(ends: list[int], value: Column) -> Column:
    """How many of the sorted ends are at most value: first by steps, then inside one."""
    step = max(1, math.isqrt(len(ends)))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    if not groups:
        return F.lit(0)
    group = F.size(F.filter(_longs(g[0] for g in groups), lambda x: x <= value))
    inside = F.get(F.array(*[_longs(g) for g in groups]), group - 1)
    return F.when(group > 0, (group - 1) * step + F.size(F.filter(inside, lambda x: x <= value))).otherwise(0)


def compare_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, rows_per_range: int = 4000) -> DataFrame:
    """The fingerprint of each document (doc_id, text), that of its edited text and
    their likeness, and its likeness to the next document.

    The next document is the one after it by doc_id, then by text; after the last
    comes the first. A null text is empty, a null id comes first. Repeated rows
    follow each other. A table without rows gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    heads = ranges(docs.select("doc_id"), rows_per_range)
    least = docs.agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63))))).first()[0]
    n = max(1, len(heads))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(place_among(heads[1:], F.col("doc_id")))
    starts = _longs(heads[1:]) if len(heads) > 1 else F.array().cast("array<bigint>")
    # a head goes to the range before its own too, and the first of all to the last
    also = F.when(F.coalesce("doc_id", F.lit(-(1 << 63))) == least, F.lit(n - 1)).when((F.col("part") > 0) & (F.get(starts, F.col("part") - 1) == F.col("doc_id")), F.col("part") - 1)
    dealt = docs.withColumn("part", part).withColumn("copy", F.explode(F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.when(also.isNotNull(), F.struct(also.alias("part"), F.lit(True).alias("extra")))))))
    dealt = dealt.select(F.col("copy.part").alias("part"), F.col("copy.extra").alias("extra"), "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches):
        worker_state(None)
        part, last, extra_done, held = None, None, True, []

        def row(doc, text, mark, after, after_mark):
            changed = edited(text, after)
            other = winnow(points_of(changed), gram, window)[1] if changed != text else mark
            return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_string(mark), as_string(other), likeness(mark, other), likeness(mark, after_mark))

        def out():
            columns = list(zip(*held)) or [()] * 7
            held.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[f.split()[0] for f in RESULT.split(", ")])

        for batch in slices(batches):
            for p, extra, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = text or ""
                if p != part:
                    part, last, extra_done = p, None, False
                if extra and extra_done:
                    continue
                mark = winnow(points_of(text), gram, window)[1]
                if last is not None:
                    held.append(row(*last, text, mark))
                last, extra_done = (doc, text, mark), extra_done or extra
                if len(held) >= 500:
                    yield out()
        yield out()

    return map_batches(dealt, run, RESULT)
