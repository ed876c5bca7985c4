"""Similarity join of word-shingle sets by PartEnum signatures.

Sets of Jaccard similarity 0.8 or more have sizes within a ratio of 5 : 4 and
differ in at most a ninth of the sum of their sizes. Sizes are cut into bands of
that ratio; a set signs for its own band and for the next one, so two similar
sets always meet in the band of the larger. In a band whose sets may differ in
k elements, the domain of shingle hashes is cut into n1 first-level partitions,
each into n2 second-level ones; some first-level partition then holds at most k2
of the differences, so that some n2 - k2 of its second-level partitions are the
same in both sets. Each such subset is hashed to one signature.

Subsets that are empty would be shared by everybody. A set skips them if it has
so few that the argument above still leaves it a subset that is not empty; the
rare others sign them too, and two of these meet by the plain argument. So no
link is lost.

Sets with equal signatures are compared with one leader of each signature
first; the links found form components, and only pairs between components are
compared thereafter, each in one of the signatures that it shares. A histogram of
each set and the parities of a finer one bound its difference from another from
below and rule most of those pairs out before texts are fetched. Every link is
decided on the whole sets.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import append_columns, discard, map_batches, only, raw_texts, slices, stored, worker_state
from quernstone.llm.fastbytes import PowerTable, mixed, shingle_hashes
from quernstone.llm.graph import components

SHINGLE = 5
#: Similarity as a fraction: NUMERATOR / DENOMINATOR of the union is shared.
NUMERATOR, DENOMINATOR = 4, 5
#: Places of the histogram of a set's hashes, and bytes of the parities of a finer one.
HISTOGRAM, PARITIES = 128, 128
SKETCH = HISTOGRAM + PARITIES
#: Signatures that a bucket has at most, on average; buckets follow the input.
BUCKET_SIGNATURES = 1_000_000
#: Signatures after which a task hands its buckets on.
CHUNK_SIGNATURES = 500_000
#: Pairs that a task holds with their sketches at a time.
PAIRS = 1 << 14
#: Least signatures of a set by which others know that they have met it before.
LEAST = 8


class Band(NamedTuple):
    index: int
    least: int
    most: int
    k: int
    n1: int
    n2: int
    k2: int
    spare: int  # first-level partitions beyond those that k differences can spoil


@lru_cache(None)
def band(index: int) -> Band:
    least = 1 if index == 0 else band(index - 1).most + 1
    most = least * DENOMINATOR // NUMERATOR
    k = 2 * most * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    if k == 0:
        return Band(index, least, most, 0, 1, 1, 0, 1)
    k2, n2 = (1, 3) if k == 1 or k > 8 else (2, 5)
    spoiled = k // (k2 + 1)
    n1 = spoiled + 1
    if k > 8:  # room for partitions with an empty subset, and some more for luck
        for _ in range(2):
            empty = math.exp(-least * NUMERATOR / DENOMINATOR / (n1 * n2))
            bad = n1 * (3 * empty**2 - 2 * empty**3)
            n1 = spoiled + 1 + math.ceil(bad + math.sqrt(bad))
    return Band(index, least, most, k, n1, n2, k2, n1 - spoiled)


@lru_cache(4096)
def _labels(b: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each partition and subset, one for each second-level place, and
    the places that each subset leaves out."""
    left_out = np.array(list(itertools.combinations(range(b.n2), b.k2)), np.intp).reshape(math.comb(b.n2, b.k2), b.k2)
    names = np.arange(b.n1 * len(left_out), dtype=np.uint64).reshape(b.n1, -1) + np.uint64(b.index << 40)
    return mixed(names), mixed(np.arange(1, b.n2 + 1, dtype=np.uint64)) | np.uint64(1), left_out


def band_of(size: int) -> Band:
    return next(b for b in map(band, itertools.count()) if b.most >= size)


def signatures(hashes: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of a set of sorted distinct 64-bit hashes."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    own = _band_at(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return np.concatenate([_band_signatures(hashes, total, b) for b in (band(own), band(own + 1))])


@lru_cache(65536)
def _band_at(size: int) -> int:
    return band_of(size).index


def _band_signatures(hashes: np.ndarray, total: np.ndarray, b: Band) -> np.ndarray:
    cells = b.n1 * b.n2
    place = ((hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.intp)
    count = np.bincount(place, minlength=cells)
    ends = np.concatenate(([0], np.cumsum(count)))
    names, weights, left_out = _labels(b)
    sums = (total[ends[1:]] - total[ends[:-1]]).reshape(b.n1, b.n2) * weights
    count = count.reshape(b.n1, b.n2)
    subset, members = names + sums.sum(1)[:, None], count.sum(1)[:, None] + np.zeros_like(names, np.intp)
    for cell in left_out.T:
        subset -= sums[:, cell]
        members -= count[:, cell]
    some = members > 0
    subset = mixed(subset)
    rich = b.n1 - int(some.all(1).sum()) < b.spare
    return subset[some] if rich else subset.ravel()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes are similar enough, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or DENOMINATOR * len(a) < NUMERATOR * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


SETS = [T.StructField("n_shingles", T.LongType()), T.StructField("set_high", T.LongType()), T.StructField("set_low", T.LongType())]


def sketch_of(hashes: np.ndarray) -> bytes:
    """The histogram of a set, by upper bits, and the parities of another, by lower ones."""
    coarse = np.minimum(np.bincount((hashes >> np.uint64(57)).astype(np.intp), minlength=HISTOGRAM), 255).astype(np.uint8)
    fine = np.bincount((hashes & np.uint64(8 * PARITIES - 1)).astype(np.intp), minlength=8 * PARITIES)
    return coarse.tobytes() + np.packbits((fine & 1).astype(bool)).tobytes()


def shingle_sets(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs without text: the size of each set and its 128-bit hash."""

    def make():
        import xxhash

        table = PowerTable()

        def step(batch):
            out: list[list] = [[], [], []]
            for raw in raw_texts(batch):
                h = shingle_hashes(raw, words, table)
                digest = xxhash.xxh3_128_intdigest(h.tobytes())
                for x, y in zip(out, (len(h), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63))):
                    x.append(y)
            return out

        return step

    return append_columns(docs, SETS, make, ("text",))


def sketches(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs without text: the size of each set and its sketch."""

    def make():
        table = PowerTable()

        def step(batch):
            hashes = [shingle_hashes(raw, words, table) for raw in raw_texts(batch)]
            return [[len(h) for h in hashes], [sketch_of(h) for h in hashes]]

        return step

    return append_columns(docs, [T.StructField("n_shingles", T.LongType()), T.StructField("sketch", T.BinaryType())], make, ("text",))


BLOBS = "bucket int, ids binary, counts binary, signatures binary"


def signature_buckets(docs: DataFrame, buckets: int, words: int = SHINGLE) -> DataFrame:
    """Signatures of (doc_id, text), by bucket: of many documents at once, how many
    each has there and the lower halves of them, in the order of the documents."""

    def run(batches):
        table = PowerTable()
        ids: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def flush():
            every = np.concatenate(held)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(x) for x in held])
            bucket = ((every >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            bucket, owner, lower = bucket[order], owner[order], every[order].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [[], [], [], []]
            at = np.concatenate(([0], cuts, [len(bucket)]))
            own = np.array(ids, np.int64)
            for a, b in zip(at[:-1], at[1:]):
                members, counts = np.unique(owner[a:b], return_counts=True)
                for x, y in zip(rows, (int(bucket[a]), own[members].tobytes(), counts.astype(np.uint32).tobytes(), lower[a:b].tobytes())):
                    x.append(y)
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "ids", "counts", "signatures"])

        worker_state(None)
        for batch in slices(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch)):
                if len(signs := signatures(shingle_hashes(raw, words, table))):
                    ids.append(doc)
                    held.append(signs)
                    n += len(signs)
                    if n >= CHUNK_SIGNATURES:
                        yield flush()
                        n = 0
        if held:
            yield flush()

    return map_batches(docs.select("doc_id", "text"), run, BLOBS)


def shared_signatures(blobs: DataFrame) -> DataFrame:
    """(signature, doc_id) of the signatures that two documents or more have.

    Each bucket is gone through in pieces; of a signature that has been seen, one
    document is remembered, so that a hot signature takes no more memory than any.
    """

    def run(batches):
        bucket, ids, signs = None, [], []
        seen = (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool))

        def merge():
            """Sorts what is held into seen; returns the rows of shared signatures."""
            nonlocal seen
            every = np.concatenate([seen[0], *signs])
            owner = np.concatenate([seen[1], *ids])
            told = np.concatenate([seen[2], np.zeros(len(every) - len(seen[2]), bool)])
            order = np.argsort(every, kind="stable")
            every, owner, told = every[order], owner[order], told[order]
            first = np.concatenate(([True], every[1:] != every[:-1]))
            run_of = np.cumsum(first) - 1
            size = np.bincount(run_of)
            out = (size[run_of] > 1) & ~told
            seen = (every[first], owner[first], told[first] | (size > 1))
            ids.clear()
            signs.clear()
            names = (np.int64(bucket) << np.int64(32)) | every[out].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(owner[out])], names=["signature", "doc_id"])

        held = 0
        worker_state(None)
        for batch in slices(batches):
            for b, own, counts, lower in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if signs:
                        yield merge()
                    bucket, held = b, 0
                    seen = (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool))
                ids.append(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(counts, np.uint32)))
                signs.append(np.frombuffer(lower, np.uint32))
                held += len(signs[-1])
                if held >= BUCKET_SIGNATURES:
                    yield merge()
                    held = 0
        if signs:
            yield merge()

    return map_batches(blobs.repartition("bucket").sortWithinPartitions("bucket"), run, "signature long, doc_id long")


def sketch_allows(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches leave room for a link. Broadcasts."""
    sizes = DENOMINATOR * np.minimum(n_a, n_b) >= NUMERATOR * np.maximum(n_a, n_b)
    most = (DENOMINATOR - NUMERATOR) * (n_a + n_b) // (DENOMINATOR + NUMERATOR)
    # parities differ only where an odd number of elements is in one set alone
    odd = np.bitwise_count(a[..., HISTOGRAM:] ^ b[..., HISTOGRAM:]).sum(-1, dtype=np.int64)
    apart = np.abs(a[..., :HISTOGRAM].astype(np.int16) - b[..., :HISTOGRAM].astype(np.int16)).sum(-1, dtype=np.int64)
    return sizes & (np.maximum(odd, apart) <= most)


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sizes and histograms leave room for."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches):
        worker_state(None)
        for batch in slices(batches):
            if batch.num_rows:
                n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(sketch_allows(n_a, a, n_b, b)))

    return map_batches(both, run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) that link, decided on the whole texts."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    found = only(docs.select("doc_id", "text"), ids)
    side = lambda x: found.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        worker_state(None)
        table, last, left = PowerTable(), None, None
        for batch in slices(batches):
            keep = []
            for a, raw_a, raw_b in zip(batch.column(0).to_pylist(), raw_texts(batch, "text_a"), raw_texts(batch, "text_b")):
                if a != last:
                    last, left = a, shingle_hashes(raw_a, words, table)
                keep.append(linked(left, shingle_hashes(raw_b, words, table)))
            if any(keep):
                yield batch.select([0, 1]).filter(pa.array(keep))

    return map_batches(both, run, "a long, b long")


def distinct_groups(groups: DataFrame) -> DataFrame:
    """groups without those whose members are the members of another."""
    member = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"members_{i}") for i in range(2)]
    shape = groups.groupBy("signature").agg(F.count("*").alias("n"), *member).where("n > 1")
    first = shape.groupBy("n", "members_0", "members_1").agg(F.min("signature").alias("signature"))
    return groups.join(first.select("signature"), "signature", "left_semi")


def star_pairs(groups: DataFrame, latest: bool) -> DataFrame:
    """Each member of a signature's group with the first (or last) one."""
    lead = groups.groupBy("signature").agg((F.max if latest else F.min)("doc_id").alias("a"))
    return groups.join(lead, "signature").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def block_pairs(groups: DataFrame, sets: DataFrame, block: int = 2000) -> DataFrame:
    """Pairs between components in the same group that sketches leave room for.

    groups: (signature, doc_id, component). Groups are cut into blocks; a task
    holds two blocks at a time, and only pairs that may link leave it. Alike sets
    share many signatures: a pair stays in a group if both sets have a lesser
    signature in common among their LEAST least ones, so nearly all leave once,
    from the least that they share.
    """
    least = groups.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("signature")), 1, LEAST).alias("least"))
    rows = groups.join(sets.select("doc_id", "n_shingles", "sketch").join(least, "doc_id"), "doc_id")
    sizes = groups.groupBy("signature").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, "signature").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "part").alias("low"), F.greatest(i, "part").alias("high")))
    rows = rows.withColumn("pair", F.explode(others)).select("signature", "pair.low", "pair.high", "part", "doc_id", "component", "n_shingles", "sketch", "least")

    def run(key, frame):
        signature, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
        part, doc, component, n = (frame.column(x).to_numpy() for x in ("part", "doc_id", "component", "n_shingles"))
        sketch = np.frombuffer(b"".join(frame.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        lesser = np.full((len(doc), LEAST), -1, np.int64)  # of its least signatures, those before this one
        for row, x in zip(lesser, frame.column("least").to_pylist()):
            x = [y for y in x if y < signature]
            row[: len(x)] = x
        other = np.where(lesser < 0, -2, lesser)  # what is not there is never in common
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        found, step = [], max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step, None]
            open_ = component[rows] != component[right]
            if low == high:
                open_ &= doc[rows] < doc[right]
            i, j = np.nonzero(open_)
            i, j = rows[i, 0], right[j]
            new = ~(lesser[i][:, :, None] == other[j][:, None, :]).any((1, 2))
            i, j = i[new], j[new]
            maybe = sketch_allows(n[i], sketch[i], n[j], sketch[j])
            i, j = doc[i[maybe]], doc[j[maybe]]
            found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
        a, b = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("signature", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    component_id is the least doc_id that links reach. Words are runs of what is
    no white space, A-Z lower-cased. A null or empty text, or one without words,
    has an empty set, links with nothing and is its own component. A row without
    an id has no component and links with nothing. Rows of one id are one
    document if their texts are equal; a table without rows gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = stored(shingle_sets(docs, words), "shingle-sets")
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    alike = full.groupBy("n_shingles", "set_high", "set_low").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(alike, "shingle-classes")
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(total / BUCKET_SIGNATURES))
    firsts = only(docs, classes.select("doc_id"))
    shared = stored(shared_signatures(signature_buckets(firsts, buckets, words)).distinct(), "shared-signatures")
    groups = stored(distinct_groups(shared), "signature-groups")
    discard(shared)
    sketched = stored(sketches(only(docs, groups.select("doc_id").distinct()), words).dropDuplicates(["doc_id"]), "sketches")

    links, found, open_groups = None, None, groups
    for step in ("first", "last", "all"):
        if step == "all":
            candidates = block_pairs(open_groups, sketched)
        else:
            candidates = possible(star_pairs(open_groups, step == "last"), sketched)
        candidates = stored(candidates, "candidates")
        if not candidates.isEmpty():
            new = stored(verified(candidates, firsts, words).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
            links = new if links is None else links.unionByName(new)
            old, found = found, components(links)
            discard(old)
        discard(candidates)
        if step != "all":
            known = groups.withColumn("component", F.col("doc_id"))
            if found is not None:
                known = groups.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            # stars from one end have compared all of a group of two, from both ends of three
            shape = known.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
            split = shape.where(F.expr("low <> high") & (F.col("n") > (2 if step == "first" else 3))).select("signature")
            old, open_groups = open_groups, stored(known.join(split, "signature", "left_semi"), "open-groups")
            if old is not groups:
                discard(old)
            if open_groups.isEmpty():
                break
    discard(sketched)
    discard(groups)
    if open_groups is not groups:
        discard(open_groups)

    named = classes.select("n_shingles", "set_high", "set_low", F.col("doc_id").alias("first_id"))
    if found is not None:
        named = named.join(found.withColumnRenamed("node", "first_id"), "first_id", "left")
        named = named.withColumn("first_id", F.coalesce("component", "first_id")).drop("component")
    out = sets.join(named, ["n_shingles", "set_high", "set_low"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("first_id")).otherwise(F.col("doc_id"))).alias("component_id"))
