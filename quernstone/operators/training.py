"""What training reads: examples behind their guards, the schedule of batches,
collated rows, what a queue may not be a negative for, and losses.

Losses are sums over a table of logits, which a model makes elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.picks import seeded_order, uniform
from quernstone.operators.sampling import IGNORED, epoch_seed, ordinal_within, padded
from quernstone.operators.vocab import CLS, IDENTITY


class GuardError(ValueError):
    """Training data that may not be read as asked."""


def load_examples(rows: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Eligible rows of one split with tokens and content, in the order of their ids;
    refuses a split that was never recorded."""
    chosen = splits.where(F.col("split") == split).select("package")
    if chosen.isEmpty():
        raise GuardError(f"no package is in the split {split}; assign splits first")
    return rows.join(chosen.distinct(), "package", "left_semi").select("function_id", *IDENTITY, "opt_level", "tokens", "content").orderBy("function_id")


def train_functions(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(identity, tokens) of the train split alone, for a vocabulary."""
    return load_examples(rows, splits, "train").select(*IDENTITY, "tokens")


def check_vocabulary(source: dict, fingerprint: str) -> None:
    """Refuses a vocabulary that was made of other rows or splits than these."""
    if source.get("fingerprint") != fingerprint:
        raise GuardError(f"the vocabulary is of {source.get('fingerprint')}, the dataset is {fingerprint}; build it anew")


def _turns(counts: list[tuple[str, int]], batch: int, per_package: int, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For each batch, the packages that it visits, how many each gives, and names."""
    import hashlib

    left = dict(counts)
    remaining, number = sum(left.values()), 0
    while remaining >= batch:
        live = sorted((p for p, n in left.items() if n), key=lambda p: (hashlib.md5(f"{salt}:{number}:{p}".encode()).hexdigest(), p))
        names, takes, need = [], [], batch
        while need:
            for p in live:
                take = min(per_package, need, left[p])
                if take:
                    names.append(p)
                    takes.append(take)
                    left[p] -= take
                    need -= take
                if not need:
                    break
        remaining -= batch
        yield np.full(batch, number, np.int64), np.array(takes), names
        number += 1


def schedule(identities: DataFrame, batch: int = 64, per_package: int | None = None, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(batch, slot, identity): which identities share a batch. For each batch the
    packages that have some left, in an order drawn anew, give up to per_package
    each, over and over until it is full; an incomplete batch is left out.

    Only how many identities each package has matters to the turns, so one task
    makes the places from those counts, a batch at a time, and they meet the
    identities, numbered in hash order within their package, in a shuffle.
    """
    salt, quota = epoch_seed(seed, epoch), per_package or max(1, batch // 8)
    each = identities.select(*IDENTITY).distinct()
    numbered = ordinal_within(each, ["package"], [seeded_order(salt, *IDENTITY), *map(F.col, IDENTITY)], "number")
    counts = each.groupBy("package").agg(F.count("*").alias("n")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((p, n) for b in batches for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        given = dict.fromkeys((p for p, _ in rows), 0)
        for numbers, takes, names in _turns(rows, batch, quota, salt):
            first = []
            for p, n in zip(names, takes.tolist()):
                first.append(given[p])
                given[p] += n
            inside = np.arange(batch) - np.repeat(np.cumsum(takes) - takes, takes)
            who = np.repeat(np.arange(len(names)), takes)
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(who)), pa.array(np.array(first)[who] + inside), pa.array(numbers.astype(np.int32)), pa.array(np.arange(batch, dtype=np.int32))], names=["package", "number", "batch", "slot"])

    places = counts.mapInArrow(run, "package string, number long, batch int, slot int")
    return places.join(numbered, ["package", "number"]).select("batch", "slot", *IDENTITY)


#: Fixed: the levels that retrieval is measured between.
EVAL_LEVELS = ("O0", "O3")


def drawn_pairs(rows: DataFrame, seed: int = 0, epoch: int = 0, eval_pair_share: float | None = None) -> DataFrame:
    """(identity, query_id, key_id, query_level, key_level): of each identity with two
    levels or more, two of them and a row of each, drawn by hash. With a share, so
    many of those that have both levels of evaluation give these."""
    salt = str(epoch_seed(seed, epoch))
    h = lambda *x: F.md5(F.concat_ws(":", F.lit(salt), *x))
    views = rows.groupBy(*IDENTITY, "opt_level").agg(F.min(F.struct(h(F.lit("row"), F.col("function_id").cast("string")).alias("h"), "function_id", "content")).alias("r"))
    order = F.struct(h(F.lit("level"), *map(F.col, IDENTITY), F.col("opt_level")).alias("h"), F.col("opt_level").alias("level"), F.col("r.function_id").alias("id"), F.col("r.content").alias("content"))
    levels = views.groupBy(*IDENTITY).agg(F.array_sort(F.collect_list(order)).alias("l")).where(F.size("l") >= 2)
    both = F.filter("l", lambda x: x["level"].isin(*EVAL_LEVELS))
    if eval_pair_share is not None:
        chosen = (F.size(both) == len(EVAL_LEVELS)) & (uniform(F.lit("share"), F.lit(salt), *map(F.col, IDENTITY)) < eval_pair_share)
        levels = levels.withColumn("l", F.when(chosen, both).otherwise(F.col("l")))
    q, k = F.col("l")[0], F.col("l")[1]
    return levels.select(*IDENTITY, q["id"].alias("query_id"), k["id"].alias("key_id"), q["level"].alias("query_level"), k["level"].alias("key_level"), q["content"].alias("query_content"), k["content"].alias("key_content"))


def pair_batches(rows: DataFrame, batch: int = 64, per_package: int | None = None, seed: int = 0, epoch: int = 0, eval_pair_share: float | None = None) -> DataFrame:
    """(batch, slot, identity, query_id, key_id, …): the schedule of the identities
    that two levels or more have, with the two rows that each of them draws."""
    drawn = drawn_pairs(rows, seed, epoch, eval_pair_share)
    return schedule(drawn.select(*IDENTITY), batch, per_package, seed, epoch).join(drawn, IDENTITY)


def drawn_identical_share(pairs: DataFrame) -> DataFrame:
    """One row: pairs drawn, and the share of them with equal content."""
    return pairs.agg(F.count("*").alias("pairs"), F.avg((F.col("query_content") == F.col("key_content")).cast("int")).alias("identical"))


def window_of(ids: Column, body: int, *draw: Column | str) -> Column:
    """ids, or body of them from a place that is drawn, and the start token before."""
    spare = F.size(ids) - body
    first = F.when(spare > 0, F.floor(uniform(F.lit("window"), *draw) * (spare + 1)).cast("int")).otherwise(0)
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, first + 1, F.lit(body)))


def collated(rows: DataFrame, ids: str, labels: str | None = None, by: str = "batch") -> DataFrame:
    """rows with ids filled up to the longest of their batch, attention, the mask of
    what is no filling, and labels filled with what is ignored."""
    longest = rows.groupBy(by).agg(F.max(F.size(ids)).alias("_longest"))
    wide = rows.join(longest, by)
    filled, mask = padded(F.col(ids), F.col("_longest"))
    out = wide.withColumns({ids: filled, "attention": mask})
    if labels:
        out = out.withColumn(labels, padded(F.col(labels), F.col("_longest"), IGNORED)[0])
    return out.drop("_longest")


def queue_excluded(batch: DataFrame, queue: DataFrame, size: int) -> DataFrame:
    """(slot, place) that a queue may not be a negative at: those that are empty, have
    the same identity, or the content of the query or of its key.

    batch: slot, identity, query_content, key_content. queue: place, identity,
    content, at most size rows; each way to be excluded is a join of its own.
    """
    empty = batch.sparkSession.range(size).select(F.col("id").cast("int").alias("place")).join(queue.select("place"), "place", "left_anti")
    own = batch.select("slot", F.explode(F.array_distinct(F.array("query_content", "key_content"))).alias("content"))
    by_content = own.join(queue.select("place", "content"), "content").select("slot", "place")
    by_identity = batch.select("slot", "identity").join(queue.select("place", "identity"), "identity").select("slot", "place")
    slots = batch.select("slot").distinct()
    return by_content.unionByName(by_identity).unionByName(slots.join(F.broadcast(empty))).distinct()  # size is a setting


def info_nce(logits: DataFrame, temperature: float) -> DataFrame:
    """(batch, loss): the mean over slots of the cross-entropy of the own key.

    logits: batch, slot, key, logit, target (the own key), removed (may not count).
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    kept = logits.where(~F.col("removed") | F.col("target")).withColumn("x", F.col("logit") / temperature)
    most = kept.groupBy("batch", "slot").agg(F.max("x").alias("most"))
    sums = kept.join(most, ["batch", "slot"]).groupBy("batch", "slot", "most").agg(F.sum(F.exp(F.col("x") - F.col("most"))).alias("z"), F.max(F.when(F.col("target"), F.col("x"))).alias("own"))
    return sums.groupBy("batch").agg(F.avg(F.log("z") + F.col("most") - F.col("own")).alias("loss"))


def mlm_loss(logits: DataFrame) -> DataFrame:
    """One row: the mean cross-entropy over positions with a label, and how many.
    logits: logit (an array over the vocabulary), label."""
    most = F.array_max("logit")
    z = F.aggregate("logit", F.lit(0.0), lambda s, x: s + F.exp(x - most))
    return logits.where(F.col("label") != IGNORED).agg(F.avg(F.log(z) + most - F.get("logit", F.col("label"))).alias("loss"), F.count("*").alias("positions"))


def pooled(vectors: Column, attention: Column, first: bool = False) -> Column:
    """The mean of the vectors that attention counts, or the first, at unit length."""
    n = F.aggregate(attention, F.lit(0), lambda s, x: s + x)
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(F.arrays_zip(vectors.alias("v"), attention.alias("a")), zero, lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q * x["a"]))
    mean = vectors[0] if first else F.transform(total, lambda x: x / F.greatest(n, F.lit(1)))
    return unit(mean)


def unit(vector: Column) -> Column:
    """A vector at length 1; one of no length stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x))
