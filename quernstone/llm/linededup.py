"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys (a 128-bit hash), cut into buckets by key and sorted
by it in each, with how many documents of a batch hold the key and the largest id
among them. A new batch is merge-anti-joined with the runs, bucket by bucket and
without a shuffle of theirs: keys that no run has become a run of level 0, so a key
is in one run only; for keys that were there before, what the batch adds to them is
kept apart. When a level has ``fan_in`` runs they are merged into one run of the
next, so a key is rewritten as often as there are levels. Runs lie in the shared
folder; only their paths and levels are on the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import BROADCAST_ROWS, append_columns, map_batches, own_prefix, raw_texts, shared_folder, slices, stored, worker_state

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
KEY = ["key_high", "key_low"]
#: Keys of a bucket of a run, on average; buckets follow the input.
BUCKET_KEYS = 1_000_000
KEYS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key_high", T.LongType()), T.StructField("key_low", T.LongType())])


def key_of(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The hash of a line's key, or None if the key is too short to count."""
    import xxhash

    key = line.strip(SPACE).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each document and each of its distinct keys that count."""

    def run(batches):
        worker_state(None)
        for batch in slices(batches):
            ids, high, low = [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch)):
                for a, b in {k for line in raw.split(b"\n") if (k := key_of(line, min_chars))}:
                    ids.append(doc)
                    high.append(a)
                    low.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, high, low)], names=KEYS.names)

    return map_batches(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), run, KEYS)


class LineRuns:
    """The levelled runs. All that is kept on the driver is levels."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int = 16):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets
        self.levels: list[list[DataFrame]] = []
        self.later: list[DataFrame] = []  # what batches add to keys of earlier ones

    def _written(self, df: DataFrame, name: str, dealt: bool) -> DataFrame:
        """df as a bucketed and sorted table. dealt: its partitions are buckets already."""
        table = f"{name}_{uuid.uuid4().hex}"
        df = df if dealt else df.repartition(self.buckets, *KEY)
        writer = df.sortWithinPartitions(*KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", shared_folder(self.spark, name)).option("compression", "zstd").saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name; files and the plan that reads them stay
        return out

    def all_runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, key) and returns its keys with counts and
        ``fresh``, that no batch before it had the key. A document belongs to one batch."""
        marked = keys.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        fresh = F.lit(True)
        for i, run in enumerate(self.all_runs()):
            marked = marked.join(run.select(*KEY, F.lit(True).alias(f"in_{i}")), KEY, "left")
            fresh = fresh & F.col(f"in_{i}").isNull()
        batch = self._written(marked.select(*KEY, "n_docs", "last_doc", fresh.alias("fresh")), "line_batch", False)
        if self.levels:
            self.later.append(batch.where("NOT fresh").drop("fresh"))
        self._push(0, batch.where("fresh").drop("fresh"))
        return batch

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = reduce(self._merged, self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """One run of two, which have no key in common: a merge of their buckets."""
        both = one.join(other.withColumnsRenamed({"n_docs": "n", "last_doc": "last"}), KEY, "full")
        return self._written(both.select(*KEY, F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("last_doc", "last").alias("last_doc")), "line_run", True)

    def totals(self) -> DataFrame:
        """Each key once, with its documents over all batches and the largest id."""
        runs = reduce(DataFrame.unionByName, self.all_runs())
        if not self.later:
            return runs
        more = reduce(DataFrame.unionByName, self.later).groupBy(*KEY).agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("last"))
        every = [run.join(more, KEY, "left") for run in self.all_runs()]
        n = F.col("n_docs") + F.coalesce("n", F.lit(0))
        return reduce(DataFrame.unionByName, every).select(*KEY, n.alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """(doc_id, drop): the keys that a document loses, as an array. Documents that
    lose none are absent. batches: how many take turns, by a hash of the id."""
    spark = docs.sparkSession
    keys = line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    keys = stored(keys, "line-keys", "batch")
    runs = LineRuns(spark, buckets=max(16, -(-keys.count() // BUCKET_KEYS)))
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch))
    often = stored(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "lines-often")
    few = often.count() <= BROADCAST_ROWS  # else a join by key, in which a hot one can be split
    lost = keys.join(F.broadcast(often) if few else often, KEY).where("doc_id <> last_doc")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drop"))


def drop_repeated_lines(
    docs: DataFrame, prefix: str = "", keep_text: bool = True, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4
) -> DataFrame:
    """docs without the lines whose key (stripped, A-Z lower-cased) has min_chars
    code points or more and is in min_docs documents or more, but for the
    document of the largest id that holds it.

    New columns, behind prefix: kept (the remaining lines, joined by \\n),
    n_lines, n_dropped and kept_sha256. keep_text=False leaves out text and kept.
    A null or empty text is one empty line. Rows of one id are one document: the
    lines of each count once and are dropped alike. Rows without an id keep all
    lines and count for none. Texts are read whole, however long; a table without
    rows gives none. A column of docs whose name is that of a new column,
    whatever the case of its letters, is replaced; all others stay.
    """
    own = own_prefix(docs)
    lost, by = f"{own}drop", f"{own}lost_by"
    drops = repeated_lines(docs, min_chars, min_docs, batches).withColumnsRenamed({"doc_id": by, "drop": lost})
    joined = docs.join(drops, docs["doc_id"] == drops[by], "left").drop(by)
    fields = [
        T.StructField(f"{prefix}kept", T.StringType()),
        T.StructField(f"{prefix}n_lines", T.LongType()),
        T.StructField(f"{prefix}n_dropped", T.LongType()),
        T.StructField(f"{prefix}kept_sha256", T.StringType()),
    ]
    if not keep_text:
        fields = fields[1:]

    def make():
        import hashlib

        def step(batch):
            kept, n_lines, n_dropped, digests = [], [], [], []
            for raw, drop in zip(raw_texts(batch), batch.column(batch.schema.get_field_index(lost)).to_pylist()):
                lines = left = raw.split(b"\n")
                if drop:
                    gone = {(x[KEY[0]], x[KEY[1]]) for x in drop}
                    left = [x for x in lines if key_of(x, min_chars) not in gone]
                text = raw if left is lines else b"\n".join(left)
                if keep_text:
                    kept.append(text.decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                digests.append(hashlib.sha256(text).hexdigest())
            return [kept, n_lines, n_dropped, digests] if keep_text else [n_lines, n_dropped, digests]

        return step

    return append_columns(joined, fields, make, (lost,) if keep_text else (lost, "text"))
