"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.sources.shared import discard, shared_folder, stored  # noqa: F401 - the operators take them from here

#: A side of a join is broadcast only after its rows have been counted, up to this.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts that a Python worker handles at a time, but for a single longer one.
SLICE_BYTES = 4 << 20


def worker_state(owner: str | None, key: tuple = (), make: Callable | None = None):
    """What make() built in this Python worker for a task of the same key before, or
    now. One owner's state is kept at a time, so idle workers hold little; with no
    owner there is none."""
    held = sys.__dict__.setdefault("_quernstone_state", {})
    for x in [x for x in held if x != (owner, key)]:
        del held[x]
    give_back()
    if owner is not None:
        if (owner, key) not in held:
            held[owner, key] = make()
        return held[owner, key]


def give_back() -> None:
    """Returns what earlier tasks of this worker have freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces whose strings and binaries come to about limit
    bytes, and to more only where one row does."""
    held, waiting = [], 0
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + limit - waiting, "right"))
            if stop > at or not held:
                stop = max(at + 1, stop)
                held.append(batch.slice(at, stop - at))
                waiting += int(ends[stop - 1] - before)
                at = stop
            if at < batch.num_rows:
                yield _joined(held)
                held, waiting = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Bytes of an Arrow batch between the JVM and Python, of which the JVM, the worker and
#: the pipe hold one each; Spark's default of 64 MB is much for two tasks an executor.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES, unless the session has a size of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "67108864", "64MB"):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    drop: tuple[str, ...] = (),
    stateful: bool = False,
) -> DataFrame:
    """Columns computed in Python, batch by batch, beside the columns of df.

    make() runs once a task and returns the function that turns a record batch
    into one list (or Arrow array) for each of fields. Columns named in drop
    are read but not returned. A new field replaces a column of its name,
    whatever the case of its letters. stateful: make asks for worker_state.
    """
    new = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema) if f.name not in drop and f.name.lower() not in new]
    schema = T.StructType([df.schema[i] for i in kept] + list(fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not stateful:
            worker_state(None)
        out, step = to_arrow_schema(schema), make()
        for batch in slices(batches):
            columns = [batch.column(i) for i in kept]
            for x in step(batch):
                columns.append(x if isinstance(x, pa.Array) else pa.array(x, out.field(len(columns)).type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out)], schema=out)

    return map_batches(df, run, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


class Memory:
    """A value for each of the keys that came last: between most and twice as many.
    What was asked for in this generation or the one before is known."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def known(self, keys: Iterable, learn: Callable[[list], Iterable]) -> list:
        """Values of distinct keys; learn gives those of unknown ones, in their order."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        out = [young.get(k) for k in keys]
        for i, x in enumerate(out):
            if x is None:
                if (x := old.get(keys[i])) is None:
                    new.append(i)
                else:
                    out[i] = young[keys[i]] = x
        for i, x in zip(new, learn([keys[i] for i in new])):
            out[i] = x
            if len(keys[i]) <= 1000:  # longer ones aren't worth remembering
                young[keys[i]] = x
        return out


def only(docs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of docs whose doc_id is among the distinct ids, or with keep=False
    is not. ids are broadcast if there are few enough, by a count."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi" if keep else "left_anti").select(*docs.columns)


def own_prefix(df: DataFrame) -> str:
    """A prefix with which no column of df begins, whatever the case."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def least_hashed(rows: DataFrame, total: int, n: int, *ties: str) -> DataFrame:
    """The n rows with the least xxhash64 of doc_id, then by ties, of about total.

    Only rows below a threshold that twice as many should pass are sorted, so what
    tasks send to be merged is bounded by n and not by their number.
    """
    h = F.xxhash64("doc_id")
    if total > 4 * n:
        rows = rows.where(h < -(1 << 63) + int((1 << 64) * (2 * n / total)))
    return rows.orderBy(h, *ties).limit(n)
