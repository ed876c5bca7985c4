"""Structured Streaming front end: events appended with a gap-free sequence."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quernstone.operators.store import append_events


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Only a
    local session may lack that setting, and gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/quernstone-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class EventAppender:
    """Appends micro-batches of events to a table, each binary's sequence going on.

    A batch is written to a folder of its own number, overwritten if it is run
    again, and what it goes on from is read from the batches before it; so a batch
    that is repeated after a failure leaves the same rows.
    """

    #: Every so many batches the last sequences of all binaries are written anew.
    WHOLE = 16

    def __init__(self, spark: SparkSession, folder: str, order: list[str]):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), order

    def _last(self, batch_id: int) -> DataFrame:
        """The last sequence of each binary before a batch: the last whole table, and
        those of the few batches since, which have only their own binaries."""
        if not batch_id:
            return self.spark.createDataFrame([], "binary_id long, seq long")
        first = (batch_id - 1) // self.WHOLE * self.WHOLE
        parts = self.spark.read.schema("binary_id long, seq long").parquet(*[f"{self.folder}/last/{i}" for i in range(first, batch_id)])
        return parts.groupBy("binary_id").agg(F.max("seq").alias("seq"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last = self._last(batch_id)
        rows = append_events(last, batch, self.order)
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/batch={batch_id}")
        ends = written.groupBy("binary_id").agg(F.max("seq").alias("seq"))
        if batch_id % self.WHOLE == 0 and batch_id:
            ends = ends.unionByName(last).groupBy("binary_id").agg(F.max("seq").alias("seq"))
        ends.write.mode("overwrite").parquet(f"{self.folder}/last/{batch_id}")


def append_stream(events: DataFrame, folder: str, order: list[str], trigger: dict | None = None):
    """Starts the query that appends a stream of events (binary_id and the columns of
    order) below folder. The default trigger takes all there is and ends."""
    appender = EventAppender(events.sparkSession, f"{folder}/table", order)
    return events.writeStream.foreachBatch(appender).option("checkpointLocation", f"{folder}/offsets").trigger(**(trigger or {"availableNow": True})).start()


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The table that append_stream has made."""
    return spark.read.parquet(f"{folder}/table/rows").drop("batch")


def late_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; what comes later than the watermark is not counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Tells a callback, after each batch of any stream, how many batches and rows
    there have been so far."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell, self.batches, self.rows = tell, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.tell(self.batches, self.rows)

    def onQueryTerminated(self, event) -> None:
        pass
