"""Tumbling and sliding counts on a stream or on a table, and what a stream leaves out as late."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def windowed_counts(
    events: DataFrame,
    by: Sequence[str] = (),
    size: str = "5 minutes",
    slide: str | None = None,
    late: str | None = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """Events per window and key. On a stream, rows later than ``late`` are dropped by Spark."""
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        events.groupBy(window.alias("w"), *by)
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count")
    )


class BatchCounts(StreamingQueryListener):
    """Per micro-batch of a query: input rows, observed counts, and what the watermark dropped.

    A batch that is reported again (a replay) replaces its numbers, so the sums count each batch once.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event: Any) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        counts = {"input_rows": p.numInputRows, "dropped": sum(o.numRowsDroppedByWatermark for o in p.stateOperators)}
        for name, row in p.observedMetrics.items():
            counts |= {f"{name}.{k}": v for k, v in row.asDict().items() if isinstance(v, int)}
        self.batches[str(p.id), p.batchId] = counts

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all progress of a finished run has arrived; events come in order, the end last."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError("the end of the query was not reported")

    def total(self, name: str) -> int:
        return sum(b.get(name, 0) for b in self.batches.values())


def run_windows(
    events: DataFrame,
    by: Sequence[str],
    path: str,
    checkpoint: str,
    size: str = "5 minutes",
    late: str = "10 minutes",
    ts: str = "ts",
    seconds: int | None = None,
) -> StreamingQuery:
    """Write each tumbling window once, when the watermark closes it; its state is dropped then."""
    seen = events.where(F.col(ts).isNotNull()).observe("seen", F.count(F.lit(1)).alias("rows"))
    counts = windowed_counts(seen, by, size, late=late, ts=ts)
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if seconds:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    return writer.trigger(availableNow=True).start()


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(start, end, keys.., count) of the windows that the watermark has not closed yet, from the state store."""
    rows = spark.read.format("statestore").load(checkpoint)
    keys = [f.name for f in rows.schema["key"].dataType.fields if f.name != "window"]
    return rows.select("key.window.start", "key.window.end", *[F.col("key")[k].alias(k) for k in keys], F.col("value.count").alias("count"))


def late_rows(counts: BatchCounts, closed: DataFrame, still_open: DataFrame) -> int:
    """Rows that came after their window was closed: all that were seen less all that were counted.

    (The store's own number of dropped rows is one per window and key and task, as rows are added up before.)
    """
    counted = closed.select("count").unionByName(still_open.select("count")).agg(F.sum("count")).first()[0]
    return counts.total("seen.rows") - (counted or 0)
