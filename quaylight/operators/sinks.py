"""Fan-out of one batch to several sinks, and the statistics it leaves."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaylight.operators.commits import commit

log = logging.getLogger(__name__)

# A sink writes a batch and reports its counts. It must be idempotent for a batch id: a streaming
# batch can be delivered again after a failure.
Sink = Callable[[DataFrame, int], dict[str, int]]

STATS = "batch_id BIGINT, sink STRING, written BIGINT, errors BIGINT, retries BIGINT, queued BIGINT"


def file_sink(path: str, prepare: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> Sink:
    """Parquet sink: each batch is committed whole (see ``commits``), and a replay takes its place.

    Inside it rows are partitioned by the columns ``by``.
    """

    def write(batch: DataFrame, batch_id: int) -> dict[str, int]:
        seen = Observation()
        rows = prepare(batch).observe(seen, F.count(F.lit(1)).alias("n"))
        commit(rows, path, batch_id, by)
        return {"written": seen.get["n"], "errors": 0, "retries": 0, "queued": 0}

    return write


def with_retries(sink: Sink, attempts: int = 3) -> Sink:
    """A sink that is tried up to ``attempts`` times; it reports its retries, and as queued what it could not write."""

    def write(batch: DataFrame, batch_id: int) -> dict[str, int]:
        for n in range(attempts):
            try:
                return {**sink(batch, batch_id), "retries": n}
            except Exception:
                log.exception("attempt %s of batch %s failed", n + 1, batch_id)
        left = batch.count()
        return {"written": 0, "errors": left, "retries": attempts - 1, "queued": left}

    return write


def fan_out(
    batch: DataFrame, batch_id: int, sinks: Mapping[str, Sink], stats_path: str | None = None
) -> list[tuple]:
    """Write one batch to every sink at once; a failing sink does not stop the others.

    The batch is computed once and kept while the sinks read it. Counts come back in the order of ``sinks``.
    """
    spark: SparkSession = batch.sparkSession
    held = batch.persist()

    def write(item: tuple[str, Sink]) -> tuple:
        name, sink = item
        try:
            got = sink(held, batch_id)
        except Exception:
            log.exception("sink %s failed on batch %s", name, batch_id)
            got = {"written": 0, "errors": held.count(), "retries": 0, "queued": 0}
        return (batch_id, name, *[got.get(k, 0) for k in ("written", "errors", "retries", "queued")])

    try:
        with ThreadPoolExecutor(max(1, len(sinks))) as pool:
            rows = list(pool.map(inheritable_thread_target(spark)(write), sinks.items()))
    finally:
        held.unpersist()
    if stats_path:
        stats = spark.createDataFrame(rows, STATS)
        stats.coalesce(1).write.mode("overwrite").parquet(f"{stats_path}/part={batch_id}")
    return rows


def sink_totals(stats: DataFrame) -> DataFrame:
    """Written, errors, retries and queued per batch over all sinks."""
    names = ("written", "errors", "retries", "queued")
    return stats.groupBy("batch_id").agg(*[F.sum(n).alias(f"total_{n}") for n in names])
