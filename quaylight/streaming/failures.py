"""Consecutive failures per target on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quaylight.fixed import SNMP_MAX_FAILURES
from quaylight.streaming.state import failure_runs, use_state_store


def run_failures(
    polls: DataFrame,
    keys: Sequence[str],
    ok: str,
    root: str,
    checkpoint: str,
    max_failures: int = SNMP_MAX_FAILURES,
    seconds: int | None = None,
    initial: DataFrame | None = None,
) -> StreamingQuery:
    """Write counted polls below ``root/polls``, in folders named by the batch: a replay overwrites its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/polls/batch_id={batch_id}")

    use_state_store(polls.sparkSession)
    counted = failure_runs(polls, keys, ok, max_failures=max_failures, initial=initial)
    writer = counted.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    if seconds:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    return writer.trigger(availableNow=True).start()
