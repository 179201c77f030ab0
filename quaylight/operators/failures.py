"""Consecutive-failure state of polled targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.fixed import SNMP_MAX_FAILURES
from quaylight.functions.times import step_number
from quaylight.operators.series import joined_on


def consecutive_failures(
    polls: DataFrame,
    keys: Sequence[str],
    ok: str,
    ts: str = "ts",
    tie: str = "id",
    max_failures: int = SNMP_MAX_FAILURES,
    chunk_seconds: int = 3600,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add the failure run length after each poll, and whether the target still counts as healthy.

    A target's polls are counted per time chunk; what carries into a chunk is computed on one row
    per chunk, so no task orders all polls of a target. ``initial`` (keys, failures) holds run
    lengths from before the first poll.
    """
    rows = polls.withColumn("__chunk", step_number(F.col(ts), chunk_seconds))
    near = Window.partitionBy(*keys, "__chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__since", F.sum(F.col(ok).cast("int")).over(near))
    run = Window.partitionBy(*keys, "__chunk", "__since").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum((~F.col(ok)).cast("int")).over(run))
    cells = rows.groupBy(*keys, "__chunk").agg(
        F.max("__since").alias("oks"),
        F.max_by("__run", F.struct(ts, tie)).alias("tail"),
    )
    # Chunks up to and including the next one with a success share a carry group.
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("epoch", F.sum((F.col("oks") > 0).cast("int")).over(before))
    upto = Window.partitionBy(*keys, "epoch").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0)
    if initial is None:
        cells = cells.withColumn("failures", F.lit(0))
    else:
        cells = joined_on(cells, initial.select(*keys, "failures"), keys, "left")
    start = F.coalesce("failures", F.lit(0))
    after = F.sum("tail").over(upto) + F.when(F.col("epoch") == 0, start).otherwise(F.lit(0))
    cells = cells.withColumn("after", after)
    carry = F.coalesce(F.lag("after").over(Window.partitionBy(*keys).orderBy("__chunk")), start)
    carried = cells.select(*keys, "__chunk", carry.alias("__carry"))
    total = F.col("__run") + F.when(F.col("__since") == 0, F.col("__carry")).otherwise(F.lit(0))
    return (
        joined_on(rows, carried, [*keys, "__chunk"])
        .withColumn("consecutive_failures", total)
        .withColumn("healthy", F.col("consecutive_failures") < max_failures)
        .drop("__chunk", "__since", "__run", "__carry")
    )


def last_runs(
    counted: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str = "id"
) -> DataFrame:
    """(keys, failures) after the last counted poll of each target."""
    last = F.max_by("consecutive_failures", F.struct(ts, tie))
    return counted.groupBy(*keys).agg(last.alias("failures"))
