"""Operators with a value per key, kept in Spark's state store.

The store is RocksDB below the query's checkpoint: a micro-batch changes only the keys it holds, and a restart or
a replayed batch starts from the version its predecessor committed. Rows of a micro-batch meet their key's value
in time order; a row that arrives in a later micro-batch than a newer one is judged on arrival.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaylight.fixed import SNMP_MAX_FAILURES
from quaylight.session import STATE_STORE

_AT, _TIE = "__at", "__tie"


def use_state_store(spark: SparkSession) -> SparkSession:
    """Queries started from now on keep their state in RocksDB, as value state needs."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    return spark


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of one micro-batch by time and tie; rows without a time come first."""
    return sorted(rows, key=lambda r: tuple((v is not None, v) if v is not None else (False,) for v in (r[_AT], r[_TIE])))


class FailureRuns(StatefulProcessor):
    """The run of failures after each poll. A poll without a result changes nothing."""

    def __init__(self, ok: str, max_failures: int):
        self.ok, self.max_failures = ok, max_failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "failures bigint")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.failures.update((initialState["failures"] or 0,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        run = self.failures.get()[0] if self.failures.exists() else 0
        for row in _in_order(rows):
            passed = row[self.ok]
            run = run if passed is None else 0 if passed else run + 1
            yield Row(**row.asDict(), consecutive_failures=run, healthy=run < self.max_failures)
        self.failures.update((run,))

    def close(self) -> None:
        pass


class FirstSights(StatefulProcessor):
    """Sights more than ``width`` microseconds after the key's last kept one, which hidden ones do not refresh.

    A timer drops a key's value once the watermark has passed all that it can hide.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for row in _in_order(rows):
            at = row[_AT]
            if at is None:
                yield row
            elif last is None or at - last > self.width:
                last = at
                yield row
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + self.width) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.last.exists() and (self.last.get()[0] + self.width) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, ts: str, tie: str | None) -> DataFrame:
    """Times as numbers: they pass the workers unchanged whatever their time zone."""
    return rows.withColumns({_AT: F.unix_micros(ts), _TIE: F.col(tie) if tie else F.lit(None).cast("bigint")})


def _restored(rows: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn(ts, F.timestamp_micros(_AT)).select(*columns)


def failure_runs(
    polls: DataFrame,
    keys: Sequence[str],
    ok: str,
    ts: str = "ts",
    tie: str = "id",
    max_failures: int = SNMP_MAX_FAILURES,
    initial: DataFrame | None = None,
) -> DataFrame:
    """A stream of polls with ``consecutive_failures`` and ``healthy``; ``initial`` (keys, failures) seeds the state.

    A target's polls of one micro-batch are ordered in one task, so a micro-batch bounds what is held; a poll
    that arrives after a newer one was counted continues from the run as it stands.
    """
    timed = _timed(polls, ts, tie)
    found = [T.StructField("consecutive_failures", T.LongType()), T.StructField("healthy", T.BooleanType())]
    start = initial.select(*keys, F.col("failures").cast("bigint")).groupBy(*keys) if initial is not None else None
    counted = timed.groupBy(*keys).transformWithState(
        FailureRuns(ok, max_failures), T.StructType([*timed.schema.fields, *found]), "append", "none", start
    )
    return _restored(counted, ts, [*polls.columns, "consecutive_failures", "healthy"])


def drop_duplicates(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", window_seconds: int = 3600, late: str = "10 minutes", tie: str | None = None
) -> DataFrame:
    """A stream without sights that a kept one of the same key hides, as ``delivery.drop_repeats`` over a table.

    Rows later than ``late`` are dropped by Spark; among those in time, one that is older than the key's last kept
    sight is hidden by it. A row without a time is kept. Of rows at one instant the lowest ``tie`` counts.
    """
    timed = _timed(events, ts, tie).withWatermark(ts, late)
    kept = timed.groupBy(*keys).transformWithState(FirstSights(window_seconds * 1_000_000), timed.schema, "append", "eventtime")
    return _restored(kept, ts, events.columns)


def state_of(spark: SparkSession, checkpoint: str, value: str) -> DataFrame:
    """The value of every key after the last committed micro-batch."""
    rows = spark.read.format("statestore").option("stateVarName", value).load(checkpoint)
    return rows.select("key.*", "value.*")
