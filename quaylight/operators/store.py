"""The event store: row preparation, append, filters and counts."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight import fixed
from quaylight.functions import payload as js
from quaylight.functions import times
from quaylight.functions.text import first_non_empty, strip
from quaylight.operators import commits
from quaylight.schema import STORED_EVENT, col, present


def event_time(df: DataFrame, as_of: Column, fields=fixed.STORE_TIME_FIELDS) -> Column:
    """First parseable time field as TIMESTAMP, else ``as_of``."""
    types = {f.name: f.dataType for f in df.schema}
    return F.coalesce(*[times.any_time(col(f), types[f]) for f in present(df, fields)], as_of)


def row_position() -> Column:
    """Where a row of a Parquet scan stands: its file and its number there. Stable whenever the file is read."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def store_rows(
    df: DataFrame, as_of: Column, batch: Column | str = "", position: str | None = None, payload: str = "text"
) -> DataFrame:
    """(ts, type, source, data, id, created_at) rows of events; ``data`` is JSON text or, with ``payload``
    "variant", VARIANT.

    The id is a hash of batch and content, or of batch and the column ``position`` (see ``row_position``), which is
    then no part of the data: replaying a batch gives the same ids. Equal events have equal content: without a
    position ``numbered_repeats`` tells them apart when they are written.
    """
    kind = F.coalesce(F.nullif(strip(col("type").cast("string")), F.lit("")), F.lit("unknown"))
    kind = F.when(kind == "unknown", kind).otherwise(col("type"))
    source = first_non_empty([col(f) for f in present(df, fixed.STORE_SOURCE_FIELDS)])
    source = F.when(strip(source) == "", F.lit("unknown")).otherwise(
        F.coalesce(source, F.lit("unknown"))
    )
    kept = [c for c in df.columns if c not in fixed.TIME_FIELDS and c != position]
    event = F.struct(*[col(c) for c in kept])
    batch = F.lit(batch) if isinstance(batch, str) else batch
    rows = df.select(
        event_time(df, as_of).alias("ts"),
        kind.alias("type"),
        source.alias("source"),
        (F.to_variant_object(event) if payload == "variant" else F.to_json(event)).alias("data"),
        (F.xxhash64(batch, col(position)) if position else F.to_json(event)).alias("id"),
    )
    if not position:
        rows = rows.withColumn("id", F.xxhash64(batch, "ts", "type", "source", "id"))
    return rows.withColumn("created_at", as_of)


def numbered_repeats(rows: DataFrame) -> DataFrame:
    """Store rows in which equal events of a batch have ids of their own: the second, third.. hash their number in.

    Equal rows are counted (before the shuffle too) and made again from the count, so no id depends on an order.
    """
    same = [c for c in rows.columns if c != "data"]
    data = F.any_value("data").alias("data")
    if not isinstance(rows.schema["data"].dataType, T.VariantType):
        same, data = [*same, "data"], None
    counted = rows.groupBy(*same).agg(*([data] if data is not None else []), F.count(F.lit(1)).alias("__n"))
    again = counted.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1)))
    number = F.when(F.col("__k") == 0, F.col("id")).otherwise(F.xxhash64("id", "__k"))
    return again.withColumn("id", number).select(*rows.columns)


def append(rows: DataFrame, path: str, mode: str = "append", unique: bool = False) -> None:
    """Append rows partitioned by day. Without ``unique`` ids, repeats are numbered first (one more shuffle).

    Rebalancing sends a day's rows together, then lets adaptive execution split a hot day and join
    small ones by size. It needs no sampling pass over the (costly) steps before it. Sorting keeps
    (type, ts) runs together, so row groups can be skipped.
    """
    rows = rows if unique else numbered_repeats(rows)
    dated(rows).write.mode(mode).partitionBy("event_date").parquet(path)


def commit(rows: DataFrame, path: str, batch: str | int, unique: bool = False) -> None:
    """Write store rows as one batch that readers see whole or not at all; a replay of the batch replaces it."""
    commits.commit(dated(rows if unique else numbered_repeats(rows)), path, batch, ("event_date",))


def dated(rows: DataFrame) -> DataFrame:
    """Rows with their day, dealt and sorted for writing."""
    days = rows.withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date")
    return days.sortWithinPartitions("event_date", "type", "ts")


def compact(spark: SparkSession, streamed: str, path: str) -> None:
    """Rewrite the batch folders of a streamed store as one day-partitioned store (a periodic batch job).

    ``read`` takes either layout; many small batches list and scan slowly.
    """
    append(read(spark, streamed).drop("event_date"), path, "overwrite", unique=True)


def read(spark: SparkSession, path: str, payload: str = "text") -> DataFrame:
    """A store as ``append``, ``commit`` or the streaming sink leaves it: days, or days inside batches, of which
    only committed ones count. ``payload`` tells how ``data`` was stored."""
    shape = STORED_EVENT.replace("data STRING", "data VARIANT") if payload == "variant" else STORED_EVENT
    names = [f.strip().split(" ")[0] for f in shape.split(",")]
    if commits.is_committed(spark, path):
        return commits.read(spark, path, shape + ", event_date DATE").select(*names, "event_date")
    return spark.read.schema(shape + ", event_date DATE").option("recursiveFileLookup", "false").parquet(path).select(*names, "event_date")


def in_range(
    df: DataFrame,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    ts: str = "ts",
    after: bool = False,
) -> DataFrame:
    """Closed time range (open at the start with ``after``); day partitions are pruned as well."""
    if start is not None:
        low = F.lit(start).cast("timestamp")
        df = df.where(col(ts) > low) if after else df.where(col(ts) >= low)
        if "event_date" in df.columns:
            df = df.where(F.col("event_date") >= F.to_date(low))
    if end is not None:
        high = F.lit(end).cast("timestamp")
        df = df.where(col(ts) <= high)
        if "event_date" in df.columns:
            df = df.where(F.col("event_date") <= F.to_date(high))
    return df


def query_events(
    df: DataFrame,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    type: str | None = None,
    source: str | None = None,
    limit: int | None = 1000,
    offset: int = 0,
    tie: str = "id",
) -> DataFrame:
    """Newest events first under optional time, type and source filters.

    Sort, offset and limit run as one top-k: each task keeps ``offset + limit`` rows. Without a limit all rows
    come back, unordered.
    """
    df = in_range(df, start, end)
    if type:
        df = df.where(F.col("type") == type)
    if source:
        df = df.where(F.col("source") == source)
    order = [F.col("ts").desc()]
    if tie in df.columns:
        order.append(F.col(tie))
    if limit is None and not offset:
        return df
    rows = df.orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def merge_payload(
    df: DataFrame,
    fields: dict[str, str],
    data: str = "data",
    prefer_payload: bool = True,
) -> DataFrame:
    """Lift payload fields (name -> type) to columns; on a clash the payload wins by default."""
    out = df.withColumn("__doc", js.document(df, data))
    lifted = {}
    for name, kind in fields.items():
        value = F.try_variant_get(F.col("__doc"), js._key(name), kind)
        if name in df.columns:
            own = col(name).cast(kind)
            value = F.coalesce(value, own) if prefer_payload else F.coalesce(own, value)
        lifted[name] = value
    return out.withColumns(lifted).drop("__doc")


def containing(df: DataFrame, probe: Any, data: str = "data") -> DataFrame:
    """Rows whose payload (VARIANT, or JSON text) contains the sub-document ``probe``."""
    stored = isinstance(df.schema[data].dataType, T.VariantType)
    return df.where(js.holds(col(data), probe) if stored else js.contains(js.as_variant(col(data)), probe))


def recent(df: DataFrame, type: str, as_of: str, hours: int = 1) -> DataFrame:
    """Events of one type in the hours before ``as_of``."""
    low = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    df = df.where((F.col("type") == type) & (F.col("ts") > low))
    if "event_date" in df.columns:
        df = df.where(F.col("event_date") >= F.to_date(low))
    return df


def counts_by_hour(df: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Events per type and hour over the last ``hours``, newest hour first."""
    low = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    if "event_date" in df.columns:
        df = df.where(F.col("event_date") >= F.to_date(low))
    return (
        df.where(F.col("ts") > low)
        .groupBy("type", F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("hour").desc(), "type")
    )


def totals(df: DataFrame, as_of: str) -> DataFrame:
    """Rows in the store, and rows created in the last hour."""
    low = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    return df.agg(
        F.count("*").alias("total_events_in_db"),
        F.count_if(F.col("created_at") > low).alias("events_last_hour"),
    )
