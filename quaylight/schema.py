"""Declared shapes, and a walk over the string leaves of a schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.functions.text import literal

# Schemas are DDL text: usable by readers before any session exists.
EVENT = (
    "timestamp STRING, type STRING, source STRING, message STRING, severity STRING, "
    "hostname STRING, service STRING, source_ip STRING, path STRING, "
    "tags MAP<STRING,STRING>, data STRING"
)
EVENT_STRUCT = (
    "STRUCT<timestamp: STRING, type: STRING, source: STRING, message: STRING, severity: STRING, "
    "hostname: STRING, service: STRING, source_ip: STRING, path: STRING, "
    "tags: MAP<STRING,STRING>, data: STRING>"
)
STORED_EVENT = (
    "ts TIMESTAMP, type STRING, source STRING, data STRING, id BIGINT, created_at TIMESTAMP"
)
LOG_ENTRY = "ts_ns BIGINT, line STRING, labels MAP<STRING,STRING>"
SAMPLE = "ts TIMESTAMP, name STRING, labels MAP<STRING,STRING>, value DOUBLE"
DELIVERY = "id BIGINT, ts TIMESTAMP, message_data STRING, status STRING"


def envelope(event_struct: str = EVENT_STRUCT) -> str:
    """Wire batch of messages of a declared struct type."""
    return (
        f"messages ARRAY<{event_struct}>, batch_size INT, timestamp STRING, source STRING, "
        "is_retry BOOLEAN, batch_metadata MAP<STRING,STRING>"
    )


Rewrite = Callable[[str], str]


def holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(holds_text(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_text(dtype.valueType)
    return False


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rewrite_sql(value: str, dtype: T.DataType, fn: Rewrite, depth: int = 0) -> str:
    """SQL text applying ``fn`` to every string inside ``value``, following its declared type."""
    if not holds_text(dtype):
        return value
    if isinstance(dtype, T.StringType):
        return fn(value)
    if isinstance(dtype, T.StructType):
        inner = ", ".join(
            f"{literal(f.name)}, {rewrite_sql(f'{value}.{quoted(f.name)}', f.dataType, fn, depth)}"
            for f in dtype
        )
        return f"if({value} IS NULL, NULL, named_struct({inner}))"
    v = f"v{depth}"
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {v} -> {rewrite_sql(v, dtype.elementType, fn, depth + 1)})"
    body = rewrite_sql(v, dtype.valueType, fn, depth + 1)
    return f"transform_values({value}, (k{depth}, {v}) -> {body})"


def leaves_sql(value: str, dtype: T.DataType, path: str, depth: int = 0) -> list[str]:
    """SQL texts, each an array of ``struct(path, text)`` for one string leaf of a declared type.

    Array items and map keys are only known per row, so every leaf is an array. ``path`` is SQL.
    """
    if not holds_text(dtype):
        return []
    if isinstance(dtype, T.StringType):
        return [f"array(named_struct('path', {path}, 'text', {value}))"]
    if isinstance(dtype, T.StructType):
        return [
            leaf
            for f in dtype
            for leaf in leaves_sql(
                f"{value}.{quoted(f.name)}",
                f.dataType,
                f"concat({path}, {literal('.' + f.name)})",
                depth,
            )
        ]
    v, i = f"v{depth}", f"i{depth}"
    if isinstance(dtype, T.ArrayType):
        inner = leaves_sql(v, dtype.elementType, f"concat({path}, '[', {i}, ']')", depth + 1)
        return [f"flatten(transform({value}, ({v}, {i}) -> concat({', '.join(inner)})))"]
    inner = leaves_sql(f"{v}.value", dtype.valueType, f"concat({path}, '.', {v}.key)", depth + 1)
    return [f"flatten(transform(map_entries({value}), {v} -> concat({', '.join(inner)})))"]


def present(df: DataFrame, names) -> list[str]:
    """Those of ``names`` that are columns of ``df``, in the given order."""
    return [n for n in names if n in df.columns]


def col(name: str) -> Column:
    """A top-level column whatever characters its name holds."""
    return F.col(quoted(name))
