"""Metric samples from exposition text and from nested service statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.functions.text import strip

LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?$"
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'


def samples(df: DataFrame, ts: Column, line: str = "value") -> DataFrame:
    """(ts, name, labels, value) of exposition lines; comments and blank lines are dropped."""
    text = strip(F.col(line))
    labels = F.regexp_extract(text, LINE, 2)
    raw = F.regexp_extract_all(labels, F.lit(LABEL), F.lit(2))
    # An escaped backslash splits a value first: what follows it is no escape.
    plain = F.transform(
        raw,
        lambda v: F.array_join(
            F.transform(
                F.split(v, r"\\\\", -1),
                lambda part: F.regexp_replace(F.regexp_replace(part, r"\\n", "\n"), r'\\"', '"'),
            ),
            "\\",
        ),
    )
    return df.where(text.rlike(LINE) & ~text.startswith("#")).select(
        ts.alias("ts"),
        F.regexp_extract(text, LINE, 1).alias("name"),
        F.map_from_arrays(F.regexp_extract_all(labels, F.lit(LABEL), F.lit(1)), plain).alias("labels"),
        F.regexp_extract(text, LINE, 3).try_cast("double").alias("value"),
    )


def stats_samples(df: DataFrame, ts: Column, service: Column, stats: str, prefix: str = "edge") -> DataFrame:
    """Flatten a statistics struct (numbers, and one level of nested numbers) to named samples."""
    numeric = (T.NumericType, T.BooleanType)
    parts: list[tuple[str, Column]] = []
    for f in df.schema[stats].dataType:
        c = F.col(stats).getField(f.name)
        if isinstance(f.dataType, numeric):
            parts.append((f.name, c))
        elif isinstance(f.dataType, T.StructType):
            parts += [
                (f"{f.name}_{g.name}", c.getField(g.name))
                for g in f.dataType
                if isinstance(g.dataType, numeric)
            ]
    rows = F.array(
        *[F.struct(F.lit(n).alias("n"), c.cast("double").alias("value")) for n, c in parts]
    )
    out = df.select(ts.alias("ts"), service.alias("__s"), F.inline(rows))
    name = F.regexp_replace(F.concat_ws("_", F.lit(prefix), "__s", "n"), "-", "_")
    return out.where(F.col("value").isNotNull()).select(
        "ts", name.alias("name"), F.create_map().cast("map<string,string>").alias("labels"), "value"
    )
