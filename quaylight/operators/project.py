"""Projections over event columns and payload maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.fixed import INTERNAL_FIELDS
from quaylight.schema import col


def sanitise(df: DataFrame, payload: str | None = None) -> DataFrame:
    """Remove delivery bookkeeping: ``__`` names and the internal fields, as columns or map keys."""
    out = df.drop(*[c for c in df.columns if c.startswith("__") or c in INTERNAL_FIELDS])
    if payload and payload in out.columns:
        out = out.withColumn(
            payload,
            F.map_filter(
                col(payload), lambda k, _v: ~(k.startswith("__") | k.isin(*INTERNAL_FIELDS))
            ),
        )
    return out
