"""NMEA 0183 field expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaylight.functions.text import non_empty


def degrees(value: Column, hemisphere: Column) -> Column:
    """``ddmm.mmmm`` (N/S) or ``dddmm.mmmm`` (otherwise) as signed degrees; short text is null."""
    width = F.when(hemisphere.isin("N", "S"), 2).otherwise(3)
    whole = F.substring(value, F.lit(1), width).try_cast("double")
    minutes = F.substring(value, width + 1, F.length(value)).try_cast("double")
    size = whole + minutes / 60.0
    return F.when(F.length(value) >= 3, F.when(hemisphere.isin("S", "W"), -size).otherwise(size))


def number(value: Column) -> Column:
    return non_empty(value).try_cast("double")
