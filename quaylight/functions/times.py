"""Time parsing and bucketing. The session time zone is UTC (see ``session``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight import fixed

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
NUMBER = r"^[+-]?\d+(\.\d+)?$"


def from_epoch(c: Column) -> Column:
    """Seconds since the epoch, with a fraction, as TIMESTAMP."""
    return F.timestamp_micros(F.round(c.try_cast("double") * 1_000_000).try_cast("bigint"))


def from_iso(c: Column) -> Column:
    """ISO text with Z, an offset or no zone (UTC); null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), c.try_cast("timestamp"))


def from_formats(c: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def any_time(c: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP from a declared column: instants pass, numbers are Unix seconds, text is ISO."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return F.when(c != 0, from_epoch(c))
    return F.coalesce(from_iso(c), F.when(c.rlike(NUMBER), from_epoch(c)))


def normalise_text(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """ISO text at second precision; null when the value is in no accepted form.

    Accepted: four text formats (their fraction is cut), Unix numbers, and any text already in ISO
    form with a zone, which is kept as it is.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, ISO_SECONDS)
    if isinstance(dtype, T.NumericType):
        return F.date_format(from_epoch(c), ISO_SECONDS)
    parsed = F.coalesce(
        from_formats(c, fixed.TIME_FORMATS), F.when(c.rlike(NUMBER), from_epoch(c))
    )
    zoned = c.contains("T") & (
        c.contains("Z") | c.contains("+") | F.right(c, F.lit(6)).contains("-")
    )
    return F.coalesce(F.date_format(parsed, ISO_SECONDS), F.when(zoned, c))


def import_time(
    c: Column,
    formats: Sequence[tuple[str, str]] = fixed.IMPORT_TIME_FORMATS,
    tz: str | None = None,
    digits: bool = True,
) -> Column:
    """Importer rule: all digits = epoch, a ``T`` = ISO, else the formats read in zone ``tz``."""
    local = F.coalesce(
        *[F.try_to_timestamp(F.concat(F.lit(pre), c), F.lit(fmt)) for pre, fmt in formats]
    )
    if tz:
        local = F.to_utc_timestamp(local, tz)
    parsed = F.when(c.contains("T"), from_iso(c)).otherwise(local)
    if digits:
        parsed = F.when(c.rlike(r"^\d+$"), from_epoch(c)).otherwise(parsed)
    return parsed


def micros(c: Column) -> Column:
    return F.unix_micros(c)


def step_number(ts: Column, step_seconds: int) -> Column:
    """Number n of the evaluation step whose range ``((n - 1) * step, n * step]`` holds ``ts``."""
    step = F.lit(step_seconds * 1_000_000)
    last = F.unix_micros(ts) + step - F.lit(1)
    return F.call_function("div", last - F.pmod(last, step), step)


def step_time(number: Column, step_seconds: int) -> Column:
    return F.timestamp_seconds(number * F.lit(step_seconds))
