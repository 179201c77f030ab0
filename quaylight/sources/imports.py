"""File importers: JSON-lines syslog and metric events, and weather CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight import fixed
from quaylight.functions import times
from quaylight.functions.text import first_non_empty
from quaylight.operators.enrich import import_severity
from quaylight.schema import col, present

CORRUPT = "_corrupt_record"


def read_jsonl(
    spark: SparkSession, path: str, schema: str | None = None, max_lines: int | None = None
) -> DataFrame:
    """JSON lines; a bad line keeps its text in ``_corrupt_record`` and the read goes on."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema:
        reader = reader.schema(f"{schema}, {CORRUPT} STRING")
    df = reader.json(path)
    return df.limit(max_lines) if max_lines else df


def import_summary(df: DataFrame, ok: Column | None = None) -> DataFrame:
    """Imported and failed record counts."""
    if ok is None:
        ok = col(CORRUPT).isNull() if CORRUPT in df.columns else F.lit(True)
    return df.agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("errors"))


def _first_not_null(df: DataFrame, names: Sequence[str]) -> Column:
    cols = [col(n).cast("string") for n in present(df, names)]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def _time(df: DataFrame, as_of: Column, formats, tz, digits=True, names=fixed.IMPORT_TIME_FIELDS) -> Column:
    found = [
        times.import_time(F.nullif(col(n).cast("string"), F.lit("")), formats, tz, digits)
        for n in present(df, names)
    ]
    return F.coalesce(*found, as_of)


def _extras(df: DataFrame, mapped: set[str]) -> dict[str, Column]:
    return {
        f"extra_{n}": col(n) for n in df.columns if n not in mapped and not n.startswith("_")
    }


def rfc_variant(message: Column) -> Column:
    """Variant tag of an imported message, from short prefixes."""
    return F.when(message.rlike(fixed.RFC5424_PREFIX), "RFC5424").when(
        message.rlike(fixed.RFC3164_PREFIX), "RFC3164"
    )


def syslog_events(
    df: DataFrame, as_of: Column, tz: str | None = None, map_severity: bool = False
) -> DataFrame:
    """Normalised syslog events; fields outside the mapping come along as ``extra_*``.

    Priority, severity and pid are whole numbers where they can be and text otherwise, so each is
    a text column with an ``*_int`` companion.
    """
    message = _first_not_null(df, ("message", "msg"))
    raw = F.coalesce(message, F.lit(""))
    port_name = first_non_empty([col(n) for n in present(df, fixed.SYSLOG_FIELDS["source_port"])])
    out = {
        "timestamp": _time(df, as_of, fixed.IMPORT_TIME_FORMATS, tz),
        "type": F.lit("syslog_event"),
        "source": F.lit("jsonl-import"),
        "raw_message": raw,
        "rfc_variant": rfc_variant(raw),
        "source_ip": first_non_empty([col(n) for n in present(df, fixed.SYSLOG_FIELDS["source_ip"])]),
        "source_port": port_name.try_cast("int"),
    }
    for name in ("facility", "severity", "priority", "tag", "pid"):
        value = _first_not_null(df, fixed.SYSLOG_FIELDS[name])
        out[name] = value
        if name in ("severity", "priority", "pid"):
            out[f"{name}_int"] = value.try_cast("bigint")
    out["structured_data"] = first_non_empty(
        [_as_text(df, n) for n in present(df, fixed.SYSLOG_FIELDS["structured_data"])]
    )
    if map_severity:
        out["severity_num"] = import_severity(out["severity"])
    mapped = {"message", "msg", CORRUPT, *fixed.IMPORT_TIME_FIELDS}
    mapped.update(n for names in fixed.SYSLOG_FIELDS.values() for n in names)
    out.update(_extras(df, mapped))
    return df.select(*[c.alias(n) for n, c in out.items()])


def _as_text(df: DataFrame, name: str) -> Column:
    nested = (T.StructType, T.ArrayType, T.MapType)
    return F.to_json(col(name)) if isinstance(df.schema[name].dataType, nested) else col(name)


def metric_events(
    df: DataFrame, as_of: Column, tz: str | None = None, percent_as_ratio: bool = False
) -> DataFrame:
    """Normalised device metrics: numeric value where possible, text kept beside it."""
    out = {
        "timestamp": _time(df, as_of, fixed.IMPORT_TIME_FORMATS, tz),
        "type": F.lit("snmp_metric"),
        "source": F.lit("jsonl-import"),
    }
    for name, names in fixed.METRIC_FIELDS.items():
        out[name] = _first_not_null(df, names)
    out["value_double"] = out["value"].try_cast("double")
    if percent_as_ratio:
        out["value_ratio"] = F.when(out["unit"] == "%", out["value_double"] / 100.0)
    mapped = {CORRUPT, *fixed.IMPORT_TIME_FIELDS}
    mapped.update(n for names in fixed.METRIC_FIELDS.values() for n in names)
    out.update(_extras(df, mapped))
    return df.select(*[c.alias(n) for n, c in out.items()])


def detect_delimiter(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """The most frequent candidate in the header line; one line is read, the table is not."""
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0] if first else ""
    return max(candidates, key=header.count) if any(map(header.count, candidates)) else ","


def read_weather_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, max_lines: int | None = None
) -> DataFrame:
    """Weather CSV as text columns named by its header."""
    sep = delimiter or detect_delimiter(spark, path)
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    return df.limit(max_lines) if max_lines else df


def _one_of(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """The first of ``names`` that is a column at all (an empty cell does not fall through)."""
    there = present(df, names)
    return col(there[0]).cast("string") if there else F.lit(default).cast("string")


def weather_events(df: DataFrame, as_of: Column, tz: str | None = None) -> DataFrame:
    """Location and current-weather structs of CSV rows.

    Numeric fields are doubles; text that is not a number stays available in ``unparsed``.
    """
    stamp = F.nullif(_one_of(df, ("timestamp", "time", "datetime")), F.lit(""))
    numeric, text = {}, {}
    for name, names in fixed.WEATHER_FIELDS.items():
        value = first_non_empty([col(n) for n in present(df, names)])
        if name in fixed.WEATHER_NUMERIC:
            numeric[name] = value.try_cast("double")
            text[name] = F.when(value.try_cast("double").isNull(), value)
        else:
            numeric[name] = value
    mapped = {"timestamp", "time", "datetime", "latitude", "lat", "longitude", "lon", "city", "location"}
    mapped.update(n for names in fixed.WEATHER_FIELDS.values() for n in names)
    for n in df.columns:
        if n not in mapped and not n.startswith("_"):
            numeric[n] = col(n).try_cast("double")
            text[n] = F.when(col(n).try_cast("double").isNull(), col(n))
    unparsed = F.map_filter(
        F.create_map(*[x for n, c in text.items() for x in (F.lit(n), c)]),
        lambda _k, v: v.isNotNull(),
    )
    return df.select(
        F.coalesce(times.import_time(stamp, fixed.WEATHER_TIME_FORMATS, tz, digits=False), as_of).alias("timestamp"),
        F.lit("weather").alias("type"),
        F.lit("csv-import").alias("source"),
        F.struct(
            _one_of(df, ("latitude", "lat"), "0.0").try_cast("double").alias("latitude"),
            _one_of(df, ("longitude", "lon"), "0.0").try_cast("double").alias("longitude"),
            _one_of(df, ("city", "location"), "unknown").alias("city"),
        ).alias("location"),
        F.struct(*[c.alias(n) for n, c in numeric.items()]).alias("current_weather"),
        unparsed.alias("unparsed"),
    )
