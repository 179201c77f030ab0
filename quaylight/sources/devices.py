"""Landed device payloads: weather service replies, management polls, flow packets, vessel lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions import nmea
from quaylight.functions.network import flow_version
from quaylight.functions.text import lookup, strip

WEATHER_REPLY = (
    "latitude DOUBLE, longitude DOUBLE, timezone STRING, elevation DOUBLE, current STRUCT<"
    + ", ".join(
        f"{n}: {'STRING' if n == 'time' else 'INT' if n in ('is_day', 'weather_code') else 'DOUBLE'}"
        for n in fixed.WEATHER_CURRENT
    )
    + ">, current_units MAP<STRING,STRING>"
)


def weather_description(code: Column) -> Column:
    """Text of a WMO code; an absent code stays null."""
    return F.coalesce(
        lookup(fixed.WMO_CODES, code.cast("int")),
        F.concat(F.lit("Unknown weather code: "), code.cast("string")),
    )


def weather_replies(df: DataFrame, as_of: Column, source: str = "open-meteo") -> DataFrame:
    """Weather events from reply documents of ``WEATHER_REPLY`` shape."""
    current = []
    for field, name in fixed.WEATHER_CURRENT.items():
        c = F.col(f"current.{field}")
        current.append((F.coalesce(c == 1, F.lit(False)) if name == "is_day" else c).alias(name))
    return df.select(
        as_of.alias("timestamp"),
        F.lit("weather").alias("type"),
        F.lit(source).alias("source"),
        F.struct(
            "latitude",
            "longitude",
            F.coalesce("timezone", F.lit("UTC")).alias("timezone"),
            "elevation",
        ).alias("location"),
        F.struct(*current).alias("current_weather"),
        weather_description(F.col("current.weather_code")).alias("weather_description"),
        F.col("current_units").alias("units"),
    )


def oid_name(oid: Column) -> Column:
    return F.coalesce(lookup(fixed.OID_NAMES, oid), F.concat(F.lit("unknown_"), oid))


def numeric_text(value: Column) -> Column:
    return strip(value).try_cast("double")


def poll_results(df: DataFrame, results: str = "results") -> DataFrame:
    """Name and parse every result of a poll in place: no explode, no regrouping."""
    named = F.transform(
        results,
        lambda r: F.struct(
            r["oid"].alias("oid"),
            oid_name(r["oid"]).alias("oid_name"),
            r["value"].alias("value"),
            numeric_text(r["value"]).alias("numeric_value"),
        ),
    )
    return df.withColumns(
        {"type": F.lit("snmp"), results: named, "oids_count": F.size(results)}
    )


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """One datagram per file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def flow_packets(df: DataFrame, content: str = "content", kind: str = "netflow") -> DataFrame:
    """Version, size and base64 text of flow datagrams."""
    data = F.col(content)
    return df.withColumns(
        {
            "type": F.lit("flow_packet"),
            "subtype": F.lit(kind),
            "version": flow_version(data),
            "size_bytes": F.length(data),
            "payload_b64": F.regexp_replace(F.base64(data), r"\s", ""),
        }
    ).drop(content)


def nmea_events(df: DataFrame, line: str = "value") -> DataFrame:
    """Position, course, speed and heading of NMEA sentences; other lines are dropped."""
    text = strip(F.col(line))
    fields = F.split(text, ",")
    rows = df.where(text.rlike(fixed.NMEA)).withColumns(
        {"raw": text, "sentence": F.regexp_extract(text, fixed.NMEA, 1), "__f": fields}
    )

    def f(i: int) -> Column:
        return F.get("__f", F.lit(i))

    size = F.size("__f")
    rmc = F.col("sentence").endswith("RMC") & (size >= 12)
    vtg = F.col("sentence").endswith("VTG") & (size >= 9)
    hdt = F.col("sentence").endswith("HDT") & (size >= 2)
    return rows.withColumns(
        {
            "type": F.lit("nmea"),
            "valid": F.when(rmc, f(2) == "A"),
            "lat": F.when(rmc, nmea.degrees(f(3), f(4))),
            "lon": F.when(rmc, nmea.degrees(f(5), f(6))),
            "sog_kn": F.when(rmc, nmea.number(f(7))).when(vtg, nmea.number(f(5))),
            "cog_deg": F.when(rmc, nmea.number(f(8))).when(vtg, nmea.number(f(1))),
            "heading_true_deg": F.when(hdt, nmea.number(f(1))),
        }
    ).drop("__f", line)
