"""Syslog lines: RFC 5424, then RFC 3164, else kept as unparsed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions.text import lookup, strip

PARSE_ERROR = "Could not match RFC3164 or RFC5424 format"


def priority(pri: Column) -> dict[str, Column]:
    """Facility and severity numbers and names of a priority value."""
    severity = F.pmod(pri, F.lit(8))
    facility = F.call_function("div", pri - severity, F.lit(8)).cast("int")

    def named(table: dict, code: Column) -> Column:
        return F.coalesce(lookup(table, code), F.concat(F.lit("unknown_"), code.cast("string")))

    return {
        "facility_code": facility,
        "severity_code": severity.cast("int"),
        "facility": named(fixed.FACILITIES, facility),
        "severity": named(fixed.SEVERITIES, severity.cast("int")),
    }


# Groups of each variant in the order they are cut out. No group but the last can hold a line
# break, so a line break separates them; the last part takes whatever is left.
_CUT_5424 = ("priority", "version", "time", "host", "app", "proc", "msgid", "data", "message")
_CUT_3164 = ("priority", "host", "tag", "proc", "message", "time")
_ORDER_3164 = (1, 3, 4, 5, 6, 2)


def parse(df: DataFrame, line: str = "value") -> DataFrame:
    """Add the parsed syslog fields of a text column.

    A line is searched once per variant and rewritten once: the rewrite yields all groups at once,
    instead of one search per field.
    """
    text = F.col(line)
    rest = r"[\s\S]*"
    new = F.regexp_replace(text, fixed.RFC5424 + rest, "\n".join(f"${i}" for i in range(1, 10)))
    old = F.regexp_replace(text, fixed.RFC3164 + rest, "\n".join(f"${i}" for i in _ORDER_3164))
    out = df.withColumn(
        "__v",
        F.when(text.rlike(fixed.RFC5424), "rfc5424")
        .when(text.rlike(fixed.RFC3164), "rfc3164")
        .otherwise("unknown"),
    ).withColumn(
        "__g",
        F.when(F.col("__v") == "rfc5424", F.split(new, "\n", 9)).when(
            F.col("__v") == "rfc3164", F.split(old, "\n", 6)
        ),
    )
    variant = F.col("__v")
    unknown = variant == "unknown"

    def group(name: str) -> Column:
        cases = None
        for label, cut in (("rfc5424", _CUT_5424), ("rfc3164", _CUT_3164)):
            if name in cut:
                value = F.get("__g", F.lit(cut.index(name)))
                is_it = variant == label
                cases = F.when(is_it, value) if cases is None else cases.when(is_it, value)
        return cases

    def given(name: str) -> Column:
        return F.nullif(F.nullif(group(name), F.lit("-")), F.lit(""))

    raw = strip(text)
    out = out.withColumn("__pri", group("priority").cast("int"))
    codes = priority(F.col("__pri"))
    return out.withColumns(
        {
            "type": F.lit("syslog"),
            "rfc_variant": variant,
            "raw_message": raw,
            "priority": F.col("__pri"),
            "facility": F.when(unknown, "unknown").otherwise(codes["facility"]),
            "facility_code": codes["facility_code"],
            "severity": F.when(unknown, "unknown").otherwise(codes["severity"]),
            "severity_code": codes["severity_code"],
            "version": group("version").try_cast("int"),
            "timestamp_original": group("time"),
            "hostname": F.when(unknown, "unknown").otherwise(group("host")),
            "tag": group("tag"),
            "app_name": group("app"),
            "process_id": given("proc"),
            "message_id": given("msgid"),
            "structured_data": given("data"),
            "message": F.when(unknown, raw).otherwise(group("message")),
            "parse_error": F.when(unknown, PARSE_ERROR),
        }
    ).drop("__v", "__g", "__pri")
