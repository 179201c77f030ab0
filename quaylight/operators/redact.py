"""Field dropping, pattern masking, field hashing and personal-data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight import fixed
from quaylight.functions.text import FINDINGS, hash_text, hits_sql, json_hits_sql, literal, mask_json_sql, mask_sql, printed
from quaylight.schema import col, holds_text, leaves_sql, quoted, rewrite_sql

#: Columns of JSON text of undeclared shape.
JSON_COLUMNS = ("data",)


def drop_fields(df: DataFrame, names: Sequence[str], payload: str | None = None) -> DataFrame:
    """Drop top-level columns; with ``payload`` also those keys of a map column."""
    out = df.drop(*names)
    if payload and payload in out.columns:
        out = out.withColumn(
            payload, F.map_filter(col(payload), lambda k, _v: ~k.isin(*names))
        )
    return out


def mask_patterns(
    df: DataFrame,
    patterns: Sequence[str] = fixed.MASK_PATTERNS,
    mask_char: str = "*",
    mask_length: int = 8,
    columns: Sequence[str] | None = None,
    unicode: bool = True,
    json_columns: Sequence[str] = JSON_COLUMNS,
) -> DataFrame:
    """Mask every string of the declared schema, however deeply nested.

    Top-level columns of JSON text (``json_columns``) stay JSON: only the string values in it are masked.
    """
    names = set(columns if columns is not None else df.columns)

    def cover(text: str) -> str:
        return mask_sql(text, patterns, mask_char, mask_length, unicode)

    def cover_json(text: str) -> str:
        return mask_json_sql(text, patterns, mask_char, mask_length, unicode)

    changed = {
        f.name: F.expr(rewrite_sql(quoted(f.name), f.dataType, cover_json if f.name in json_columns else cover))
        for f in df.schema
        if f.name in names and holds_text(f.dataType)
    }
    return df.withColumns(changed) if changed else df


def hash_fields(
    df: DataFrame,
    names: Sequence[str] = fixed.HASH_FIELDS,
    salt: str = "",
    algorithm: str = "sha256",
    preserve_original: bool = False,
) -> DataFrame:
    """Replace values by their salted digest; nulls stay null."""
    types = {f.name: f.dataType for f in df.schema}
    changed: dict[str, Column] = {}
    for name in names:
        if name in types:
            changed[name] = hash_text(printed(col(name), types[name]), salt, algorithm)
            if preserve_original:
                changed[f"{name}_original"] = col(name)
    return df.withColumns(changed) if changed else df


def redact(df: DataFrame, config: Mapping) -> DataFrame:
    """Drop, then mask, then hash; each step only when configured."""
    if config.get("drop_fields"):
        df = drop_fields(df, config["drop_fields"])
    if config.get("mask_patterns"):
        df = mask_patterns(
            df,
            config["mask_patterns"],
            config.get("mask_char", "*"),
            config.get("mask_length", 8),
        )
    if config.get("hash_fields"):
        df = hash_fields(
            df,
            config["hash_fields"],
            config.get("salt", ""),
            config.get("hash_algorithm", "sha256"),
            config.get("preserve_original", False),
        )
    return df


def detect_pii(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    patterns: Sequence[tuple[str, str]] = fixed.PII_PATTERNS,
    name: str = "pii_findings",
    unicode: bool = True,
    json_columns: Sequence[str] = JSON_COLUMNS,
) -> DataFrame:
    """Add an array of ``struct(path, type, text)``, one per (string, matching pattern).

    Columns of JSON text (``json_columns``) are walked by value: ``data.user.mail``, not ``data``.
    """
    wanted = set(columns if columns is not None else df.columns)
    walked = [f.name for f in df.schema if f.name in wanted and f.name in json_columns and isinstance(f.dataType, T.StringType)]
    leaves = [
        f"coalesce({leaf}, cast(array() AS array<struct<path:string,text:string>>))"
        for f in df.schema
        if f.name in wanted and f.name not in walked
        for leaf in leaves_sql(quoted(f.name), f.dataType, literal(f.name))
    ]
    found = [json_hits_sql(quoted(c), c, patterns, unicode) for c in walked]
    if leaves:
        hits = hits_sql("x.text", "x.path", patterns, unicode)
        found.insert(0, f"flatten(transform(concat({', '.join(leaves)}), x -> {hits}))")
    if not found:
        return df.withColumn(name, F.array().cast(FINDINGS))
    return df.withColumn(name, F.expr(found[0] if len(found) == 1 else f"concat({', '.join(found)})"))


def pii_flag(df: DataFrame, name: str = "pii_findings", flag: str = "quarantined") -> DataFrame:
    """Every row with whether it has findings: written partitioned by the flag, good rows and quarantine
    come from one detection."""
    return df.withColumn(flag, F.coalesce(F.size(col(name)), F.lit(0)) > 0)


def pii_gate(
    df: DataFrame, strict: bool = True, name: str = "pii_findings"
) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows for quarantine; a lax gate passes everything, findings attached."""
    # Coalesced: a bare size would add a null test, and with it a second run of the detection.
    found = F.coalesce(F.size(col(name)), F.lit(0)) > 0
    if not strict:
        return df, df.where(F.lit(False))
    return df.where(~found), df.where(found)


def explode_pii(df: DataFrame, name: str = "pii_findings") -> DataFrame:
    """One row per finding. The outer form keeps the optimizer from adding an emptiness filter,
    which would run the detection twice."""
    rows = df.withColumn("__f", F.explode_outer(name)).where(F.col("__f").isNotNull())
    return rows.select(*[c for c in df.columns if c != name], "__f.*")


def pii_summary(df: DataFrame, name: str = "pii_findings") -> DataFrame:
    """Findings and affected rows per type."""
    kinds = df.select(F.transform(col(name), lambda f: f["type"]).alias("kinds"))
    counted = F.transform(
        F.array_distinct("kinds"),
        lambda k: F.struct(
            k.alias("type"), F.size(F.filter("kinds", lambda other: other == k)).alias("n")
        ),
    )
    rows = kinds.select(F.explode_outer(counted).alias("k")).where(F.col("k").isNotNull())
    return rows.groupBy("k.type").agg(
        F.sum("k.n").alias("findings"), F.count("*").alias("events")
    )
