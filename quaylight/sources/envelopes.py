"""Envelope source: batched JSON documents to one row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight import schema
from quaylight.schema import col


def read(
    spark: SparkSession, path: str, event_struct: str = schema.EVENT_STRUCT, stream: bool = False, **options
) -> DataFrame:
    """Envelope files under a declared message type; unreadable documents keep their text.

    With ``event_struct`` ``VARIANT`` nothing is declared: see :func:`open_messages`.
    """
    reader = spark.readStream if stream else spark.read
    return (
        reader.schema(schema.envelope(event_struct) + ", _corrupt_record STRING")
        .option("mode", "PERMISSIVE")
        .options(**options)
        .json(path)
    )


def parse(df: DataFrame, text: Column, event_struct: str = schema.EVENT_STRUCT) -> DataFrame:
    """Envelope columns from JSON text, e.g. a message queue value; unreadable text is kept."""
    shape = schema.envelope(event_struct) + ", _corrupt_record STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return df.select(F.from_json(text, shape, options).alias("e")).select("e.*")


def messages(envelopes: DataFrame, *keep: str) -> DataFrame:
    """One row per message."""
    return envelopes.select(*keep, F.explode("messages").alias("m")).select(*keep, "m.*")


def open_messages(envelopes: DataFrame, event: str = schema.EVENT, payload: str = "data") -> DataFrame:
    """One row per message of envelopes whose messages are VARIANT; no key is lost.

    Declared keys become columns. All others go into ``payload`` as JSON text, beside what the message itself
    holds there (its own keys win). A payload that is not an object stays as it is under its own name.
    """
    fields = [(f.name, f.dataType) for f in T.StructType.fromDDL(event)]
    m = F.col("m")
    keys = F.try_variant_get(m, "$", "map<string,variant>")
    declared = [
        F.try_variant_get(m, f"$['{name}']", kind.simpleString()).alias(name) for name, kind in fields if name != payload
    ]
    extra = F.map_filter(keys, lambda k, _v: ~k.isin(*[name for name, _ in fields]))
    own = F.try_variant_get(m, f"$['{payload}']", "map<string,variant>")
    plain = F.map_filter(keys, lambda k, _v: k == payload)
    none = F.create_map().cast("map<string,variant>")
    inner = F.when(own.isNotNull(), own).otherwise(F.coalesce(F.map_filter(plain, lambda _k, v: ~F.is_variant_null(v)), none))
    merged = F.map_concat(F.map_filter(F.coalesce(extra, none), lambda k, _v: ~F.array_contains(F.map_keys(inner), k)), inner)
    data = F.when(F.size(merged) > 0, F.to_json(merged)).alias(payload)
    return envelopes.select(F.explode("messages").alias("m")).select(*declared, data)


def split_valid(events: DataFrame, required: str = "type") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the required field must be present."""
    return events.where(col(required).isNotNull()), events.where(col(required).isNull())


def rejects(envelopes: DataFrame, events: DataFrame, required: str = "type") -> DataFrame:
    """(reason, payload): documents that could not be read, and messages without the required field."""
    broken = envelopes.where("_corrupt_record IS NOT NULL").select(F.lit("corrupt document").alias("reason"), F.col("_corrupt_record").alias("payload"))
    _, missing = split_valid(events, required)
    return broken.unionByName(missing.select(F.lit(f"no {required}").alias("reason"), F.to_json(F.struct("*")).alias("payload")))
