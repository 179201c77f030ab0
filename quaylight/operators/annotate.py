"""Externally produced annotations: prompt shape, validation and the confidence-gated merge.

No model is called; annotations arrive as a table keyed by event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight import fixed
from quaylight.functions.payload import salvage
from quaylight.operators.enrich import merge_tags
from quaylight.schema import col, present


def _truthy(c: Column, dtype: T.DataType) -> Column:
    """Null for the values that count as empty: empty text, empty collections, zero, false."""
    if isinstance(dtype, T.StringType):
        return F.when(c != "", c)
    if isinstance(dtype, (T.MapType, T.ArrayType)):
        return F.when(F.size(c) > 0, c)
    if isinstance(dtype, T.NumericType):
        return F.when(c != 0, c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, c)
    return c


def prompt_text(df: DataFrame, name: str = "prompt_event") -> DataFrame:
    """JSON of the safe fields, message cut at 500 characters plus an ellipsis."""
    types = {f.name: f.dataType for f in df.schema}
    fields = []
    for f in present(df, fixed.PROMPT_FIELDS):
        c = _truthy(col(f), types[f])
        if f == "message":
            limit = fixed.PROMPT_MESSAGE_CHARS
            c = F.when(
                F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))
            ).otherwise(c)
        fields.append(c.alias(f))
    return df.withColumn(name, F.to_json(F.struct(*fields)))


def annotatable(df: DataFrame, max_chars: int = fixed.PROMPT_EVENT_CHARS) -> DataFrame:
    """Events whose whole JSON text is small enough to be annotated."""
    return df.where(F.length(F.to_json(F.struct(*[col(c) for c in df.columns]))) <= max_chars)


def parse_annotation(text: Column) -> Column:
    """VARIANT of an annotation reply; JSON inside free text is salvaged."""
    return salvage(text)


def valid_annotation(reply: Column) -> Column:
    """Confidence is a number in [0, 1]; optional parts have their declared kinds and sizes."""

    def get(key: str, kind: str) -> Column:
        return F.try_variant_get(reply, f"$.{key}", kind)

    def kind_of(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(get(key, "variant")), F.lit("ABSENT"))

    numeric = ~kind_of("confidence").isin("ABSENT", "STRING", "VOID") & ~kind_of(
        "confidence"
    ).rlike("^(ARRAY|OBJECT)")
    # A boolean is a number here: true counts as 1.
    confidence = F.coalesce(get("confidence", "double"), get("confidence", "boolean").cast("double"))
    raw_tags = get("tags", "map<string,variant>")
    tags_ok = (kind_of("tags") == "ABSENT") | (
        kind_of("tags").startswith("OBJECT")
        & F.forall(F.map_values(raw_tags), lambda v: F.schema_of_variant(v) == "STRING")
    )
    priority_ok = (kind_of("priority") == "ABSENT") | (
        (kind_of("priority") == "STRING") & get("priority", "string").isin(*fixed.PRIORITIES)
    )
    summary_ok = (kind_of("summary") == "ABSENT") | (
        (kind_of("summary") == "STRING")
        & (F.length(get("summary", "string")) <= fixed.SUMMARY_CHARS)
    )
    is_object = F.schema_of_variant(reply).startswith("OBJECT")
    ok = (
        is_object & numeric & confidence.between(0.0, 1.0) & tags_ok & priority_ok & summary_ok
    )
    return F.coalesce(ok, F.lit(False))


def annotation_fields(reply: Column) -> Column:
    """Typed struct of a valid reply."""
    return F.struct(
        F.coalesce(
            F.try_variant_get(reply, "$.confidence", "double"),
            F.try_variant_get(reply, "$.confidence", "boolean").cast("double"),
        ).alias("confidence"),
        F.try_variant_get(reply, "$.tags", "map<string,string>").alias("tags"),
        F.try_variant_get(reply, "$.category", "string").alias("category"),
        F.try_variant_get(reply, "$.priority", "string").alias("priority"),
        F.try_variant_get(reply, "$.summary", "string").alias("summary"),
    )


def merge_annotations(
    events: DataFrame,
    annotations: DataFrame,
    on: str,
    model: str = "",
    as_of: Column | None = None,
    threshold: float = fixed.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Left join on the event id; only annotations at or above the threshold change an event.

    ``annotations`` holds the id and one struct column ``annotation`` of the declared fields.
    Weak annotations are dropped before the join, so they are not shuffled. Of several for one
    event the most confident counts; they are combined before the shuffle the join needs anyway.
    """
    best = F.struct("annotation.confidence", "annotation.category", "annotation.summary")
    strong = (
        annotations.where(F.col("annotation.confidence") >= threshold)
        .groupBy(on)
        .agg(F.max_by("annotation", best).alias("annotation"))
    )
    out = events.join(strong, on, "left")
    a = F.col("annotation")
    used = a.isNotNull()
    no_tags = F.create_map().cast("map<string,string>")
    prefixed = F.transform_keys(
        F.coalesce(a["tags"], no_tags), lambda k, _v: F.concat(F.lit("llm_"), k)
    )
    tags = col("tags") if "tags" in events.columns else F.lit(None).cast("map<string,string>")
    return out.withColumns(
        {
            "tags": F.when(
                used & a["tags"].isNotNull(), merge_tags(F.coalesce(tags, no_tags), prefixed)
            ).otherwise(tags),
            "llm_enrichment": F.when(
                used,
                F.struct(
                    F.lit(model).alias("model"),
                    a["confidence"].alias("confidence"),
                    (as_of if as_of is not None else F.lit(None)).cast("timestamp").alias("timestamp"),
                ),
            ),
            "llm_category": a["category"],
            "llm_priority": a["priority"],
            "llm_summary": a["summary"],
        }
    ).drop("annotation")
