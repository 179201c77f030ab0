"""JSON payload expressions over VARIANT columns."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.functions.text import let
from quaylight.schema import col


def as_variant(text: Column) -> Column:
    return F.try_parse_json(text)


def document(df: DataFrame, name: str) -> Column:
    """The payload column as VARIANT: as it is, or parsed where it is text."""
    kind = df.schema[name].dataType
    return col(name) if isinstance(kind, T.VariantType) else as_variant(col(name))


def _key(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def field(data: Column, path: str, kind: str = "string") -> Column:
    """Value at a ``$.a.b`` path, null when absent or of another kind."""
    return F.try_variant_get(data, path, kind)


def contains(data: Column, probe: Any) -> Column:
    """Sub-document containment: every key, element and scalar of ``probe`` occurs in ``data``."""
    return F.coalesce(let(data, lambda doc: _contains(doc, probe)), F.lit(False))


def holds(doc: Column, probe: Any) -> Column:
    """``contains`` for a VARIANT column: scalars below keys are read at their whole path, in place."""
    parts = [
        _contains(doc, value) if path == "$" else _is(doc, path, value) if isinstance(value, str) else contains(F.try_variant_get(doc, path, "variant"), value)
        for path, value in _leaves("$", probe)
    ]
    return F.coalesce(reduce(and_, parts), F.lit(False))


def _leaves(path: str, probe: Any) -> list[tuple[str, Any]]:
    if isinstance(probe, dict) and probe:
        return [leaf for key, value in probe.items() for leaf in _leaves(path + _key(key)[1:], value)]
    return [(path, probe)]


def _is(doc: Column, path: str, text: str) -> Column:
    """A string at a path; its kind is asked for only where the text is the same."""
    same = F.try_variant_get(doc, path, "string") == F.lit(text)
    return same & (F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING")


def _containing(value: Any):
    return lambda item: contains(item, value)


def _contains(doc: Column, probe: Any) -> Column:
    # Values are compared first: naming the kind of a value costs more than reading it. A key or
    # element lookup already fails on a value of the wrong kind, so only empty probes ask for it.
    kind = F.schema_of_variant(doc)
    if isinstance(probe, dict):
        parts = [
            contains(F.try_variant_get(doc, _key(key), "variant"), value)
            for key, value in probe.items()
        ]
        return reduce(and_, parts) if parts else kind.startswith("OBJECT")
    if isinstance(probe, list):
        items = F.try_variant_get(doc, "$", "array<variant>")
        parts = [F.exists(items, _containing(value)) for value in probe]
        return reduce(and_, parts) if parts else kind.startswith("ARRAY")
    if isinstance(probe, bool):
        return (F.try_variant_get(doc, "$", "boolean") == F.lit(probe)) & (kind == "BOOLEAN")
    if isinstance(probe, (int, float)):
        same = F.try_variant_get(doc, "$", "double") == F.lit(float(probe))
        return same & ~kind.isin("STRING", "BOOLEAN", "VOID")
    if probe is None:
        return kind == "VOID"
    return (F.try_variant_get(doc, "$", "string") == F.lit(probe)) & (kind == "STRING")


def salvage(text: Column) -> Column:
    """JSON value of a free text: the whole text, else its outermost ``{...}`` part."""
    return F.coalesce(
        F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    )
