"""Composition of steps. A step maps an event DataFrame to an event DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.operators import annotate, enrich, redact
from quaylight.schema import col
from quaylight.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply steps in order; the result is one plan."""
    return reduce(DataFrame.transform, steps, df)


def fail_safe(df: DataFrame, name: str, new: Column) -> DataFrame:
    """Rewrite a column, keeping the old value where the new expression gives nothing."""
    return df.withColumn(name, F.coalesce(new, col(name)))


def with_audit(df: DataFrame, step: str, action: str, name: str = "audit") -> DataFrame:
    """Append a (step, action) entry to the audit column, creating it when missing."""
    entry = F.array(F.struct(F.lit(step).alias("step"), F.lit(action).alias("action")))
    if name not in df.columns:
        return df.withColumn(name, entry)
    return df.withColumn(name, F.concat(col(name), entry))


def observed(df: DataFrame, ok: Column) -> tuple[DataFrame, Observation]:
    """Count processed and failed rows while another action runs; no extra job.

    Filters are not moved below an observation, so what it watches is computed once, there.
    """
    seen = Observation()
    out = df.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("processed"),
        F.count_if(~ok).alias("errors"),
    )
    return out, seen


def step_stats(df: DataFrame, ok: Column) -> DataFrame:
    """Processed, failed and total rows of a step with its success rate."""
    total, good = F.count(F.lit(1)), F.count_if(ok)
    return df.agg(
        good.alias("processed"),
        (total - good).alias("errors"),
        total.alias("total"),
        F.when(total > 0, good / total).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def build_steps(
    config: Mapping,
    as_of: Column | str,
    quarantine: Callable[[DataFrame], None] | None = None,
    annotations: DataFrame | None = None,
    stats: dict[str, Observation] | None = None,
    audit: bool = False,
) -> list[Step]:
    """Configured steps in their fixed order; a block that is missing or disabled is skipped.

    Order: redaction, personal-data check, tags, severity, service, place, site, time, annotations.
    ``quarantine`` receives the events held back; ``stats`` receives the counts of the check. With ``audit`` each
    step adds its name and what it did to the ``audit`` column of the events it lets through.
    """
    steps: list[Step] = []
    done: list[tuple[str, str]] = []

    def enabled(block: str) -> Mapping | None:
        found = config.get(block)
        return found if found is not None and found.get("enabled", True) else None

    if (block := enabled("redaction")) is not None:
        steps.append(lambda df, b=block: redact.redact(df, b))
        done.append(("redaction", "redacted"))
    if (block := enabled("pii_check")) is not None:

        def check(df: DataFrame, b=block) -> DataFrame:
            found = redact.detect_pii(df)
            if not df.isStreaming:
                found, seen = observed(found, F.size("pii_findings") == 0)
                if stats is not None:
                    stats["pii_check"] = seen
            if quarantine is not None and not df.isStreaming:
                # Both outputs read one stored detection.
                found = cut_lineage(found)
            good, bad = redact.pii_gate(found, b.get("strict_mode", True))
            if quarantine is not None:
                quarantine(bad)
            return good.drop("pii_findings")

        steps.append(check)
        done.append(("pii_check", "passed"))
    if (block := enabled("enrichment")) is not None:
        geo = block.get("geo_hints", {})
        site = block.get("site_env_tags", {})
        steps += [
            lambda df, b=block: enrich.add_tags(df, b.get("add_tags", {})),
            lambda df, b=block: enrich.map_severity(
                df, b.get("severity_mapping", fixed.SEVERITY_ALIASES)
            ),
            lambda df, b=block: enrich.service_from_path(
                df, b.get("path_patterns", fixed.PATH_SERVICES)
            ),
            lambda df: enrich.geo_hint(
                df, geo.get("ip_location_map", {}), geo.get("subnet_location_map", {})
            ),
            lambda df: enrich.site_env_tags(
                df,
                site.get("site_patterns", fixed.SITE_PATTERNS),
                site.get("default_site"),
                site.get("default_env"),
            ),
            lambda df, b=block: enrich.normalise_time(
                df, as_of, b.get("timestamp_fields", fixed.TIME_FIELDS)
            ),
        ]
        done += [("add_tags", "enriched"), ("severity_map", "mapped"), ("service_from_path", "enriched")]
        done += [("geo_hint", "enriched"), ("site_env_tags", "enriched"), ("timestamp_normalizer", "normalized")]
    if (block := enabled("annotations")) is not None and annotations is not None:
        steps.append(
            lambda df, b=block: annotate.merge_annotations(
                df,
                annotations,
                b["on"],
                b.get("model", ""),
                threshold=b.get("confidence_threshold", fixed.CONFIDENCE_THRESHOLD),
            )
        )
        done.append(("annotations", "merged"))
    if not audit:
        return steps
    return [lambda df, s=step, entry=entry: with_audit(s(df), *entry) for step, entry in zip(steps, done, strict=True)]
