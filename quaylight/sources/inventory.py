"""Host inventories from collected socket listings and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.operators.series import joined_on
from quaylight.functions.text import strip


def listener(line: Column) -> Column:
    """struct(proto, local, proc) of one socket line; null with fewer than five fields."""
    parts = F.split(strip(line), r"\s+")
    last = F.element_at(parts, -1)
    return F.when(
        F.size(parts) >= 5,
        F.struct(
            F.get(parts, F.lit(0)).alias("proto"),
            F.get(parts, F.lit(4)).alias("local"),
            F.when(last.startswith("users:"), last).alias("proc"),
        ),
    )


def listeners(output: Column) -> Column:
    """All listeners of one collected listing, header line skipped. Stays within the row."""
    lines = F.split(output, r"\r?\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_compact(F.transform(body, listener))


def known_logs(files: DataFrame, path: str = "path", extra: Sequence[str] = ()) -> DataFrame:
    """Rows of a file listing that are well-known log files.

    The list is short and constant, so it is a filter that reaches the scan rather than a join.
    """
    return files.where(F.col(path).isin(*fixed.KNOWN_LOGS, *extra))


def inventory(
    listings: DataFrame,
    files: DataFrame,
    host: str = "host",
    output: str = "output",
    snapshot: str | None = None,
) -> DataFrame:
    """One inventory event per host, or per host and ``snapshot`` where both inputs have that column.

    A host known from one input only is reported with the other part empty. Sets are bounded by ports and by
    the known-log list within a snapshot.
    """
    keys = [host, *([snapshot] if snapshot else [])]
    logs = known_logs(files).groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("log_candidates"))
    items = listings.select(*keys, F.explode_outer(listeners(F.col(output))).alias("l"))
    socks = items.groupBy(*keys).agg(F.array_sort(F.collect_set("l")).alias("listeners"))
    found = joined_on(socks, logs, keys, "full")
    return found.select(
        F.lit("host_service_inventory").alias("type"),
        *keys,
        F.coalesce("listeners", F.array().cast(socks.schema["listeners"].dataType)).alias("listeners"),
        F.coalesce("log_candidates", F.array().cast("array<string>")).alias("log_candidates"),
    )
