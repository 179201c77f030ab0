"""Times the headline queries and prints one JSON line.

Each query runs once to warm the JVM and is then timed to completion without collecting its rows.
"""

from __future__ import annotations

import json
import os
import time

from quaylight.plans.catalog import QUERIES
from quaylight.session import local_session

HEADLINE = (
    "redact_enrich_count",
    "syslog_parse",
    "mask_patterns",
    "pii_detect",
    "full_event_flow",
    "geo_hint",
    "store_rows",
    "event_query",
    "counts_by_type_hour",
    "payload_containment",
    "log_entry_conversion",
    "stream_grouping",
    "count_over_time",
    "sliding_count_over_time",
    "top_messages",
    "quantile_over_time",
    "counter_rate",
    "error_ratio",
    "histogram_quantile",
    "availability",
    "alert_for_duration",
    "alert_notifications",
    "windowed_duplicate_drop",
    "attempt_disposition",
    "batch_keys",
    "envelope_sink",
    "consecutive_failures",
    "slo_rules",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
