"""Metric queries over samples: counters, gauges, histograms, objectives and recording rules.

Values are evaluated on a grid; the value at time t covers ``(t - range, t]``. Counter increases
count every step between neighbouring samples (a drop is a reset) and are not extrapolated to the
edges of the range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions.times import step_number
from quaylight.operators.logs import select_streams
from quaylight.operators.series import (
    joined_on, label_key, per_step, sliding, steps_of, with_eval_time,
)
from quaylight.schema import col
from quaylight.session import cut_lineage


def select_series(
    samples: DataFrame, name: str | Sequence[str], by: Sequence[str] = (), **matchers
) -> DataFrame:
    """Samples of metrics under label matchers: (series, labels of ``by``, ts, value).

    ``series`` is the canonical text of the whole label set; counters are differenced per series
    before anything is summed over labels. Several names keep ``name`` as a column.
    """
    many = not isinstance(name, str)
    chosen = F.col("name").isin(*name) if many else F.col("name") == name
    df = select_streams(samples.where(chosen), **matchers)
    return df.select(
        *(["name"] if many else []),
        label_key(F.col("labels")).alias("series"),
        *[F.col("labels")[b].alias(b) for b in by],
        "ts",
        "value",
    )


def _delta(value: Column, before: Column) -> Column:
    """Counter growth between neighbours: a drop means a restart from zero."""
    return F.when(before.isNull(), F.lit(0.0)).when(value < before, value).otherwise(value - before)


def increase_per_step(series: DataFrame, keys: Sequence[str], step_seconds: int) -> DataFrame:
    """Counter growth per (series, step).

    Neighbours inside a step are compared within that step; the pair that straddles two steps is
    compared between per-step summaries. No task ever orders the raw samples of a whole series.
    """
    rows = series.withColumn("step", step_number(F.col("ts"), step_seconds))
    near = Window.partitionBy(*keys, "step").orderBy("ts")
    rows = rows.withColumn("delta", _delta(F.col("value"), F.lag("value").over(near)))
    cells = rows.groupBy(*keys, "step").agg(
        F.sum("delta").alias("inner"),
        F.min_by("value", "ts").alias("first"),
        F.max_by("value", "ts").alias("last"),
        F.min("ts").alias("first_ts"),
        F.max(F.when(F.col("delta") > 0, F.col("ts"))).alias("grew_at"),
    )
    along = Window.partitionBy(*keys).orderBy("step")
    edge = _delta(F.col("first"), F.lag("last").over(along))
    return cells.withColumn("edge", edge).select(
        *keys,
        "step",
        (F.col("inner") + F.col("edge")).alias("increase"),
        F.greatest("grew_at", F.when(F.col("edge") > 0, F.col("first_ts"))).alias("grew_at"),
    )


def increase(
    series: DataFrame,
    range_seconds: int,
    keys: Sequence[str] = ("series",),
    step_seconds: int | None = None,
) -> DataFrame:
    step = step_seconds or range_seconds
    cells = increase_per_step(series, keys, step).drop("grew_at")
    out = sliding(cells, keys, steps_of(range_seconds, step), {"increase": "sum"})
    return with_eval_time(out, step)


def rate(
    series: DataFrame,
    range_seconds: int,
    keys: Sequence[str] = ("series",),
    step_seconds: int | None = None,
) -> DataFrame:
    """Growth per second."""
    out = increase(series, range_seconds, keys, step_seconds)
    return out.withColumn("rate", F.col("increase") / F.lit(float(range_seconds))).drop("increase")


def sum_by(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over series per label values and evaluation time."""
    return df.groupBy(*by, "eval_ts").agg(F.sum(value).alias(value))


def histogram_quantile(
    df: DataFrame, q: float, keys: Sequence[str], value: str = "rate", le: str = "le"
) -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets.

    A rank in the open last bucket gives the highest finite bound; an empty histogram gives null.
    The window covers the buckets of one histogram, a fixed small number.
    """
    return histogram_quantiles(df, {"quantile": q}, keys, value, le)


def histogram_quantiles(
    df: DataFrame, wanted: Mapping[str, float], keys: Sequence[str], value: str = "rate", le: str = "le"
) -> DataFrame:
    """Several quantiles (column: rank share) of the same histograms, in one pass."""
    bound = F.when(col(le).cast("string").isin("+Inf", "Inf", "Infinity"), F.lit(float("inf"))).otherwise(
        col(le).cast("string").try_cast("double")
    )
    rows = df.withColumn("__le", bound)
    order = Window.partitionBy(*keys).orderBy("__le")
    rows = rows.withColumns(
        {
            "__low": F.lag("__le").over(order),
            "__below": F.coalesce(F.lag(value).over(order), F.lit(0.0)),
            "__total": F.max(value).over(Window.partitionBy(*keys)),
        }
    )
    start = F.coalesce("__low", F.when(F.col("__le") > 0, F.lit(0.0)).otherwise(F.col("__le")))

    def at(q: float) -> Column:
        rank = F.lit(q) * F.col("__total")
        inside = start + (F.col("__le") - start) * (rank - F.col("__below")) / (
            F.col(value) - F.col("__below")
        )
        found = (
            F.when(F.col("__le") == float("inf"), F.col("__low"))
            .when(F.col(value) == F.col("__below"), F.col("__le"))
            .otherwise(inside)
        )
        hit = (F.col(value) >= rank) & (F.col("__total") > 0)
        return F.min_by(found, F.when(hit, F.col("__le")))

    return rows.groupBy(*keys).agg(*[at(q).alias(name) for name, q in wanted.items()])


def build_histogram(
    df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]
) -> DataFrame:
    """Cumulative buckets, count and sum per key in one aggregate; rows are not multiplied."""
    names = [repr(float(b)) for b in bounds] + ["+Inf"]
    counts = [F.count_if(col(value) <= b).alias(f"__b{i}") for i, b in enumerate(bounds)]
    counts.append(F.count(value).alias(f"__b{len(bounds)}"))
    agg = df.groupBy(*keys).agg(
        *counts, F.count(value).alias("count"), F.sum(value).alias("sum")
    )
    buckets = F.array(
        *[
            F.struct(F.lit(n).alias("le"), F.col(f"__b{i}").alias("bucket"))
            for i, n in enumerate(names)
        ]
    )
    return agg.select(*keys, "count", "sum", F.inline(buckets))


def avg_over_time(
    series: DataFrame,
    range_seconds: int,
    keys: Sequence[str] = ("series",),
    step_seconds: int | None = None,
) -> DataFrame:
    """Mean of the samples in the range, from per-step sums and counts."""
    step = step_seconds or range_seconds
    cells = per_step(
        series, keys, step, [F.sum("value").alias("s"), F.count("value").alias("n")]
    )
    out = sliding(cells, keys, steps_of(range_seconds, step), {"s": "sum", "n": "sum"})
    return with_eval_time(out.select(*keys, "step", (F.col("s") / F.col("n")).alias("avg")), step)


def error_ratio(
    requests: DataFrame,
    range_seconds: int,
    by: Sequence[str] = (),
    status: str = "status",
    step_seconds: int | None = None,
) -> DataFrame:
    """Share of 5xx growth in all growth, summed over series first."""
    grown = increase(requests, range_seconds, ("series", *dict.fromkeys([*by, status])), step_seconds)
    bad = F.when(col(status).rlike(r"\A5..\z"), F.col("increase")).otherwise(F.lit(0.0))
    out = grown.groupBy(*by, "eval_ts").agg(
        F.sum(bad).alias("errors"), F.sum("increase").alias("requests")
    )
    return out.withColumn(
        "error_ratio", F.when(F.col("requests") > 0, F.col("errors") / F.col("requests"))
    )


def success_ratio(
    samples: DataFrame,
    written: str,
    failed: str,
    range_seconds: int,
    by: Sequence[str] = ("sink",),
    step_seconds: int | None = None,
) -> DataFrame:
    """written / (written + failed) growth per label values, both metrics in one pass."""
    series = select_series(samples, [written, failed], by)
    grown = increase(series, range_seconds, ("name", "series", *by), step_seconds)
    ok = F.sum(F.when(F.col("name") == written, F.col("increase")).otherwise(F.lit(0.0)))
    out = grown.groupBy(*by, "eval_ts").agg(ok.alias("written"), F.sum("increase").alias("total"))
    return out.withColumn(
        "success_ratio", F.when(F.col("total") > 0, F.col("written") / F.col("total"))
    ).drop("written", "total")


def gauge_growth(
    series: DataFrame,
    range_seconds: int,
    keys: Sequence[str] = ("series",),
    step_seconds: int | None = None,
) -> DataFrame:
    """(last - first) / range of a gauge."""
    step = step_seconds or range_seconds
    cells = per_step(
        series,
        keys,
        step,
        [
            F.min(F.struct("ts", "value")).alias("first"),
            F.max(F.struct("ts", "value")).alias("last"),
        ],
    )
    out = sliding(cells, keys, steps_of(range_seconds, step), {"first": "min", "last": "max"})
    growth = (F.col("last.value") - F.col("first.value")) / F.lit(float(range_seconds))
    return with_eval_time(out.withColumn("growth", growth).drop("first", "last"), step)


def seconds_since_growth(
    series: DataFrame, as_of: str, keys: Sequence[str] = ("series",), step_seconds: int = 3600
) -> DataFrame:
    """Seconds between ``as_of`` and the last growth of each counter; null if it never grew."""
    at = F.lit(as_of).cast("timestamp")
    grown = increase_per_step(series.where(F.col("ts") <= at), keys, step_seconds)
    last = grown.groupBy(*keys).agg(F.max("grew_at").alias("last"))
    micros = F.unix_micros(at) - F.unix_micros("last")
    return last.select(*keys, (micros / 1_000_000.0).alias("seconds_since"))


def latest(series: DataFrame, as_of: str, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Most recent value of each series at ``as_of``."""
    at = F.lit(as_of).cast("timestamp")
    return (
        series.where(F.col("ts") <= at)
        .groupBy(*keys)
        .agg(F.max(F.struct("ts", "value")).alias("m"))
        .select(*keys, F.col("m.value").alias("value"))
    )


def threshold(df: DataFrame, value: str, op: str, limit: float, scale: float = 1.0) -> DataFrame:
    """Rows whose ``value / scale`` meets a comparison."""
    c = col(value) / F.lit(scale) if scale != 1.0 else col(value)
    tests = {
        "==": c == limit, "!=": c != limit, ">": c > limit,
        ">=": c >= limit, "<": c < limit, "<=": c <= limit,
    }
    return df.where(tests[op])


def record(
    df: DataFrame,
    name: str,
    value: str,
    by: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
    ts: str = "eval_ts",
    series: str | None = None,
) -> DataFrame:
    """A derived series in sample shape: its labels are ``by`` columns plus static ones.

    With ``series`` (a column of ``select_series``) it keeps the whole label set of its input as well, so that
    two inputs never give two samples of equal name, labels and time; static labels win.
    """
    entries = F.array(
        *[F.struct(F.lit(b).alias("key"), col(b).alias("value")) for b in by],
        *[
            F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
            for k, v in (labels or {}).items()
        ],
    )
    label_map = (
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        if by or labels
        else F.create_map().cast("map<string,string>")
    )
    if series:
        own = F.coalesce(F.from_json(col(series), "map<string,string>"), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(own, lambda k, _v: ~F.array_contains(F.map_keys(label_map), k))
        label_map = F.map_concat(kept, label_map)
    return df.select(
        col(ts).alias("ts"),
        F.lit(name).alias("name"),
        label_map.alias("labels"),
        col(value).cast("double").alias("value"),
    )


def union_rules(rules: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


#: Samples that one task orders at once, whatever the input: the number of tasks follows the samples.
SAMPLES = 1 << 20


def _series_keys(rows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Column, int]:
    """The series (name, series, labels of ``by``), stored with a number each (``key``); that number of a sample; all samples."""
    named = rows.groupBy("name", "series", *by).agg(F.count(F.lit(1)).alias("samples"))
    for salt in count():
        key = F.xxhash64(F.lit(salt), "name", "series")
        found = cut_lineage(named.withColumn("key", key))
        if found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty():
            return found, key, found.agg(F.sum("samples")).first()[0] or 0
    raise AssertionError


def rule_cells(samples: DataFrame, steps: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """A whole set of rules from one ordering of the samples, stored: all rules read the cells.

    ``steps`` gives each metric's step in seconds. A cell is (name, series, step) with the labels of ``by``: ``sum``
    and ``n`` of its values, and ``increase``, its growth as a counter (see ``increase_per_step``). Only numbers are
    shuffled and ordered: a first pass gathers the series, and their texts come back to the cells.
    """
    rows = select_series(samples, list(steps), by)
    sizes = sorted(set(steps.values()))
    step = F.coalesce(
        *[F.when(F.col("name").isin(*[n for n, s in steps.items() if s == size]), step_number(F.col("ts"), size)) for size in sizes]
    )
    # The labels follow from the series, so the series alone tells cells apart.
    series, key, total = _series_keys(rows, by)
    tasks = max(samples.sparkSession.sparkContext.defaultParallelism, -(-total // SAMPLES))
    rows = rows.select(step.alias("step"), key.alias("key"), "ts", "value").repartition(tasks, "step", "key")
    near = Window.partitionBy("step", "key").orderBy("ts")
    rows = rows.withColumn("delta", _delta(F.col("value"), F.lag("value").over(near)))
    cells = rows.groupBy("step", "key").agg(
        F.sum("value").alias("sum"),
        F.count("value").alias("n"),
        F.sum("delta").alias("inner"),
        F.min_by("value", "ts").alias("first"),
        F.max_by("value", "ts").alias("last"),
    )
    along = Window.partitionBy("key").orderBy("step")
    edge = _delta(F.col("first"), F.lag("last").over(along))
    cells = cells.withColumn("increase", F.col("inner") + edge).join(series, "key")
    return cut_lineage(cells.select("name", "series", "step", *by, "sum", "n", "increase"))


def slo_rules(samples: DataFrame, prefix: str = "slo", metric: str = "ingest", job: str | None = None) -> DataFrame:
    """The recording rules of the service objectives, from one ordering of the samples."""
    names = {op: f"{op}_seconds_bucket" for op in dict.fromkeys((metric, "pipeline", "sink_write"))}
    if job:
        samples = samples.where((F.col("name") != "up") | (F.col("labels")["job"] == job))
    cells = rule_cells(samples, {"up": 60, "requests_total": 300, **dict.fromkeys(names.values(), 300)}, ("le", "sink", "status"))
    rules = []

    up = cells.where("name = 'up'")
    for r, s, tag in ((300, 60, "5m"), (3600, 300, "1h"), (86400, 3600, "1d")):
        coarse = up.groupBy("series", F.ceil(F.col("step") * 60 / s).alias("step")).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        ranged = sliding(coarse, ("series",), steps_of(r, s), {"sum": "sum", "n": "sum"})
        values = with_eval_time(ranged.withColumn("avg", F.col("sum") / F.col("n")), s)
        rules.append(record(values, f"{prefix}:availability:rate{tag}", "avg", labels={"slo": "availability"}, series="series"))

    # Growth is summed over series before ranges are put together: far fewer cells, the same sums.
    buckets = cells.where(F.col("name").isin(*names.values())).groupBy("name", "le", "sink", "step").agg(F.sum("increase").alias("rate"))
    hour = sliding(buckets.where(F.col("name") == names[metric]), ("name", "le", "sink"), 12, {"rate": "sum"})
    for rates, tag, ops in ((buckets, "5m", names), (hour, "1h", (metric,))):
        found = histogram_quantiles(rates, {"95": 0.95, "99": 0.99}, ("name", "sink", "step"))
        found = with_eval_time(found, 300)
        for op in ops:
            for q in ("95", "99") if op == metric else ("95",):
                rules.append(
                    record(found.where(F.col("name") == names[op]), f"{prefix}:latency_p{q}:{op}:rate{tag}", q, ("sink",),
                           {"slo": "latency", "operation": op, "quantile": q})
                )

    bad = F.when(F.col("status").rlike(r"\A5..\z"), F.col("increase")).otherwise(F.lit(0.0))
    requests = cells.where("name = 'requests_total'").groupBy("step").agg(F.sum(bad).alias("errors"), F.sum("increase").alias("requests"))
    ratio = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests"))
    errors = with_eval_time(requests.withColumn("error_ratio", ratio), 300)
    rules.append(record(errors, f"{prefix}:error_rate:http:rate5m", "error_ratio", labels={"slo": "error_rate", "type": "http"}))
    return union_rules(rules)


def fast_burn(
    availability: DataFrame,
    latency: DataFrame,
    errors: DataFrame,
    slo: float = fixed.SLO_AVAILABILITY,
    latency_limit: float = fixed.SLO_LATENCY_P95,
    error_limit: float = fixed.SLO_ERROR_RATE,
    factor: float = fixed.FAST_BURN,
    on: Sequence[str] = (),
) -> DataFrame:
    """Evaluation times at which any of the three budgets burns; missing series do not burn.

    Inputs are (eval_ts, value) and the labels ``on``. Of several series with equal labels the worst counts,
    which is what "any burns" asks; so there is one row per evaluation time and labels, and no pairs.
    """
    keys = ["eval_ts", *on]
    a = availability.groupBy(*keys).agg(F.min("value").alias("availability"))
    b = latency.groupBy(*keys).agg(F.max("value").alias("latency"))
    c = errors.groupBy(*keys).agg(F.max("value").alias("errors"))
    joined = joined_on(joined_on(a, b, keys, "full"), c, keys, "full")
    burning = (
        F.coalesce((1 - F.col("availability")) > factor * (1 - slo), F.lit(False))
        | F.coalesce(F.col("latency") > latency_limit, F.lit(False))
        | F.coalesce(F.col("errors") > error_limit, F.lit(False))
    )
    return joined.withColumn("burning", burning)


def burn_rules(rules: DataFrame, prefix: str = "slo", metric: str = "ingest") -> DataFrame:
    """The two burn series over already recorded rules: 1 where a budget burns, else 0."""
    def of(name: str) -> DataFrame:
        return rules.where(F.col("name") == f"{prefix}:{name}").select(F.col("ts").alias("eval_ts"), "value")

    fast = fast_burn(of("availability:rate1h"), of(f"latency_p95:{metric}:rate1h"), of("error_rate:http:rate5m"))
    worst = of("availability:rate1d").groupBy("eval_ts").agg(F.min("value").alias("value"))
    parts = (("fast:4h", "fast", fast), ("slow:30d", "slow", slow_burn(worst)))
    return union_rules(
        [
            record(df.withColumn("value", F.col("burning").cast("double")), f"{prefix}:error_budget_burn:{name}", "value",
                   labels={"slo": "error_budget_burn", "window": window})
            for name, window, df in parts
        ]
    )


def slow_burn(
    availability: DataFrame, slo: float = fixed.SLO_AVAILABILITY, factor: float = fixed.SLOW_BURN
) -> DataFrame:
    return availability.withColumn("burning", (1 - F.col("value")) > factor * (1 - slo))


RELIABILITY_COUNTERS = (
    "sink_retry_total", "sink_error_total", "sink_timeout_total",
    "sink_circuit_open_total", "sink_dlq_total",
)


def reliability_rates(
    samples: DataFrame,
    names: Sequence[str] = RELIABILITY_COUNTERS,
    range_seconds: int = 60,
    step_seconds: int | None = None,
) -> DataFrame:
    """Per-second growth of the reliability counters per sink, all in one pass."""
    series = select_series(samples, list(names), ("sink",))
    grown = rate(series, range_seconds, ("name", "series", "sink"), step_seconds)
    return grown.groupBy("name", "sink", "eval_ts").agg(F.sum("rate").alias("rate"))
