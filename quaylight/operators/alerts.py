"""Alert rules over evaluated series, and what becomes of the alerts they raise.

A condition is a DataFrame of the (labels, eval_ts) rows at which its expression holds. There is at
most one row per label set and evaluation time, so ordering along a label set is bounded by time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions.text import whole_match
from quaylight.functions.times import step_number
from quaylight.operators import metrics as m
from quaylight.operators.series import first_sights, label_key, matched, per_step, steps_between, with_eval_time
from quaylight.schema import col


_SERIES = ("series", "sink")


@dataclass(frozen=True)
class Rule:
    """Name, hold time and static labels of an alert."""

    name: str
    hold_seconds: int = 0
    labels: Mapping[str, str] = field(default_factory=dict)


def evaluate(
    condition: DataFrame, rule: Rule, keys: Sequence[str], step_seconds: int
) -> DataFrame:
    """State of the alert at every evaluation: ``firing`` once it held for ``hold_seconds``.

    Consecutive evaluations form a run; a missing evaluation starts a new one.
    """
    step = F.call_function("div", F.unix_seconds("eval_ts"), F.lit(step_seconds))
    order = Window.partitionBy(*keys).orderBy("eval_ts")
    runs = condition.withColumn("__run", step - F.row_number().over(order))
    start = F.min("eval_ts").over(Window.partitionBy(*keys, "__run"))
    held = F.unix_seconds("eval_ts") - F.unix_seconds("__start")
    out = runs.withColumn("__start", start).withColumns(
        {
            "alertname": F.lit(rule.name),
            "state": F.when(held >= rule.hold_seconds, "firing").otherwise("pending"),
            "active_since": F.col("__start"),
        }
    )
    return out.withColumns({k: F.lit(v) for k, v in rule.labels.items()}).drop("__run", "__start")


def no_growth(grown: DataFrame) -> DataFrame:
    """Evaluations at which a known counter did not grow."""
    return grown.where(F.col("increase") == 0)


def silent(
    series: DataFrame,
    range_seconds: int,
    step_seconds: int,
    until: str,
    keys: Sequence[str] = ("series",),
) -> DataFrame:
    """Evaluations from a counter's first sample to ``until`` without growth in the range.

    Unlike ``no_growth`` this also covers times at which the counter is not sampled at all.
    """
    grown = m.increase(series, range_seconds, keys, step_seconds).where(F.col("increase") > 0)
    last = step_number(F.lit(until).cast("timestamp"), step_seconds)
    first = series.groupBy(*keys).agg(step_number(F.min("ts"), step_seconds).alias("first"))
    # A series first seen after ``until`` has no evaluation yet.
    steps = steps_between(first, F.col("first"), last, keys)
    return matched(with_eval_time(steps, step_seconds), grown, [*keys, "eval_ts"], "left_anti")


def both(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """``left and on(...) right``: left rows with a right row at the same time and labels."""
    return matched(left, right, ["eval_ts", *on], "left_semi")


def unless(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Left rows without a right row at the same time and labels."""
    return matched(left, right, ["eval_ts", *on], "left_anti")


def either(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """All left rows, and the right rows that have no left row at the same time and labels."""
    return left.unionByName(unless(right, left, on), allowMissingColumns=True)


def latency_rule(
    buckets: DataFrame,
    rule: Rule,
    q: float = 0.95,
    limit: float = 1.0,
    by: Sequence[str] = (),
    range_seconds: int = 300,
    step_seconds: int = 60,
) -> DataFrame:
    """Histogram quantile above a limit, held."""
    rates = m.sum_by(m.rate(buckets, range_seconds, ("series", "le", *by), step_seconds), "rate", ("le", *by))
    values = m.histogram_quantile(rates, q, (*by, "eval_ts"))
    return evaluate(values.where(F.col("quantile") > limit), rule, by, step_seconds)


def error_rule(
    requests: DataFrame, rule: Rule, limit: float = 0.1, range_seconds: int = 300, step_seconds: int = 60
) -> DataFrame:
    ratio = m.error_ratio(requests, range_seconds, step_seconds=step_seconds)
    return evaluate(ratio.where(F.col("error_ratio") > limit), rule, (), step_seconds)


def down_rule(
    up: DataFrame, rule: Rule, keys: Sequence[str] = ("series",), step_seconds: int = 60
) -> DataFrame:
    """Gauge at zero at the end of a step, held."""
    cells = per_step(up, keys, step_seconds, [F.max(F.struct("ts", "value")).alias("last")])
    zero = cells.where(F.col("last.value") == 0).drop("last")
    return evaluate(with_eval_time(zero, step_seconds), rule, keys, step_seconds)


def reliability_alerts(
    samples: DataFrame, step_seconds: int = 60, range_seconds: int = 300
) -> DataFrame:
    """The recommended sink alerts: open circuit, full queue, dead letters, retries, growth.

    Every series (``series``: its whole label set) is tested for itself, so of two instances of a sink one can
    fire while the other does not.
    """
    counters, gauges = ["sink_dlq_total", "sink_retry_total"], ["sink_circuit_state", "sink_queue_bytes", "sink_queue_size"]
    # Two passes over the samples, whatever the number of rules: one for counters, one for gauges.
    rates = m.rate(m.select_series(samples, counters, ("sink",)), range_seconds, ("name", *_SERIES), step_seconds)
    rates = rates.withColumnRenamed("rate", "value")
    levels = m.select_series(samples, gauges, ("sink",))
    last = per_step(levels, ("name", *_SERIES), step_seconds, [F.max(F.struct("ts", "value")).alias("v")])
    last = with_eval_time(last.withColumn("value", F.col("v.value")).drop("v"), step_seconds)
    growth = m.gauge_growth(levels.where(F.col("name") == "sink_queue_size"), range_seconds, ("name", *_SERIES), step_seconds)
    growth = growth.withColumnRenamed("growth", "value")

    critical, warning = {"severity": "critical"}, {"severity": "warning"}
    parts = [
        (last, "sink_circuit_state", ("==", 1), Rule("SinkCircuitBreakerOpen", 300, critical)),
        (last, "sink_queue_bytes", (">", 0.9, fixed.QUEUE_CAPACITY_BYTES), Rule("SinkQueueNearFull", 600, critical)),
        (rates, "sink_dlq_total", (">", 0.01), Rule("HighDeadLetterQueueRate", 300, critical)),
        (rates, "sink_retry_total", (">", 0.1), Rule("HighSinkRetryRate", 600, warning)),
        (growth, "sink_queue_size", (">", 1), Rule("SinkQueueGrowth", 900, warning)),
    ]
    return m.union_rules(
        [
            evaluate(m.threshold(values.where(F.col("name") == name), "value", *test), rule, _SERIES, step_seconds).select(
                "eval_ts", "alertname", *_SERIES, "severity", "state", "value"
            )
            for values, name, test, rule in parts
        ]
    )


def objective_alerts(
    rules: DataFrame,
    prefix: str = "slo",
    metric: str = "ingest",
    availability: float = fixed.SLO_AVAILABILITY,
    p95: float = fixed.SLO_LATENCY_P95,
    p99: float = fixed.SLO_LATENCY_P99,
    latency: float = 1.0,
) -> DataFrame:
    """Latency, availability and budget alerts over recorded series (``metrics.slo_rules`` and ``burn_rules``).

    Every recorded series is tested for itself; ``series`` is its label set, ``sink`` and ``status`` two of its labels.
    """
    critical, warning = {"severity": "critical"}, {"severity": "warning"}
    parts = [
        (f"latency_p95:{op}:rate5m", (">", latency), Rule(name, 300, warning), 300)
        for op, name in (
            (metric, "HighIngestLatency95th"),
            ("pipeline", "HighPipelineLatency95th"),
            ("sink_write", "HighSinkWriteLatency95th"),
        )
    ]
    parts += [
        (f"latency_p95:{metric}:rate5m", (">", p95), Rule("IngestLatencyP95Breach", 300, warning), 300),
        (f"latency_p99:{metric}:rate5m", (">", p99), Rule("IngestLatencyP99Breach", 300, warning), 300),
        ("availability:rate1h", ("<", availability), Rule("AvailabilityBreach", 300, critical), 300),
        ("error_budget_burn:fast:4h", ("==", 1), Rule("ErrorBudgetBurnFast", 120, critical), 300),
        ("error_budget_burn:slow:30d", ("==", 1), Rule("ErrorBudgetBurnSlow", 900, warning), 3600),
    ]
    labels = F.col("labels")
    rows = rules.select(
        F.col("ts").alias("eval_ts"), "name", label_key(labels).alias("series"), labels["sink"].alias("sink"), labels["status"].alias("status"), "value"
    )
    return m.union_rules(
        [
            evaluate(m.threshold(rows.where(F.col("name") == f"{prefix}:{name}"), "value", *test), rule, ("series",), step).select(
                "eval_ts", "alertname", "severity", "series", "sink", "status", "state", "value"
            )
            for name, test, rule, step in parts
        ]
    )


@dataclass(frozen=True)
class Inhibition:
    """Alerts matching ``target`` are dropped while ``source`` fires with equal labels."""

    source: str
    target: str
    equal: tuple[str, ...] = ("job",)


INHIBITIONS = (
    Inhibition("ServiceDown", r".*Writes.*"),
    Inhibition("NoIngestEvents", r"High.*Latency.*"),
)


def inhibit(firing: DataFrame, rules: Sequence[Inhibition] = INHIBITIONS, ts: str = "eval_ts") -> DataFrame:
    """Drop target alerts at the times their source fires; missing labels are equal to each other.

    Every rule counts: an alert is dropped if any rule that has it as a target has a firing source. Rules are
    told apart by their number and the values of their own ``equal`` labels, so one join serves them all.
    """
    if not rules:
        return firing

    def shared(r: Inhibition) -> Column:
        return F.array(*[F.coalesce(col(n).cast("string"), F.lit("")) for n in r.equal]).cast("array<string>")

    def cases(fits: Callable[[Inhibition], Column]) -> Column:
        each = [F.when(fits(r), F.struct(F.lit(i).alias("rule"), shared(r).alias("labels"))) for i, r in enumerate(rules)]
        return F.explode(F.array_compact(F.array(*each))).alias("case")

    names = sorted({n for r in rules for n in r.equal})
    identity = [ts, "alertname", *names]
    sources = firing.select(ts, cases(lambda r: F.col("alertname") == r.source))
    targets = firing.select(*identity, cases(lambda r: whole_match(F.col("alertname"), r.target)))
    hidden = matched(targets, sources, [ts, "case"], "left_semi")
    return matched(firing, hidden, identity, "left_anti")


@dataclass(frozen=True)
class Route:
    """Label patterns that must all match whole values, and the receiver they select."""

    receiver: str
    match: Mapping[str, str]
    repeat_seconds: int = 3600


ROUTES = (
    Route("email-alerts", {"severity": "critical|warning"}, 3600),
    Route("critical-alerts", {"severity": "critical"}, 1800),
    Route("warning-alerts", {"severity": "warning"}, 14400),
)


def route(firing: DataFrame, routes: Sequence[Route] = ROUTES, default: str = "null") -> DataFrame:
    """First matching route wins."""

    def met(r: Route) -> Column:
        out = F.lit(True)
        for name, pattern in r.match.items():
            out = out & whole_match(F.coalesce(col(name), F.lit("")), pattern)
        return out

    receiver = F.coalesce(*[F.when(met(r), F.lit(r.receiver)) for r in routes], F.lit(default))
    repeat = F.coalesce(*[F.when(met(r), F.lit(r.repeat_seconds)) for r in routes], F.lit(3600))
    return firing.withColumns({"receiver": receiver, "repeat_seconds": repeat})


def notifications(
    firing: DataFrame,
    group_by: Sequence[str] = ("alertname", "cluster", "service"),
    repeat_seconds: int | None = 3600,
    ts: str = "eval_ts",
    routes: Sequence[Route] = ROUTES,
) -> DataFrame:
    """Times at which a group notifies: its first evaluation, then once per repeat interval.

    With ``repeat_seconds`` None the alerts are routed first, and each receiver repeats at its own route's
    interval; the receiver is then part of the group.
    """
    if repeat_seconds is not None:
        return first_sights(firing, group_by, ts, repeat_seconds, inclusive=True)
    routed = route(firing, routes)
    parts = [
        first_sights(routed.where(F.col("repeat_seconds") == n), [*group_by, "receiver"], ts, n, inclusive=True)
        for n in sorted({r.repeat_seconds for r in routes} | {3600})
    ]
    return reduce(DataFrame.unionByName, parts)
