"""Queries over metric samples and the alerts raised from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.operators import alerts as al
from quaylight.operators import metrics as m
from quaylight.plans import shapes as sh
from quaylight.plans.registry import query
from quaylight.plans.shapes import AS_OF, SAMPLES_SQL, increase_sql, seconds, step_sql, table, with_parts

H = 3600
BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
WRITTEN = "(SELECT * FROM sm WHERE name = 'sink_written_total')"
REQUESTS = "(SELECT * FROM sm WHERE name = 'requests_total')"


def _eval(df):
    return df.withColumn("eval_s", seconds("eval_ts")).drop("eval_ts")


def _written(spark, folder):
    return m.select_series(sh.samples(spark, folder), "sink_written_total", ("sink", "status"))


# ---- counters --------------------------------------------------------------------------------


@query(
    with_parts(SAMPLES_SQL, increase_sql(WRITTEN, "sink, status", H))
    + f"SELECT sink, status, step * {H} AS eval_s, increase / {H}.0 AS rate FROM inc"
)
def counter_rate(spark, folder):
    r = m.rate(_written(spark, folder), H, ("series", "sink", "status"))
    return _eval(r.drop("series"))


@query(
    with_parts(SAMPLES_SQL, increase_sql(WRITTEN, "sink, status", H))
    + f", s AS (SELECT sink, unnest(generate_series(step, step + 2)) AS step, increase FROM inc) "
    f"SELECT sink, step * {H} AS eval_s, sum(increase) AS increase FROM s GROUP BY ALL"
)
def counter_increase(spark, folder):
    """Growth over three hours, evaluated hourly, summed over statuses."""
    i = m.increase(_written(spark, folder), 3 * H, ("series", "sink", "status"), H)
    return _eval(m.sum_by(i, "increase", ("sink",)))


@query(
    with_parts(SAMPLES_SQL, increase_sql(REQUESTS, "sink, status", H))
    + f"SELECT status, step * {H} AS eval_s, sum(increase) / {H}.0 AS rate FROM inc WHERE regexp_full_match(status, '5..') AND sink <> 'sink2' GROUP BY ALL"
)
def status_class_rate(spark, folder):
    s = m.select_series(
        sh.samples(spark, folder), "requests_total", ("status",), status=("=~", "5.."), sink=("!=", "sink2")
    )
    return _eval(m.sum_by(m.rate(s, H, ("series", "status")), "rate", ("status",)))


@query(
    with_parts(SAMPLES_SQL, increase_sql(REQUESTS, "sink, status", 6 * H))
    + f", t AS (SELECT step * {6 * H} AS eval_s, sum(CASE WHEN status LIKE '5%' THEN increase ELSE 0 END) AS errors, sum(increase) AS requests FROM inc GROUP BY ALL) "
    "SELECT eval_s, errors, requests, CASE WHEN requests > 0 THEN errors / requests END AS error_ratio FROM t"
)
def error_ratio(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "requests_total", ("status",))
    return _eval(m.error_ratio(s, 6 * H))


@query(
    with_parts(SAMPLES_SQL, increase_sql("(SELECT * FROM sm WHERE name IN ('sink_written_total', 'sink_error_total'))", "name, sink, status", 6 * H))
    + f", t AS (SELECT sink, step * {6 * H} AS eval_s, sum(CASE WHEN name = 'sink_written_total' THEN increase ELSE 0 END) AS w, sum(increase) AS a FROM inc GROUP BY ALL) "
    "SELECT sink, eval_s, CASE WHEN a > 0 THEN w / a END AS success_ratio FROM t"
)
def sink_success_ratio(spark, folder):
    return _eval(m.success_ratio(sh.samples(spark, folder), "sink_written_total", "sink_error_total", 6 * H))


@query(
    with_parts(SAMPLES_SQL, increase_sql("(SELECT * FROM sm WHERE name IN ('sink_written_total', 'sink_error_total'))", "name, sink, status", H))
    + f"SELECT name, sink, step * {H} AS eval_s, round(sum(increase) / {H}.0, 9) AS rate FROM inc GROUP BY ALL"
)
def reliability_rates(spark, folder):
    r = m.reliability_rates(sh.samples(spark, folder), ("sink_written_total", "sink_error_total"), H)
    return _eval(r).withColumn("rate", F.round("rate", 9))


@query(
    with_parts(SAMPLES_SQL) + ", g AS (SELECT *, lag(value) OVER (PARTITION BY sink, status ORDER BY ts) AS prev FROM sm WHERE name = 'sink_error_total' "
    f"AND ts <= TIMESTAMP '{AS_OF}') SELECT sink, status, (epoch_us(TIMESTAMP '{AS_OF}') - max(CASE WHEN value > prev OR (value < prev AND value > 0) THEN epoch_us(ts) END)) / 1000000.0 AS seconds_since FROM g GROUP BY ALL"
)
def seconds_since_growth(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "sink_error_total", ("sink", "status"))
    return m.seconds_since_growth(s, AS_OF, ("series", "sink", "status")).drop("series")


# ---- gauges ----------------------------------------------------------------------------------


@query(
    with_parts(SAMPLES_SQL)
    + f", c AS (SELECT sink, status, {step_sql('ts', 6 * H)} AS step, arg_min(value, ts) AS a, arg_max(value, ts) AS b FROM sm WHERE name = 'sink_queue_bytes' GROUP BY ALL) "
    f"SELECT sink, status, step * {6 * H} AS eval_s, (b - a) / {6 * H}.0 AS growth FROM c"
)
def gauge_growth(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "sink_queue_bytes", ("sink", "status"))
    return _eval(m.gauge_growth(s, 6 * H, ("series", "sink", "status")).drop("series"))


@query(
    with_parts(SAMPLES_SQL)
    + f"SELECT sink, status, arg_max(value, ts) AS value FROM sm WHERE name = 'sink_queue_bytes' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL"
)
def latest_gauge(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "sink_queue_bytes", ("sink", "status"))
    return m.latest(s, AS_OF, ("series", "sink", "status")).drop("series")


@query(
    with_parts(SAMPLES_SQL) + "SELECT epoch_us(ts) AS ts_us, sink, value FROM sm WHERE name = 'sink_queue_bytes' AND value / 104857600.0 > 0.8"
)
def gauge_threshold(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "sink_queue_bytes", ("sink",))
    hot = m.threshold(s, "value", ">", 0.8, 104857600.0)
    return hot.select(F.unix_micros("ts").alias("ts_us"), "sink", "value")


_UP = (
    f"u AS (SELECT {step_sql('ts', 6 * H)} AS step, sum(value) AS s, count(*) AS n FROM sm WHERE name = 'up' GROUP BY 1), "
    "x AS (SELECT unnest(generate_series(step, step + 3)) AS step, s, n FROM u), "
    f"av AS (SELECT step * {6 * H} AS eval_s, sum(s) / sum(n) AS avg FROM x GROUP BY ALL)"
)


def _up(spark, folder):
    up = m.select_series(sh.samples(spark, folder), "up").withColumn("series", F.lit("up"))
    return m.avg_over_time(up, 24 * H, step_seconds=6 * H).drop("series")


@query(with_parts(SAMPLES_SQL, _UP) + "SELECT eval_s, round(avg, 9) AS avg FROM av")
def availability(spark, folder):
    return _eval(_up(spark, folder)).withColumn("avg", F.round("avg", 9))


# ---- histograms ------------------------------------------------------------------------------

_BUCKETS = "[" + ", ".join(f"{b}" for b in BOUNDS) + ", 1e308]"


@query(
    f"SELECT event_type, CASE WHEN b > 1e300 THEN '+Inf' ELSE CAST(CAST(b AS DOUBLE) AS VARCHAR) END AS le, count(*) FILTER (WHERE value <= b) AS bucket, count(*) AS count, round(sum(value), 4) AS sum "
    f"FROM events, unnest({_BUCKETS}) AS u(b) GROUP BY ALL"
)
def histogram_build(spark, folder):
    h = m.build_histogram(table(spark, folder, "events"), ["event_type"], "value", BOUNDS)
    return h.withColumn("sum", F.round("sum", 4))


@query(
    f"WITH h AS (SELECT event_type, {step_sql('ts', 86400)} * 86400 AS eval_s, CAST(b AS DOUBLE) AS le, CAST(count(*) FILTER (WHERE value <= b) AS DOUBLE) AS c FROM events, unnest({_BUCKETS}) AS u(b) GROUP BY ALL), "
    "w AS (SELECT *, coalesce(lag(le) OVER q, 0) AS low, coalesce(lag(c) OVER q, 0) AS below, 0.95 * max(c) OVER (PARTITION BY event_type, eval_s) AS r FROM h WINDOW q AS (PARTITION BY event_type, eval_s ORDER BY le)), "
    "f AS (SELECT event_type, eval_s, arg_min(CASE WHEN le > 1e300 THEN low ELSE low + (le - low) * (r - below) / (c - below) END, le) AS quantile FROM w WHERE c >= r GROUP BY ALL) "
    "SELECT event_type, eval_s, round(quantile, 6) AS quantile FROM f"
)
def histogram_quantile(spark, folder):
    e = table(spark, folder, "events")
    from quaylight.functions.times import step_number

    e = e.withColumn("eval_s", step_number(F.col("ts"), 86400) * 86400)
    h = m.build_histogram(e, ["event_type", "eval_s"], "value", BOUNDS)
    h = h.withColumn("bucket", F.col("bucket").cast("double"))
    q = m.histogram_quantile(h, 0.95, ("event_type", "eval_s"), "bucket")
    return q.withColumn("quantile", F.round("quantile", 6))


def _bucket_samples(spark, folder):
    """Cumulative bucket counters: one sample per event and bucket it falls below."""
    e = table(spark, folder, "events")
    le = F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.lit(b).alias("b")) for n, b in
                             [*((repr(b), b) for b in BOUNDS), ("+Inf", float("inf"))]]))
    rows = e.select("ts", "event_id", "event_type", "value", le.alias("l"))
    return rows.select(
        "ts", F.lit("ingest_seconds_bucket").alias("name"),
        F.create_map(F.lit("sink"), F.col("event_type"), F.lit("le"), F.col("l.le")).alias("labels"),
        # The counter restarts whenever the event does not fall into the bucket.
        F.when(F.col("value") <= F.col("l.b"), F.col("event_id").cast("double")).otherwise(F.lit(0.0)).alias("value"),
    )


@query(
    f"WITH bs AS (SELECT ts, event_type AS sink, CAST(b AS DOUBLE) AS le, CASE WHEN value <= b THEN CAST(event_id AS DOUBLE) ELSE 0 END AS value FROM events, unnest({_BUCKETS}) AS u(b)), "
    + increase_sql("bs", "sink, le", 86400)
    + ", w AS (SELECT *, coalesce(lag(le) OVER q, 0) AS low, coalesce(lag(increase) OVER q, 0) AS below, 0.5 * max(increase) OVER (PARTITION BY sink, step) AS r FROM inc WINDOW q AS (PARTITION BY sink, step ORDER BY le)), "
    "f AS (SELECT sink, step * 86400 AS eval_s, arg_min(CASE WHEN le > 1e300 THEN low WHEN increase = below THEN le ELSE low + (le - low) * (r - below) / (increase - below) END, le) AS quantile FROM w WHERE increase >= r AND r > 0 GROUP BY ALL) "
    "SELECT sink, eval_s, round(quantile, 6) AS quantile FROM f"
)
def rate_histogram_quantile(spark, folder):
    """Quantile over the growth of bucket counters."""
    b = m.select_series(_bucket_samples(spark, folder), "ingest_seconds_bucket", ("le", "sink"))
    r = m.sum_by(m.rate(b, 86400, ("series", "le", "sink")), "rate", ("le", "sink"))
    q = m.histogram_quantile(r, 0.5, ("sink", "eval_ts")).where(F.col("quantile").isNotNull())
    return _eval(q).withColumn("quantile", F.round("quantile", 6))


# ---- objectives and recording rules ----------------------------------------------------------

_REQ = increase_sql(REQUESTS, "sink, status", 6 * H)
_ERR = (
    f"er AS (SELECT step * {6 * H} AS eval_s, sum(CASE WHEN status LIKE '5%' THEN increase ELSE 0 END) AS e, sum(increase) AS a FROM inc GROUP BY ALL), "
    "erx AS (SELECT eval_s, CASE WHEN a > 0 THEN e / a END AS ratio FROM er)"
)


def _ratio(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "requests_total", ("status",))
    return m.error_ratio(s, 6 * H)


@query(
    with_parts(SAMPLES_SQL, _UP, _REQ, _ERR)
    + "SELECT eval_s, 'slo:availability:rate1d' AS name, 'availability' AS slo, round(avg, 9) AS value FROM av "
    "UNION ALL SELECT eval_s, 'slo:error_rate:http:rate6h', 'error_rate', round(ratio, 9) FROM erx"
)
def recording_rules(spark, folder):
    rules = m.union_rules([
        m.record(_up(spark, folder), "slo:availability:rate1d", "avg", labels={"slo": "availability"}),
        m.record(_ratio(spark, folder), "slo:error_rate:http:rate6h", "error_ratio", labels={"slo": "error_rate", "type": "http"}),
    ])
    return rules.select(seconds("ts").alias("eval_s"), "name", F.col("labels")["slo"].alias("slo"), F.round("value", 9).alias("value"))


def _availability_sql(tag, range_seconds, step):
    return (
        f"SELECT 'slo:availability:rate{tag}' AS name, sink, status, e * {step} AS eval_s, sum(value) / count(value) AS value FROM (SELECT sink, status, value, "
        f"unnest(generate_series({step_sql('ts', step)}, {step_sql('ts', step)} + {range_seconds // step - 1})) AS e FROM sm WHERE name = 'up') GROUP BY ALL"
    )


#: Which events give samples of which histogram.
_OPERATIONS = {"ingest": ("click", "view", "signup"), "pipeline": ("error",), "sink_write": ("purchase",)}


def _latency_sql(op, quantile, tag, n):
    """Quantile of the growth over n steps of 300 seconds."""
    kinds = ", ".join(f"'{k}'" for k in _OPERATIONS[op])
    return (
        f"SELECT 'slo:latency_p{quantile}:{op}:rate{tag}' AS name, sink, CAST(NULL AS VARCHAR) AS status, step * 300 AS eval_s, "
        f"arg_min(CASE WHEN le > 1e300 THEN low WHEN c = below THEN le ELSE low + (le - low) * (0.{quantile} * top - below) / (c - below) END, le) FILTER (WHERE c >= 0.{quantile} * top AND top > 0) AS value FROM "
        "(SELECT *, coalesce(lag(le) OVER q, 0) AS low, coalesce(lag(c) OVER q, 0) AS below, max(c) OVER (PARTITION BY sink, step) AS top FROM "
        f"(SELECT sink, le, step, sum(increase) AS c FROM (SELECT sink, le, unnest(generate_series(step, step + {n - 1})) AS step, increase FROM inc WHERE sink IN ({kinds})) GROUP BY ALL) "
        "WINDOW q AS (PARTITION BY sink, step ORDER BY le)) GROUP BY sink, step"
    )


_BS = (
    "bs AS (SELECT ts, event_type AS sink, CAST(b AS DOUBLE) AS le, CASE WHEN value <= b THEN CAST(event_id AS DOUBLE) ELSE 0 END AS value "
    f"FROM events, unnest({_BUCKETS}) AS u(b))"
)
_REQ5 = increase_sql(REQUESTS, "sink, status", 300).replace("dd AS", "rd AS").replace("FROM dd", "FROM rd").replace("inc AS", "ri AS")
_SLO = (
    "rules AS ("
    + " UNION ALL ".join(
        [
            _availability_sql("5m", 300, 60),
            _availability_sql("1h", 3600, 300),
            _availability_sql("1d", 86400, 3600),
            *[_latency_sql("ingest", q, t, n) for q in (95, 99) for t, n in (("5m", 1), ("1h", 12))],
            *[_latency_sql(op, 95, "5m", 1) for op in ("pipeline", "sink_write")],
            "SELECT 'slo:error_rate:http:rate5m', NULL, NULL, step * 300, CASE WHEN sum(increase) > 0 THEN sum(CASE WHEN status LIKE '5%' THEN increase ELSE 0 END) / sum(increase) END FROM ri GROUP BY step",
        ]
    )
    + "), h AS (SELECT eval_s, min(value) FILTER (WHERE name = 'slo:availability:rate1h') AS a, max(value) FILTER (WHERE name = 'slo:latency_p95:ingest:rate1h') AS l, "
    "max(value) FILTER (WHERE name = 'slo:error_rate:http:rate5m') AS e FROM rules WHERE name IN ('slo:availability:rate1h', 'slo:latency_p95:ingest:rate1h', 'slo:error_rate:http:rate5m') GROUP BY 1), "
    f"burns AS (SELECT 'slo:error_budget_burn:fast:4h' AS name, NULL AS sink, NULL AS status, eval_s, CASE WHEN coalesce(1 - a > {fixed.FAST_BURN} * (1 - {fixed.SLO_AVAILABILITY}), false) OR coalesce(l > {fixed.SLO_LATENCY_P95}, false) OR coalesce(e > {fixed.SLO_ERROR_RATE}, false) THEN 1.0 ELSE 0.0 END AS value FROM h "
    f"UNION ALL SELECT 'slo:error_budget_burn:slow:30d', NULL, NULL, eval_s, CASE WHEN 1 - min(value) > {fixed.SLOW_BURN} * (1 - {fixed.SLO_AVAILABILITY}) THEN 1.0 ELSE 0.0 END FROM rules WHERE name = 'slo:availability:rate1d' GROUP BY eval_s), "
    "every_rule AS (SELECT * FROM rules UNION ALL SELECT * FROM burns) "
)


def _slo_samples(spark, folder):
    """Gauge, counter and bucket samples of every event, in one pass over the events."""
    operation = F.coalesce(*[F.when(F.col("event_type").isin(*kinds), F.lit(op)) for op, kinds in _OPERATIONS.items()])
    # One short expression for all bounds: written out per bound, the code is too long to be compiled.
    bounds = [*((repr(b), b) for b in BOUNDS), ("+Inf", float("inf"))]
    kinds = F.array(*[F.struct(F.lit(n).cast("string").alias("le"), F.lit(b).cast("double").alias("bound")) for n, b in [(None, None), *bounds]])
    rows = table(spark, folder, "events").select("*", F.inline(kinds))
    own = F.col("le").isNull()
    labels = F.create_map(F.lit("sink"), F.expr(sh.SAMPLE_COLUMNS["sink"]), F.lit("status"), F.expr(sh.SAMPLE_COLUMNS["status"]), F.lit("job"), F.lit("edge"))
    below = F.when(F.col("value") <= F.col("bound"), F.col("event_id").cast("double")).otherwise(F.lit(0.0))
    return rows.select(
        "ts",
        F.when(own, F.expr(sh.SAMPLE_COLUMNS["name"])).otherwise(F.concat(operation, F.lit("_seconds_bucket"))).alias("name"),
        F.when(own, labels).otherwise(F.create_map(F.lit("sink"), F.col("event_type"), F.lit("le"), F.col("le"))).alias("labels"),
        F.when(own, F.expr(sh.SAMPLE_COLUMNS["value"]).cast("double")).otherwise(below).alias("value"),
    )


@query(
    with_parts(SAMPLES_SQL, _BS, increase_sql("bs", "sink, le", 300), _REQ5, _SLO)
    + "SELECT name, sink, status, eval_s // 86400 AS day, count(*) AS n, count(value) AS known, CAST(sum(CAST(round(value, 6) AS DECIMAL(20, 6))) AS DOUBLE) AS total, "
    "min(round(value, 6)) AS low, max(round(value, 6)) AS high FROM every_rule GROUP BY ALL"
)
def slo_rules(spark, folder):
    """All service-objective rules and the burn series over one sample table: what each day's values add up to."""
    rules = m.slo_rules(_slo_samples(spark, folder))
    value = F.round("value", 6)
    return (
        rules.unionByName(m.burn_rules(rules))
        .groupBy("name", F.col("labels")["sink"].alias("sink"), F.col("labels")["status"].alias("status"), F.expr("unix_seconds(ts) div 86400").alias("day"))
        .agg(F.count("*").alias("n"), F.count("value").alias("known"), F.sum(value.cast("decimal(20,6)")).cast("double").alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    )


def _objective_sql(alertname, severity, name, test, hold, step):
    return (
        f"SELECT '{alertname}' AS alertname, '{severity}' AS severity, sink, status, eval_s, CASE WHEN eval_s - min(eval_s) OVER (PARTITION BY sink, status, run) >= {hold} THEN 'firing' ELSE 'pending' END AS state FROM "
        f"(SELECT *, eval_s // {step} - row_number() OVER (PARTITION BY sink, status ORDER BY eval_s) AS run FROM every_rule WHERE name = 'slo:{name}' AND value {test})"
    )


@query(
    with_parts(SAMPLES_SQL, _BS, increase_sql("bs", "sink, le", 300), _REQ5, _SLO)
    + " UNION ALL ".join(
        _objective_sql(*row)
        for row in (
            ("HighIngestLatency95th", "warning", "latency_p95:ingest:rate5m", "> 60.0", 300, 300),
            ("HighPipelineLatency95th", "warning", "latency_p95:pipeline:rate5m", "> 60.0", 300, 300),
            ("HighSinkWriteLatency95th", "warning", "latency_p95:sink_write:rate5m", "> 60.0", 300, 300),
            ("IngestLatencyP95Breach", "warning", "latency_p95:ingest:rate5m", "> 80.0", 300, 300),
            ("IngestLatencyP99Breach", "warning", "latency_p99:ingest:rate5m", "> 90.0", 300, 300),
            ("AvailabilityBreach", "critical", "availability:rate1h", "< 0.9", 300, 300),
            ("ErrorBudgetBurnFast", "critical", "error_budget_burn:fast:4h", "= 1", 120, 300),
            ("ErrorBudgetBurnSlow", "warning", "error_budget_burn:slow:30d", "= 1", 900, 3600),
        )
    )
)
def alert_objectives(spark, folder):
    """Latency, availability and burn alerts over the recorded series."""
    rules = m.slo_rules(_slo_samples(spark, folder))
    fired = al.objective_alerts(rules.unionByName(m.burn_rules(rules)), availability=0.9, p95=80.0, p99=90.0, latency=60.0)
    return _eval(fired).select("alertname", "severity", "sink", "status", "eval_s", "state")


_LAT = (
    f"lt AS (SELECT {step_sql('ts', 6 * H)} * {6 * H} AS eval_s, max(value) AS v FROM events GROUP BY 1)"
)


def _latency(spark, folder):
    from quaylight.operators.series import per_step, with_eval_time

    v = table(spark, folder, "events")
    return with_eval_time(per_step(v, [], 6 * H, [F.max("value").alias("value")]), 6 * H)


@query(
    with_parts(SAMPLES_SQL, _UP, _REQ, _ERR, _LAT)
    + "SELECT coalesce(av.eval_s, lt.eval_s, erx.eval_s) AS eval_s, coalesce(1 - av.avg > 14.4 * (1 - 0.99), false) OR coalesce(lt.v > 100.0, false) OR coalesce(erx.ratio > 0.3, false) AS burning "
    "FROM av FULL JOIN lt ON av.eval_s = lt.eval_s FULL JOIN erx ON coalesce(av.eval_s, lt.eval_s) = erx.eval_s"
)
def error_budget_fast(spark, folder):
    b = m.fast_burn(
        _up(spark, folder).withColumnRenamed("avg", "value"),
        _latency(spark, folder),
        _ratio(spark, folder).withColumnRenamed("error_ratio", "value"),
        slo=0.99, latency_limit=100.0, error_limit=0.3,
    )
    return b.select(seconds("eval_ts").alias("eval_s"), "burning")


@query(with_parts(SAMPLES_SQL, _UP) + "SELECT eval_s, 1 - avg > 1.0 * (1 - 0.9) AS burning FROM av")
def error_budget_slow(spark, folder):
    b = m.slow_burn(_up(spark, folder).withColumnRenamed("avg", "value"), slo=0.9)
    return b.select(seconds("eval_ts").alias("eval_s"), "burning")


# ---- alerts ----------------------------------------------------------------------------------

_FOR = (
    "r AS (SELECT *, step - row_number() OVER (PARTITION BY sink ORDER BY step) AS run FROM c), "
    f"f AS (SELECT *, min(step) OVER (PARTITION BY sink, run) AS s0 FROM r) "
)


@query(
    with_parts(SAMPLES_SQL)
    + f", c AS (SELECT sink, {step_sql('ts', H)} AS step, max(value) AS v FROM sm WHERE name = 'sink_queue_bytes' GROUP BY ALL HAVING max(value) > 50000000), "
    + _FOR
    + f"SELECT sink, step * {H} AS eval_s, 'SinkQueueNearFull' AS alertname, 'critical' AS severity, CASE WHEN (step - s0) * {H} >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM f"
)
def alert_for_duration(spark, folder):
    """Pending until the condition held for two hours."""
    from quaylight.operators.series import per_step, with_eval_time

    g = m.select_series(sh.samples(spark, folder), "sink_queue_bytes", ("sink",))
    cells = with_eval_time(per_step(g, ("sink",), H, [F.max("value").alias("v")]), H)
    rule = al.Rule("SinkQueueNearFull", 7200, {"severity": "critical"})
    fired = al.evaluate(cells.where(F.col("v") > 50000000), rule, ("sink",), H)
    return _eval(fired).select("sink", "eval_s", "alertname", "severity", "state")


@query(
    with_parts(SAMPLES_SQL, increase_sql(WRITTEN, "sink, status", H))
    + f"SELECT sink, status, step * {H} AS eval_s FROM inc WHERE increase = 0"
)
def alert_no_growth(spark, folder):
    i = m.increase(_written(spark, folder), H, ("series", "sink", "status"))
    return _eval(al.no_growth(i)).select("sink", "status", "eval_s")


_LAST = step_sql(f"TIMESTAMP '{AS_OF}'", H)


@query(
    with_parts(SAMPLES_SQL, increase_sql(WRITTEN, "sink, status", H))
    + f", p0 AS (SELECT sink, status, min(step) AS s0 FROM inc GROUP BY ALL), p AS (SELECT sink, status, unnest(generate_series(s0, {_LAST})) AS step FROM p0) "
    f"SELECT sink, status, p.step * {H} AS eval_s FROM p ANTI JOIN (SELECT * FROM inc WHERE increase > 0) i USING (sink, status, step)"
)
def alert_silence(spark, folder):
    """Grid times without growth, whether or not the counter was sampled there."""
    keys = ("series", "sink", "status")
    return _eval(al.silent(_written(spark, folder), H, H, AS_OF, keys)).drop("series")


@query(
    with_parts(SAMPLES_SQL, increase_sql(WRITTEN, "sink, status", H))
    + f", z AS (SELECT DISTINCT sink, step * {H} AS eval_s FROM inc WHERE increase = 0), q AS (SELECT DISTINCT {step_sql('ts', H)} * {H} AS eval_s FROM sm WHERE name = 'sink_queue_bytes' AND value > 0) "
    "SELECT sink, eval_s FROM z SEMI JOIN q USING (eval_s)"
)
def alert_conjunction(spark, folder):
    """No writes although the queue is filled: joined on time only."""
    from quaylight.operators.series import per_step, with_eval_time

    zero = al.no_growth(m.increase(_written(spark, folder), H, ("series", "sink", "status")))
    g = m.select_series(sh.samples(spark, folder), "sink_queue_bytes").where("value > 0")
    filled = with_eval_time(per_step(g, [], H, [F.count("*").alias("n")]), H)
    return _eval(al.both(zero.select("sink", "eval_ts").distinct(), filled))


@query(
    with_parts(SAMPLES_SQL)
    + f", c AS (SELECT sink, {step_sql('ts', H)} AS step, arg_max(value, ts) AS v FROM sm WHERE name = 'up' GROUP BY ALL HAVING arg_max(value, ts) = 0), "
    + _FOR
    + f"SELECT sink, step * {H} AS eval_s, CASE WHEN (step - s0) * {H} >= 3600 THEN 'firing' ELSE 'pending' END AS state FROM f"
)
def alert_down(spark, folder):
    up = m.select_series(sh.samples(spark, folder), "up", ("sink",))
    fired = al.down_rule(up, al.Rule("ServiceDown", 3600), ("sink",), H)
    return _eval(fired).select("sink", "eval_s", "state")


@query(
    with_parts(SAMPLES_SQL, _REQ, _ERR)
    + f", c AS (SELECT 'all' AS sink, eval_s // {6 * H} AS step FROM erx WHERE ratio > 0.1), " + _FOR
    + f"SELECT step * {6 * H} AS eval_s, CASE WHEN (step - s0) * {6 * H} >= 43200 THEN 'firing' ELSE 'pending' END AS state FROM f"
)
def alert_error_ratio(spark, folder):
    s = m.select_series(sh.samples(spark, folder), "requests_total", ("status",))
    fired = al.error_rule(s, al.Rule("HighHTTPErrorRate", 43200), 0.1, 6 * H, 6 * H)
    return _eval(fired).select("eval_s", "state")


_REL = (
    f"cells AS (SELECT name, sink, status, {step_sql('ts', H)} AS step, arg_max(value, ts) AS v, arg_min(value, ts) AS v0 FROM sm WHERE name IN ('up', 'sink_queue_bytes', 'requests_total') GROUP BY ALL), "
    "c AS (SELECT 'SinkCircuitBreakerOpen' AS alertname, 'critical' AS severity, sink, status, step, v AS value FROM cells WHERE name = 'up' AND v = 1 "
    "UNION ALL SELECT 'SinkQueueNearFull', 'critical', sink, status, step, v FROM cells WHERE name = 'sink_queue_bytes' AND v / 104857600.0 > 0.9 "
    f"UNION ALL SELECT 'SinkQueueGrowth', 'warning', sink, status, step, (v * 1000.0 - v0 * 1000.0) / {H}.0 FROM cells WHERE name = 'requests_total' AND (v * 1000.0 - v0 * 1000.0) / {H}.0 > 1 "
    f"UNION ALL SELECT 'HighDeadLetterQueueRate', 'critical', sink, status, step, increase / {H}.0 FROM inc WHERE name = 'sink_error_total' AND increase / {H}.0 > 0.01 "
    f"UNION ALL SELECT 'HighSinkRetryRate', 'warning', sink, status, step, increase / {H}.0 FROM inc WHERE name = 'sink_written_total' AND increase / {H}.0 > 0.1), "
    "r AS (SELECT *, step - row_number() OVER (PARTITION BY alertname, sink, status ORDER BY step) AS run FROM c), "
    "f AS (SELECT *, min(step) OVER (PARTITION BY alertname, sink, status, run) AS s0 FROM r)"
)


@query(
    with_parts(SAMPLES_SQL, increase_sql("(SELECT * FROM sm WHERE name IN ('sink_written_total', 'sink_error_total'))", "name, sink, status", H), _REL)
    + f"SELECT step * {H} AS eval_s, alertname, severity, sink, status, CASE WHEN step > s0 THEN 'firing' ELSE 'pending' END AS state, round(value, 6) AS value FROM f"
)
def alert_reliability(spark, folder):
    """The recommended sink alerts over renamed counters, every series for itself."""
    s = sh.samples(spark, folder)
    names = {"sink_written_total": "sink_retry_total", "sink_error_total": "sink_dlq_total", "up": "sink_circuit_state", "requests_total": "sink_queue_size"}
    renamed = F.coalesce(*[F.when(F.col("name") == a, F.lit(b)) for a, b in names.items()], F.col("name"))
    s = s.withColumn("value", F.when(F.col("name") == "requests_total", F.col("value") * 1000).otherwise(F.col("value"))).withColumn("name", renamed)
    fired = al.reliability_alerts(s, H, H)
    return _eval(fired).select("eval_s", "alertname", "severity", "sink", F.get_json_object("series", "$.status").alias("status"), "state", F.round("value", 6).alias("value"))


# Alerts for what follows are derived from events: name by type, job and service by user.
_ALERTS = (
    f"a0 AS (SELECT DISTINCT {step_sql('ts', H)} * {H} AS eval_s, CASE event_type WHEN 'error' THEN 'ServiceDown' WHEN 'view' THEN 'SinkWritesZero' WHEN 'click' THEN 'HighIngestLatency95th' "
    "WHEN 'signup' THEN 'NoIngestEvents' ELSE 'QueueFull' END AS alertname, CASE WHEN user_id % 4 < 3 THEN concat('job', user_id % 4) END AS job, "
    "CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity FROM events)"
)


def _alerts(spark, folder):
    from quaylight.functions.times import step_number, step_time

    return table(spark, folder, "events").select(
        step_time(step_number(F.col("ts"), H), H).alias("eval_ts"),
        F.expr("CASE event_type WHEN 'error' THEN 'ServiceDown' WHEN 'view' THEN 'SinkWritesZero' WHEN 'click' THEN 'HighIngestLatency95th' WHEN 'signup' THEN 'NoIngestEvents' ELSE 'QueueFull' END AS alertname"),
        F.expr("CASE WHEN user_id % 4 < 3 THEN concat('job', user_id % 4) END AS job"),
        F.expr("CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity"),
    ).distinct()


@query(
    with_parts(_ALERTS)
    + "SELECT eval_s, alertname, job FROM a0 WHERE NOT EXISTS (SELECT 1 FROM a0 s WHERE s.eval_s = a0.eval_s AND coalesce(s.job, '') = coalesce(a0.job, '') "
    "AND ((s.alertname = 'ServiceDown' AND a0.alertname LIKE '%Writes%') OR (s.alertname = 'NoIngestEvents' AND a0.alertname LIKE 'High%Latency%')))"
)
def alert_inhibition(spark, folder):
    return _eval(al.inhibit(_alerts(spark, folder))).select("eval_s", "alertname", "job")


@query(
    with_parts(_ALERTS)
    + "SELECT eval_s, alertname, job, CASE WHEN severity IN ('critical', 'warning') THEN 'email-alerts' ELSE 'null' END AS receiver FROM a0"
)
def alert_routing(spark, folder):
    return _eval(al.route(_alerts(spark, folder))).select("eval_s", "alertname", "job", "receiver")


@query(
    "WITH RECURSIVE " + _ALERTS + ", g AS (SELECT DISTINCT alertname, coalesce(job, '-') AS job, eval_s FROM a0), "
    "nx AS (SELECT *, min(eval_s) OVER (PARTITION BY alertname, job ORDER BY eval_s RANGE BETWEEN 14400 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM g), "
    "ch AS (SELECT alertname, job, min(eval_s) AS eval_s FROM g GROUP BY ALL UNION ALL SELECT nx.alertname, nx.job, nx.nxt FROM ch JOIN nx ON ch.alertname = nx.alertname AND ch.job = nx.job AND ch.eval_s = nx.eval_s WHERE nx.nxt IS NOT NULL) "
    "SELECT alertname, nullif(job, '-') AS job, eval_s FROM ch"
)
def alert_notifications(spark, folder):
    """First evaluation of a group, then one every four hours while it keeps firing."""
    return _eval(al.notifications(_alerts(spark, folder), ("alertname", "job"), 14400))


_ROUTES = (("pager", "critical", 7200), ("mail", "warning", 14400))


def _repeat_sql(receiver, severity, seconds):
    return (
        f"g_{receiver} AS (SELECT DISTINCT alertname, coalesce(job, '-') AS job, eval_s FROM a0 WHERE severity {severity}), "
        f"nx_{receiver} AS (SELECT *, min(eval_s) OVER (PARTITION BY alertname, job ORDER BY eval_s RANGE BETWEEN {seconds} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM g_{receiver}), "
        f"ch_{receiver} AS (SELECT alertname, job, min(eval_s) AS eval_s FROM g_{receiver} GROUP BY ALL UNION ALL SELECT nx.alertname, nx.job, nx.nxt FROM ch_{receiver} ch JOIN nx_{receiver} nx "
        "ON ch.alertname = nx.alertname AND ch.job = nx.job AND ch.eval_s = nx.eval_s WHERE nx.nxt IS NOT NULL)"
    )


@query(
    "WITH RECURSIVE " + _ALERTS + ", " + ", ".join([*[_repeat_sql(r, f"= '{s}'", n) for r, s, n in _ROUTES], _repeat_sql("other", "= 'info'", 3600)]) + " "
    + " UNION ALL ".join(f"SELECT '{r}' AS receiver, alertname, nullif(job, '-') AS job, eval_s FROM ch_{r}" for r in ("pager", "mail", "other"))
)
def alert_route_notifications(spark, folder):
    """Notifications per receiver, each at its own route's interval."""
    routes = tuple(al.Route(r, {"severity": s}, n) for r, s, n in _ROUTES)
    sent = al.notifications(_alerts(spark, folder), ("alertname", "job"), None, routes=routes)
    return _eval(sent.replace({"null": "other"}, subset=["receiver"]))
