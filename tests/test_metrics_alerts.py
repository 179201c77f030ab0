import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quaylight.operators import alerts as al
from quaylight.operators import metrics as m
from quaylight.operators import series
from quaylight.plans import q_metrics


def samples(spark, name, points, **labels):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), name, labels, float(v)) for s, v in points]
    return spark.createDataFrame(rows, "ts timestamp, name string, labels map<string,string>, value double")


def secs(df, *cols):
    base = 1704067200
    return sorted((r.eval_ts.timestamp() - base, *[r[c] for c in cols]) for r in df.collect())


def test_increase_with_reset(spark):
    s = m.select_series(samples(spark, "c", [(10, 1), (20, 5), (30, 2), (40, 4)]), "c")
    assert [r.increase for r in m.increase(s, 60).collect()] == [8.0]
    by_ten = m.increase(s, 10)
    assert secs(by_ten, "increase") == [(10, 0.0), (20, 4.0), (30, 2.0), (40, 2.0)]
    sliding = m.increase(s, 20, step_seconds=10)
    assert secs(sliding, "increase") == [(10, 0.0), (20, 4.0), (30, 6.0), (40, 4.0), (50, 2.0)]
    assert m.rate(s, 60).first().rate == pytest.approx(8 / 60)
    with pytest.raises(ValueError):
        m.increase(s, 15, step_seconds=10)


@pytest.mark.parametrize("step", [7, 30, 3600])
def test_increase_does_not_depend_on_the_step(spark, step):
    points = [(i * 3 + 1, (i * 37) % 101) for i in range(300)]
    s = m.select_series(samples(spark, "c", points), "c")
    values = [v for _, v in points]
    want = sum(b if b < a else b - a for a, b in zip(values, values[1:], strict=False))
    assert m.increase_per_step(s, ("series",), step).agg(F.sum("increase")).first()[0] == want


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_sliding_matches_brute_force(spark, n):
    """Sums, least and greatest over ranges of n steps: dense and sparse keys, gaps, negative steps, a null key."""
    rng = random.Random(n)
    rows = []
    for key, density, span in (("dense", 0.95, 120), ("sparse", 0.05, 400), (None, 0.4, 90), ("one", 1, 1)):
        rows += [(key, s - 60, rng.choice([0.1, 2.5, 7.0, None]), rng.randrange(99)) for s in range(span) if rng.random() < density or key == "one"]
    df = spark.createDataFrame(rows, "k string, step long, x double, y int").repartition(3)
    got = series.sliding(df, ["k"], n, {"x": "sum", "y": "min"}).collect()
    high = {(r.k, r.step): r.y for r in series.sliding(df.drop("x"), ["k"], n, {"y": "max"}).collect()}
    want = {}
    for key, step, x, y in rows:
        for e in range(step, step + n):
            want.setdefault((key, e), []).append((x, y))
    assert len(got) == len(want) == len(high)
    for r in got:
        cell = want[r.k, r.step]
        xs = [x for x, _ in cell if x is not None]
        assert (r.x is None) == (not xs) and (not xs or r.x == pytest.approx(sum(xs)))
        assert r.y == min(y for _, y in cell) and high[r.k, r.step] == max(y for _, y in cell)


def test_sliding_keeps_small_values_beside_large_ones(spark):
    df = spark.createDataFrame([(i, 1e18 if i < 10 else 1e-6) for i in range(40)], "step long, x double")
    got = {r.step: r.x for r in series.sliding(df, [], 4, {"x": "sum"}).collect()}
    assert got[20] == pytest.approx(4e-6, rel=1e-12)


def test_histogram_quantile(spark):
    def q(buckets, level=0.95):
        df = spark.createDataFrame([("h", le, float(v)) for le, v in buckets.items()], "k string, le string, rate double")
        return m.histogram_quantile(df, level, ("k",)).first().quantile

    assert q({"0.1": 10, "0.5": 30, "1.0": 40, "+Inf": 40}) == pytest.approx(0.9)
    assert q({"0.1": 10, "+Inf": 40}) == pytest.approx(0.1)
    assert q({"0.1": 0, "+Inf": 0}) is None
    assert q({"0.1": 40, "0.5": 40, "+Inf": 40}, 0.5) == pytest.approx(0.05)


def test_histogram_build(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.7), ("a", 9.0)], "k string, v double")
    rows = {r.le: (r.bucket, r["count"], r["sum"]) for r in m.build_histogram(df, ["k"], "v", [0.1, 1.0]).collect()}
    assert rows == {"0.1": (1, 3, 9.75), "1.0": (2, 3, 9.75), "+Inf": (3, 3, 9.75)}


def test_gauges(spark):
    s = m.select_series(samples(spark, "g", [(10, 1), (30, 7), (70, 4)], sink="x"), "g", ("sink",))
    assert secs(m.gauge_growth(s, 60), "growth") == [(60, 0.1), (120, 0.0)]
    assert m.latest(s, "2024-01-01 00:00:40", ("sink",)).first().value == 7.0
    assert secs(m.avg_over_time(s, 60), "avg") == [(60, 4.0), (120, 4.0)]
    assert m.threshold(s, "value", ">", 0.5, 10.0).count() == 1
    grown = m.seconds_since_growth(s, "2024-01-01 00:02:00", ("sink",), 60)
    assert grown.first().seconds_since == 50.0


def test_ratios(spark):
    ok = samples(spark, "requests_total", [(10, 0), (50, 30)], status="200")
    bad = samples(spark, "requests_total", [(10, 0), (50, 10)], status="503")
    r = m.error_ratio(m.select_series(ok.union(bad), "requests_total", ("status",)), 60).first()
    assert r.error_ratio == 0.25
    w = samples(spark, "w", [(10, 0), (50, 9)], sink="a").union(samples(spark, "e", [(10, 0), (50, 1)], sink="a"))
    assert m.success_ratio(w, "w", "e", 60).first().success_ratio == 0.9
    flat = samples(spark, "requests_total", [(10, 5), (50, 5)], status="200")
    assert m.error_ratio(m.select_series(flat, "requests_total", ("status",)), 60).first().error_ratio is None


def conditions(spark, seconds, **labels):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), *labels.values()) for s in seconds]
    return spark.createDataFrame(rows, ", ".join(["eval_ts timestamp", *[f"{k} string" for k in labels]]))


def test_for_duration(spark):
    cond = conditions(spark, range(60, 421, 60), job="a").union(conditions(spark, [540, 600], job="a"))
    out = al.evaluate(cond, al.Rule("X", 300, {"severity": "warning"}), ("job",), 60)
    assert secs(out.where("state = 'firing'"), "alertname") == [(360, "X"), (420, "X")]
    assert out.where("state = 'pending'").count() == 7


def test_set_operators(spark):
    a, b = conditions(spark, [60, 120], job="a"), conditions(spark, [120, 180], job="a")
    assert secs(al.both(a, b)) == [(120,)]
    assert secs(al.unless(a, b, ("job",))) == [(60,)]
    assert secs(al.either(a, b, ("job",))) == [(60,), (120,), (180,)]


def test_silence(spark):
    s = m.select_series(samples(spark, "c", [(10, 1), (70, 2), (250, 2)]), "c")
    quiet = al.silent(s, 60, 60, "2024-01-01 00:06:00")
    assert secs(quiet) == [(60,), (180,), (240,), (300,), (360,)]


def test_inhibit_route_notify(spark):
    rows = [
        (60, "ServiceDown", "j1", "critical"), (60, "SinkWritesZero", "j1", "warning"), (60, "SinkWritesZero", "j2", "warning"),
        (60, "ServiceDown", None, "critical"), (60, "StoreWritesZero", None, "info"), (120, "SinkWritesZero", "j1", "warning"),
    ]
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), *r) for s, *r in rows], "eval_ts timestamp, alertname string, job string, severity string")
    left = {(r.eval_ts.minute, r.alertname, r.job) for r in al.inhibit(df).collect()}
    assert left == {(1, "ServiceDown", "j1"), (1, "SinkWritesZero", "j2"), (1, "ServiceDown", None), (2, "SinkWritesZero", "j1")}
    routed = {(r.severity, r.receiver) for r in al.route(df).collect()}
    assert routed == {("critical", "email-alerts"), ("warning", "email-alerts"), ("info", "null")}
    firing = conditions(spark, range(0, 10000, 600), alertname="A", cluster="c").withColumn("service", F.lit(None).cast("string"))
    assert secs(al.notifications(firing)) == [(0,), (3600,), (7200,)]


def test_rules(spark):
    up = samples(spark, "up", [(i * 30, 0 if 300 <= i * 30 <= 600 else 1) for i in range(60)], job="edge")
    down = al.down_rule(m.select_series(up, "up", ("job",)), al.Rule("ServiceDown", 60), ("job",))
    assert secs(down.where("state = 'firing'"))[0] == (360,)
    gauge = samples(spark, "sink_circuit_state", [(i * 60, 1) for i in range(1, 10)], sink="s")
    fired = al.reliability_alerts(gauge)
    assert fired.where("state = 'firing' and alertname = 'SinkCircuitBreakerOpen'").count() == 4
    buckets = samples(spark, "b", [(60, 0), (120, 0)], le="1.0").union(samples(spark, "b", [(60, 0), (120, 50)], le="5.0")).union(
        samples(spark, "b", [(60, 0), (120, 50)], le="+Inf"))
    slow = al.latency_rule(m.select_series(buckets, "b", ("le",)), al.Rule("HighLatency", 0), range_seconds=60)
    assert slow.where("state = 'firing'").count() == 1


def test_an_open_circuit_beside_a_closed_one(spark):
    """Two instances of a sink: only the open one fires, whichever is sampled last in a step."""
    rows = samples(spark, "sink_circuit_state", [(i * 60 - 10, 1) for i in range(1, 13)], sink="s", instance="a").unionByName(
        samples(spark, "sink_circuit_state", [(i * 60, 0) for i in range(1, 13)], sink="s", instance="b"))
    fired = al.reliability_alerts(rows).where("state = 'firing'").collect()
    assert {r.series for r in fired} == {'{"instance":"a","sink":"s"}'} and len(fired) == 7


def test_every_reliability_rule_yields_rows(spark):
    minutes = range(1, 25)
    rows = [samples(spark, n, [(i * 60, v(i)) for i in minutes], sink="s") for n, v in (
        ("sink_circuit_state", lambda i: 1), ("sink_queue_bytes", lambda i: 1e8), ("sink_dlq_total", lambda i: 9 * i),
        ("sink_retry_total", lambda i: 60 * i), ("sink_queue_size", lambda i: 90 * i))]
    fired = al.reliability_alerts(m.union_rules(rows)).where("state = 'firing'").groupBy("alertname").count().collect()
    assert {r.alertname for r in fired} == {"SinkCircuitBreakerOpen", "SinkQueueNearFull", "HighDeadLetterQueueRate", "HighSinkRetryRate", "SinkQueueGrowth"}


def test_burn(spark):
    def series(values):
        return conditions(spark, [60 * i for i in range(len(values))]).withColumn(
            "value", F.element_at(F.array(*[F.lit(v) for v in values]), (F.unix_seconds("eval_ts") % 3600 / 60 + 1).cast("int")))

    out = m.fast_burn(series([1.0, 0.9, 1.0]), series([0.1, 0.1, 2.0, 0.1]), series([0.0]))
    assert [b for _, b in secs(out, "burning")] == [False, True, True, False]
    assert [b for _, b in secs(m.slow_burn(series([1.0, 0.99])), "burning")] == [False, True]


def _at(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("eval_ts", F.timestamp_seconds("t")).drop("t")


def test_overlapping_inhibitions_all_count(spark):
    firing = _at(spark, [(0, "NoIngestEvents", "a", "x"), (0, "HighWritesLatency", "a", "x"), (0, "HighReadLatency", "b", "x"), (0, "ServiceDown", None, "x"), (0, "DiskWritesSlow", None, "x")], "t int, alertname string, job string, zone string")
    left = {r.alertname for r in al.inhibit(firing).collect()}
    assert left == {"NoIngestEvents", "HighReadLatency", "ServiceDown"}
    twice = [al.Inhibition("NoIngestEvents", "High.*", ("job",)), al.Inhibition("NoIngestEvents", "High.*", ("zone",))]
    assert {r.alertname for r in al.inhibit(firing, twice).collect()} == {"NoIngestEvents", "ServiceDown", "DiskWritesSlow"}


def test_missing_labels_are_equal(spark):
    left = _at(spark, [(0, None), (0, "a"), (60, None)], "t int, sink string")
    right = _at(spark, [(0, None)], "t int, sink string")
    assert [r.sink for r in al.both(left, right, ["sink"]).collect()] == [None]
    assert al.unless(left, right, ["sink"]).count() == 2
    assert al.either(left, right, ["sink"]).count() == 3


def test_silence_of_late_born_and_unlabelled_series(spark):
    rows = [(0, "s", None, 1.0), (30, "s", None, 2.0), (70, "s", None, 2.0), (5000, "late", "b", 1.0)]
    series = spark.createDataFrame(rows, "t int, series string, sink string, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    found = al.silent(series, 60, 60, "1970-01-01 00:03:00", ("series", "sink")).collect()
    assert {r.series for r in found} == {"s"}
    grown = {r.eval_ts for r in m.increase(series, 60, ("series", "sink"), 60).where("increase > 0").collect()}
    assert grown and not grown & {r.eval_ts for r in found}


def test_routes_repeat_at_their_own_interval(spark):
    routes = (al.Route("fast", {"severity": "critical"}, 600), al.Route("slow", {"severity": "warning"}, 1800))
    rows = [(t, "A", "critical") for t in range(0, 3600, 300)] + [(t, "B", "warning") for t in range(0, 3600, 300)]
    firing = _at(spark, rows, "t int, alertname string, severity string")
    sent = al.notifications(firing, ("alertname",), None, routes=routes).groupBy("receiver").count().collect()
    assert {r.receiver: r["count"] for r in sent} == {"fast": 6, "slow": 2}


def test_burn_takes_the_worst_of_several_series(spark):
    a = _at(spark, [(0, "x", 1.0), (0, "y", 0.2), (60, "x", 1.0)], "t int, job string, value double")
    b = _at(spark, [(0, "x", 0.1), (0, None, 9.0)], "t int, job string, value double")
    c = _at(spark, [(60, "x", 0.0)], "t int, job string, value double")
    found = m.fast_burn(a, b, c, slo=0.99, latency_limit=1.0, error_limit=0.5)
    assert secs0(found) == [(0, True), (60, False)]
    by_job = m.fast_burn(a, b, c, slo=0.99, latency_limit=1.0, error_limit=0.5, on=("job",))
    assert sorted(((r.job or "-"), r.burning) for r in by_job.where("eval_ts = timestamp_seconds(0)").collect()) == [("-", True), ("x", False), ("y", True)]


def secs0(df):
    return sorted((int(r.eval_ts.timestamp()), r.burning) for r in df.collect())


def test_availability_rules_keep_series_apart_and_burn_series_follow(spark):
    up = samples(spark, "up", [(0, 1), (60, 1)], instance="a").unionByName(samples(spark, "up", [(0, 0), (60, 0)], instance="b"))
    rules = m.slo_rules(up)
    rows = rules.where("name LIKE '%availability%'").select("ts", "name", F.to_json("labels").alias("l")).collect()
    assert len(rows) == len(set(rows)) and {"a", "b"} == {r.i for r in rules.where("name LIKE '%availability%'").select(F.col("labels")["instance"].alias("i")).collect()}
    burns = m.burn_rules(rules).groupBy("name").agg(F.max("value").alias("v")).collect()
    assert {r.name: r.v for r in burns} == {"slo:error_budget_burn:fast:4h": 1.0, "slo:error_budget_burn:slow:30d": 1.0}


def test_samples_of_the_rules_are_made_by_code_that_is_compiled(spark, tmp_path):
    """The JVM interprets a method of more than 8000 bytes, which took most of the time of slo_rules."""
    rows = [(1, "2024-01-01 00:00:10", 7, "click", 3.0), (2, "2024-01-01 00:05:00", 10, "signup", None), (3, None, None, "error", 1e9), (4, "2024-01-01 00:05:00", 1, None, 0.5)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    made = q_metrics._slo_samples(spark, str(tmp_path))
    series = m.select_series(made, ["up", "requests_total", "ingest_seconds_bucket"], ("le", "sink", "status"))
    code = series._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    found = made.select("ts", "name", F.to_json("labels").alias("labels"), "value").collect()
    assert len(found) == len(rows) * (len(q_metrics.BOUNDS) + 2)
    own = {(r.name, r.value) for r in found if "job" in r["labels"]}
    assert own == {("sink_written_total", 1.0), ("up", 0.0), ("sink_error_total", 3.0), ("sink_queue_bytes", 4.0)}
    first = {r["labels"]: r.value for r in found if r.ts and r.ts.second == 10 and "le" in r["labels"]}
    assert first == {f'{{"sink":"click","le":"{n}"}}': 1.0 if 3.0 <= float(n) else 0.0 for n in [*map(repr, q_metrics.BOUNDS), "+Inf"]}


def test_samples_of_a_task_are_bounded(spark, monkeypatch):
    """More samples make more tasks, and the cells stay the same: two series, a reset, a range without samples."""
    grown = samples(spark, "requests_total", [(t, (t * 7) % 90) for t in range(0, 4000, 9)], status="500").unionByName(samples(spark, "requests_total", [(t, t) for t in range(5000, 6000, 50)], status="200"))
    want = sorted(m.rule_cells(grown, {"requests_total": 300}, ("status",)).collect())
    tasks, dealt = [], type(grown).repartition
    monkeypatch.setattr(m, "SAMPLES", 10)
    monkeypatch.setattr(type(grown), "repartition", lambda df, n, *by: (tasks.append(n), dealt(df, n, *by))[1])
    assert sorted(m.rule_cells(grown, {"requests_total": 300}, ("status",)).collect()) == want and len(want) > 10
    assert tasks == [-(-grown.count() // 10)]
    assert {r.status: r.n for r in m.rule_cells(grown, {"requests_total": 300}, ("status",)).groupBy("status").agg(F.sum("n").alias("n")).collect()} == {"500": 445, "200": 20}
