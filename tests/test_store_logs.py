import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quaylight.operators import commits, logs, store


def ts(text):
    return F.lit(text).cast("timestamp")


def test_store_rows_are_stable(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", "syslog", "web01", "m"), ("1640995200", " ", None, None), (None, None, " ", "x"), ("2024-01-01T02:00:00+02:00", "a", "b", "c")],
        "timestamp string, type string, source string, message string")
    rows = store.store_rows(df, ts("2024-02-02"), "b").collect()
    assert [str(r.ts) for r in rows] == ["2024-01-01 00:00:00", "2022-01-01 00:00:00", "2024-02-02 00:00:00", "2024-01-01 00:00:00"]
    assert [r.type for r in rows] == ["syslog", "unknown", "unknown", "a"]
    assert [r.source for r in rows] == ["web01", "unknown", "unknown", "b"]
    assert json.loads(rows[0].data) == {"type": "syslog", "source": "web01", "message": "m"}
    again = store.store_rows(df, ts("2024-02-02"), "b").collect()
    assert [r.id for r in rows] == [r.id for r in again]
    assert store.store_rows(df, ts("2024-02-02"), "c").first().id != rows[0].id


def test_store_prunes_days(spark, tmp_path):
    df = spark.range(96).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("timestamp"),
        F.lit("t").alias("type"), F.lit("s").alias("source"))
    store.append(store.store_rows(df, ts("2024-02-02")), str(tmp_path / "s"))
    back = store.read(spark, str(tmp_path / "s"))
    assert back.count() == 96
    q = store.query_events(back, "2024-01-02", "2024-01-02 05:00:00", "t", "s", limit=3, offset=1)
    assert [str(r.ts)[11:13] for r in q.collect()] == ["04", "03", "02"]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    text = store.in_range(back, "2024-01-02", "2024-01-02 05:00:00")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(event_date" in text


def test_containment(spark):
    df = spark.createDataFrame(
        [(1, '{"tags":{"service":"nginx","n":1},"l":["a",{"x":2}]}'), (2, '{"tags":{"service":"web"}}'), (3, "broken"), (4, '{"tags":{"service":1}}')],
        "id int, data string")
    ids = lambda p: [r.id for r in store.containing(df, p).collect()]
    assert ids({"tags": {"service": "nginx"}}) == [1]
    assert ids({"tags": {"service": 1}}) == [4] and ids({"tags": {"service": "1"}}) == []
    assert ids({"l": [{"x": 2}]}) == [1] and ids({"l": ["b"]}) == [] and ids({"tags": {"n": 1.0}}) == [1]
    assert ids({}) == [1, 2, 4]
    merged = store.merge_payload(
        spark.createDataFrame([(1, "col", '{"source":"doc","extra":5}')], "id int, source string, data string"),
        {"source": "string", "extra": "int"})
    assert (merged.first().source, merged.first().extra) == ("doc", 5)


def test_log_entries(spark):
    df = spark.createDataFrame(
        [Row(timestamp=1640995200, message="hi", service="test service with spaces", host="special@chars#here", request_id="r1", severity=None, _x="no", tags={"site": "ams"})],
        "timestamp long, message string, service string, host string, request_id string, severity string, _x string, tags map<string,string>")
    r = logs.to_entries(df.drop("tags"), ts("2024-01-01"), {"service": "d", "source": "c"}).first()
    assert r.ts_ns == 1640995200000000000
    assert r.labels == {"service": "test_service_with_spaces", "host": "special_chars_here", "source": "c"}
    assert r.line == 'hi {"timestamp":1640995200,"request_id":"r1"}'
    p = logs.to_entries(df, ts("2024-01-01"), promote_tags=True).first()
    assert p.labels["site"] == "ams"
    no_message = logs.to_entries(df.select("timestamp", "request_id"), ts("2024-01-01")).first()
    assert no_message.line == '{"timestamp":1640995200,"request_id":"r1"}'
    # A label that is too long goes to the line, unless a default takes its place.
    long = spark.createDataFrame([("x" * 1025, "y" * 1025, "é-1.a")], "service string, site string, host string")
    r = logs.to_entries(long, ts("2024-01-01")).first()
    assert r.labels == {"service": "edge", "source": "central", "host": "é-1.a"}
    assert r.line == '{"site":"' + "y" * 1025 + '"}'


def test_streams(spark):
    rows = [(0, 3, "c", {"a": "1", "b": "2"}), (1, 1, "a", {"b": "2", "a": "1"}), (2, 2, "b", {"a": "9"}), (3, 0, "z", {"a": "1", "b": "2"})]
    df = spark.createDataFrame(rows, "id long, ts_ns long, line string, labels map<string,string>")
    got = {(r.batch_no, r.stream): [(v.ts_ns, v.line) for v in r["values"]] for r in logs.group_streams(df, "id", 3).collect()}
    assert got == {(0, '{"a":"1","b":"2"}'): [(1, "a"), (3, "c")], (0, '{"a":"9"}'): [(2, "b")], (1, '{"a":"1","b":"2"}'): [(0, "z")]}


def test_matchers(spark):
    df = spark.createDataFrame(
        [(1, "api", "GET /a error", {"service": "api"}), (2, "auth", "debug x", {"service": "auth-2"}), (3, None, '{"user_id":"u"}', {})],
        "id int, k string, line string, labels map<string,string>")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(logs.select_streams(df, service="api")) == [1]
    assert ids(logs.select_streams(df, service=("=~", "api|auth"))) == [1]
    assert ids(logs.select_streams(df, service=("!=", "api"))) == [2, 3]
    assert ids(logs.select_streams(df, service=("!~", "a.*"))) == [3]
    assert ids(logs.select_streams(df, service="")) == [3]
    assert ids(logs.filter_lines(df, ("!=", "debug"), ("|~", "(?i)ERROR"))) == [1]
    assert ids(logs.field_not_empty(logs.json_stage(df, ["user_id"]), "user_id")) == [3]


def test_exact_quantile_of_a_hot_group(spark):
    values = [((i * 7919) % 1000) / 8 - 20 for i in range(997)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "value double").select(
        "value", F.lit("2024-01-01 00:10:00").cast("timestamp").alias("ts"), F.create_map(F.lit("s"), F.lit("x")).alias("labels"))
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        want = df.select(F.percentile("value", q)).first()[0]
        got = logs.quantile_over_time(df, q, "value", 3600, ["s"]).first()["quantile"]
        assert abs(got - want) < 1e-9


def test_log_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"l{i}", {"a": str(i % 2)}) for i in range(10)], "ts_ns long, line string, labels map<string,string>")
    logs.write_log_store(df, str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert logs.select_streams(back, a="1").count() == 5


def test_quantile_of_missing_labels_infinities_and_overlapping_ranges(spark):
    rows = [(0, None, 1.0), (10, None, 3.0), (0, "a", float("inf")), (5, "a", float("inf")), (70, "a", 2.0), (71, "a", float("-inf")), (72, "a", 100.0), (73, "a", 100.1)]
    df = spark.createDataFrame(rows, "t int, lab string, v double").select(
        F.timestamp_seconds("t").alias("ts"), F.when(F.col("lab").isNotNull(), F.create_map(F.lit("lab"), "lab")).otherwise(F.create_map().cast("map<string,string>")).alias("labels"), "v")
    found = {(r.lab, int(r.eval_ts.timestamp())): r.quantile for r in logs.quantile_over_time(df, 0.5, "v", 120, ["lab"], 60).collect()}
    # The value at t covers (t - 120, t].
    assert found[None, 0] == 1.0 and found[None, 60] == 2.0 and found["a", 60] == float("inf")
    assert found["a", 120] == 100.0 and found["a", 180] == pytest.approx(51.0)


def test_equal_events_have_ids_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "t", "s", "same")] * 3 + [("2024-01-01T00:00:00Z", "t", "s", "other")], "timestamp string, type string, source string, message string")
    for payload in ("text", "variant"):
        for run in ("a", "b"):  # a replay gives the same ids
            store.append(store.store_rows(df, ts("2024-02-02"), "b", payload=payload), str(tmp_path / payload / run))
        ids = [sorted(r.id for r in store.read(spark, str(tmp_path / payload / run), payload).collect()) for run in ("a", "b")]
        assert ids[0] == ids[1] and len(set(ids[0])) == 4


def test_ids_by_position(spark, tmp_path):
    spark.createDataFrame([("t", "x")] * 5, "type string, message string").coalesce(1).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).select("*", store.row_position().alias("at"))
    rows = store.store_rows(df, ts("2024-02-02"), "b", "at")
    assert len({r.id for r in rows.collect()}) == 5 and "at" not in json.loads(rows.first().data)
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in store.store_rows(df, ts("2024-02-02"), "b", "at").collect())


def test_containment_in_variant_columns(spark):
    texts = ['{"tags":{"service":"nginx","n":1},"l":["a",{"x":2}],"b":true,"z":null}', '{"tags":{"service":"web"}}', '"nginx"', '{"tags":{"service":1}}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.parse_json("text").alias("data"), "text")
    probes = [{"tags": {"service": "nginx"}}, {"tags": {"service": 1}}, {"tags": {"service": "1"}}, {"l": [{"x": 2}]}, {"l": ["b"]}, {}, {"tags": {}}, "nginx", {"b": True}, {"z": None}, {"tags": {"n": 1.0}}, {"tags": {"service": "nginx", "n": 1}, "b": True}]
    for probe in probes:
        want = [r.id for r in store.containing(df, probe, "text").collect()]
        assert [r.id for r in store.containing(df, probe).collect()] == want
    plan = store.containing(df.select("id", "data"), {"tags": {"service": "nginx"}})._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_a_batch_that_dies_leaves_what_was_there(spark, tmp_path):
    """A failure in mid-write, a replay, a batch without rows, and a table without batches."""
    root = str(tmp_path / "t")
    rows = store.store_rows(spark.range(20).selectExpr("'t' AS type", "cast(id AS string) AS message"), ts("2024-02-02"), "0")
    assert commits.read(spark, root, "id long").count() == 0
    store.commit(rows, root, 0)
    first = sorted(r.id for r in store.read(spark, root).collect())
    dies = rows.withColumn("type", F.when(F.get_json_object("data", "$.message") == "17", F.raise_error(F.lit("disk gone")).cast("string")).otherwise(F.col("type")))
    for batch in (0, 1):
        with pytest.raises(Exception, match="disk gone"):
            store.commit(dies, root, batch)
        assert sorted(r.id for r in store.read(spark, root).collect()) == first
    store.commit(rows.limit(5), root, 0)
    store.commit(rows.limit(0), root, 1)
    assert store.read(spark, root).count() == 5 and len(commits.committed(spark, root)) == 2


def test_quantiles_of_values_that_are_close(spark):
    """50 000 distinct values within one part in ten thousand, in two groups: bins are refined until small."""
    df = spark.range(50_000).select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"), F.create_map(F.lit("lab"), (F.col("id") % 2).cast("string")).alias("labels"),
        (F.lit(100.0) + F.pow(F.col("id") / 50_000, 3) / 100).alias("v"))
    cells = df.select(F.col("labels")["lab"].alias("lab"), "v", F.lit(1).alias("n"))
    picked = logs._around_rank(cells, ["lab"], 0.37, 200)
    assert picked.groupBy("lab", "bin").count().agg(F.max("count")).first()[0] <= 200
    for q in (0.0, 0.37, 0.999, 1.0):
        got = {r.lab: r.quantile for r in logs.quantile_over_time(df, q, "v", 60, ["lab"], most=200).collect()}
        want = {r.lab: r.q for r in cells.groupBy("lab").agg(F.percentile("v", q).alias("q")).collect()}
        assert got == pytest.approx(want, rel=1e-15)
