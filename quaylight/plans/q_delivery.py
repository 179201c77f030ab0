"""Queries over delivery tables, fan-out statistics and the batch forms of stream operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaylight.operators import delivery, failures, logs, sinks
from quaylight.plans import shapes as sh
from quaylight.plans.registry import query
from quaylight.plans.shapes import DELIVERIES_SQL, EVENTS_SQL, stamp, table, with_parts
from quaylight.session import cut_lineage
from quaylight.streaming import windows

DL = with_parts(DELIVERIES_SQL)
NUMBERED = "n AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) AS i FROM dl WHERE status = 'pending')"


def _pending(spark, folder):
    return sh.deliveries(spark, folder).where("status = 'pending'")


# ---- batches and duplicates ------------------------------------------------------------------


@query(
    with_parts(DELIVERIES_SQL, NUMBERED)
    + "SELECT i // 100 AS batch_no, md5(string_agg(c, '' ORDER BY c)) AS batch_key, count(*) AS batch_size FROM "
    "(SELECT i, concat(message_data, strftime(ts, '%Y-%m-%d')) AS c FROM n) GROUP BY ALL"
)
def batch_keys(spark, folder):
    d = _pending(spark, folder).select(
        "id", F.col("message_data").alias("message"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp")
    )
    return delivery.batch_keys(d, "id", 100)


_CHAIN = (
    "nx AS (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21600.000001 seconds' FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events), "
    "ch AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY ALL UNION ALL SELECT nx.user_id, nx.nxt FROM ch JOIN nx ON ch.user_id = nx.user_id AND ch.ts = nx.ts WHERE nx.nxt IS NOT NULL) "
)


@query(f"WITH RECURSIVE {_CHAIN} SELECT e.event_id, e.user_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, e.event_type FROM events e SEMI JOIN ch USING (user_id, ts)")
def windowed_duplicate_drop(spark, folder):
    """First sight per user and six hours; duplicates do not extend the window."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return delivery.drop_repeats(e, ["user_id"], "ts", "event_id", 21600).withColumn("ts", stamp("ts"))


@query(
    "WITH RECURSIVE " + _CHAIN.replace("FROM events", "FROM (SELECT event_id, ts, event_type AS user_id FROM events)")
    + "SELECT user_id AS event_type, count(*) AS kept, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_kept FROM ch GROUP BY ALL"
)
def windowed_duplicate_drop_hot(spark, folder):
    """The same rule where a few keys hold all rows: a key's chain runs over many partitions."""
    from quaylight.operators.series import first_sights

    e = table(spark, folder, "events")
    k = first_sights(e, ["event_type"], "ts", 21600)
    return k.groupBy("event_type").agg(F.count("*").alias("kept"), stamp(F.max("ts")).alias("last_kept"))


# ---- queue tables ----------------------------------------------------------------------------


@query(DL + "SELECT id, status FROM dl WHERE status = 'pending' ORDER BY dl.ts, id LIMIT 50")
def fifo_batch(spark, folder):
    return delivery.fifo_batch(sh.deliveries(spark, folder), 50).select("id", "status")


_ATT = (
    "a AS (SELECT l_orderkey AS id, l_returnflag = 'R' AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o FROM lineitem), "
    "b AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY id ORDER BY o) AS nb FROM a), "
    "s AS (SELECT id, min(CASE WHEN NOT bad THEN o END) AS ok_at, min(CASE WHEN bad AND nb = 4 THEN o END) AS dead_at FROM b GROUP BY id) "
)


@query(
    "WITH " + _ATT + "SELECT s.id, CASE WHEN dead_at IS NOT NULL AND (ok_at IS NULL OR dead_at < ok_at) THEN 'dlq' WHEN ok_at IS NOT NULL THEN 'completed' ELSE 'pending' END AS status, "
    "(SELECT count(*) FROM b WHERE b.id = s.id AND bad AND nb <= 4 AND (ok_at IS NULL OR o < ok_at)) AS retry_count FROM s"
)
def attempt_disposition(spark, folder):
    """Completed, dead after the fourth failure, or pending, from the attempt log."""
    d = delivery.disposition(
        table(spark, folder, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R",
        ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    )
    return d.select(F.col("l_orderkey").alias("id"), "status", F.col("retry_count").cast("bigint").alias("retry_count"))


@query(DL + "SELECT id, status FROM dl WHERE NOT (status = 'completed' AND ts < TIMESTAMP '1999-12-31')")
def retention_rewrite(spark, folder):
    return delivery.apply_retention(sh.deliveries(spark, folder), "2000-01-01", 86400).select("id", "status")


@query(
    DL + "SELECT strftime(dl.ts, '%Y-%m') AS month, count(*) FILTER (WHERE NOT old) AS n, coalesce(CAST(sum(id) FILTER (WHERE NOT old) AS BIGINT), 0) AS ids, bool_or(old) AS written_again FROM "
    "(SELECT *, status = 'completed' AND dl.ts < TIMESTAMP '1995-06-14' AS old FROM dl) dl GROUP BY 1"
)
def retention_store(spark, folder):
    """Deliveries stored by month, expired ones deleted: rows that are left, and which months' files changed."""
    root = _root(spark, "retention")
    rows = sh.deliveries(spark, folder).select("id", "ts", "status", F.date_format("ts", "yyyy-MM").alias("month"))
    rows.repartition("month").write.partitionBy("month").parquet(root)
    shape = "id BIGINT, ts TIMESTAMP, status STRING, month STRING"
    read = lambda: spark.read.schema(shape).parquet(root)
    files = F.sort_array(F.collect_set(F.col("_metadata.file_path")))
    before = cut_lineage(read().groupBy("month").agg(files.alias("before")))
    delivery.expire(spark, root, shape, "month", "1995-06-15", 86400)
    after = read().groupBy("month").agg(files.alias("after"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    joined = before.join(after, "month", "left")
    again = F.coalesce(F.col("before") != F.col("after"), F.lit(True)).alias("written_again")
    return joined.select("month", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit(0)).alias("ids"), again)


@query(DL + "SELECT count(*) AS to_delete FROM dl WHERE status = 'completed' AND ts < TIMESTAMP '1999-12-31'")
def retention_dry_run(spark, folder):
    return delivery.retention_count(sh.deliveries(spark, folder), "2000-01-01", 86400)


@query(DL + "SELECT id, strftime(ts, '%Y-%m-%d') AS day, message_data FROM dl WHERE status = 'failed' ORDER BY dl.ts DESC, id LIMIT 10")
def sample_messages(spark, folder):
    return delivery.newest(sh.deliveries(spark, folder), 10, "failed").select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "message_data")


@query(DL + "SELECT count(*) AS total_messages, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM dl")
def delivery_status_counts(spark, folder):
    return delivery.status_counts(sh.deliveries(spark, folder))


@query(DL + "SELECT status, count(*) AS count FROM dl GROUP BY 1")
def delivery_status_breakdown(spark, folder):
    return delivery.status_breakdown(sh.deliveries(spark, folder))


@query(
    "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_message, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_message, "
    "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS timespan FROM events"
)
def time_span(spark, folder):
    s = delivery.time_span(table(spark, folder, "events"))
    return s.withColumns({"first_message": stamp("first_message"), "last_message": stamp("last_message")})


@query(DL + "SELECT count(*) AS depth, CAST(sum(length(message_data)) AS BIGINT) AS bytes FROM dl WHERE status = 'pending'")
def queue_depth(spark, folder):
    return delivery.queue_depth(_pending(spark, folder))


@query(
    with_parts(DELIVERIES_SQL) + "SELECT id, concat('{\"id\": ', id, ', \"message_data\": ', to_json(message_data), ', \"status\": \"failed\"}') AS original_message, "
    "'undecodable' AS reason, 5 AS attempts, substr(md5(concat('{\"id\": ', id, ', \"message_data\": ', to_json(message_data), ', \"status\": \"failed\"}')), 1, 8) AS message_hash "
    "FROM dl WHERE status = 'failed' AND NOT json_valid(message_data)"
)
def dead_letters(spark, folder):
    bad = sh.deliveries(spark, folder).where(
        (F.col("status") == "failed") & F.try_parse_json("message_data").isNull()
    ).select("id", "message_data", "status")
    d = delivery.dead_letters(bad, "undecodable", 5, sh.AS_OF).drop("dlq_timestamp")
    return d.withColumn("id", F.get_json_object("original_message", "$.id").cast("bigint"))


@query(DL + "SELECT id FROM dl WHERE status = 'failed' ORDER BY dl.ts DESC, id LIMIT 10")
def dead_letter_latest(spark, folder):
    return delivery.newest(sh.deliveries(spark, folder).where("status = 'failed'"), 10).select("id")


# ---- envelopes and fan-out -------------------------------------------------------------------


@query(
    with_parts(DELIVERIES_SQL, NUMBERED)
    + "SELECT i // 100 AS batch_no, CAST(count(*) AS INTEGER) AS batch_size, md5(concat('{\"messages\":[', string_agg(concat('{\"id\":', id, ',\"day\":\"', strftime(ts, '%Y-%m-%d'), '\"}'), ',' ORDER BY i), "
    "'],\"batch_size\":', count(*), ',\"timestamp\":\"2024-01-30 12:00:00\",\"source\":\"edge\",\"is_retry\":false}')) AS payload FROM n GROUP BY 1"
)
def envelope_sink(spark, folder):
    d = _pending(spark, folder).select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "status", F.col("id").alias("__spool_id"))
    return delivery.envelopes(d, "id", sh.AS_OF, 100).withColumn("payload", F.md5("payload"))


@query(
    "SELECT o_orderdate_m AS batch_id, CAST(sum(w) AS BIGINT) AS total_written, CAST(sum(e) AS BIGINT) AS total_errors, CAST(sum(e) AS BIGINT) AS total_retries, 0::BIGINT AS total_queued FROM "
    "(SELECT CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_m, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS w, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e FROM orders) GROUP BY 1"
)
def sink_totals(spark, folder):
    stats = table(spark, folder, "orders").select(
        F.month("o_orderdate").cast("bigint").alias("batch_id"),
        F.col("o_orderpriority").alias("sink"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("written"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("errors"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("retries"),
        F.lit(0).alias("queued"),
    )
    return sinks.sink_totals(stats)


@query(
    with_parts(EVENTS_SQL)
    + "SELECT sink, count(*) AS rows, CAST(sum(length(type)) AS BIGINT) AS type_chars FROM ev, unnest(['logs', 'store']) AS u(sink) GROUP BY 1"
)
def dual_fan_out(spark, folder):
    """One batch written to both sinks under its batch id and read back from the shared folder."""

    from quaylight.operators import store
    from quaylight.session import checkpoint_dir

    root = f"{checkpoint_dir(spark).rstrip('/')}/fan-{uuid.uuid4().hex}"
    e = sh.events(spark, folder).select("event_id", F.col("ts").alias("timestamp"), "type", "source", "message")
    sinks.fan_out(
        e,
        0,
        {
            "store": sinks.file_sink(f"{root}/store", lambda df: store.store_rows(df, sh.as_of(), "0")),
            "logs": sinks.file_sink(f"{root}/logs", lambda df: logs.to_entries(df, sh.as_of())),
        },
        f"{root}/stats",
    )
    kept = spark.read.parquet(f"{root}/store").select(F.lit("store").alias("sink"), "type")
    lines = spark.read.parquet(f"{root}/logs").select(F.lit("logs").alias("sink"), F.col("labels")["type"].alias("type"))
    return kept.unionByName(lines).groupBy("sink").agg(
        F.count("*").alias("rows"), F.sum(F.length("type")).cast("bigint").alias("type_chars")
    )


@query(
    "SELECT 'steady' AS sink, count(*) AS written, 0 AS errors, 0 AS retries, 0 AS queued FROM events "
    "UNION ALL SELECT 'flaky', count(*), 0, 2, 0 FROM events UNION ALL SELECT 'down', 0, count(*), 2, count(*) FROM events"
)
def sink_retries(spark, folder):
    """A steady sink, one that fails twice before it writes, and one that never does."""
    root, calls = _root(spark, "retries"), []
    steady = sinks.file_sink(f"{root}/steady", lambda df: df)

    def flaky(batch, batch_id):
        calls.append(batch_id)
        if len(calls) < 3:
            raise OSError("not yet")
        return sinks.file_sink(f"{root}/flaky", lambda df: df)(batch, batch_id)

    def down(batch, batch_id):
        raise OSError("never")

    outputs = {"steady": steady, "flaky": sinks.with_retries(flaky), "down": sinks.with_retries(down)}
    sinks.fan_out(table(spark, folder, "events").select("event_id", "event_type"), 0, outputs, f"{root}/stats")
    return spark.read.schema(sinks.STATS).parquet(f"{root}/stats").select("sink", "written", "errors", "retries", "queued")


# ---- batch forms of stream operators ---------------------------------------------------------


@query(
    "SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS count FROM events GROUP BY ALL"
)
def windowed_counts(spark, folder):
    w = windows.windowed_counts(table(spark, folder, "events"), ["event_type"], "5 minutes")
    return w.select("event_type", stamp("start").alias("start"), "count")


@query(
    "WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS w FROM events) "
    "SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS count FROM s GROUP BY ALL"
)
def sliding_counts(spark, folder):
    w = windows.windowed_counts(table(spark, folder, "events"), ["event_type"], "1 hour", "20 minutes")
    return w.select("event_type", stamp("start").alias("start"), "count")


@query(
    "WITH p AS (SELECT *, event_type IN ('error', 'view') AS bad FROM events), "
    "g AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM p), "
    "r AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS n FROM g) "
    "SELECT event_id, n AS consecutive_failures, n < 5 AS healthy FROM r"
)
def consecutive_failures(spark, folder):
    polls = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", "ts", (~F.col("event_type").isin("error", "view")).alias("ok")
    )
    c = failures.consecutive_failures(polls, ["user_id"], "ok", chunk_seconds=86400)
    return c.select(F.col("id").alias("event_id"), "consecutive_failures", "healthy")


# ---- the stream operators themselves, drained over the given files ----------------------------


def _stream(spark, folder, name):
    """The table as a stream of its files; all of it is there, so the stream drains and stops."""
    # A pattern, since the table may be one file: a plain path must be a folder.
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parquet*")


def _root(spark, name):
    from quaylight.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drained(counts, root):
    """Run a complete-mode stream to its end; each batch replaces the result."""

    def put(batch, _batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out")

    writer = counts.writeStream.outputMode("complete").foreachBatch(put)
    writer.option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(f"{root}/out")


@query(
    "SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS count FROM events GROUP BY ALL"
)
def stream_counts(spark, folder):
    """Windowed counts by the stream itself, drained to its end."""
    counts = windows.windowed_counts(_stream(spark, folder, "events"), ["event_type"], "5 minutes")
    return _drained(counts, _root(spark, "counts")).select("event_type", stamp("start").alias("start"), "count")


@query(
    "WITH p AS (SELECT *, event_type IN ('error', 'view') AS bad FROM events), "
    "g AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM p), "
    "r AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS n FROM g) "
    "SELECT event_id, n AS consecutive_failures, n < 5 AS healthy FROM r"
)
def stream_failures(spark, folder):
    """Failure runs counted by the stream: three slices of time, each after a restart, from the state store."""
    from quaylight.streaming.failures import run_failures

    polls = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", "ts", (~F.col("event_type").isin("error", "view")).alias("ok")
    )
    root = _root(spark, "polls")
    _restarted(_slices(polls), root, lambda s: run_failures(s, ["user_id"], "ok", root, f"{root}/log"))
    counted = spark.read.parquet(f"{root}/polls")
    return counted.select(F.col("id").alias("event_id"), "consecutive_failures", "healthy")


def _slices(rows, n=3):
    """Slices of equal time, oldest first."""
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    if ends.low is None:
        return [rows]
    width = (ends.high - ends.low) // n + 1
    place = F.expr(f"(unix_micros(ts) - {ends.low}) div {width}")
    return [rows.where(place == k) for k in range(n)]


def _restarted(slices, root, start):
    """Write one slice after the other below ``root/in`` and drain the stream after each, from its checkpoint."""
    for part in slices:
        part.write.mode("append").parquet(f"{root}/in")
        spark = part.sparkSession
        start(spark.readStream.schema(part.schema).parquet(f"{root}/in")).awaitTermination()


@query(f"WITH RECURSIVE {_CHAIN} SELECT e.event_id, e.user_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, e.event_type FROM events e SEMI JOIN ch USING (user_id, ts)")
def stream_duplicates(spark, folder):
    """The windowed duplicate drop by the stream, over three slices of time with a restart after each."""
    from quaylight.streaming import state

    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    root = _root(spark, "sights")
    state.use_state_store(spark)

    def start(stream):
        kept = state.drop_duplicates(stream, ["user_id"], "ts", 21600, tie="event_id")
        return kept.writeStream.option("checkpointLocation", f"{root}/log").trigger(availableNow=True).format("parquet").start(f"{root}/out")

    _restarted(_slices(events), root, start)
    return spark.read.schema(events.schema).parquet(f"{root}/out").withColumn("ts", stamp("ts"))


@query(
    "WITH e AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_id % 10 = 0 AS again FROM events), "
    "m AS (SELECT date_trunc('milliseconds', max(ts) FILTER (WHERE event_id % 10 <> 0)) - INTERVAL 10 MINUTE AS first, date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS last FROM events), "
    "s AS (SELECT e.*, again AND start + INTERVAL 5 MINUTE <= first AS late FROM e, m) "
    "SELECT 'closed' AS state, event_type, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS count FROM s, m WHERE NOT late AND start + INTERVAL 5 MINUTE <= last GROUP BY ALL "
    "UNION ALL SELECT 'open', event_type, strftime(start, '%Y-%m-%d %H:%M:%S.%f'), count(*) FROM s, m WHERE NOT late AND start + INTERVAL 5 MINUTE > last GROUP BY ALL "
    "UNION ALL SELECT 'late', NULL, NULL, count(*) FROM s WHERE late"
)
def stream_late(spark, folder):
    """Windows in append mode; a tenth of the events arrives after all others, most of it too late."""
    events = table(spark, folder, "events").select("event_id", "ts", "event_type")
    root = _root(spark, "late")
    counts = windows.BatchCounts()
    spark.streams.addListener(counts)
    try:
        def start(stream):
            run = windows.run_windows(stream, ["event_type"], f"{root}/out", f"{root}/log")
            run.awaitTermination()
            counts.wait(run)
            return run

        _restarted([events.where("event_id % 10 <> 0"), events.where("event_id % 10 = 0")], root, start)
    finally:
        spark.streams.removeListener(counts)
    closed = spark.read.schema("start timestamp, end timestamp, event_type string, count bigint").parquet(f"{root}/out")
    still = windows.open_windows(spark, f"{root}/log")
    late = spark.range(1).select(F.lit("late").alias("state"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("start"), F.lit(windows.late_rows(counts, closed, still)).cast("bigint").alias("count"))
    found = [d.select(F.lit(name).alias("state"), "event_type", stamp("start").alias("start"), "count") for name, d in (("closed", closed), ("open", still))]
    return found[0].unionByName(found[1]).unionByName(late)


@query(
    "SELECT slice, count(*) FILTER (WHERE role <> 'system') AS written FROM (SELECT *, conv_id % 3 AS slice FROM conversations) GROUP BY slice HAVING count(*) FILTER (WHERE role <> 'system') > 0"
)
def stream_micro_batches(spark, folder):
    """Three arrivals of envelope files, a micro-batch each: every batch is delivered and counted for itself."""
    from quaylight.streaming import ingest

    root = _root(spark, "batches")
    c = table(spark, folder, "conversations")
    message = F.struct(F.when(F.col("role") != "system", F.col("role")).alias("type"), (F.col("conv_id") % 3).cast("string").alias("source"), F.col("text").alias("message"))
    for k in range(3):
        part = c.where(F.col("conv_id") % 3 == k).select(F.to_json(F.struct(F.array(message).alias("messages"))).alias("value"))
        part.write.mode("append").text(f"{root}/in")
        events = ingest.event_stream(spark, f"{root}/in", max_files=100_000)
        sink = {"store": ingest.store_sink(f"{root}/store", sh.AS_OF)}
        ingest.run_ingest(events, [], sink, f"{root}/log", f"{root}/stats", quarantine=f"{root}/refused").awaitTermination()
    from quaylight.operators import commits

    rows = commits.read(spark, f"{root}/store", "batch STRING, source STRING, event_date DATE")
    batches = rows.groupBy(F.split_part("batch", F.lit("-"), F.lit(1)).cast("bigint").alias("batch_id")).agg(F.min("source").cast("bigint").alias("slice"), F.max("source").cast("bigint").alias("last"), F.count(F.lit(1)).alias("n"))
    stats = spark.read.schema(sinks.STATS).parquet(f"{root}/stats")
    return batches.where("slice = last").join(stats, "batch_id").where("n = written").select("slice", "written")


@query(
    "SELECT 'store' AS output, role AS kind, count(*) AS n, count(DISTINCT conv_id) AS sources FROM conversations WHERE role <> 'system' GROUP BY ALL "
    "UNION ALL SELECT 'quarantine', 'no type', count(*), count(DISTINCT conv_id) FROM conversations WHERE role = 'system'"
)
def stream_store_query(spark, folder):
    """Envelope files through the live path, a replayed batch, and the event query over what it stored."""
    from quaylight.operators import store
    from quaylight.streaming import ingest

    root = _root(spark, "live")
    c = table(spark, folder, "conversations")
    message = F.struct(
        F.when(F.col("role") != "system", F.col("role")).alias("type"),
        F.col("conv_id").cast("string").alias("source"),
        F.col("text").alias("message"),
        F.lit("2024-01-02T00:00:00Z").alias("timestamp"),
        F.col("turn").alias("turn"),
    )
    c.select(F.to_json(F.struct(F.array(message).alias("messages"))).alias("value")).write.text(f"{root}/in")
    for run in ("first", "again"):  # the second run is a replay: same batches, same folders
        events = ingest.event_stream(spark, f"{root}/in", max_files=100_000)
        sinks = {"store": ingest.store_sink(f"{root}/store", sh.AS_OF)}
        ingest.run_ingest(events, [], sinks, f"{root}/log-{run}", quarantine=f"{root}/refused").awaitTermination()
    rows = store.query_events(store.read(spark, f"{root}/store"), start="2024-01-02", end="2024-01-02 23:00:00", limit=None)
    kept = rows.groupBy(F.lit("store").alias("output"), F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    refused = spark.read.parquet(f"{root}/refused")
    source = F.get_json_object("event", "$.source")
    lost = refused.groupBy(F.lit("quarantine").alias("output"), F.col("rejected").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"))
    return kept.unionByName(lost)
