"""Operator inputs derived from the driver tables, as DataFrames and as SQL common table parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30 12:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stamp(c: Column | str) -> Column:
    """Instant as text with microseconds, the form both engines print alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def seconds(c: Column | str) -> Column:
    return F.unix_seconds(c)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# ---- events ----------------------------------------------------------------------------------

_EVENT_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "value": "value",
    "type": "event_type",
    "source": "concat('user-', user_id)",
    "severity": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN ' Notice ' "
    "WHEN 'signup' THEN 'info' WHEN 'click' THEN '7' ELSE 'verbose' END",
    "hostname": "concat('host', user_id % 20, '.', CASE user_id % 3 WHEN 0 THEN 'ams' WHEN 1 THEN 'sin' "
    "ELSE 'nyc' END, '.', CASE user_id % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' WHEN 2 THEN 'testing' "
    "WHEN 3 THEN 'stage' ELSE 'lab' END, '.example.com')",
    "path": "CASE user_id % 6 WHEN 0 THEN '/var/log/nginx/access.log' "
    "WHEN 1 THEN concat('/opt/svc', user_id % 7, '/app.log') WHEN 2 THEN '/var/log/mysql/error.log' "
    "WHEN 3 THEN '/srv/data/x.log' WHEN 5 THEN '/var/log/redis/redis.log' END",
    "source_ip": "concat('10.0.', user_id % 4, '.', user_id % 250)",
    "message": "concat(event_type, ' value=', value)",
    "data": "props",
}

# The column expressions above are plain SQL that both engines read alike.
EVENTS_SQL = "ev AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EVENT_COLUMNS.items()) + " FROM events)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        *[f"{e} AS {n}" for n, e in _EVENT_COLUMNS.items()]
    )


# ---- log entries -----------------------------------------------------------------------------

LOGS_SQL = (
    "lg AS (SELECT event_id, ts, value, concat(event_type, ' value=', value) AS line, props, "
    "CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'auth' WHEN 2 THEN 'web' ELSE 'db' END AS service, "
    "event_type AS type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, "
    "concat('host', user_id % 20) AS host FROM events)"
)


def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, ts, ts_ns, line, props, value, labels)."""
    e = table(spark, folder, "events").selectExpr(
        "event_id", "ts", "value", "props", "concat(event_type, ' value=', value) AS line",
        "CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'auth' WHEN 2 THEN 'web' ELSE 'db' END AS service",
        "event_type AS type", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity",
        "concat('host', user_id % 20) AS host",
    )
    pairs = [x for n in ("service", "type", "severity", "host") for x in (F.lit(n), F.col(n))]
    return e.select(
        "event_id", "ts", (F.unix_micros("ts") * 1000).alias("ts_ns"), "value", "props", "line",
        F.create_map(*pairs).alias("labels"),
    )


# ---- metric samples --------------------------------------------------------------------------

SAMPLE_COLUMNS = {
    "ts": "ts",
    "name": "CASE event_type WHEN 'click' THEN 'sink_written_total' WHEN 'error' THEN 'sink_error_total' "
    "WHEN 'view' THEN 'requests_total' WHEN 'signup' THEN 'up' ELSE 'sink_queue_bytes' END",
    "sink": "concat('sink', user_id % 3)",
    "status": "CASE user_id % 7 WHEN 0 THEN '500' WHEN 1 THEN '404' ELSE '200' END",
    "value": "CASE event_type WHEN 'signup' THEN (CASE WHEN user_id % 10 = 0 THEN 0.0 ELSE 1.0 END) "
    "WHEN 'purchase' THEN CAST(event_id % 1000 AS DOUBLE) * 110000.0 ELSE CAST(event_id % 97 AS DOUBLE) END",
}
SAMPLES_SQL = "sm AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SAMPLE_COLUMNS.items()) + " FROM events)"


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, name, labels, value): two sink counters, a request counter, an up gauge, a byte gauge."""
    s = table(spark, folder, "events").selectExpr(
        *[f"{e} AS {n}" for n, e in SAMPLE_COLUMNS.items()]
    )
    labels = F.create_map(
        F.lit("sink"), F.col("sink"), F.lit("status"), F.col("status"), F.lit("job"), F.lit("edge")
    )
    return s.select("ts", "name", labels.alias("labels"), F.col("value").cast("double").alias("value"))


# ---- deliveries ------------------------------------------------------------------------------

DELIVERIES_SQL = (
    "dl AS (SELECT o_orderkey AS id, o_orderdate AS ts, "
    "CASE WHEN o_custkey % 10 = 0 THEN concat('{broken ', o_orderkey) "
    "ELSE concat('{\"p\":\"', o_orderpriority, '\",\"c\":', o_custkey, '}') END AS message_data, "
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status "
    "FROM orders)"
)


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ts, message_data, status) spool rows, one per order; some payloads are not JSON."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate AS ts",
        "CASE WHEN o_custkey % 10 = 0 THEN concat('{broken ', o_orderkey) "
        "ELSE concat('{\"p\":\"', o_orderpriority, '\",\"c\":', o_custkey, '}') END AS message_data",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status",
    )


def with_parts(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def step_sql(ts: str, step_seconds: int) -> str:
    """Evaluation step number of an instant."""
    s = step_seconds * 1_000_000
    return f"((epoch_us({ts}) + {s - 1}) // {s})"


def increase_sql(source: str, keys: str, step_seconds: int) -> str:
    """Two table parts: neighbour differences ``dd`` and growth per step ``inc`` of ``source``."""
    return (
        f"dd AS (SELECT *, lag(value) OVER (PARTITION BY {keys} ORDER BY ts) AS prev FROM {source}), "
        f"inc AS (SELECT {keys}, {step_sql('ts', step_seconds)} AS step, "
        "sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS increase "
        f"FROM dd GROUP BY ALL)"
    )
