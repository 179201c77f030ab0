"""Queries over log entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylight.operators import logs
from quaylight.plans import shapes as sh
from quaylight.plans.registry import query
from quaylight.plans.shapes import AS_OF, LOGS_SQL, seconds, step_sql, table, with_parts

LG = with_parts(LOGS_SQL)


def _eval(df):
    return df.withColumn("eval_s", seconds("eval_ts")).drop("eval_ts")


@query(
    "SELECT event_id, epoch_us(ts) // 1000000 * 1000000000 AS ts_ns, concat(event_type, ' {\"timestamp\":\"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), "
    "'\",\"k\":', user_id % 7, CASE WHEN user_id % 5 = 0 THEN ',\"host\":\"\"' ELSE '' END, '}') AS line, "
    "concat('{', CASE WHEN user_id % 5 > 0 THEN concat('\"host\":\"host_', user_id % 20, '\",') ELSE '' END, "
    "'\"service\":\"', CASE WHEN user_id % 2 = 0 THEN 'my_app.v1' ELSE 'edge' END, '\",\"source\":\"', "
    "CASE WHEN user_id % 3 = 0 THEN 'central' ELSE concat('user-', user_id) END, '\"}') AS labels FROM events"
)
def log_entry_conversion(spark, folder):
    """Events to (time, line, labels): labels are cleaned, the rest of the event joins the line."""
    user = F.col("user_id")
    e = table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("event_type").alias("message"),
        (user % 7).alias("k"),
        F.when(user % 5 > 0, F.concat(F.lit(" host#"), user % 20)).otherwise("").alias("host"),
        F.when(user % 2 == 0, "my app.v1").alias("service"),
        F.when(user % 3 > 0, F.concat(F.lit("user-"), user)).alias("source"),
        F.lit("never in a line").alias("_internal"),
    )
    out = logs.to_entries(e, sh.as_of(), keep=("event_id",))
    return out.withColumn("labels", logs.label_key(F.col("labels")))


@query(
    "SELECT p_partkey, regexp_replace(trim(concat(p_name, '#', p_brand)), '[^A-Za-z0-9_.-]', '_', 'g') AS label FROM part"
)
def safe_labels(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit(" "), "p_name", F.lit("#"), "p_brand", F.lit("\t")).alias("l")
    )
    return p.select("p_partkey", logs.safe_label(F.col("l")).alias("label"))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) * 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000000 ELSE 1706616000000000000 END AS ts_ns FROM events"
)
def entry_time_ns(spark, folder):
    k = F.col("event_id") % 3
    e = table(spark, folder, "events").select(
        "event_id",
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise("?").alias("timestamp"),
        F.when(k == 1, F.unix_seconds("ts")).alias("time"),
    )
    return e.select("event_id", logs.entry_time_ns(e, sh.as_of()).alias("ts_ns"))


@query(
    LG + ", n AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch_no, "
    "concat('{\"host\":\"', host, '\",\"service\":\"', service, '\",\"severity\":\"', severity, '\",\"type\":\"', type, '\"}') AS stream FROM lg) "
    "SELECT batch_no, stream, count(*) AS entries, md5(string_agg(concat(epoch_us(ts) * 1000, ' ', line), chr(10) ORDER BY ts, event_id)) AS content FROM n GROUP BY ALL"
)
def stream_grouping(spark, folder):
    """Push batches of one hundred entries, grouped by label set, values in time order."""
    g = logs.group_streams(sh.log_entries(spark, folder), "event_id", 100)
    text = F.array_join(
        F.transform("values", lambda v: F.concat_ws(" ", v["ts_ns"].cast("string"), v["line"])), "\n"
    )
    return g.select("batch_no", "stream", F.size("values").cast("bigint").alias("entries"), F.md5(text).alias("content"))


# ---- selection -------------------------------------------------------------------------------


@query(LG + "SELECT event_id, line FROM lg WHERE service IN ('api', 'auth') AND severity = 'error' AND host <> 'host4'")
def label_matchers(spark, folder):
    s = logs.select_streams(
        sh.log_entries(spark, folder), service=("=~", "api|auth"), severity="error", host=("!=", "host4"), missing=""
    )
    return s.select("event_id", "line")


@query(
    "SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') AND regexp_matches(text, '(?i)th[aeiou]r') AND NOT contains(text, 'zzz')"
)
def line_filters(spark, folder):
    c = table(spark, folder, "conversations").withColumnRenamed("text", "line")
    return logs.filter_lines(c, ("|=", "the"), ("|~", "(?i)th[aeiou]r"), ("!=", "zzz"), ("!~", r"\d{9}")).select("conv_id", "turn")


@query(
    LG + "SELECT event_id, json_extract_string(props, '$.k') AS k FROM lg WHERE service = 'api' AND json_extract_string(props, '$.k') <> ''"
)
def json_field_filter(spark, folder):
    s = logs.select_streams(sh.log_entries(spark, folder), service="api")
    return logs.field_not_empty(logs.json_stage(s, ["k"], "props"), "k").select("event_id", "k")


@query(LG + f"SELECT event_id, line FROM lg WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF}'")
def range_selection(spark, folder):
    return logs.range_select(sh.log_entries(spark, folder), AS_OF, 3600).select("event_id", "line")


# ---- range aggregates ------------------------------------------------------------------------

_H = step_sql("ts", 3600)


@query(LG + f"SELECT service, {_H} * 3600 AS eval_s, count(*) AS count FROM lg GROUP BY ALL")
def count_over_time(spark, folder):
    return _eval(logs.count_over_time(sh.log_entries(spark, folder), 3600, ["service"]))


@query(
    LG + f", s AS (SELECT severity, unnest(generate_series({_H}, {_H} + 5)) AS step FROM lg) "
    "SELECT severity, step * 3600 AS eval_s, count(*) AS count FROM s GROUP BY ALL"
)
def sliding_count_over_time(spark, folder):
    """Six-hour range evaluated every hour."""
    return _eval(logs.count_over_time(sh.log_entries(spark, folder), 21600, ["severity"], 3600))


@query(LG + f"SELECT service, {_H} * 3600 AS eval_s, round(count(*) / 3600.0, 9) AS rate FROM lg WHERE severity = 'error' GROUP BY ALL")
def log_rate(spark, folder):
    s = logs.select_streams(sh.log_entries(spark, folder), severity="error")
    return _eval(logs.log_rate(s, 3600, ["service"])).withColumn("rate", F.round("rate", 9))


_D = step_sql("ts", 86400)


@query(
    LG + f", c AS (SELECT host, {_D} * 86400 AS eval_s, count(*) AS count FROM lg GROUP BY ALL) "
    "SELECT host, eval_s, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY eval_s ORDER BY count DESC, host) AS rank FROM c) WHERE rank <= 3"
)
def top_hosts(spark, folder):
    c = logs.count_over_time(sh.log_entries(spark, folder), 86400, ["host"])
    return _eval(logs.top_k(c, 3, "count", "eval_ts", ["host"])).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    LG + f", c AS (SELECT line AS message, {_D} * 86400 AS eval_s, count(*) AS count FROM lg WHERE severity = 'error' GROUP BY ALL) "
    "SELECT message, eval_s, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY eval_s ORDER BY count DESC, message) AS rank FROM c) WHERE rank <= 10"
)
def top_messages(spark, folder):
    s = logs.select_streams(sh.log_entries(spark, folder), severity="error").withColumn("message", F.col("line"))
    c = logs.count_over_time(s, 86400, ["message"])
    return _eval(logs.top_k(c, 10, "count", "eval_ts", ["message"])).withColumn("rank", F.col("rank").cast("bigint"))


@query(LG + f"SELECT service, {_D} * 86400 AS eval_s, round(quantile_cont(value, 0.95), 6) AS quantile FROM lg GROUP BY ALL")
def quantile_over_time(spark, folder):
    q = logs.quantile_over_time(sh.log_entries(spark, folder), 0.95, "value", 86400, ["service"])
    return _eval(q).withColumn("quantile", F.round("quantile", 6))


@query(
    LG + f", g AS (SELECT unnest(generate_series((SELECT min({_H}) FROM lg), (SELECT max({_H}) FROM lg))) AS step) "
    f"SELECT step * 3600 AS eval_s, 1 AS absent FROM g WHERE step NOT IN (SELECT {_H} FROM lg WHERE service = 'api' AND severity = 'error')"
)
def absent_over_time(spark, folder):
    e = sh.log_entries(spark, folder)
    return _eval(logs.absent_over_time(e, logs.select_streams(e, service="api", severity="error"), 3600))


@query(LG + f"SELECT service, {_H} * 3600 AS eval_s, count(*) AS count FROM lg WHERE contains(line, 'error value=1') GROUP BY ALL HAVING count(*) > 1")
def threshold_on_count(spark, folder):
    s = logs.filter_lines(sh.log_entries(spark, folder), ("|=", "error value=1"))
    return _eval(logs.count_over_time(s, 3600, ["service"]).where(F.col("count") > 1))


@query(LG + "SELECT DISTINCT host AS value FROM lg")
def label_values(spark, folder):
    return logs.label_values(sh.log_entries(spark, folder), "host")


@query("SELECT DISTINCT name FROM (SELECT unnest(['service', 'type', 'severity', 'host']) AS name FROM events)")
def label_names(spark, folder):
    return logs.label_names(sh.log_entries(spark, folder))
