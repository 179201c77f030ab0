"""Queries over parsing jobs; raw text is derived from the driver tables by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions.payload import as_variant
from quaylight.operators import delivery
from quaylight.plans import shapes as sh
from quaylight.plans.registry import query
from quaylight.plans.shapes import DELIVERIES_SQL, EVENTS_SQL, stamp, table, with_parts
from quaylight.sources import devices, envelopes, exposition, imports, inventory, rawlog, syslog

EV = with_parts(EVENTS_SQL)

# ---- envelopes and raw lines -----------------------------------------------------------------

_MESSAGE = "STRUCT<id: BIGINT, type: STRING, source: STRING, message: STRING>"


def _envelope_rows(spark, folder):
    """Envelope documents of the conversations table: one batch per turn text."""
    c = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("role") != "system", F.col("role")).alias("type"),
        F.col("conv_id").cast("string").alias("source"),
        F.col("text").alias("message"),
    )
    docs = delivery.envelopes(c, "id", sh.AS_OF, size=10)
    return envelopes.messages(envelopes.parse(docs, F.col("payload"), _MESSAGE))


@query(
    "SELECT conv_id * 1000 + turn AS id, role AS type, CAST(conv_id AS VARCHAR) AS source, md5(text) AS message "
    "FROM conversations WHERE role <> 'system'"
)
def envelope_source(spark, folder):
    accepted, _ = envelopes.split_valid(_envelope_rows(spark, folder))
    return accepted.withColumn("message", F.md5("message"))


def _open_envelopes(spark, folder):
    """Envelopes with undeclared keys in their messages; every 7th document is cut off."""
    c = table(spark, folder, "conversations")
    message = F.struct(
        F.when(F.col("role") != "system", F.col("role")).alias("type"),
        F.col("text").alias("message"),
        F.struct(F.col("conv_id").alias("conv"), F.lit("own").alias("kind")).alias("data"),
        F.col("turn").alias("turn"),
        F.lit("outer").alias("kind"),
    )
    text = F.to_json(F.struct(F.array(message).alias("messages"), F.lit(1).alias("batch_size")))
    broken = F.pmod("conv_id", F.lit(7)) == 0
    docs = c.select(F.when(broken, F.concat(F.lit("{"), F.col("text"))).otherwise(text).alias("document"))
    return envelopes.parse(docs, F.col("document"), "VARIANT")


@query(
    "SELECT role AS type, md5(text) AS message, conv_id AS conv, turn, 'own' AS kind FROM conversations WHERE role <> 'system' AND conv_id % 7 <> 0"
)
def envelope_extras(spark, folder):
    """Undeclared keys of a message are kept in its payload; the payload's own keys win."""
    accepted, _ = envelopes.split_valid(envelopes.open_messages(_open_envelopes(spark, folder)))
    v = F.try_parse_json("data")
    return accepted.select(
        "type", F.md5("message").alias("message"), F.try_variant_get(v, "$.conv", "bigint").alias("conv"),
        F.try_variant_get(v, "$.turn", "bigint").alias("turn"), F.try_variant_get(v, "$.kind", "string").alias("kind"),
    )


@query(
    "SELECT CASE WHEN conv_id % 7 = 0 THEN 'corrupt document' ELSE 'no type' END AS reason, count(*) AS n "
    "FROM conversations WHERE conv_id % 7 = 0 OR role = 'system' GROUP BY 1"
)
def envelope_corrupt(spark, folder):
    """Documents that cannot be read and messages without a type both reach the rejects."""
    e = _open_envelopes(spark, folder)
    return envelopes.rejects(e, envelopes.open_messages(e)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'system'")
def envelope_rejects(spark, folder):
    _, rejected = envelopes.split_valid(_envelope_rows(spark, folder))
    return rejected.select("id")


@query(
    "WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/var/log/nginx/error.log' WHEN 1 THEN '/data/access.log' WHEN 2 THEN '/var/log/unbound/q.log' ELSE '/tmp/x' END AS p, unnest(string_split(text, chr(10))) AS line FROM documents) "
    "SELECT p AS file_path, CASE WHEN p LIKE '%/nginx/%' OR p LIKE '%access.log' THEN 'web' WHEN p LIKE '%unbound%' THEN 'dns' END AS service, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE length(line) > 0 GROUP BY ALL"
)
def raw_log_events(spark, folder):
    """Non-empty lines as events, with the service of their file."""
    k = F.col("doc_id") % 4
    lines = table(spark, folder, "documents").select(
        F.when(k == 0, "/var/log/nginx/error.log").when(k == 1, "/data/access.log")
        .when(k == 2, "/var/log/unbound/q.log").otherwise("/tmp/x").alias("file_path"),
        F.explode(F.split("text", "\n")).alias("value"),
    )
    e = rawlog.events(lines, sh.as_of())
    return e.groupBy("file_path", "service").agg(
        F.count("*").alias("lines"), F.sum(F.length("message")).cast("bigint").alias("chars")
    )


@query("SELECT doc_id, strlen(text) <= 2000 AS accepted FROM documents")
def size_guard(spark, folder):
    fits, rest = rawlog.size_guard(table(spark, folder, "documents"), "text", 2000)
    return fits.select("doc_id", F.lit(True).alias("accepted")).unionByName(
        rest.select("doc_id", F.lit(False).alias("accepted"))
    )


# ---- syslog ----------------------------------------------------------------------------------

_SYSLOG_LINE = (
    "CASE event_id % 4 "
    "WHEN 0 THEN concat('<', event_id % 192, '>1 2024-01-05T10:00:00Z host', user_id % 20, ' ', event_type, ' ', "
    "CASE WHEN user_id % 2 = 0 THEN '-' ELSE CAST(user_id AS STRING) END, ' ID', event_id % 7, ' ', "
    "CASE WHEN user_id % 3 = 0 THEN '[x@1 k=\"v\"]' ELSE '-' END, ' value ', value) "
    "WHEN 1 THEN concat('<', event_id % 192, '>Jan  5 10:00:00 host', user_id % 20, ' ', event_type, '[', user_id, ']: value ', value) "
    "WHEN 2 THEN concat('<', event_id % 192, '>Jan 15 10:00:00 host', user_id % 20, ' ', event_type, ': value ', value) "
    "ELSE concat('<34>no header ', event_type) END"
)


def _syslog_lines(spark, folder):
    return table(spark, folder, "events").selectExpr("event_id", f"{_SYSLOG_LINE} AS value")


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rfc5424' WHEN 3 THEN 'unknown' ELSE 'rfc3164' END AS rfc_variant, "
    "CASE WHEN event_id % 4 < 3 THEN event_id % 192 END AS priority, "
    "CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE concat('host', user_id % 20) END AS hostname, "
    "CASE WHEN event_id % 4 IN (1, 2) THEN event_type END AS tag, CASE WHEN event_id % 4 = 0 THEN event_type END AS app_name, "
    "CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id % 2 = 1 THEN CAST(user_id AS VARCHAR) END WHEN 1 THEN CAST(user_id AS VARCHAR) END AS process_id, "
    "CASE WHEN event_id % 4 = 0 THEN concat('ID', event_id % 7) END AS message_id, "
    "CASE WHEN event_id % 4 = 0 AND user_id % 3 = 0 THEN '[x@1 k=\"v\"]' END AS structured_data, "
    "CASE event_id % 4 WHEN 3 THEN concat('<34>no header ', event_type) ELSE concat('value ', value) END AS message, "
    "CASE event_id % 4 WHEN 0 THEN '2024-01-05T10:00:00Z' WHEN 1 THEN 'Jan  5 10:00:00' WHEN 2 THEN 'Jan 15 10:00:00' END AS timestamp_original, "
    "event_id % 4 = 3 AS failed FROM events"
)
def syslog_parse(spark, folder):
    p = syslog.parse(_syslog_lines(spark, folder))
    return p.select(
        "event_id", "rfc_variant", F.col("priority").cast("bigint").alias("priority"), "hostname", "tag", "app_name",
        "process_id", "message_id", "structured_data", "message", "timestamp_original",
        F.col("parse_error").isNotNull().alias("failed"),
    )


_FACILITY = "CASE (event_id % 192) // 8 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in fixed.FACILITIES.items()
) + " ELSE concat('unknown_', (event_id % 192) // 8) END"
_SEVERITY = "CASE (event_id % 192) % 8 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in fixed.SEVERITIES.items()
) + " END"


@query(f"SELECT {_FACILITY} AS facility, {_SEVERITY} AS severity, count(*) AS n FROM events WHERE event_id % 4 < 3 GROUP BY ALL")
def syslog_priority(spark, folder):
    p = syslog.parse(_syslog_lines(spark, folder)).where(F.col("priority").isNotNull())
    return p.groupBy("facility", "severity").agg(F.count("*").alias("n"))


# ---- importers -------------------------------------------------------------------------------


@query(
    "SELECT event_id AS extra_event_id, strftime(CASE WHEN user_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, "
    "concat('host', user_id % 20) AS source_ip, CAST(user_id AS INTEGER) AS source_port, event_type AS tag, "
    "CASE WHEN user_id % 3 = 0 THEN 3 END AS severity_num, CAST(user_id AS BIGINT) AS pid_int, props AS structured_data, "
    "CASE event_id % 4 WHEN 0 THEN 'RFC5424' WHEN 3 THEN NULL ELSE 'RFC3164' END AS rfc_variant FROM events"
)
def jsonl_syslog_import(spark, folder):
    """Importer fields under alias names; the rest comes along as extra fields."""
    e = table(spark, folder, "events").selectExpr(
        "event_id",
        "CASE WHEN user_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") END AS time",
        "concat('host', user_id % 20) AS host", "user_id AS port", "event_type AS program",
        "CASE WHEN user_id % 3 = 0 THEN 'ERR' ELSE 'fatal' END AS level", "user_id AS pid", "props AS data",
        f"{_SYSLOG_LINE} AS msg", "value AS _hidden",
    )
    n = imports.syslog_events(e, sh.as_of(), map_severity=True)
    return n.select(
        "extra_event_id", stamp("timestamp").alias("timestamp"), "source_ip", "source_port", "tag",
        F.col("severity_num").cast("int").alias("severity_num"), "pid_int", "structured_data", "rfc_variant",
    )


@query(
    "SELECT event_id AS extra_event_id, concat('host', user_id % 20) AS host, event_type AS metric_name, "
    "CASE WHEN user_id % 5 > 0 THEN value END AS value_double, CASE WHEN user_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value, "
    "CASE WHEN user_id % 2 = 0 AND user_id % 5 > 0 THEN round(value / 100.0, 9) END AS value_ratio FROM events"
)
def jsonl_metric_import(spark, folder):
    e = table(spark, folder, "events").selectExpr(
        "event_id", "ts", "concat('host', user_id % 20) AS target", "event_type AS name",
        "CASE WHEN user_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END AS value",
        "CASE WHEN user_id % 2 = 0 THEN '%' ELSE 's' END AS units",
    )
    n = imports.metric_events(e, sh.as_of(), percent_as_ratio=True)
    return n.select("extra_event_id", "host", "metric_name", "value_double", "value", F.round("value_ratio", 9).alias("value_ratio"))


@query(
    "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS timestamp, CAST(user_id AS DOUBLE) AS latitude, 0.0::DOUBLE AS longitude, "
    "event_type AS city, value AS temperature_celsius, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS DOUBLE) END AS humidity_percent, "
    "CASE WHEN user_id % 2 = 1 THEN 'damp' END AS humidity_text FROM events"
)
def weather_csv_rows(spark, folder):
    e = table(spark, folder, "events").selectExpr(
        "CAST(event_id AS STRING) AS event_id", "date_format(ts, 'yyyy-MM-dd') AS time", "CAST(user_id AS STRING) AS lat",
        "event_type AS location", "CAST(value AS STRING) AS temp",
        "CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE 'damp' END AS rh",
    )
    w = imports.weather_events(e, sh.as_of())
    return w.select(
        F.col("current_weather.event_id").cast("bigint").alias("event_id"), stamp("timestamp").alias("timestamp"),
        "location.latitude", "location.longitude", "location.city", "current_weather.temperature_celsius",
        "current_weather.humidity_percent", F.col("unparsed")["humidity_percent"].alias("humidity_text"),
    )


def _fresh(spark, name):
    import uuid

    from quaylight.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "SELECT d AS delimiter, event_type AS city, count(*) AS n, CAST(sum(user_id) AS DOUBLE) AS latitudes FROM events, (VALUES ('comma', 0), ('semicolon', 1), ('tab', 2), ('bar', 3)) AS t(d, k) "
    "WHERE events.user_id % 4 = k GROUP BY ALL"
)
def csv_delimiter(spark, folder):
    """Weather files written with four delimiters; each is found from its header line."""
    rows = table(spark, folder, "events").selectExpr("user_id", "date_format(ts, 'yyyy-MM-dd') AS time", "user_id AS lat", "event_type AS city", "value AS temp")
    root, out = _fresh(spark, "csv"), []
    for k, (name, mark) in enumerate({"comma": ",", "semicolon": ";", "tab": "\t", "bar": "|"}.items()):
        rows.where(F.col("user_id") % 4 == k).drop("user_id").write.option("header", True).option("sep", mark).csv(f"{root}/{name}")
        events = imports.weather_events(imports.read_weather_csv(spark, f"{root}/{name}"), sh.as_of())
        out.append(events.groupBy(F.lit(name).alias("delimiter"), F.col("location.city").alias("city")).agg(F.count(F.lit(1)).alias("n"), F.sum("location.latitude").alias("latitudes")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT least(250, count(*)) AS events, least(250, count(*)) AS hosts FROM events")
def import_row_limit(spark, folder):
    """At most so many lines of a file are imported."""
    path = _fresh(spark, "lines")
    table(spark, folder, "events").selectExpr("concat('h', event_id) AS host", "event_type AS message").write.json(path)
    read = imports.read_jsonl(spark, path, "host STRING, message STRING", max_lines=250)
    return read.agg(F.count("message").alias("events"), F.countDistinct("host").alias("hosts"))


@query(
    with_parts(DELIVERIES_SQL) + "SELECT count(*) FILTER (WHERE json_valid(message_data)) AS imported, "
    "count(*) FILTER (WHERE NOT json_valid(message_data)) AS errors FROM dl"
)
def import_summary(spark, folder):
    """Bad JSON lines are counted, the rest is imported."""
    lines = sh.deliveries(spark, folder).select(
        F.from_json("message_data", "p STRING, c BIGINT, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    )
    return imports.import_summary(lines.select("r.*"))


# ---- devices ---------------------------------------------------------------------------------

_WMO = "CASE user_id % 120 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.WMO_CODES.items()) + (
    " ELSE concat('Unknown weather code: ', user_id % 120) END"
)


@query(
    "SELECT event_id, value AS temperature_celsius, user_id % 2 = 1 AS is_day, 'UTC' AS timezone, "
    f"{_WMO} AS weather_description FROM events"
)
def weather_reply_flatten(spark, folder):
    """Landed reply documents, read under their declared schema."""
    docs = table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('{\"latitude\":', user_id, ',\"longitude\":1.5,\"current\":{\"temperature_2m\":', value, ',\"is_day\":', user_id % 2, "
        "',\"weather_code\":', user_id % 120, '}}') AS doc",
    )
    rows = docs.select("event_id", F.from_json("doc", devices.WEATHER_REPLY).alias("d")).select("event_id", "d.*")
    keep = rows.withColumn("current_units", F.create_map(F.lit("id"), F.col("event_id").cast("string")))
    w = devices.weather_replies(keep, sh.as_of())
    return w.select(
        F.col("units")["id"].cast("bigint").alias("event_id"), "current_weather.temperature_celsius",
        "current_weather.is_day", "location.timezone", "weather_description",
    )


@query(f"SELECT {_WMO} AS weather_description, count(*) AS n FROM events GROUP BY 1")
def weather_codes(spark, folder):
    e = table(spark, folder, "events").select((F.col("user_id") % 120).alias("code"))
    return e.groupBy(devices.weather_description(F.col("code")).alias("weather_description")).agg(F.count("*").alias("n"))


@query(
    "SELECT event_id, 'sysUpTime' AS name0, concat('unknown_1.3.6.1.4.', user_id) AS name1, CAST(user_id AS DOUBLE) AS value0, "
    "CAST(NULL AS DOUBLE) AS value1, 2 AS oids_count FROM events"
)
def snmp_results(spark, folder):
    polls = table(spark, folder, "events").select(
        "event_id",
        F.array(
            F.struct(F.lit("1.3.6.1.2.1.1.3.0").alias("oid"), F.col("user_id").cast("string").alias("value")),
            F.struct(F.concat(F.lit("1.3.6.1.4."), "user_id").alias("oid"), F.col("event_type").alias("value")),
        ).alias("results"),
    )
    p = devices.poll_results(polls)
    r = F.col("results")
    return p.select(
        "event_id", r[0]["oid_name"].alias("name0"), r[1]["oid_name"].alias("name1"),
        r[0]["numeric_value"].alias("value0"), r[1]["numeric_value"].alias("value1"), "oids_count",
    )


@query(
    "WITH p AS (SELECT event_id, unhex(concat(CASE user_id % 4 WHEN 0 THEN '0005' WHEN 1 THEN '000A' WHEN 2 THEN '00000005' ELSE '0007' END, printf('%08X', event_id))) AS content FROM events) "
    "SELECT p.event_id, CASE user_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 5 END AS version, octet_length(content) AS size_bytes, base64(content) AS payload_b64 FROM p JOIN events e ON p.event_id = e.event_id"
)
def flow_packets(spark, folder):
    packets = table(spark, folder, "events").selectExpr(
        "event_id",
        "unhex(concat(CASE user_id % 4 WHEN 0 THEN '0005' WHEN 1 THEN '000A' WHEN 2 THEN '00000005' ELSE '0007' END, lpad(hex(event_id), 8, '0'))) AS content",
    )
    f = devices.flow_packets(packets)
    return f.select("event_id", "version", F.col("size_bytes").cast("bigint").alias("size_bytes"), "payload_b64")


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GPRMC' WHEN 1 THEN 'GPVTG' ELSE 'GPHDT' END AS sentence, "
    "CASE WHEN event_id % 4 = 0 THEN user_id % 2 = 0 END AS valid, "
    "CASE WHEN event_id % 4 = 0 THEN round((CASE WHEN user_id % 3 = 0 THEN -1 ELSE 1 END) * (48 + (7 + (user_id % 50) / 100.0) / 60.0), 6) END AS lat, "
    "CASE WHEN event_id % 4 = 0 THEN round(11 + 31.0 / 60.0, 6) END AS lon, "
    "CASE WHEN event_id % 4 < 2 THEN value END AS sog_kn, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN CAST(user_id AS DOUBLE) END AS cog_deg, "
    "CASE WHEN event_id % 4 = 2 THEN value END AS heading_true_deg FROM events WHERE event_id % 4 < 3"
)
def nmea_sentences(spark, folder):
    lines = table(spark, folder, "events").selectExpr(
        "event_id",
        "CASE event_id % 4 WHEN 0 THEN concat('$GPRMC,123519,', CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'V' END, ',4807.', lpad(CAST(user_id % 50 AS STRING), 2, '0'), ',', "
        "CASE WHEN user_id % 3 = 0 THEN 'S' ELSE 'N' END, ',01131.000,E,', value, ',,230394,003.1,W*6A') "
        "WHEN 1 THEN concat('$GPVTG,', user_id, ',T,077.3,M,', value, ',N,041.5,K*48') "
        "WHEN 2 THEN concat('$GPHDT,', value, ',T*23') ELSE 'noise' END AS value",
    )
    n = devices.nmea_events(lines)
    return n.select(
        "event_id", "sentence", "valid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        "sog_kn", "cog_deg", "heading_true_deg",
    )


# ---- inventories and exposition text ---------------------------------------------------------


def _listings(spark, folder):
    return table(spark, folder, "supplier").selectExpr(
        "concat('host', s_suppkey % 40) AS host",
        "concat('Netid State Recv-Q Send-Q Local Peer Process\\nudp UNCONN 0 0 0.0.0.0:', s_suppkey, ' 0.0.0.0:* users:((\"py\",pid=', s_nationkey, '))\\n"
        "tcp LISTEN 0 128 [::]:', s_nationkey, '\\nshort line\\n') AS output",
    )


def _files(spark, folder):
    paths = "CASE c_custkey % 5 WHEN 0 THEN '/var/log/nginx/access.log' WHEN 1 THEN '/var/log/dnsmasq.log' WHEN 2 THEN '/var/log/extra.log' ELSE '/etc/passwd' END"
    return table(spark, folder, "customer").selectExpr("concat('host', c_custkey % 37) AS host", f"{paths} AS path")


@query(
    "SELECT s_suppkey AS k, 'udp' AS proto, concat('0.0.0.0:', s_suppkey) AS local, concat('users:((\"py\",pid=', s_nationkey, '))') AS proc FROM supplier "
    "UNION ALL SELECT s_suppkey, 'tcp', concat('[::]:', s_nationkey), NULL FROM supplier"
)
def listener_inventory(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS k",
        "concat('Netid State Recv-Q Send-Q Local Peer Process\\nudp UNCONN 0 0 0.0.0.0:', s_suppkey, ' 0.0.0.0:* users:((\"py\",pid=', s_nationkey, '))\\n"
        "tcp LISTEN 0 128 [::]:', s_nationkey, '\\nshort line\\n') AS output",
    )
    return rows.select("k", F.explode(inventory.listeners(F.col("output"))).alias("l")).select("k", "l.*")


@query(
    "WITH l AS (SELECT concat('host', s_suppkey % 40) AS host, count(DISTINCT s_suppkey) + count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1), "
    "f AS (SELECT concat('host', c_custkey % 37) AS host, max(CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE 0 END) AS d, max(CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 0 END) AS x, max(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) AS a FROM customer GROUP BY 1) "
    "SELECT coalesce(l.host, f.host) AS host, coalesce(l.n, 0) AS listeners, concat_ws(',', CASE WHEN d = 1 THEN '/var/log/dnsmasq.log' END, CASE WHEN a = 1 THEN '/var/log/nginx/access.log' END) AS logs "
    "FROM l FULL JOIN (SELECT * FROM f WHERE d = 1 OR a = 1) f ON l.host = f.host"
)
def host_inventory(spark, folder):
    i = inventory.inventory(_listings(spark, folder), _files(spark, folder))
    return i.select("host", F.size("listeners").cast("bigint").alias("listeners"), F.concat_ws(",", "log_candidates").alias("logs"))


@query(
    "SELECT event_id, 'requests_total' AS name, event_type AS endpoint, concat('q\"', user_id) AS detail, value FROM events WHERE event_id % 3 > 0 "
    "UNION ALL SELECT event_id, 'active_connections', NULL, NULL, value FROM events WHERE event_id % 3 = 0"
)
def exposition_samples(spark, folder):
    """Exposition lines back to samples; comment lines are dropped."""
    lines = table(spark, folder, "events").selectExpr(
        "ts", "event_id",
        "explode(array('# HELP x y', CASE WHEN event_id % 3 = 0 THEN concat('active_connections ', value) "
        "ELSE concat('requests_total{endpoint=\"', event_type, '\",detail=\"q\\\\\"', user_id, '\"} ', value) END)) AS value",
    )
    s = exposition.samples(lines, F.struct("ts", "event_id"))
    return s.select(
        "ts.event_id", "name", F.col("labels")["endpoint"].alias("endpoint"), F.col("labels")["detail"].alias("detail"), "value"
    )


@query(
    "SELECT concat('edge_', event_type, '_', m) AS name, count(*) AS n, round(sum(v), 4) AS total FROM "
    "(SELECT event_type, 'messages_total' AS m, CAST(user_id AS DOUBLE) AS v FROM events UNION ALL SELECT event_type, 'buffer_size', value FROM events "
    "UNION ALL SELECT event_type, 'running', CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END FROM events) GROUP BY ALL"
)
def stats_samples(spark, folder):
    """Nested service statistics flattened to named samples."""
    e = table(spark, folder, "events").select(
        "ts", "event_type",
        F.struct(
            F.col("user_id").alias("messages-total"),
            F.struct(F.col("value").alias("size"), F.lit("ring").alias("kind")).alias("buffer"),
            (F.col("user_id") % 2 == 0).alias("running"),
        ).alias("stats"),
    )
    s = exposition.stats_samples(e, F.col("ts"), F.col("event_type"), "stats")
    return s.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    with_parts(DELIVERIES_SQL) + "SELECT id, CASE WHEN status = 'pending' AND NOT json_valid(message_data) THEN 'failed' ELSE status END AS status FROM dl"
)
def spool_source(spark, folder):
    return delivery.decoded(sh.deliveries(spark, folder)).select("id", "status")


@query(with_parts(DELIVERIES_SQL) + "SELECT id, json_extract_string(message_data, '$.p') AS priority FROM dl WHERE json_valid(message_data)")
def queue_payload(spark, folder):
    d = sh.deliveries(spark, folder).withColumn("doc", as_variant(F.col("message_data"))).where(F.col("doc").isNotNull())
    return d.select("id", F.try_variant_get("doc", "$.p", "string").alias("priority"))
