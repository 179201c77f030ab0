"""Queries over events: redaction, enrichment, annotations, the event store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions.network import in_subnet, ip_number
from quaylight.operators import annotate, enrich, flow, project, redact, store
from quaylight.plans import shapes as sh
from quaylight.plans.registry import query
from quaylight.plans.shapes import AS_OF, EVENTS_SQL, stamp, table, with_parts

EV = with_parts(EVENTS_SQL)
SALT = "pepper"
SITE_CASES = "CASE WHEN regexp_matches(hostname, '\\.prod\\.') THEN 'production' WHEN regexp_matches(hostname, '\\.dev\\.') THEN 'development' WHEN regexp_matches(hostname, '\\.testing\\.') THEN 'test' WHEN regexp_matches(hostname, '\\.stage\\.') THEN 'staging' END"
SEVERITY_SQL = "CASE lower(trim(severity)) WHEN 'error' THEN 3 WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN '7' THEN 7 END"
SERVICE_SQL = (
    "CASE WHEN path LIKE '/var/log/nginx/%' THEN 'nginx' WHEN path LIKE '/var/log/mysql/%' THEN 'mysql' "
    "WHEN path LIKE '/var/log/redis/%' THEN 'redis' WHEN path LIKE '/opt/%' THEN regexp_extract(path, '/opt/([^/]+)/', 1) "
    "ELSE split_part(hostname, '.', 1) END"
)


def _texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def flagship(spark, folder):
    """Drop, mask and hash events, map severities, tag them, count by type and hour."""
    steps = flow.build_steps(
        {
            "redaction": {
                "drop_fields": ["path"],
                "mask_patterns": [r"value=\d+"],
                "hash_fields": ["source"],
                "salt": SALT,
            },
            "enrichment": {"add_tags": {"deployment": "production"}},
        },
        AS_OF,
    )
    done = flow.run_steps(sh.events(spark, folder), steps)
    return (
        done.groupBy("type", F.date_trunc("hour", "ts").alias("hour"))
        .agg(
            F.count("*").alias("count"),
            F.min("severity_num").alias("severity_num"),
            F.max("message").alias("last_message"),
            F.min("source").alias("first_source"),
        )
        .select("type", stamp("hour").alias("hour"), "count", "severity_num", "last_message", "first_source")
    )


@query(
    EV + "SELECT type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour, count(*) AS count, "
    f"CAST(min({SEVERITY_SQL}) AS BIGINT) AS severity_num, "
    "max(regexp_replace(message, 'value=\\d+', repeat('*', least(8, length(regexp_extract(message, 'value=\\d+')))))) AS last_message, "
    f"min(sha256(concat('{SALT}', source))) AS first_source "
    "FROM ev GROUP BY ALL"
)
def redact_enrich_count(spark, folder):
    return flagship(spark, folder)


# ---- projections -----------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events")
def drop_fields(spark, folder):
    return redact.drop_fields(table(spark, folder, "events"), ["ts", "props", "password"])


@query(
    "SELECT o_orderkey AS id, o_orderpriority AS priority, to_json({'c': CAST(o_custkey AS VARCHAR)}) AS payload FROM orders"
)
def envelope_sanitise(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("__spool_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("attempts"),
        F.create_map(
            F.lit("c"), F.col("o_custkey").cast("string"),
            F.lit("__spool_id"), F.col("o_orderkey").cast("string"),
            F.lit("last_error"), F.col("o_orderstatus"),
        ).alias("payload"),
    )
    return project.sanitise(rows, "payload").withColumn("payload", F.to_json("payload"))


# ---- redaction -------------------------------------------------------------------------------


def _mask_sql(patterns, source, key, text):
    parts, last = [], source
    for i, p in enumerate(patterns):
        p = p.replace("'", "''")
        t = text if i == 0 else "t"
        parts.append(
            f"m{i} AS (SELECT {key}, CASE WHEN regexp_matches({t}, '(?i){p}') THEN array_to_string(list_transform(list_zip("
            f"regexp_split_to_array({t}, '(?i){p}'), regexp_extract_all({t}, '(?i){p}')), "
            "lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE repeat('*', least(length(x[2]), 8)) END), '') "
            f"ELSE {t} END AS t FROM {last})"
        )
        last = f"m{i}"
    return parts, last


_parts, _last = _mask_sql(fixed.MASK_PATTERNS, "documents", "doc_id", "text")


@query(with_parts(*_parts) + f"SELECT doc_id, md5(t) AS masked, length(t) AS n FROM {_last}")
def mask_patterns(spark, folder):
    d = redact.mask_patterns(_texts(spark, folder))
    return d.select("doc_id", F.md5("text").alias("masked"), F.length("text").cast("bigint").alias("n"))


def _payloads(spark, folder):
    """Texts inside JSON payloads: a value under a key that itself looks like a secret."""
    doc = F.struct(F.lit("x").alias("token=k"), F.struct(F.array("text").alias("lines"), "doc_id").alias("body"))
    return table(spark, folder, "documents").select("doc_id", F.to_json(doc).alias("data"))


@query(
    with_parts(*_parts)
    + f"SELECT doc_id, md5(t) AS masked, true AS is_json, true AS key_kept, doc_id AS number FROM {_last}"
)
def mask_payload(spark, folder):
    """Values inside JSON are masked; it stays JSON, and keys and numbers stay as they are."""
    d = redact.mask_patterns(_payloads(spark, folder)).select("doc_id", F.try_parse_json("data").alias("v"))
    return d.select(
        "doc_id",
        F.md5(F.try_variant_get("v", "$.body.lines[0]", "string")).alias("masked"),
        F.col("v").isNotNull().alias("is_json"),
        (F.try_variant_get("v", "$['token=k']", "string") == "x").alias("key_kept"),
        F.try_variant_get("v", "$.body.doc_id", "bigint").alias("number"),
    )


_parts2, _last2 = _mask_sql([r"value=\d+", r"user-\d+"], "flat", "event_id", "t0")


@query(
    with_parts(
        EVENTS_SQL,
        "flat AS (SELECT event_id * 10 + k AS event_id, CASE k WHEN 0 THEN message WHEN 1 THEN source "
        "WHEN 2 THEN concat('seen ', source) ELSE concat('tag ', message) END AS t0 "
        "FROM ev, unnest([0, 1, 2, 3]) AS u(k))",
        *_parts2,
    )
    + f"SELECT event_id // 10 AS event_id, max(CASE WHEN event_id % 10 = 0 THEN t END) AS message, "
    "max(CASE WHEN event_id % 10 = 1 THEN t END) AS source, max(CASE WHEN event_id % 10 = 2 THEN t END) AS note, "
    f"max(CASE WHEN event_id % 10 = 3 THEN t END) AS tag FROM {_last2} GROUP BY 1"
)
def mask_nested(spark, folder):
    """Strings inside structs, arrays and maps are masked where they are."""
    e = sh.events(spark, folder).select(
        "event_id",
        "message",
        F.struct("source", F.array(F.concat(F.lit("seen "), "source")).alias("notes")).alias("config"),
        F.create_map(F.lit("k"), F.concat(F.lit("tag "), "message")).alias("tags"),
    )
    m = redact.mask_patterns(e, [r"value=\d+", r"user-\d+"])
    return m.select(
        "event_id", "message", F.col("config.source").alias("source"),
        F.element_at("config.notes", 1).alias("note"), F.col("tags")["k"].alias("tag"),
    )


@query(
    "SELECT event_id, sha256(concat('pepper', user_id)) AS user_id, md5(concat('pepper', event_type)) AS event_type, "
    "sha1(concat('pepper', props)) AS props FROM events"
)
def hash_fields(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "props")
    e = redact.hash_fields(e, ["user_id"], "pepper")
    e = redact.hash_fields(e, ["event_type"], "pepper", "md5")
    return redact.hash_fields(e, ["props", "missing"], "pepper", "sha1")


@query(
    EV + "SELECT event_id, type, regexp_replace(message, 'value=\\d+', repeat('*', least(8, length(regexp_extract(message, 'value=\\d+'))))) AS message, "
    "sha256(concat('pepper', source)) AS source, source AS source_original FROM ev"
)
def redaction_steps(spark, folder):
    e = sh.events(spark, folder).select("event_id", "type", "message", "source", F.col("data").alias("secret"))
    return redact.redact(
        e,
        {
            "drop_fields": fixed.DROP_FIELDS,
            "mask_patterns": [r"value=\d+"],
            "hash_fields": ["source"],
            "salt": SALT,
            "preserve_original": True,
        },
    )


_PII_SQL = " UNION ALL ".join(
    f"SELECT doc_id, 'text' AS path, '{kind}' AS type FROM documents WHERE regexp_matches(text, '(?i){p}')"
    for kind, p in fixed.PII_PATTERNS
)


@query(_PII_SQL)
def pii_detect(spark, folder):
    d = redact.detect_pii(_texts(spark, folder), ["text"])
    return redact.explode_pii(d).select("doc_id", "path", "type")


@query(
    f"WITH p AS ({_PII_SQL}) SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM p) AS quarantined FROM documents d"
)
def pii_gate(spark, folder):
    """One pass: every row with its verdict; writers split on the flag."""
    return redact.pii_flag(redact.detect_pii(_texts(spark, folder), ["text"])).select("doc_id", "quarantined")


@query(_PII_SQL.replace("'text' AS path", "'data.body.lines[0]' AS path"))
def pii_payload(spark, folder):
    """Findings inside JSON carry the path of the value."""
    return redact.explode_pii(redact.detect_pii(_payloads(spark, folder), ["data"])).select("doc_id", "path", "type")


@query(f"WITH p AS ({_PII_SQL}) SELECT type, count(*) AS findings, count(DISTINCT doc_id) AS events FROM p GROUP BY 1")
def pii_summary(spark, folder):
    return redact.pii_summary(
        redact.detect_pii(_texts(spark, folder), ["text"])
    )


# ---- enrichment ------------------------------------------------------------------------------


@query(EV + "SELECT event_id, 'production' AS deployment, '1.5' AS version, source AS origin FROM ev")
def add_tags(spark, folder):
    e = sh.events(spark, folder).withColumn(
        "tags", F.create_map(F.lit("version"), F.lit("0"), F.lit("origin"), F.col("source"))
    )
    t = enrich.add_tags(e, {"deployment": "production", "version": "1.5"})
    return t.select("event_id", *[F.col("tags")[k].alias(k) for k in ("deployment", "version", "origin")])


@query(EV + f"SELECT event_id, CAST({SEVERITY_SQL} AS BIGINT) AS severity_num FROM ev")
def severity_map(spark, folder):
    return enrich.map_severity(sh.events(spark, folder)).select("event_id", "severity_num")


@query(
    "SELECT o_orderkey, CAST(CASE split_part(o_orderpriority, '-', 2) WHEN 'URGENT' THEN NULL ELSE CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) END AS BIGINT) AS severity_num FROM orders"
)
def import_severity_map(spark, folder):
    level = F.when(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)) == "URGENT", "fatal").otherwise(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", enrich.import_severity(level).alias("severity_num")
    )


@query(EV + f"SELECT event_id, {SERVICE_SQL} AS service FROM ev")
def service_from_path(spark, folder):
    return enrich.service_from_path(sh.events(spark, folder)).select("event_id", "service")


@query(
    "SELECT page_id, split_part(regexp_extract(url, 'https?://([^/]+)', 1), '.', 1) AS service FROM pages"
)
def service_from_host(spark, folder):
    p = table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("url", "https?://([^/]+)", 1).alias("host")
    )
    return enrich.service_from_path(p).select("page_id", "service")


_SUBNETS = {
    "10.0.1.0/24": {"datacenter": "east", "region": "production"},
    "10.0.1.128/25": {"datacenter": "never", "region": "later entries lose"},
    "10.0.0.0/30": {"datacenter": "tiny", "region": "lab"},
    "10.0.2.0/23": {"datacenter": "west", "region": "staging"},
}
_IPS = {"10.0.1.5": {"datacenter": "exact", "region": "core"}}


@query(
    EV + "SELECT event_id, CASE WHEN source_ip = '10.0.1.5' THEN 'exact' WHEN user_id % 4 = 1 THEN 'east' "
    "WHEN user_id % 4 = 0 AND user_id % 250 < 4 THEN 'tiny' WHEN user_id % 4 IN (2, 3) THEN 'west' END AS datacenter FROM ev"
)
def geo_hint(spark, folder):
    g = enrich.geo_hint(sh.events(spark, folder), _IPS, _SUBNETS)
    return g.select("event_id", F.col("geo_hint")["datacenter"].alias("datacenter"))


@query(
    EV + "SELECT event_id, 10 * 16777216 + (user_id % 4) * 256 + user_id % 250 AS ip, "
    "user_id % 4 = 1 AND user_id % 250 >= 128 AS inside FROM ev"
)
def subnet_membership(spark, folder):
    return sh.events(spark, folder).select(
        "event_id",
        ip_number(F.col("source_ip")).alias("ip"),
        in_subnet(F.col("source_ip"), "10.0.1.128/25").alias("inside"),
    )


@query(
    EV + "SELECT event_id, CASE WHEN user_id % 5 = 4 THEN 'default' ELSE split_part(hostname, '.', 2) END AS site, "
    f"coalesce({SITE_CASES}, 'unknown') AS environment FROM ev"
)
def site_env_tags(spark, folder):
    e = enrich.add_tags(sh.events(spark, folder), {})
    s = enrich.site_env_tags(e, default_site="default", default_env="unknown")
    return s.select(
        "event_id", F.col("tags")["site"].alias("site"), F.col("tags")["environment"].alias("environment")
    )


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 5 THEN '2024-01-30T12:00:00Z' WHEN 4 THEN 'Tuesday' "
    "ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS timestamp FROM events"
)
def time_normalise(spark, folder):
    e = table(spark, folder, "events")
    form = {
        0: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        1: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        2: F.date_format("ts", "yyyy/MM/dd HH:mm:ss"),
        3: F.unix_seconds("ts").cast("string"),
        4: F.lit("Tuesday"),
    }
    text = F.coalesce(*[F.when(F.col("event_id") % 6 == k, v) for k, v in form.items()])
    return enrich.normalise_time(
        e.select("event_id", text.alias("timestamp")), "2024-01-30T12:00:00Z"
    ).select("event_id", "timestamp")


@query(
    "SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts "
    "WHEN 2 THEN date_trunc('second', ts) - INTERVAL 1 HOUR WHEN 3 THEN CAST(concat('1900', substr(CAST(date_trunc('second', ts) AS VARCHAR), 5)) AS TIMESTAMP) - INTERVAL 1 HOUR "
    "ELSE TIMESTAMP '2024-01-30 12:00:00' END, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM events"
)
def import_time_zone(spark, folder):
    """Epoch digits, ISO, zoneless local text, year-less local text, unreadable text."""
    from quaylight.functions.times import import_time

    e = table(spark, folder, "events")
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.unix_seconds("ts").cast("string"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 3, F.date_format("ts", "MMM d HH:mm:ss"))
        .otherwise("not a time")
    )
    return e.select(
        "event_id",
        stamp(F.coalesce(import_time(text, tz="+01:00"), sh.as_of())).alias("timestamp"),
    )


# ---- annotations -----------------------------------------------------------------------------


@query(
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN md5(concat(substr(text, 1, 500), '...')) ELSE md5(text) END AS message "
    "FROM documents WHERE length(CAST(to_json({'doc_id': doc_id, 'message': text}) AS VARCHAR)) <= 10000"
)
def prompt_projection(spark, folder):
    """Message part of the safe prompt, for events below the size limit."""
    d = table(spark, folder, "documents").select("doc_id", F.col("text").alias("message"))
    p = annotate.prompt_text(annotate.annotatable(d))
    return p.select("doc_id", F.md5(F.get_json_object("prompt_event", "$.message")).alias("message"))


_REPLY = (
    "CASE doc_id % 5 WHEN 0 THEN concat('{\"confidence\":0.9', quality, ',\"tags\":{\"q\":\"', quality, '\"},\"category\":\"c', toxic, '\",\"priority\":\"high\"}') "
    "WHEN 1 THEN concat('Sure: {\"confidence\":0.8,\"summary\":\"s', doc_id, '\"} done') "
    "WHEN 2 THEN '{\"confidence\":0.5,\"priority\":\"low\"}' WHEN 3 THEN '{\"tags\":{}}' "
    "ELSE '{\"confidence\":1.5}' END"
)


def _replies(spark, folder):
    return table(spark, folder, "labels").selectExpr("doc_id", f"{_REPLY} AS reply").select(
        "doc_id", annotate.parse_annotation(F.col("reply")).alias("reply")
    )


@query("SELECT doc_id, doc_id % 5 < 3 AS valid FROM labels")
def annotation_validate(spark, folder):
    return _replies(spark, folder).select("doc_id", annotate.valid_annotation(F.col("reply")).alias("valid"))


@query(
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(concat('0.9', quality) AS DOUBLE) WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 WHEN 4 THEN 1.5 END AS confidence FROM labels"
)
def annotation_salvage(spark, folder):
    return _replies(spark, folder).select(
        "doc_id", annotate.annotation_fields(F.col("reply"))["confidence"].alias("confidence")
    )


@query(
    "SELECT d.doc_id, CASE WHEN l.doc_id % 5 = 0 THEN CAST(concat('0.9', quality) AS DOUBLE) WHEN l.doc_id % 5 = 1 THEN 0.8 END AS confidence, "
    "CASE WHEN l.doc_id % 5 = 0 THEN CAST(quality AS VARCHAR) END AS llm_q, d.lang AS lang, "
    "CASE WHEN l.doc_id % 5 = 0 THEN concat('c', toxic) END AS llm_category, CASE WHEN l.doc_id % 5 = 0 THEN 'high' END AS llm_priority, "
    "CASE WHEN l.doc_id % 5 = 1 THEN concat('s', l.doc_id) END AS llm_summary "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.doc_id % 5 < 2"
)
def annotation_merge(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.create_map(F.lit("lang"), F.col("lang")).alias("tags")
    )
    reply = F.col("reply")
    notes = _replies(spark, folder).where(annotate.valid_annotation(reply)).select(
        "doc_id", annotate.annotation_fields(reply).alias("annotation")
    )
    m = annotate.merge_annotations(docs, notes, "doc_id", model="external")
    return m.select(
        "doc_id", F.col("llm_enrichment.confidence").alias("confidence"), F.col("tags")["llm_q"].alias("llm_q"),
        F.col("tags")["lang"].alias("lang"), "llm_category", "llm_priority", "llm_summary",
    )


@query(
    EV + f"SELECT event_id, CAST({SEVERITY_SQL} AS BIGINT) AS severity_num, {SERVICE_SQL} AS service, "
    f"CASE WHEN user_id % 5 = 4 THEN 'default' ELSE split_part(hostname, '.', 2) END AS site, "
    "sha256(concat('pepper', source)) AS source, '1.5' AS version, "
    "regexp_replace(message, 'value=\\d+', repeat('*', least(8, length(regexp_extract(message, 'value=\\d+'))))) AS message, "
    "CASE WHEN source_ip = '10.0.1.5' THEN 'exact' WHEN user_id % 4 = 1 THEN 'east' WHEN user_id % 4 = 0 AND user_id % 250 < 4 THEN 'tiny' "
    "WHEN user_id % 4 IN (2, 3) THEN 'west' END AS datacenter, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM ev"
)
def full_event_flow(spark, folder):
    """All configured steps as one plan."""
    e = sh.events(spark, folder).withColumn(
        "timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    steps = flow.build_steps(
        {
            "redaction": {"drop_fields": ["data"], "mask_patterns": [r"value=\d+"], "hash_fields": ["source"], "salt": SALT},
            "pii_check": {"strict_mode": True},
            "enrichment": {
                "add_tags": {"version": "1.5"},
                "geo_hints": {"ip_location_map": _IPS, "subnet_location_map": _SUBNETS},
                "site_env_tags": {"default_site": "default", "default_env": "unknown"},
            },
        },
        "2024-01-30T12:00:00Z",
    )
    done = flow.run_steps(e, steps)
    return done.select(
        "event_id", "severity_num", "service", F.col("tags")["site"].alias("site"), "source",
        F.col("tags")["version"].alias("version"), "message",
        F.col("geo_hint")["datacenter"].alias("datacenter"), "timestamp",
    )


@query(
    EV + "SELECT event_id, coalesce(CASE WHEN type <> 'view' THEN upper(message) END, message) AS message, coalesce(TRY_CAST(severity AS BIGINT), user_id) AS level FROM ev"
)
def fail_safe_steps(spark, folder):
    """Steps that give nothing for some events leave those as they were."""
    e = sh.events(spark, folder).withColumn("level", F.col("user_id"))
    steps = [
        lambda df: flow.fail_safe(df, "message", F.when(F.col("type") != "view", F.upper("message"))),
        lambda df: flow.fail_safe(df, "level", F.col("severity").try_cast("bigint")),
    ]
    return flow.run_steps(e, steps).select("event_id", "message", "level")


@query(
    EV + "SELECT 'passed' AS output, count(*) AS n, count(DISTINCT event_id) AS events, "
    "'redaction:redacted pii_check:passed add_tags:enriched severity_map:mapped service_from_path:enriched geo_hint:enriched site_env_tags:enriched timestamp_normalizer:normalized' AS audit FROM ev WHERE user_id % 3 > 0 "
    "UNION ALL SELECT 'quarantine', count(*), count(DISTINCT event_id), 'redaction:redacted' FROM ev WHERE user_id % 3 = 0"
)
def audited_flow(spark, folder):
    """The configured flow with audit entries; events with personal data go to quarantine from the same detection."""
    e = sh.events(spark, folder).select("event_id", "type", "message", "hostname", "source_ip", "path", F.when(F.col("user_id") % 3 == 0, F.lit("mail a.b@example.com")).alias("note"))
    root = _fresh(spark, "held")
    config = {"redaction": {"drop_fields": ["path"]}, "pii_check": {"strict_mode": True}, "enrichment": {"add_tags": {"v": "1"}}}
    steps = flow.build_steps(config, "2024-01-30T12:00:00Z", quarantine=lambda bad: bad.select("event_id", "audit").write.parquet(root), audit=True)
    done = flow.run_steps(e.drop("source_ip"), steps)
    held = spark.read.schema("event_id BIGINT, audit ARRAY<STRUCT<step: STRING, action: STRING>>").parquet(root)

    def summary(df, name):
        entries = F.array_join(F.transform("audit", lambda a: F.concat_ws(":", a["step"], a["action"])), " ")
        return df.groupBy(entries.alias("audit")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events")).select(F.lit(name).alias("output"), "n", "events", "audit")

    return summary(done, "passed").unionByName(summary(held, "quarantine"))


@query(
    "SELECT count(*) FILTER (WHERE json_valid(m)) AS processed, count(*) FILTER (WHERE NOT json_valid(m)) AS errors, "
    "count(*) AS total, round(count(*) FILTER (WHERE json_valid(m)) / count(*), 9) AS success_rate "
    f"FROM ({with_parts(sh.DELIVERIES_SQL)} SELECT message_data AS m FROM dl)"
)
def step_stats(spark, folder):
    d = sh.deliveries(spark, folder)
    s = flow.step_stats(d, F.try_parse_json("message_data").isNotNull())
    return s.withColumn("success_rate", F.round("success_rate", 9))


# ---- event store -----------------------------------------------------------------------------


@query(
    EV + "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, "
    "CASE WHEN type = 'view' THEN 'unknown' ELSE type END AS type, "
    "CASE WHEN user_id % 4 = 0 THEN hostname WHEN user_id % 4 = 1 THEN 'unknown' ELSE source END AS source, "
    "message FROM ev"
)
def store_rows(spark, folder):
    """Store rows of events with blank types and blank sources."""
    e = sh.events(spark, folder)
    e = e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("type") == "view", "  ").otherwise(F.col("type")).alias("type"),
        F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, " ").otherwise(F.col("source")).alias("source"),
        "hostname",
        "message",
    )
    rows = store.store_rows(e, sh.as_of(), "b1")
    return rows.select(
        F.get_json_object("data", "$.event_id").cast("bigint").alias("event_id"),
        stamp("ts").alias("ts"), "type", "source", F.get_json_object("data", "$.message").alias("message"),
    )


@query(
    "SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) "
    "ELSE TIMESTAMP '2024-01-30 12:00:00' END, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events"
)
def store_event_time(spark, folder):
    e = table(spark, folder, "events")
    k = F.col("event_id") % 4
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = e.select(
        "event_id",
        F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).otherwise("soon").alias("timestamp"),
        F.when(k == 2, F.unix_seconds("ts").cast("string")).alias("time"),
    )
    return e.select("event_id", stamp(store.event_time(e, sh.as_of())).alias("ts"))


def _stored(spark, folder):
    return sh.events(spark, folder).select(F.col("event_id").alias("id"), "ts", "type", "source", "data")


@query(
    EV + "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, type, source FROM ev "
    "WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND type = 'error' ORDER BY ev.ts DESC LIMIT 100 OFFSET 50"
)
def event_query(spark, folder):
    q = store.query_events(_stored(spark, folder), "2024-01-05", "2024-01-25", "error", limit=100, offset=50)
    return q.select("id", stamp("ts").alias("ts"), "type", "source")


@query(
    EV + "SELECT event_id AS id, source, CAST(json_extract_string(data, '$.k') AS BIGINT) AS k, "
    "coalesce(CAST(json_extract_string(data, '$.k') AS VARCHAR), type) AS type FROM ev"
)
def payload_merge(spark, folder):
    """Payload keys override columns of the same name."""
    e = _stored(spark, folder).withColumn("data", F.regexp_replace("data", r"\}$", ""))
    e = e.withColumn(
        "data", F.concat("data", F.lit(', "type": "'), F.regexp_extract("data", r"(\d+)", 1), F.lit('"}'))
    )
    return store.merge_payload(e, {"k": "bigint", "type": "string"}).select("id", "source", "k", "type")


@query(
    EV + f"SELECT event_id AS id FROM ev WHERE {SERVICE_SQL} = 'nginx' AND CAST(json_extract_string(data, '$.k') AS BIGINT) = 42"
)
def payload_containment(spark, folder):
    """Sub-documents of payloads that are VARIANT from the start: nothing is written as text and parsed."""
    e = enrich.service_from_path(sh.events(spark, folder))
    doc = F.to_variant_object(
        F.struct(
            F.struct("service").alias("tags"),
            F.get_json_object("data", "$.k").cast("bigint").alias("k"),
            F.array("type", "severity").alias("words"),
        )
    )
    e = e.select(F.col("event_id").alias("id"), doc.alias("data"))
    return store.containing(e, {"tags": {"service": "nginx"}, "k": 42}).select("id")


@query(
    EV + "SELECT event_id AS id, source FROM ev WHERE type = 'error' AND ts > TIMESTAMP '2024-01-30 11:00:00'"
)
def recent_by_type(spark, folder):
    return store.recent(_stored(spark, folder), "error", AS_OF).select("id", "source")


@query(
    EV + "SELECT type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour, count(*) AS count FROM ev "
    "WHERE ts > TIMESTAMP '2024-01-29 12:00:00' GROUP BY ALL"
)
def counts_by_type_hour(spark, folder):
    return store.counts_by_hour(_stored(spark, folder), AS_OF).select("type", stamp("hour").alias("hour"), "count")


@query(
    "SELECT count(*) AS total_events_in_db, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 11:00:00') AS events_last_hour FROM events"
)
def store_totals(spark, folder):
    return store.totals(_stored(spark, folder).withColumn("created_at", F.col("ts")), AS_OF)


def _fresh(spark, name):
    import uuid

    from quaylight.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    EV + "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, strftime(date_trunc('day', ts), '%Y-%m-%d') AS event_date, type, source, message, "
    "TRUE AS own_id, unnest([1, 2]) AS copy FROM ev"
)
def store_append_read(spark, folder):
    """Every event twice, written to the day-partitioned store and read back row by row; each has an id of its own."""
    path = _fresh(spark, "store")
    e = sh.events(spark, folder).select(F.col("ts").alias("timestamp"), "type", "source", "message")
    store.append(store.store_rows(e.unionByName(e), sh.as_of(), "b1"), path)
    rows = store.read(spark, path)
    same = Window.partitionBy("ts", "type", "source", "data").orderBy("id")
    return rows.select(
        stamp("ts").alias("ts"), F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "type", "source",
        F.get_json_object("data", "$.message").alias("message"),
        (F.coalesce(F.lag("id").over(same), F.col("id") - 1) != F.col("id")).alias("own_id"),
        F.row_number().over(same).alias("copy"),
    )


@query(
    EV + "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, type, source, CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM ev WHERE type = 'purchase'"
)
def store_variant_commit(spark, folder):
    """Events as VARIANT rows with ids by file and row, committed in two batches of which one is replayed."""
    path = _fresh(spark, "commits")
    e = table(spark, folder, "events").select(
        "event_id", "user_id", F.col("event_type").alias("type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.col("ts").alias("timestamp"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), store.row_position().alias("at"),
    )
    for batch, part in ((0, e.where("event_id % 2 = 0")), (1, e.where("event_id % 4 = 1")), (1, e.where("event_id % 2 = 1"))):
        store.commit(store.store_rows(part, sh.as_of(), str(batch), "at", "variant"), path, batch, unique=True)
    rows = store.containing(store.read(spark, path, "variant"), {"type": "purchase"})
    lifted = store.merge_payload(rows, {"event_id": "bigint", "k": "bigint"})
    return lifted.dropDuplicates(["id"]).select("event_id", stamp("ts").alias("ts"), "type", "source", "k")
