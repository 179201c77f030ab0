import json
import random
import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions.text import hash_text, mask_sql
from quaylight.operators import annotate, enrich, flow, redact


def python_mask(text, patterns, char="*", length=8):
    for p in patterns:
        text = re.sub(p, lambda m: char * min(len(m[0]), length), text, flags=re.IGNORECASE)
    return text


def test_mask_examples(spark):
    text = "User login with password=secret123 and SSN 123-45-6789"
    out = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(
        F.expr(mask_sql("t", fixed.MASK_PATTERNS)).alias("m")).collect()
    assert [r.m for r in out] == ["User login with ******** and SSN ********", None, ""]


def test_mask_equals_row_function(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [(-1, "Token: abc key=x a@b.co éa@b.co 1234 5678 9012 3456"), (-2, "PASSWORD = é x١٢٣-٤٥-٦٧٨٩")], "doc_id long, text string")
    both = docs.unionByName(extra)
    got = {r.doc_id: r.m for r in both.select("doc_id", F.expr(mask_sql("text", fixed.MASK_PATTERNS)).alias("m")).collect()}
    for r in both.collect():
        assert got[r.doc_id] == python_mask(r.text, fixed.MASK_PATTERNS)


def test_mask_nested_and_json(spark):
    df = spark.createDataFrame(
        [Row(a=Row(b=["token=abcd", "fine"], n=3), m={"k": "key: v"}, j='{"x":{"y":["password=1"]},"n":2}', none=None)],
        "a struct<b:array<string>,n:int>, m map<string,string>, j string, none string",
    )
    r = redact.mask_patterns(df, columns=["a", "m", "none"]).first()
    assert r.a.b == ["********", "fine"] and r.a.n == 3 and r.m == {"k": "******"} and r.none is None
    j = redact.mask_patterns(df, columns=["j"], json_columns=["j"]).first().j
    assert j == '{"x":{"y":["********"]},"n":2}'


def test_hash(spark):
    df = spark.createDataFrame([("bob", None, True)], "user string, email string, flag boolean")
    r = redact.hash_fields(df, ["user", "email", "flag", "absent"], "s", preserve_original=True).first()
    assert r.user == hashlib.sha256(b"sbob").hexdigest() and r.email is None and r.user_original == "bob"
    assert r.flag == hashlib.sha256(b"sTrue").hexdigest()
    h = df.select(hash_text(F.col("user"), "s", "md5").alias("a"), hash_text(F.col("user"), "s", "other").alias("b")).first()
    assert h.a == hashlib.md5(b"sbob").hexdigest() and h.b == hashlib.sha256(b"sbob").hexdigest()


def test_drop_and_redact(spark):
    df = spark.createDataFrame([("p", "m token=abc", "u")], "password string, message string, user string")
    out = redact.redact(df, {"drop_fields": ["password", "secret"], "mask_patterns": [r"token=\S+"], "hash_fields": ["user"], "salt": "x"})
    assert out.columns == ["message", "user"]
    assert out.first().message == "m ********"
    tags = df.select(F.create_map(F.lit("token"), F.lit("1"), F.lit("ok"), F.lit("2")).alias("tags"))
    assert redact.drop_fields(tags, ["token"], payload="tags").first().tags == {"ok": "2"}


def test_pii(spark):
    df = spark.createDataFrame(
        [Row(id=1, data=Row(mail="user@example.com", list=["123-456-7890", "x"]), tags={"t": "token: a"}), Row(id=2, data=None, tags=None)],
        "id int, data struct<mail:string,list:array<string>>, tags map<string,string>",
    )
    found = redact.detect_pii(df)
    r = found.where("id = 1").first()
    assert {(f.path, f.type) for f in r.pii_findings} == {("data.mail", "Email"), ("data.list[0]", "Phone"), ("tags.t", "Token")}
    good, bad = redact.pii_gate(found)
    assert [x.id for x in good.collect()] == [2] and [x.id for x in bad.collect()] == [1]
    lax, none = redact.pii_gate(found, strict=False)
    assert lax.count() == 2 and none.count() == 0
    assert {(x.type, x.findings, x.events) for x in redact.pii_summary(found).collect()} == {("Email", 1, 1), ("Phone", 1, 1), ("Token", 1, 1)}


def test_severity_service_time(spark):
    df = spark.createDataFrame([("CRITICAL",), (" 4 ",), ("Fatal",), ("odd",), (None,)], "severity string")
    assert [r.severity_num for r in enrich.map_severity(df).collect()] == [2, 4, 3, None, None]
    ev = spark.createDataFrame(
        [("/var/log/nginx/access.log", "h.x"), ("/opt/myapp/app.log", "h"), (None, "web-server-01"), ("/x", "db01.ams.prod.example.com"), (None, None)],
        "path string, hostname string")
    assert [r.service for r in enrich.service_from_path(ev).collect()] == ["nginx", "myapp", "web-server-01", "db01", None]
    kept = enrich.service_from_path(ev.withColumn("service", F.lit("old")))
    assert [r.service for r in kept.collect()] == ["nginx", "myapp", "web-server-01", "db01", "old"]
    t = spark.createDataFrame([(1640995200,)], "timestamp long")
    assert enrich.normalise_time(t, "now").first().timestamp == "2022-01-01T00:00:00Z"
    texts = spark.createDataFrame(
        [("2024-01-02T03:04:05.678Z", None), ("2024-01-02T03:04:05+02:00", None), ("nope", "2024/01/02 03:04:05"), (None, None)],
        "timestamp string, time string")
    out = [(r.timestamp, r.time) for r in enrich.normalise_time(texts, "now").collect()]
    assert out == [("2024-01-02T03:04:05Z", None), ("2024-01-02T03:04:05+02:00", None), ("nope", "2024-01-02T03:04:05Z"), ("now", None)]


def test_tags_and_site(spark):
    df = spark.createDataFrame([("a.ams.prod.x", {"k": "1", "v": "2"}), ("plain", None)], "hostname string, tags map<string,string>")
    out = enrich.add_tags(df, {"k": "new"}).collect()
    assert out[0].tags == {"k": "new", "v": "2"} and out[1].tags == {"k": "new"}
    s = enrich.site_env_tags(df, default_site="d", default_env="e").collect()
    assert s[0].tags == {"k": "1", "v": "2", "site": "ams", "environment": "production"} and s[1].tags is None
    d = enrich.site_env_tags(enrich.add_tags(df, {}), default_site="d").collect()
    assert d[1].tags == {"site": "d"}


@pytest.mark.parametrize("size", [3, 100])
def test_geo(spark, size):
    """Few subnets stay in the plan, many are joined; both use config order, not prefix length."""
    subnets = {"10.0.0.0/8": {"dc": "wide"}, "10.1.0.0/16": {"dc": "narrow"}, "192.168.1.0/24": {"dc": "lan"}, "172.16.0.9": {"dc": "single"}}
    subnets.update({f"11.{i}.0.0/16": {"dc": f"n{i}"} for i in range(size)})
    df = spark.createDataFrame(
        [("10.1.2.3",), ("192.168.1.77",), ("10.9.9.9",), ("8.8.8.8",), ("bad",), ("172.16.0.9",), ("11.2.3.4",), (None,)], "client_ip string")
    got = {r.client_ip: (r.geo_hint or {}).get("dc") for r in enrich.geo_hint(df, {"10.9.9.9": {"dc": "exact"}}, subnets).collect()}
    assert got == {"10.1.2.3": "wide", "192.168.1.77": "lan", "10.9.9.9": "exact", "8.8.8.8": None, "bad": None,
                   "172.16.0.9": "single", "11.2.3.4": "n2", None: None}


def test_annotations(spark):
    texts = [
        '{"confidence": 0.95, "tags": {"component": "db"}, "priority": "high", "summary": "s"}',
        'text {"confidence": 0.7} more', '{"tags": {}}', '{"confidence": 2}', '{"confidence": 0.9, "priority": "urgent"}',
        '{"confidence": 0.9, "tags": {"a": 1}}', '{"confidence": "0.9"}', "none", '{"confidence": 0.9, "summary": "%s"}' % ("x" * 201), "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", annotate.parse_annotation(F.col("t")).alias("r"))
    valid = df.select("id", annotate.valid_annotation(F.col("r")).alias("v"))
    assert [r.id for r in valid.where("v").collect()] == [0, 1]
    notes = df.where(annotate.valid_annotation(F.col("r"))).select("id", annotate.annotation_fields(F.col("r")).alias("annotation"))
    events = spark.createDataFrame([(0, {"k": "v"}), (1, None), (2, None)], "id int, tags map<string,string>")
    out = {r.id: r for r in annotate.merge_annotations(events, notes, "id", "m").collect()}
    assert out[0].tags == {"k": "v", "llm_component": "db"} and out[0].llm_priority == "high"
    assert out[0].llm_enrichment.confidence == 0.95
    assert out[1].llm_enrichment is None and out[1].tags is None and out[2].llm_summary is None


def test_prompt(spark):
    df = spark.createDataFrame([("syslog", "x" * 600, "", "no")], "type string, message string, service string, secret string")
    p = annotate.prompt_text(df).first().prompt_event
    assert '"message":"' + "x" * 500 + '..."' in p and "secret" not in p and "service" not in p
    assert annotate.annotatable(df, 100).count() == 0 and annotate.annotatable(df).count() == 1


def test_flow_order_and_skips(spark):
    df = spark.createDataFrame([("syslog", "token=abc", "error", "2024-01-01 00:00:00")], "type string, message string, severity string, timestamp string")
    quarantined = []
    steps = flow.build_steps(
        {"redaction": {"mask_patterns": list(fixed.MASK_PATTERNS)}, "pii_check": {"strict_mode": True}, "enrichment": {"add_tags": {"a": "b"}}},
        "now", quarantine=quarantined.append)
    r = flow.run_steps(df, steps).first()
    assert r.message == "********" and r.severity_num == 3 and r.tags == {"a": "b"} and r.timestamp == "2024-01-01T00:00:00Z"
    assert quarantined[0].count() == 0
    assert flow.build_steps({"redaction": {"enabled": False}}, "now") == []
    stats = {}
    raw = flow.run_steps(df, flow.build_steps({"pii_check": {}}, "now", quarantine=quarantined.append, stats=stats))
    assert len(raw.collect()) == 0 and len(quarantined[1].collect()) == 1
    assert stats["pii_check"].get == {"total": 1, "processed": 0, "errors": 1}
    audited = flow.with_audit(flow.with_audit(df, "mask", "changed"), "tag", "added").first().audit
    assert [tuple(a) for a in audited] == [("mask", "changed"), ("tag", "added")]
    safe = flow.fail_safe(df, "severity", F.lit(None).cast("string")).first()
    assert safe.severity == "error"
    seen_df, seen = flow.observed(df, F.col("severity").isNotNull())
    seen_df.count()
    assert seen.get == {"total": 1, "processed": 1, "errors": 0}


def test_payload_is_masked_and_walked_by_value(spark):
    docs = [
        r'{"note":"token=abc","n":1.50,"token=k":[true,null,"a\"token=\u0041\\ x"]}', '{"ok": "fine", "deep": {"mail": ["x", "a@b.co"]}}', "password=1 no json", None, "[]", '"token=zz"',
        json.dumps({"long": ["line\n" * 3000, "token=q"]}),
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, data string")
    patterns = [r"token=\S+", r"password=\S+"]
    got = [r.data for r in redact.mask_patterns(df, patterns).orderBy("id").collect()]
    assert json.loads(got[0]) == {"note": "********", "n": 1.5, "token=k": [True, None, 'a"******** x']}
    assert got[1] == docs[1] and got[2] == "******** no json" and got[3] is None and got[4] == "[]" and got[5] == '"********"'
    assert json.loads(got[6]) == {"long": ["line\n" * 3000, "*******"]}
    found = redact.detect_pii(df, patterns=[("email", r"\w+@\w+\.\w+"), ("password", r"password=\S+")]).orderBy("id").collect()
    assert [[(f.path, f.type) for f in r.pii_findings] for r in found] == [[], [("data.deep.mail[1]", "email")], [("data", "password")], [], [], [], []]


def test_geo_tables_are_not_shuffled_for(spark):
    """Configured tables have a known size: events are joined where they are."""
    df = spark.range(10).selectExpr("concat('10.0.0.', id) AS client_ip")
    out = enrich.geo_hint(df, {"10.0.0.1": {"dc": "x"}}, {"10.0.0.0/24": {"dc": "y"}, "10.0.0.8/30": {"dc": "z"}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    assert {r.client_ip[-1]: r.geo_hint["dc"] for r in out.collect()} == {**{str(i): "y" for i in range(10)}, "1": "x"}


def walk(value, path, out):
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", out)
    elif isinstance(value, str) and "@" in value:
        out.append((path, value))
    return out


def test_findings_inside_json_of_any_shape(spark):
    """Nested lists and objects, escapes, brackets and commas inside strings, empty ones, text that is not JSON."""
    rng = random.Random(9)
    texts = ["a@b", "{x@y}", "[1,2]@", 'q"@"', "\\@", "plain", "", "é@ü", ":@:", "\n@\t", "},{"]

    def make(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice([rng.choice(texts), rng.randrange(9), None, True, -1.5e3])
        if kind == 3:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["k", "a b", "k.l", 'q"', "[", "é:"]) + str(i): make(depth - 1) for i in range(rng.randrange(4))}

    docs = [json.dumps(make(4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(300)]
    docs += ["not json a@b", "{broken a@b", None, "", '"a@b"', "[]", "{}", "[[[]],{}]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, data string")
    out = redact.detect_pii(df, ["data"], patterns=[("mail", "@")])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        try:
            want = walk(json.loads(r.data), "data", []) if r.data is not None else []
        except ValueError:
            want = [("data", r.data)] if "@" in r.data else []
        assert [(f.path, f.text) for f in r.pii_findings] == want
