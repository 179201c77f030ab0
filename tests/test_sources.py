import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from quaylight.sources import devices, envelopes, exposition, imports, inventory, rawlog, syslog

AS_OF = "2024-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_syslog_lines(spark):
    rows = syslog.parse(
        lines(
            spark,
            "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8",
            "<165>1 2003-08-24T05:14:15.000003-07:00 192.0.2.1 myproc 8710 - - %% It's time to make the do-nuts.",
            "This is not a valid syslog message",
            "<46>2023-08-23T12:05:45Z server4 nginx: JSON embedded test",
            "<13>Feb  5 17:32:18 h app[77]: x",
        )
    ).collect()
    old, new, bad, bad2, pid = rows
    assert (old.rfc_variant, old.facility, old.severity, old.hostname, old.tag, old.process_id) == (
        "rfc3164", "security", "critical", "mymachine", "su", None)
    assert old.message == "'su root' failed for lonvick on /dev/pts/8"
    assert (new.rfc_variant, new.facility, new.severity, new.hostname, new.app_name, new.process_id) == (
        "rfc5424", "local4", "notice", "192.0.2.1", "myproc", "8710")
    assert new.message_id is None and new.structured_data is None and new.version == 1
    assert bad.rfc_variant == "unknown" and bad.parse_error == syslog.PARSE_ERROR
    assert bad.message == "This is not a valid syslog message"
    assert bad2.rfc_variant == "unknown"
    assert pid.process_id == "77"


def test_priority(spark):
    p = syslog.priority(F.col("p"))
    row = spark.createDataFrame([(165,), (100,)], "p int").select(*[c.alias(n) for n, c in p.items()]).collect()
    assert tuple(row[0]) == (20, 5, "local4", "notice")
    assert row[1].facility == "unknown_12"


def test_size_guard(spark):
    ok, rejected = rawlog.size_guard(lines(spark, "é" * 5, "a" * 5), limit=5)
    assert [r.value for r in ok.collect()] == ["a" * 5]
    assert rejected.count() == 1


def test_raw_log_files(spark, tmp_path):
    (tmp_path / "nginx").mkdir()
    (tmp_path / "nginx" / "error.txt").write_text("one\n\ntwo\n")
    (tmp_path / "nginx" / "skip.dat").write_text("no\n")
    df = rawlog.events(rawlog.read(spark, str(tmp_path / "nginx"), "*.txt"), as_of())
    assert sorted((r.message, r.service) for r in df.collect()) == [("one", "web"), ("two", "web")]


def test_envelope_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"messages":[{"type":"syslog","message":"m1","tags":{"a":"b"}},{"message":"no type"}],"batch_size":2,"is_retry":false}\n'
        "{not json\n"
    )
    env = envelopes.read(spark, str(tmp_path))
    good, bad = envelopes.split_valid(envelopes.messages(env))
    assert [(r.type, r.message, r.tags) for r in good.collect()] == [("syslog", "m1", {"a": "b"})]
    assert bad.count() == 1
    env.cache()
    assert env.where("_corrupt_record is not null").count() == 1
    env.unpersist()


def test_jsonl_syslog(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(
        '{"timestamp":"2024-01-15 10:00:00","host":"web01","facility":"auth","severity":3,"program":"sshd","pid":12,"message":"<34>1 2024-01-15T10:00:00Z h a - - - hello","rack":"r1","_x":"y"}\n'
        '{"ts":"1705312800","sev":"fatal","msg":"<34>Jan 15 10:00:00 h x"}\n'
        '{"time":"2024-01-15T10:00:00+02:00","level":"warn"}\n'
        "broken\n"
    )
    raw = imports.read_jsonl(spark, str(tmp_path / "e.jsonl"))
    df = imports.syslog_events(raw.where("_corrupt_record is null"), as_of(), tz="America/New_York", map_severity=True)
    by_time = {str(r.timestamp): r for r in df.collect()}
    a = by_time["2024-01-15 15:00:00"]
    assert (a.source_ip, a.facility, a.severity_int, a.severity_num, a.tag, a.pid_int) == ("web01", "auth", 3, 3, "sshd", 12)
    assert a.rfc_variant == "RFC5424" and a.extra_rack == "r1" and "extra__x" not in df.columns
    b = by_time["2024-01-15 10:00:00"]
    assert b.severity == "fatal" and b.severity_num is None and b.rfc_variant == "RFC3164"
    c = by_time["2024-01-15 08:00:00"]
    assert c.severity_num == 4 and c.raw_message == ""
    raw.cache()
    assert tuple(imports.import_summary(raw).first()) == (3, 1)
    raw.unpersist()
    assert imports.read_jsonl(spark, str(tmp_path / "e.jsonl"), max_lines=2).count() == 2


def test_jsonl_metrics(spark):
    df = spark.createDataFrame(
        [("h", "45", "%"), ("h", "up", "%"), ("h", "7", "s")], "target string, value string, units string"
    )
    rows = imports.metric_events(df, as_of(), percent_as_ratio=True).collect()
    assert [(r.value_double, r.value_ratio) for r in rows] == [(45.0, 0.45), (None, None), (7.0, None)]
    assert rows[1].value == "up"


def test_weather_csv(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text(
        "timestamp;latitude;longitude;city;temperature_celsius;humidity_percent;weather_description;uv\n"
        "2024-01-15 12:00;40.7;-74.0;New York;5.5;damp;Clear;3\n"
        "2024-01-15T12:00:00Z;1;2;X;;50;;\n"
    )
    assert imports.detect_delimiter(spark, str(path)) == ";"
    a, b = imports.weather_events(imports.read_weather_csv(spark, str(path)), as_of(), "America/New_York").collect()
    assert a.timestamp == dt.datetime(2024, 1, 15, 17) and b.timestamp == dt.datetime(2024, 1, 15, 12)
    assert (a.location.latitude, a.location.city) == (40.7, "New York")
    assert a.current_weather.temperature == "5.5" and a.current_weather.temperature_celsius == 5.5
    assert a.current_weather.humidity_percent is None and a.unparsed == {"humidity_percent": "damp"}
    assert a.current_weather.uv == 3.0 and b.current_weather.temperature_celsius is None


def test_flow_packets(spark):
    df = spark.createDataFrame(
        [(bytes([0, 5]) + bytes(46),), (bytes([0, 0, 0, 5, 0, 0, 0, 1]),), (bytes([0, 9]),), (b"\x01",), (bytes([1, 1, 1, 1]),)],
        "content binary",
    )
    rows = devices.flow_packets(df).collect()
    assert [r.version for r in rows] == [5, 5, 9, None, None]
    assert rows[0].size_bytes == 48 and "\n" not in rows[0].payload_b64


def test_nmea(spark):
    rows = devices.nmea_events(
        lines(
            spark,
            "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A",
            "$GPVTG,084.4,T,077.3,M,022.4,N,041.5,K*48",
            "$GPHDT,084.4,T*23",
            "noise",
        )
    ).collect()
    rmc, vtg, hdt = rows
    assert rmc.valid and round(rmc.lat, 4) == 48.1173 and round(rmc.lon, 4) == 11.5167
    assert (rmc.sog_kn, rmc.cog_deg) == (22.4, 84.4) and (vtg.cog_deg, vtg.sog_kn) == (84.4, 22.4)
    assert hdt.heading_true_deg == 84.4


def test_snmp_and_weather_codes(spark):
    df = spark.createDataFrame(
        [Row(results=[Row(oid="1.3.6.1.2.1.1.3.0", value="123"), Row(oid="9.9", value="x")])]
    )
    r = devices.poll_results(df).first()
    assert [(x.oid_name, x.numeric_value) for x in r.results] == [("sysUpTime", 123.0), ("unknown_9.9", None)]
    codes = spark.createDataFrame([(0,), (99,), (42,), (None,)], "c int").select(
        devices.weather_description(F.col("c")).alias("d")).collect()
    assert [c.d for c in codes] == ["Clear sky", "Thunderstorm with heavy hail", "Unknown weather code: 42", None]


def test_inventory(spark):
    text = 'Netid State Recv-Q Send-Q Local Peer Process\nudp UNCONN 0 0 0.0.0.0:5514 0.0.0.0:* users:("python",pid=123,fd=5)\nbad\n'
    listing = spark.createDataFrame([("h1", text)], "host string, output string")
    files = spark.createDataFrame([("h1", "/var/log/dnsmasq.log"), ("h1", "/etc/x")], "host string, path string")
    r = inventory.inventory(listing, files).first()
    assert tuple(r.listeners[0]) == ("udp", "0.0.0.0:5514", 'users:("python",pid=123,fd=5)')
    assert r.log_candidates == ["/var/log/dnsmasq.log"]


def test_exposition(spark):
    df = lines(
        spark, "# TYPE a counter", 'requests_total{method="POST",path="/a\\"b"} 5', "queue_size 3.5", 'b_bucket{le="+Inf"} 7', ""
    )
    rows = exposition.samples(df, as_of()).collect()
    assert [(r.name, r.labels, r.value) for r in rows] == [
        ("requests_total", {"method": "POST", "path": '/a"b'}, 5.0),
        ("queue_size", {}, 3.5),
        ("b_bucket", {"le": "+Inf"}, 7.0),
    ]


def test_escaped_backslash_before_n_is_no_line_break(spark):
    line = r'm{path="C:\\new\n\"x\"",b="\\"} 1'
    got = exposition.samples(spark.createDataFrame([(line,)], "value string"), F.lit(0).cast("timestamp")).first()
    assert got.labels == {"path": 'C:\\new\n"x"', "b": "\\"}


def test_inventory_of_a_host_without_a_listing(spark):
    listings = spark.createDataFrame([("h1", "Netid\ntcp LISTEN 0 1 *:22 users:x", "s1")], "host string, output string, snap string")
    files = spark.createDataFrame([("h2", "/var/log/dnsmasq.log", "s1"), ("h1", "/var/log/dnsmasq.log", "s2"), (None, "/var/log/dnsmasq.log", "s1")], "host string, path string, snap string")
    found = {r.host: (len(r.listeners), len(r.log_candidates)) for r in inventory.inventory(listings, files).collect()}
    assert found == {"h1": (1, 1), "h2": (0, 1), None: (0, 1)}
    assert inventory.inventory(listings, files, snapshot="snap").count() == 4
