import datetime as dt
import gzip
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.operators import chains, delivery, failures, series, sinks
from quaylight.operators.project import sanitise
from quaylight.operators.series import numbered

T0 = dt.datetime(2024, 1, 1)


def at(spark, rows, extra="key string"):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), *r) for s, *r in rows], f"ts timestamp, {extra}")


def chain(times, window, inclusive=False):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last > window or (inclusive and t - last >= window):
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("parts", [None, 1, 40])
@pytest.mark.parametrize("inclusive", [False, True])
def test_first_sights(spark, parts, inclusive):
    rng = random.Random(7)
    keys = {"a": [0, 10, 3600, 3601, 7000, 7201], "b": [rng.randrange(0, 90000) for _ in range(400)], None: [5, 6, 9000], "c": [i * 1800 for i in range(30)]}
    df = at(spark, [(t, k) for k, ts in keys.items() for t in ts])
    out = series.first_sights(df, ["key"], "ts", 3600, inclusive, parts).collect()
    got = {}
    for r in out:
        got.setdefault(r.key, []).append(int((r.ts - T0).total_seconds()))
    assert {k: sorted(v) for k, v in got.items()} == {k: chain(v, 3600, inclusive) for k, v in keys.items()}


def random_sights(rng, regular):
    """Times of a few keys in order: dense, sparse, evenly spaced, with gaps."""
    rows = []
    for key in sorted({rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))}):
        times, t = [], rng.randrange(0, 50)
        for _ in range(rng.choice([1, 3, 40, 150])):
            times.append(t)
            t += 3 if regular else rng.choice([1, 1, 2, 5, 30, 200])
        rows += [(key, x) for x in times]
    return rows


@pytest.mark.parametrize("seed", range(60))
def test_spans_compose(seed):
    """Cut anywhere, composed in any grouping: the exit is that of the plain chain."""
    rng = random.Random(seed)
    rows, width = random_sights(rng, seed % 2), rng.choice([0, 4, 20, 90])
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(12)))})
    spans = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows[low:high]
        last = np.array([t for k, t in part if k == part[-1][0]], np.int64)
        spans.append(chains._span([part[0][0], part[-1][0]], last, width, part[0][0] == part[-1][0]))
    for i in range(len(spans)):
        out = spans[i]
        for j in range(i, len(spans)):
            out = out if j == i else out.then(spans[j], width)
            began = [t for k, t in rows[: cuts[i]] if k == rows[cuts[i]][0]]
            entry = chain(began, width)[-1] if began else None
            own = [t for k, t in rows[: cuts[j + 1]] if k == rows[cuts[j + 1] - 1][0]]
            assert out.after(entry, width) == chain(own, width)[-1]
    while len(spans) > 1:  # halves of halves
        spans = [a.then(b, width) for a, b in zip(spans[::2], spans[1::2], strict=False)] + spans[len(spans) // 2 * 2 :]
    assert spans[0].after(None, width) == chain([t for k, t in rows if k == rows[-1][0]], width)[-1]


def test_a_hot_key_is_linear(spark):
    """400 000 kept sights of one key among 1 200 000 sights, over more partitions than one level holds."""
    df = spark.range(1_200_000).selectExpr("'hot' AS key", "timestamp_seconds(id * 10) AS ts")
    out = series.first_sights(df, ["key"], "ts", 25, parts=40)
    got = out.selectExpr("count(*) AS n", "sum(unix_seconds(ts) % 30) AS off").first()
    assert (got.n, got.off) == (400_000, 0)


def test_drop_repeats(spark):
    df = at(spark, [(0, "k", 2), (0, "k", 1), (10, "k", 3), (4000, "k", 4), (0, None, 5)], "key string, id long")
    assert sorted(r.id for r in delivery.drop_repeats(df, ["key"], "ts", "id").collect()) == [1, 4, 5]


@pytest.mark.parametrize("piece", [3, 1000])
def test_numbering(spark, piece):
    ids = sorted(random.Random(1).sample(range(-50, 5000), 200))
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    got = {r.id: r.row_index for r in series.numbered(df, "id", piece).collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_batch_keys(spark):
    df = spark.createDataFrame([(i, f"m{i % 3}", "t") for i in range(5)], "id long, message string, timestamp string")
    got = {r.batch_no: r.batch_key for r in delivery.batch_keys(df, "id", 3).collect()}
    key = lambda texts: hashlib.md5("".join(sorted(texts)).encode()).hexdigest()
    assert got == {0: key(["m0t", "m1t", "m2t"]), 1: key(["m0t", "m1t"])}


def test_disposition(spark):
    log = {1: "ffffs", 2: "fffs", 3: "ff", 4: "s", 5: "sffff", 6: "f" * 9}
    rows = [(k, i, o == "f") for k, seq in log.items() for i, o in enumerate(seq)]
    df = spark.createDataFrame(rows, "id int, n int, failed boolean")
    got = {r.id: (r.status, r.retry_count) for r in delivery.disposition(df, "id", F.col("failed"), ["n"]).collect()}
    assert got == {1: ("dlq", 4), 2: ("completed", 3), 3: ("pending", 2), 4: ("completed", 0), 5: ("completed", 0), 6: ("dlq", 4)}
    edge = {r.id: r.status for r in delivery.disposition(df, "id", F.col("failed"), ["n"], dead_after=5).collect()}
    assert edge[1] == "completed" and edge[6] == "dlq"


def test_queue_tables(spark):
    df = at(spark, [(0, 1, '{"a":1}', "pending"), (5, 2, "{bad", "pending"), (9, 3, "x", "completed"), (9, 4, "y", None)], "id long, message_data string, status string")
    assert [r.id for r in delivery.fifo_batch(df, 1).collect()] == [1]
    assert {r.id: r.status for r in delivery.decoded(df).collect()} == {1: "pending", 2: "failed", 3: "completed", 4: None}
    assert tuple(delivery.status_counts(df).first()) == (4, 2, 1, 0)
    assert delivery.retention_count(df, "2024-01-02 00:00:10", 86400).first()[0] == 1
    assert {r.id for r in delivery.apply_retention(df, "2024-01-02 00:00:10", 86400).collect()} == {1, 2, 4}
    assert [r.id for r in delivery.newest(df, 2).collect()] == [3, 4]
    assert delivery.time_span(df).first().timespan == 9.0
    assert tuple(delivery.queue_depth(df).first()) == (4, 13)
    assert tuple(delivery.queue_depth(df.where("false")).first()) == (0, 0)


def test_dead_letters(spark):
    df = spark.createDataFrame([("b", 1, None)], "z string, a int, n string")
    r = delivery.dead_letters(df, "max_attempts_exceeded", 5, "2024-01-01").first()
    text = json.dumps({"a": 1, "z": "b"}, sort_keys=True)
    assert r.original_message == text and r.message_hash == hashlib.md5(text.encode()).hexdigest()[:8]
    assert r.reason == "max_attempts_exceeded" and r.attempts == 5


def test_envelopes(spark, tmp_path):
    df = spark.range(5).select(
        "id", F.concat(F.lit("m"), "id").alias("message"), F.lit("x").alias("status"), F.lit(1).alias("__spool_id"), F.lit(2).alias("attempts"))
    assert sanitise(df).columns == ["id", "message"]
    docs = delivery.envelopes(df, "id", "2024-01-01T00:00:00Z", 2)
    got = [json.loads(r.payload) for r in docs.orderBy("batch_no").collect()]
    assert [d["batch_size"] for d in got] == [2, 2, 1]
    assert got[0] == {"messages": [{"id": 0, "message": "m0"}, {"id": 1, "message": "m1"}], "batch_size": 2,
                      "timestamp": "2024-01-01T00:00:00Z", "source": "edge", "is_retry": False}
    delivery.write_envelopes(docs, str(tmp_path / "out"))
    plain = sorted(t for p in (tmp_path / "out/plain").glob("*.txt") for t in p.read_text().splitlines())
    zipped = sorted(t for p in (tmp_path / "out/gzip").glob("*.gz") for t in gzip.open(p, "rt").read().splitlines())
    assert plain == zipped and len(plain) == 3


def test_fan_out_keeps_going(spark, tmp_path):
    df = spark.range(4)

    def broken(batch, batch_id):
        raise RuntimeError("down")

    good = sinks.file_sink(str(tmp_path / "good"), lambda d: d)
    for _ in range(2):  # a replay overwrites
        rows = sinks.fan_out(df, 7, {"bad": broken, "good": good}, str(tmp_path / "stats"))
    assert sorted(rows) == [(7, "bad", 0, 4, 0, 0), (7, "good", 4, 0, 0, 0)]
    assert spark.read.parquet(str(tmp_path / "good")).count() == 4
    total = sinks.sink_totals(spark.read.parquet(str(tmp_path / "stats"))).first()
    assert (total.total_written, total.total_errors) == (4, 4)


@pytest.mark.parametrize("chunk", [5, 60, 100_000])
def test_consecutive_failures(spark, chunk):
    rng = random.Random(3)
    rows, want = [], {}
    for target in ("a", "b"):
        run = 0
        for i in range(120):
            ok = rng.random() < 0.25
            run = 0 if ok else run + 1
            rows.append((i, target, ok, i))
            want[(target, i)] = (run, run < 5)
    df = at(spark, rows, "target string, ok boolean, id int")
    out = failures.consecutive_failures(df, ["target"], "ok", chunk_seconds=chunk)
    assert {(r.target, r.id): (r.consecutive_failures, r.healthy) for r in out.collect()} == want


def test_numbers_follow_any_orderable_id(spark):
    ids = [hash((i, "x")) for i in range(3000)] + [-(1 << 62), 1 << 62]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = [r.id for r in numbered(rows, "id").orderBy("row_index").collect()]
    assert got == sorted(ids)
    texts = spark.createDataFrame([("b",), ("a",), (None,)], "id string")
    assert {r.id: r.row_index for r in numbered(texts, "id").collect()} == {None: 0, "a": 1, "b": 2}
    assert numbered(rows.limit(0), "id").count() == 0
    plan = numbered(rows, "id")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_missing_keys_and_times_are_not_lost(spark):
    polls = spark.createDataFrame([(1, None, 0, False), (2, None, 10, False), (3, "a", 0, True)], "id int, host string, t int, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    found = failures.consecutive_failures(polls, ["host"], "ok").select("id", "consecutive_failures").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 2), (3, 0)]
    rows = spark.createDataFrame([(1, "k", 0), (2, "k", 10), (3, "k", None), (4, "k", None)], "id int, key string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.id for r in delivery.drop_repeats(rows, ["key"], "ts", "id").collect()) == [1, 3, 4]


def test_retention_writes_touched_days_only(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "id INT, ts TIMESTAMP, status STRING, day STRING"
    rows = [(d * 10 + i, d, "completed" if d < 2 or i % 2 else "pending") for d in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, d int, status string").select(
        "id", F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400).alias("ts"), "status", F.col("d").cast("string").alias("day"))
    df.coalesce(1).write.partitionBy("day").parquet(path)
    names = lambda: {p.parent.name: p.name for p in (tmp_path / "t").glob("day=*/part-*")}
    before = names()
    gone = delivery.expire(spark, path, shape, "day", "2024-01-05", 86400)
    assert gone == {"0": 4, "1": 4, "2": 2}
    after = names()
    assert set(after) == {f"day={d}" for d in range(2, 6)}
    assert {d for d in after if after[d] != before[d]} == {"day=2"}
    left = spark.read.schema(shape).parquet(path)
    assert left.count() == 14 and delivery.expire(spark, path, shape, "day", "2024-01-05", 86400) == {}
