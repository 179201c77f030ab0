"""Classifiers on held-out rows, vectors and components against brute force, chats by round trip, url rules."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.llm import caps, chat, language, quality, shared, toxicity, urls
from quaylight.llm.components import components
from quaylight.llm.shared import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, FOLDER, "labels")


def odd(spark, docs):
    """Rows with nulls everywhere, empty, symbol-only and very long texts, and a repeated row."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "!!! 123", None, None, 7), (3, "long text " * 30000, "en", "s", 1), (3, "long text " * 30000, "en", "s", 1)]
    return spark.createDataFrame(rows, docs.schema)


def test_language_on_held_out_rows(spark, docs):
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = language.train_language(docs.where(half == 0))
    held = language.identify(docs.where(half == 1).withColumn("score", F.lit("clash")), model)
    right = held.where("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1
    found = language.identify(odd(spark, docs), model).collect()
    assert [r.lang_pred for r in found[:3]] == ["und"] * 3 and len(found) == 5
    assert found[3].lang_pred in model.languages and tuple(found[3]) == tuple(found[4])
    none = language.train_language(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs.limit(5), none).collect()} == {"und"}


def test_ftrl_is_sparse_and_calibration_helps():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        label = int(rng.integers(2))
        at = np.unique(np.append(rng.integers(100, 5000, 20), label * 7 + 3))
        rows.append((at, np.full(len(at), 1 / math.sqrt(len(at))), label))
    dense, w = language.ftrl(rows, 2, l1=0.0), language.ftrl(rows, 2, l1=0.3)
    assert (w[100:5000] == 0).mean() > 0.8 > 0.2 > (dense[100:5000] == 0).mean()
    assert w[3, 0] > w[3, 1] and w[10, 1] > w[10, 0]
    scores = rng.standard_normal((500, 3)) * 10
    assert language.calibrate(scores, rng.integers(0, 3, 500)) > 5


def test_toxicity_on_held_out_rows(spark):
    big = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = toxicity.train_toxicity(big.where(third != 1), labels.where(third != 1))
    held = toxicity.score_toxicity(big.where(third == 1), model).join(labels.where("toxic is not null"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    # 200 confirmed texts in four languages; on the larger tables recall is 0.98 and false alarms below 0.005.
    assert counts[1, 1] > 0.75 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) < 0.04 * counts[0, 0]
    found = toxicity.score_toxicity(odd(spark, table(spark, FOLDER, "documents")), model).collect()
    assert len(found) == 5 and found[0].score == found[1].score < 0.7 and found[3].score == found[4].score
    blank = toxicity.train_toxicity(big.limit(10), labels.limit(0))
    assert toxicity.score_toxicity(big.limit(10), blank).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.score_toxicity(big.limit(0), blank).count() == 0


def test_quality_on_held_out_rows(spark, docs, labels):
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    found = quality.rate_quality(docs, labels.where(half == 0), F.col("source"), F.col("lang"))
    counts = {(r.quality, r.kept): r["count"] for r in found.join(labels.where(half == 1), "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True] and counts.get((0, True), 0) <= 0.1 * counts[0, False]
    assert quality.rate_quality(odd(spark, docs), labels, F.col("source"), F.col("lang")).count() == 5
    assert quality.rate_quality(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.rate_quality(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == docs.count()


def test_sparse_sites_are_shrunk(spark):
    scores = spark.createDataFrame([(i, "bad", "p", 0.0) for i in range(200)] + [(900, "new", "p", 0.0)] + [(1000 + i, "good", "p", 0.0) for i in range(600)], "doc_id bigint, host string, path string, logit double")
    labels = spark.createDataFrame([(i, 0) for i in range(150)] + [(900, 0)] + [(1000 + i, 1) for i in range(500)], "doc_id bigint, quality int")
    site = {r.host: r.site for r in quality.judged(scores, labels).select("host", "site").distinct().collect()}
    assert site["bad"] < 0.3 < site["new"] < site["good"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def linked(rows, similarity=0.95):
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = x @ x.T >= similarity
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            low = min(label[ids[a]], label[ids[b]])
            if label[ids[a]] != low or label[ids[b]] != low:
                label[ids[a]] = label[ids[b]] = low
                changed = True
    return {i: (int(near[k].sum()) - 1, label[i]) for k, i in enumerate(ids)}


def test_cap_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.standard_normal(64).astype(np.float32)], 0) for i in range(300)]
    for i in range(300, 700):
        center = np.array(rows[i % 7 if i < 600 else i % 60][1])
        rows.append((i, [float(c) for c in (center + rng.standard_normal(64) * rng.choice([0, 0.1, 0.25, 0.35])).astype(np.float32)], 0))
    want = linked(rows)
    strange = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None] * 64, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [float("inf")] + [1.0] * 63, 1), (None, rows[0][1], 1)]
    found = {r.vec_id: r for r in caps.cap_links(vectors(spark, rows + strange).withColumn("copies", F.lit(1))).collect()}
    links, seen = sum(n for n, _ in want.values()), sum(found[i].n_links for i in want)
    assert links > 2000 and 0.99 * links <= seen <= links
    assert sum(found[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values() if r.vec_id is not None)
    for i, *_ in strange[:-1]:
        assert (found[i].n_links, found[i].component_id) == (0, i)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)
    assert caps.cap_links(vectors(spark, [])).count() == 0


def test_recall_at_the_limit():
    rng = np.random.default_rng(1)
    for n in (2_000, 50_000, 1_000_000):
        code = caps.CapCode.for_data(n, 64)
        x = rng.standard_normal((1000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        r = rng.standard_normal(x.shape)
        r -= (r * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
        shared = [not set(a.tolist()).isdisjoint(b.tolist()) for a, b in zip(code.decode(x), code.decode(y), strict=True)]
        assert np.mean(shared) > 0.95


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8, 24, 64, 256])
@pytest.mark.parametrize("n", [300, 100_000, 2_100_000, 20_000_000, 100_000_000])
def test_recall_at_any_size_and_dimension(n, dim):
    rng = np.random.default_rng(dim)
    code = caps.CapCode.for_data(n, dim)
    x = rng.standard_normal((2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x
    if dim > 1:
        r = rng.standard_normal(x.shape)
        r -= (r * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    lists = code.decode(x)
    assert all((np.diff(f) > 0).all() for f in lists) and max(map(len, lists)) <= caps.FILTERS
    shared = [not set(a.tolist()).isdisjoint(b.tolist()) for a, b in zip(lists, code.decode(y), strict=True)]
    assert np.mean(shared) > 0.985


def test_a_lower_limit_gets_more_filters():
    rng = np.random.default_rng(3)
    code = caps.CapCode.for_data(100_000, 64, 0.85)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = 0.85 * x + math.sqrt(1 - 0.85**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    assert np.mean([not set(a.tolist()).isdisjoint(b.tolist()) for a, b in zip(code.decode(x), code.decode(y), strict=True)]) > 0.98


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 - i, 101) for i in range(20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 3), (1, 0)]
    label = {n: n for link in links for n in link if None not in link}
    for _ in range(len(label)):
        for a, b in links:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(label[n] == found.get(n, n) for n in label) and all(found[n] == label[n] for n in found)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


TRICKY = ["", r"\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\</turn>", "<image:1>", "a\\", "é\U0001f600\n\n", "### : </turn>\n" * 3]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", None, "a: b", "# x"]), rng.choice([*TRICKY, None])) for t in range(rng.randrange(1, 7))]
        want[conv] = turns
        rows += [(conv, *t) for t in turns]
    rng.shuffle(rows)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for r in made.collect():
        turns = [(role or "", text or "") for _, role, text in want[r.conv_id]]
        assert chat.read_turns(r.formatted) == turns
        assert [chat.unescape(r.formatted[m.start : m.start + m.length]) for m in r["mask"]] == [t for role, t in turns if role == "assistant"]
    digest = {r.conv_id: r for r in chat.read_back(made).collect()}
    said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in want[3])
    assert digest[3].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and digest[3].n_turns == len(want[3])


def test_chat_parts_and_odd_rows(spark):
    part = lambda kind, **more: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more
    parts = [part("text", text="see <b>"), part("image", ref="s/1.png", width=100, height=57), part("audio", ref="a", seconds=1.5), part("document", ref="d", pages=3), part(None)]
    made = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")).collect()[0]
    assert made.formatted == "### user: see \\<b><image:1><audio:2><document:3><unknown:4></turn>\n### assistant: </turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in made.attachments] == [("image", "s/1.png", 12), ("audio", "a", 38), ("document", "d", 768), ("unknown", None, 0)]
    schema = "conv_id bigint, turn bigint, role string, text string, parts_of string"
    odd = chat.format_chats(spark.createDataFrame([(None, None, None, None, "x"), (None, None, None, None, "x"), (2, 5, "user", "b", None), (2, 5, "user", "a", None), (2, None, "user", "c", None)], schema))
    assert {r.conv_id: [t for _, t in chat.read_turns(r.formatted)] for r in odd.collect()} == {None: ["", ""], 2: ["c", "a", "b"]}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_url_rules(spark):
    rows = [
        ("http://a.example.org/es/1", "block", "example.org/es/"), ("https://EXAMPLE.org/en/1?x", "block", "example.org/en/1"), ("http://x.org", "allow", None), ("http://x.org/", "allow", "org/"),
        ("http://notexample.org/es/", "allow", "org/"), ("x://a.com/de/?://", "block", "com/de/"), ("ftp://com/fr/#a", "allow", "com/fr/"), ("no scheme", "allow", None), (None, "allow", None), ("http://a.com?/de/", "allow", None), ("http://ÀB.net/P/q", "allow", None),
    ]
    pages = spark.createDataFrame([(i, r[0], None, "mine") for i, r in enumerate(rows)], "page_id int, url string, good int, verdict string")
    found = {r.page_id: r for r in urls.judge(pages).collect()}
    assert [(found[i].verdict, found[i].rule) for i in range(len(rows))] == [r[1:] for r in rows]
    assert (found[5].host, found[5].path) == ("a.com", "/de/") and (found[7].host, found[8].path) == ("", "") and found[10].host == "Àb.net"
    assert urls.judge(pages.limit(0)).count() == 0


def test_bad_hosts_are_blocked_and_sparse_ones_not(spark):
    rows = [(f"http://good{i % 9}.example.net/{i}", 1) for i in range(300)] + [(f"http://bad.example.net/{i}", 0) for i in range(40)] + [("http://once.example.net/1", 0), ("http://never.example.net/1", None)]
    found = urls.judge(spark.createDataFrame(rows, "url string, good int")).groupBy("host", "verdict").count().collect()
    assert {r.host: r.verdict for r in found} == {**{f"good{i}.example.net": "allow" for i in range(9)}, "bad.example.net": "block", "once.example.net": "allow", "never.example.net": "allow"}


def test_outcomes(spark, labels):
    pages = spark.createDataFrame([("http://a.net/en/12.html",), ("http://a.net/x",), (None,), ("http://a.net/en/12?p=13",), ("http://a.net/99999999999999999999",)], "url string")
    known = spark.createDataFrame([(12, 1, 0), (12, 0, 0), (13, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.url: r.good for r in urls.outcomes(pages, known).collect()} == {"http://a.net/en/12.html": 0, "http://a.net/x": None, None: None, "http://a.net/en/12?p=13": 0, "http://a.net/99999999999999999999": None}


def test_one_id_on_two_vectors(spark):
    """Links belong to a vector: an id on two vectors has each one's own."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.0, 1.0]), (0, [0.0, 2.0]), (9, [1.0, 1.0]), (1, [-1.0, 0.0])]
    found = caps.cap_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found)
    assert got == [(0, 3, 0, True), (1, 0, 1, True), (1, 1, 1, True), (1, 3, 0, False), (2, 1, 1, False), (3, 3, 0, False), (4, 3, 0, False), (9, 0, 9, True)]


def test_sample_of_many_groups_and_a_hot_key(spark):
    """Thousands of groups, a hot one, repeated rows, null groups and keys: bounded, and each group is there."""
    few = spark.range(5000).selectExpr("id AS doc_id", "concat('l', id) AS lang", "concat('text ', id) AS text")
    hot = spark.range(20000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "'hot' AS lang", "concat('hot ', id) AS text")
    same = spark.range(20000).selectExpr("CAST(8 AS BIGINT) AS doc_id", "'same' AS lang", "'same text' AS text")
    none = spark.range(20000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS lang", "concat('none ', id) AS text")
    frame = few.unionByName(hot).unionByName(same).unionByName(none)
    counts = {r.lang: r.n for r in shared.sampled(frame, "doc_id", "lang", 500_300).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert sum(1 for g in counts if g and g[0] == "l") == 5000
    assert 60 < counts["hot"] < 150 and 60 < counts[None] < 150 and counts.get("same", 0) <= 1
    assert shared.sampled(frame.limit(0), "doc_id", "lang", 10).count() == 0


def plain_strength(groups):
    groups = [(n, k, m) for n, k, m in groups if 0 < m < 1 and n > 0]
    total = sum(n for n, *_ in groups)
    excess = sum(n * (k / n - m) ** 2 / (m * (1 - m)) for n, k, m in groups) - (len(groups) - 1) if groups else 0.0
    free = max(0.0, total - sum(n * n for n, *_ in groups) / total - (len(groups) - 1)) if groups else 0.0
    rho = (excess + quality.PRIOR / (1 + quality.STRENGTH)) / (free + quality.PRIOR)
    return min(quality.STRONGEST, max(quality.WEAKEST, (1 - rho) / rho)) if rho > 0 else quality.STRONGEST


def test_site_posteriors_match_plain_python(spark):
    """Sums, strengths, rates without the own label and decisions, over hosts and paths of all sizes."""
    rng = random.Random(6)
    rows, label = [], {}
    for h in range(12):
        rate = rng.random()
        for _ in range(rng.choice([1, 2, 30, 200])):
            d = len(rows)
            rows.append((d, f"h{h}", rng.choice("ab"), rng.gauss(1 if rng.random() < rate else -1, 1)))
            if rng.random() < 0.4:
                label[d] = int(rng.random() < rate)
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id bigint, host string, path string, logit double"), spark.createDataFrame(list(label.items()), "doc_id bigint, quality int")).collect()}
    sums = {}
    for d, h, q, logit in rows:
        w, v = (1.0, label[d]) if d in label else (quality.SOFT, 1 / (1 + math.exp(-logit)))
        for key in ((h,), (h, q)):
            n, k = sums.get(key, (0, 0))
            sums[key] = (n + w, k + w * v)
    hosts = [v for key, v in sums.items() if len(key) == 1]
    base = sum(k for _, k in hosts) / sum(n for n, _ in hosts)
    s = plain_strength([(n, k, base) for n, k in hosts])
    mean = {h: (k + s * base) / (n + s) for (h, *q), (n, k) in sums.items() if not q}
    t = plain_strength([(n, k, mean[key[0]]) for key, (n, k) in sums.items() if len(key) == 2])
    assert quality.WEAKEST < s < quality.STRONGEST
    for d, h, q, logit in rows:
        own, hit = (1, label[d]) if d in label else (0, 0)
        (hn, hk), (n, k) = sums[h,], sums[h, q]
        site = (k - hit + t * (hk - hit + s * base) / (hn - own + s)) / (n - own + t)
        assert found[d].site == pytest.approx(site, rel=1e-9, abs=1e-12)
        site = min(max(site, 0.001), 0.999)
        score = 1 / (1 + math.exp(-(logit + math.log(site / (1 - site)) - math.log(base / (1 - base)))))
        assert found[d].score == pytest.approx(score, rel=1e-9) and found[d].kept == (found[d].score >= quality.CUT)
