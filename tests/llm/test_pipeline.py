"""The corpus pipeline against a plain version of its stages, and its guard."""

import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quaylight.llm import packing, quality
from quaylight.llm.queries import tokenizer
from quaylight.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_copies(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d: t for d, t in texts.items() if label[d] == d}


def without_repeats(texts):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    out = {}
    for d, w in words.items():
        hit = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                hit |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        if not hit or kept:
            out[d] = kept if hit else texts[d]
    return out


def without_benchmark(texts, items):
    windows = {}
    for t in items:
        w = ITEM_WORD.findall(lower(t or ""))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]): n for i in range(len(w) - n + 1) if n}
    out = {}
    for d, t in texts.items():
        found = list(ITEM_WORD.finditer(lower(t or "")))
        w = [m[0] for m in found]
        hit = [False] * len(w)
        for n in set(windows.values()):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if sum(hit) > 0.5 * len(w):
            continue
        pieces, at, i = [], 0, 0
        while i < len(w):
            if hit[i]:
                j = i
                while j + 1 < len(w) and hit[j + 1]:
                    j += 1
                pieces.append(t[at : found[i].start()])
                at = found[j].end()
                i = j
            i += 1
        out[d] = "".join([*pieces, t[at:]]) if any(hit) else t
    return out


def test_pipeline_matches_a_plain_version(spark):
    docs = table(spark, FOLDER, "documents")
    judged = quality.rate_quality(docs, table(spark, FOLDER, "labels"), F.col("source"), F.col("lang")).collect()
    rejected = {r.doc_id for r in judged if not r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    assert 0 < len(rejected) < 0.4 * len(judged)
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    want = without_benchmark(without_repeats(without_copies(texts)), items)
    coder = Tokenizer.from_file(tokenizer())
    pieces = []
    for d, t in want.items():
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            pieces.append((d, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    lengths = {}
    for *_, n, _ in pieces:
        lengths[n] = lengths.get(n, 0) + 1
    assert len({r.sequence_id for r in got}) == sum(run.count for run in packing.sweep(lengths, 2048))


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_and_empty_rows(spark, k):
    docs = table(spark, FOLDER, "documents")
    odd = [(None, None, None, None, None), (None, "x y", "en", None, 3), (1, "", "en", "s", 0), (2, "one two three " * 20, "en", "s", 9), (2, "one two three " * 20, "en", "s", 9), (3, None, None, "s", None)]
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, spark.createDataFrame(odd, docs.schema).withColumn("digest", F.lit("x")), FOLDER)
    rows = out.collect()
    assert out.columns == [*docs.columns, "digest"] and len(rows) <= len(odd)
    if name != "quality":
        assert sum(r.doc_id == 2 for r in rows) == (1 if name == "ngram_jaccard" else 2)
    assert sum(r.doc_id is None for r in rows) == 2
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
