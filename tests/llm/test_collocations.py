"""Phrase counts and collocations against plain counting, over one shard and many, with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quaylight.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, n bigint, phrase string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(rows, depth=5):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    return counts, sizes


def plain(rows, least, limit, share=100, depth=5):
    counts, sizes = counted(rows, depth)
    out = []
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in frequent.items():
        longer = (f for (g, q), f in frequent.items() if g == lang and len(q) > len(w) and any(q[i : i + len(w)] == w for i in range(len(q))))
        if any(100 * f >= share * a for f in longer):
            continue
        cuts = [(1000 * a * sizes[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], sizes[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    ranked = []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= limit:
            ranked.append((r[0], ranks[r[0]], *r[1:]))
    return ranked


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["New", "york", "the", "a", "of", "city", "é", " x", "state\x1c", "to", "be"]
    phrases = ["New York city", "the state of", "to be or not", "be to be to be", "a a a a a a a"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! ", "\x0b"]
    out = []
    for k in range(260):
        words = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        out.append(("".join(w + rng.choice(marks) for w in words), ["en", "fr", None, "und"][k % 4]))
    return out + [(None, "en"), ("", "en"), ("...", "de"), ("one", "de"), (" \t", None)] + [("x y z " * 900, "en")] * 2


@pytest.mark.parametrize("size", [collocations.SHARD, 150])
@pytest.mark.parametrize("least", [2, 40])
def test_plain_counts(spark, rows, size, least):
    frame = spark.createDataFrame([(k, t, g, 1, "p") for k, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    found = collocations.collocations(frame, least=least, rows=60, size=size).collect()
    got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)
    assert got == sorted(plain(rows, least, 60))
    assert len(got) > 40


def test_shares_and_shorter_phrases(spark, rows):
    frame = spark.createDataFrame([(k, t, g, 1, "p") for k, (t, g) in enumerate(rows)], SCHEMA)
    for depth, share in ((2, 100), (4, 60)):
        found = collocations.collocations(frame, least=30, rows=50, depth=depth, share=share).collect()
        assert sorted(tuple(r) for r in found) == sorted(plain(rows, 30, 50, share, depth))


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA)).count() == 0


def test_exact_beyond_64_bits(spark):
    """Products of counts that pass 64 bits: the scoring as it stands in the query, over large counts."""
    a, n, left, right = 10**12 + 7, 10**13 + 1, 3 * 10**12 + 1, 10**12 + 9
    row = spark.range(1).selectExpr(f"{a}L a", f"{n}L n", f"{left}L l", f"{right}L r")
    assert collocations.scored(row).first().score == 1000 * a * n // (left * right)


def test_intervals():
    """Every interval holds exactly the suffixes that begin with the phrase, in both indexes."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 300).astype(np.int32)
    index = collocations.PhraseIndex(ids, 5)
    want = Counter()
    for k in range(1, 6):
        for i in range(len(ids) - k + 1):
            if (ids[i : i + k] > 0).all():
                want[tuple(ids[i : i + k].tolist())] += 1
    got = Counter()
    for phrase, counts in index.phrases(1, 5):
        for p, n in zip(phrase.tolist(), counts.tolist(), strict=True):
            got[tuple(p)] += n
    assert got == want
    found = index.words()
    for step in (index.right, index.left, index.left, index.right):
        found = step(*found)
    back = index.ids[::-1]
    for begin, other, n in zip(*found, strict=True):
        forward = {tuple(index.ids[i : i + 5].tolist()) for i in index.order[begin : begin + n]}
        backward = {tuple(back[i : i + 5].tolist()[::-1]) for i in index.reverse[0][other : other + n]}
        assert forward == backward and len(forward) == 1 and want[forward.pop()] == n
