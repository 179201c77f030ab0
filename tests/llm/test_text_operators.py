"""Passages, near copies, benchmark hits and packing against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quaylight.llm import decontaminate, jaccard, packing, phrases
from quaylight.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts):
    return [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeated words, odd spaces, nulls, and one very long text."""
    rng = random.Random(3)
    vocabulary = [a + b for a in "ka lo mi ru sé tö Na".split() for b in "ta be no x1 zz".split()]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = line(40), line(160)
    texts = [line(rng.randrange(1, 120)) for _ in range(40)]
    texts += [f"{line(20)}\n{shared}\t{line(15)}" for _ in range(12)]
    for _ in range(15):
        words = base.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = line(1)
        texts.append(" ".join(words))
    texts += [base, base, texts[3], texts[3].upper(), "", None, " \n ", "one", "one two", "one two", "a " * 300, "a " * 50 + "b"]
    texts += ["x\u00a0y\u2003z " * 30, "\x1c".join("abcdefghijklmnop") * 3, line(9000) + " " + shared, base[: len(base) // 2]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def words_of(text):
    return WORD.findall(text or "")


def removed(texts, size=13):
    first = {}
    for d, t in texts:
        w = words_of(t)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in texts:
        w = words_of(t)
        hit = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                hit[i : i + size] = [True] * size
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out[d] = (len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 22, 500])
def test_repeats_match_brute_force(spark, corpus, bucket_bytes):
    found = phrases.repeat_digest(spark.createDataFrame(rows_of(corpus), SCHEMA).repartition(5), bucket_bytes).collect()
    want = removed(corpus)
    assert sum(w[1] for w in want.values()) > 100
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want
    assert len(found) == len(corpus)


def test_repeats_without_ids_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = rows_of([(5, text), (5, text), (None, text), (None, "other " + text), (9, text)])
    found = sorted((r.doc_id or -1, r.n_removed) for r in phrases.repeat_digest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(-1, 20), (-1, 20), (5, 0), (5, 0), (9, 20)]
    assert phrases.repeat_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    lonely = spark.createDataFrame(rows_of([(None, text), (None, text)]), SCHEMA)
    assert [r.n_removed for r in phrases.repeat_digest(lonely).collect()] == [0, 0]


def test_repeats_cut_from_documents(spark, corpus):
    frame = spark.createDataFrame(rows_of(corpus), SCHEMA).withColumn("bucket", F.lit("mine")).withColumn("digest", F.lit(1))
    out = phrases.without_repeats(frame, min_words=1)
    assert out.columns == frame.columns
    want, before = removed(corpus), dict(corpus)
    got = {r.doc_id: r for r in out.collect()}
    for d, (n, k, digest) in want.items():
        if k and k == n:
            assert d not in got
        elif k:
            assert hashlib.sha256(got[d].text.encode()).hexdigest() == digest
            assert got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == before[d] and got[d].bucket == "mine"


def test_hash_windows_agree_with_words():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\x1cé") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "x" * 99]
    hashes, places = phrases.word_hashes(*phrases.text_parts(pa.array(texts)))
    flat = [w for t in texts for w in words_of(t)]
    assert places[-1] == len(flat) == len(hashes)
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) and len(set(known.values())) == len(known)


def shingles(text, size=3):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def linked(texts, percent=90):
    sets = {d: shingles(t) for d, t in texts}
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize("percent", [90, 60])
def test_jaccard_matches_brute_force(spark, corpus, percent):
    frame = spark.createDataFrame(rows_of(corpus), SCHEMA).withColumn("n", F.lit(1)).withColumn("tok", F.lit("x"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame, percent).collect()}
    want = linked(corpus, percent)
    assert len({c for _, c in want.values()}) < len(want) - 5
    assert found == want


def test_jaccard_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = rows_of([(4, text), (4, text), (None, text), (7, text + " more"), (8, ""), (9, None), (2, "a b"), (1, "A  b")])
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(-1, 28, None), (1, 1, 1), (2, 1, 1), (4, 28, 4), (4, 28, 4), (7, 29, 4), (8, 0, 8), (9, 0, 9)]
    assert jaccard.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_links_what_any_text_of_a_doc_id_links_with(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long, short, third, other = text(200), text(40), text(90), text(60)
    rows = [(5, long), (5, short), (5, ""), (9, short + " more"), (12, "first " + long), (20, third), (20, short), (3, third + " end"), (30, other), (31, other), (31, other), (40, text(40)), (None, short)]
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert {d: {c for (e, _), c in found.items() if e == d} for d, _ in rows} == {5: {3}, 9: {3}, 12: {3}, 20: {3}, 3: {3}, 30: {30}, 31: {30}, 40: {40}, None: {None}}


def rows_of_joins(node):
    """The most rows that one join of an executed plan made."""
    name, most = node.nodeName(), 0
    if name == "AdaptiveSparkPlan":
        return rows_of_joins(node.executedPlan())
    if hasattr(node, "plan") and "QueryStage" in name:
        return rows_of_joins(node.plan())
    if "Join" in name:
        most = node.metrics().apply("numOutputRows").value()
    children = node.children()
    return max([most, *(rows_of_joins(children.apply(i)) for i in range(children.size()))])


def test_jaccard_pairs_of_labels_that_no_limit_allows_are_not_made(spark):
    """One shingle in 400 sets of as many labels, too late in each for any pair but those of four sets."""
    rows = [(7, i, 100, 1 if i < 4 else 12, i, i, i) for i in range(400)]
    found = jaccard._differing(spark.createDataFrame(rows, "tok bigint, gid bigint, n bigint, pos bigint, low bigint, high bigint, label bigint"), 90)
    assert {(r.ga, r.gb) for r in found.collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert rows_of_joins(found._jdf.queryExecution().executedPlan()) <= 400


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_jaccard_pairs_are_all_that_fit(spark, percent):
    """Random lists with groups of one and of several labels, against the limits tried on each pair."""
    rng = random.Random(percent)
    size, owner = {g: rng.randrange(20, 28) for g in range(60)}, {g: {rng.randrange(25) for _ in range(rng.choice([1, 1, 3]))} for g in range(60)}
    lists = {tok: {g: rng.randrange(1, size[g] - size[g] * percent // 100 + 2) for g in rng.sample(range(60), 25)} for tok in range(6)}
    rows = [(tok, g, size[g], pos, label) for tok, held in lists.items() for g, pos in held.items() for label in owner[g]]
    want = set()
    for held in lists.values():
        for a, b in combinations(sorted(held), 2):
            n, m = size[a], size[b]
            reach = 1 + min(n - held[a], m - held[b])
            if min(n, m) * 100 >= max(n, m) * percent and reach * (100 + percent) >= (n + m) * percent:
                want |= {(a, la, b, lb) for la in owner[a] for lb in owner[b] if la != lb}
    found = [tuple(r) for r in jaccard._differing(spark.createDataFrame(rows, "tok bigint, gid bigint, n bigint, pos bigint, label bigint"), percent).collect()]
    assert want and len(found) == len(set(found)) and set(found) == want


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits(text, items, window=10):
    w, hit, found = item_words(text), set(), set()
    for item, t in items:
        x = item_words(t)
        n = min(window, len(x))
        for j in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), len(found), decontaminate.items_digest(list(found)), bool(hit)


@pytest.mark.parametrize("shard_words", [1_000_000, 25])
def test_benchmark_hits_match_brute_force(spark, shard_words):
    rng = random.Random(5)
    words = "abel Bär cid dora é9 f g".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 3, 2, 18, 11])]
    items += [(100, ""), (101, None), (102, "..."), (9, items[0][1]), (9, items[0][1])]
    texts = []
    for d in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        x = item_words(rng.choice(items)[1])
        a = rng.randrange(len(x) + 1)
        texts.append((d, f"{t}. {'_'.join(x[a : a + rng.randrange(8, 20)]).upper()}! {t}"))
    texts += [(60, None), (61, ""), (62, "x" * 5000)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).withColumn("items", F.lit("mine"))
    benchmark = spark.createDataFrame([*items, (None, items[1][1])], "item_id bigint, text string")
    found = decontaminate.report(decontaminate.find_benchmark(docs, benchmark, shard_words=shard_words)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {d: hits(t, items) for d, t in texts}
    none = decontaminate.find_benchmark(docs, benchmark.limit(0)).select(F.max(F.size("spans"))).first()[0]
    assert none == 0


def test_benchmark_is_cut(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame(rows_of([(1, f"Keep this, and that too; a b c d e f g h. {item.upper()} Tail…"), (2, item), (3, "clean\ttext"), (4, None)]), SCHEMA)
    out = {r.doc_id: r for r in decontaminate.strip_benchmark(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1].text == "Keep this, and that too; a b c d e f g h.  Tail…" and out[1].n_chars == len(out[1].text)
    assert out[3].text == "clean\ttext" and out[4].text is None


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(100):
        lengths = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(0, 60))}
        runs = packing.sweep(lengths, 40)
        ranks, bins = {}, []
        for run in runs:
            assert sum(n for n, _ in run.held) <= 40
            for n, rank in run.held:
                ranks.setdefault(n, []).extend(range(rank, rank + run.count))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(k)) for n, k in lengths.items()}
        for n in sorted(lengths, reverse=True):
            for _ in range(lengths[n]):
                fits = [b for b in bins if b >= n]
                if fits:
                    bins.remove(min(fits))
                bins.append((min(fits) if fits else 40) - n)
        assert len(bins) == sum(run.count for run in runs)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer())
    texts = [*corpus, (900, "word " * 5000), (901, "don't, it's 'S A\u030angström ǅ ½ <|x|> \u0301a " * 3), (None, "no id"), (902, "same"), (902, "same")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    ids = sorted((d if d is not None else -1, [*coder.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts)
    placed = packing.packed_documents(docs, tokenizer()).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in placed)
    crc = lambda part: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    assert got == sorted((d, k, 2048 * k, len(part := x[2048 * k : 2048 * (k + 1)]), crc(part)) for d, x in ids for k in range(-(-len(x) // 2048)))
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(docs, tokenizer()).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(len(x) for _, x in ids) and len(whole) == len(sequences)
    assert packing.packed_documents(docs.limit(0), tokenizer()).count() == 0
