"""The manifest against a plain tree in Python, over many group sizes, odd rows and repeated rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quaylight.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def layers(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def steps(tree, at):
    for nodes in tree[:-1]:
        low = at // 16 * 16
        yield nodes[low:at], nodes[at + 1 : low + 16]
        at //= 16


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: layers([leaf(r) for r in order[g]]) for g in names}
    top = layers([trees[g][-1][0] for g in names])
    root = top[-1][0]
    out = []
    for k, g in enumerate(names):
        for at, row in enumerate(order[g]):
            path = [*steps(trees[g], at), *steps(top, k)]
            low = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = leaf((*row[:4], low)) if changed else leaf(row)
            for left, right in path:
                value = digest([*left, value, *right])
            out.append((row[0], leaf(row), trees[g][-1][0], root, digest(s for p in path for side in p for s in side), value, value == root))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("rank", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("digest", F.lit(2.5))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf_digest(frame, columns, text=manifest.lowered(frame["text"])))
    got = manifest.manifest(frame, altered=altered, **options).collect()
    return got, sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=repr)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows, ids = [], list(range(sum(sizes.values())))
    rng.shuffle(ids)
    for g, n in sizes.items():
        rows += [(ids.pop(), g, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Ab É", "ab"])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 2, "": 1}, {"a": 16, "b": 17, "c": 15, "d": 256, "é": 257, "Z": 300, None: 33}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_plain_trees(spark, sizes):
    rows = rows_of(sizes)
    assert found(spark, rows)[1] == plain(rows)


def test_many_blocks(spark):
    """Blocks of 16 leaves: three levels of blocks."""
    rows = rows_of({"a": 700, "b": 16, "c": 17, "d": 256, "e": 1, None: 300} | {f"z{k}": 2 for k in range(20)})
    assert found(spark, rows, levels=1)[1] == plain(rows)


def test_more_than_one_full_block(spark):
    rows = rows_of({"hot": 2 * 4096 + 1, "b": 4096, "c": 5})
    assert found(spark, rows)[1] == plain(rows)


def test_repeated_rows_null_ids_and_proofs(spark):
    rows = [(3, "a", "en", 1, "T"), (3, "a", "en", 1, "T"), (3, "a", "de", 1, "T"), (None, "a", None, None, None), (None, "a", None, None, None), (4, None, "x", 2, "y" * 100_000)]
    got, digests = found(spark, rows, proofs=True)
    assert digests == plain(rows)
    for r in got:
        path = [p.split("|") for p in r.proof.split(";")[:-1]]
        assert digest(side for p in path for side in p) == r.proof_sha256
        assert manifest.folded(r.leaf.encode(), tuple((a.encode(), b.encode()) for a, b in path)).decode() == r.root
    assert found(spark, [])[1] == []


def test_partial_witnesses_grow():
    frontier = manifest.Frontier()
    nodes = [manifest.Node(digest([str(k)]).encode(), row=(k,)) for k in range(20)]
    for node in nodes[:3]:
        frontier.append(node)
    assert nodes[0].left == b"" and bytes(nodes[0].right) == nodes[1].digest + nodes[2].digest
    assert nodes[2].left == nodes[0].digest + nodes[1].digest and not nodes[2].right
    for node in nodes[3:]:
        frontier.append(node)
    root = frontier.finish(None)
    for node, path in manifest.witnesses(root):
        assert manifest.folded(node.digest, path) == root.digest
