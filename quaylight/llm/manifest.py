"""A Merkle manifest of a dataset: every row a leaf, one tree per group, one tree over the groups' roots.

Rows are numbered within their group by one range partitioning. Aligned blocks of leaves are then
appended, in order, to frontiers of open subtrees in the tasks: a node that completes takes the digests of
its left siblings as its partial witness, and each sibling that completes later extends it on the right. A
full run closes into its parent, which is appended one level up and takes its part of the witness there, so
a witness is kept once per subtree and not once per leaf. A block's root is again a node: block roots are
appended in blocks of their own, level by level, until one per group is left, and the groups' roots likewise.
What reaches a block from above is one row (its upper witness), however many leaves it holds; a second pass
over the leaves joins both parts. No task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.shared import discard, shuffle_partitions, stored

#: Nodes of a run, and the levels of a block: 4096 leaves.
RUN, LEVELS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Steps = tuple[tuple[bytes, bytes], ...]


def joined_digest(parts: bytes) -> bytes:
    """H of digests that are written one after the other, as hex text."""
    return sha256(parts).hexdigest().encode()


@dataclass(slots=True)
class Node:
    """A completed subtree: its digest, the witness so far within its run, and what it was made of."""

    digest: bytes
    left: bytes = b""
    right: bytearray = field(default_factory=bytearray)
    below: list[Node] = field(default_factory=list)
    row: tuple | None = None


class Frontier:
    """Open runs, one per level; nodes are appended in order."""

    def __init__(self) -> None:
        self.open: list[list[Node]] = [[]]

    def append(self, node: Node, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for sibling in run:
            sibling.right += node.digest
        node.left = b"".join(s.digest for s in run)
        run.append(node)
        if len(run) == RUN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.append(Node(joined_digest(b"".join(n.digest for n in run)), below=run), level + 1)

    def finish(self, levels: int | None) -> Node:
        """Closes all open runs up to ``levels``, or until one node is left; gives that node."""
        level = 0
        while level < levels if levels is not None else len(self.open[level]) != 1 or any(self.open[level + 1 :]):
            if self.open[level]:
                self._close(level)
            level += 1
        (root,) = self.open[level]
        return root


def witnesses(node: Node, upper: Steps = ()) -> Iterator[tuple[Node, Steps]]:
    """What was appended below ``node``, each with its siblings (left, right) from the lowest level up."""
    if not node.below:
        yield node, upper
    for child in node.below:
        yield from witnesses(child, ((child.left, bytes(child.right)), *upper))


def folded(digest: bytes, steps: Steps) -> bytes:
    """The root that a digest and its siblings give."""
    for left, right in steps:
        digest = joined_digest(left + digest + right)
    return digest


def _written(steps: Steps) -> str:
    return "".join(f"{left.decode()}|{right.decode()};" for left, right in steps)


def _read(text: str) -> Steps:
    parts = (step.split("|") for step in text.split(";")[:-1])
    return tuple((left.encode(), right.encode()) for left, right in parts)


def leaf_digest(docs: DataFrame, columns: list[str], **other: Column) -> Column:
    """H of the columns' values in order: ``-`` if null, else byte count, ``:`` and the value as text."""
    texts = [(other.get(c, docs[c])).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank``, their number from 0 within ``tree`` by ``order``; nulls come first.

    One range partitioning; a task numbers what it holds, and the driver gets one row per partition whose
    first tree begins in an earlier one, so at most as many as there are partitions.
    """
    sort = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = nodes.repartitionByRange(shuffle_partitions(nodes.sparkSession), *sort).sortWithinPartitions(*sort)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tree, begun, trees, at = TaskContext.get().partitionId(), None, False, 0, 0
        for batch in batches:
            places, leads = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for k, t in enumerate(batch.column("tree").to_pylist()):
                if begun and t != tree:
                    trees, at = trees + 1, 0
                begun, tree = True, t
                places[k], leads[k] = at, trees == 0
                at += 1
            extra = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(places), pa.array(leads)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "__part", "__at", "__lead"])

    local = stored(ranged.mapInArrow(task, f"{kinds}, __part int, __at bigint, __lead boolean"), "manifest-order")
    counts = local.groupBy("tree", "__part", "__lead").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = {r["__part"]: r.n for r in counts.withColumn("n", F.sum("n").over(before)).where("__lead and n > 0").collect()}
    offsets = F.lit(np.array([ahead.get(p, 0) for p in range(max(ahead, default=0) + 1)], np.int64))
    offset = F.when(F.col("__lead"), F.coalesce(F.get(offsets, F.col("__part")), F.lit(0))).otherwise(0)
    return local.select(*nodes.columns, (F.col("__at") + offset).alias("rank"))


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    """Whole blocks in tasks, each block's rows in order."""
    blocked = nodes.withColumn("block", F.expr(f"rank div {RUN**levels}") if "block" not in nodes.columns else F.col("block"))
    return blocked.repartition(shuffle_partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "rank")


def _finished(frontier: Frontier, block: int, rows: int, levels: int) -> Node:
    """A block's root. Block 0 is a tree of its own if it is not full; all others reach the common height."""
    return frontier.finish(None if block == 0 and rows < RUN**levels else levels)


def _blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[tuple, Frontier, int]]:
    """((tree, block), frontier, rows) of each block in turn; rows have tree, block, rank and digest."""
    frontier, at, rows = Frontier(), None, 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("tree", "block", "rank", "digest"))
        for tree, block, rank, digest in zip(*columns, strict=True):
            if rank % RUN**levels == 0 and rows:
                yield at, frontier, rows
                frontier, rows = Frontier(), 0
            at, rows = (tree, block), rows + 1
            frontier.append(Node(digest.hex().encode(), row=(rank,)))
    if rows:
        yield at, frontier, rows


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """One node per block of ``nodes`` (tree, rank, digest), one level of blocks up."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), frontier, rows in _blocks(batches, levels):
            root = _finished(frontier, block, rows, levels)
            yield _batch([(tree, block, bytes.fromhex(root.digest.decode()))], ("tree", "rank", "digest"), (pa.string(), pa.int64(), pa.binary()))

    return _dealt(nodes.select("tree", "rank", "digest"), levels).mapInArrow(task, "tree string, rank bigint, digest binary")


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _forest(nodes: DataFrame, levels: int) -> DataFrame:
    """Roots and witnesses of ``nodes`` (tree, rank, digest): tree, rank, root, witness."""
    names, kinds = ("tree", "rank", "block", "root", "witness"), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), frontier, rows in _blocks(batches, levels):
            root = _finished(frontier, block, rows, levels)
            digest = bytes.fromhex(root.digest.decode())
            yield _batch([(tree, node.row[0], block, digest, _written(steps)) for node, steps in witnesses(root)], names, kinds)

    level = stored(_dealt(nodes, levels).mapInArrow(task, "tree string, rank bigint, block bigint, root binary, witness string"), "manifest-level")
    tops = level.where(F.col("rank") % RUN**levels == 0).select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"))
    if (tops.agg(F.max("rank")).first()[0] or 0) == 0:
        return level.drop("block")
    upper = _forest(tops, levels).select(F.col("tree").alias("__tree"), F.col("rank").alias("__block"), F.col("root").alias("__root"), F.col("witness").alias("__upper"))
    joined = level.join(upper, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")))
    return joined.select("tree", "rank", F.col("__root").alias("root"), F.concat("witness", "__upper").alias("witness"))


def manifest(docs: DataFrame, tree: str = "source", key: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` (the key as bigint), ``leaf``, ``subroot``, ``root``,
    ``proof`` (with ``proofs``: the siblings from the leaf up, each step ``left|right;``), ``proof_sha256``,
    ``folded_root`` and ``verified``.

    Leaves of a tree ascend by key and then by digest, so repeated rows and keys have a defined order; nulls
    come first, in trees as in keys, and a null in a column is a value of its own. ``altered`` is the digest
    of a changed row, null where nothing changed: it is folded in place of the leaf, with the siblings as they
    were. Columns that are not named take no part, whatever their names. A lone row is its own subroot and root,
    with an empty proof; the empty table gives the empty table. A block has ``levels`` levels of runs.
    """
    digest = leaf_digest(docs, list(columns))
    changed = F.lit(None).cast("string") if altered is None else altered
    rows = docs.select(
        docs[tree].cast("string").alias("tree"), docs[key].cast("bigint").alias("doc_id"), F.unhex(digest).alias("digest"), F.unhex(changed).alias("altered")
    )
    # Texts are read and hashed once; from here on only digests move.
    made = stored(rows, "manifest-leaves")
    leaves = stored(numbered(made, ["doc_id", "digest", "altered"]), "manifest-numbered")
    upper = stored(_forest(stored(_roots(leaves, levels), "manifest-roots"), levels), "manifest-upper")
    trees = upper.where("rank = 0").select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    ordered = stored(numbered(trees, ["name"]), "manifest-trees")
    tops = _forest(ordered.select("tree", "rank", "digest"), levels).select("rank", F.col("root").alias("top"), F.col("witness").alias("above"))
    named = ordered.select("name", "rank").join(tops, "rank").select("name", "top", "above")
    heads = upper.join(named, F.col("tree").eqNullSafe(F.col("name"))).select(
        "tree", F.col("rank").alias("block"), F.lit(-1).cast("bigint").alias("rank"), F.col("root").alias("digest"), "top", F.concat("witness", "above").alias("above")
    )
    rows = leaves.withColumn("block", F.expr(f"rank div {RUN**levels}")).unionByName(heads, allowMissingColumns=True)
    discard(made)
    return _dealt(rows.select("tree", "block", "rank", "doc_id", "digest", "altered", "top", "above"), levels).mapInArrow(partial(_proofs, proofs, levels), PROOFS)


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(written: bool, levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of blocks: a head row (rank -1, with what lies above the block), then the block's leaves."""
    names = tuple(part.split()[0] for part in PROOFS.split(", "))
    kinds = (pa.int64(), *[pa.string()] * 6, pa.bool_())
    frontier, head, rows = Frontier(), None, 0

    def done() -> pa.RecordBatch:
        block, subroot, root, above = head
        out = []
        text = b"".join(left + right for left, right in above)
        for node, steps in witnesses(_finished(frontier, block, rows, levels)):
            doc, altered = node.row
            fold = folded(altered or node.digest, steps + above).decode()
            proof = b"".join(left + right for left, right in steps) + text
            out.append((doc, node.digest.decode(), subroot, root, _written(steps + above) if written else None, sha256(proof).hexdigest(), fold, fold == root))
        return _batch(out, names, kinds)

    columns = ("block", "rank", "doc_id", "digest", "altered", "top", "above")
    for batch in batches:
        for block, rank, doc, digest, altered, top, above in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if rank < 0:
                if rows:
                    yield done()
                frontier, head, rows = Frontier(), (block, digest.hex(), top.hex(), _read(above)), 0
            else:
                frontier.append(Node(digest.hex().encode(), row=(doc, altered and altered.hex().encode())))
                rows += 1
    if rows:
        yield done()


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else unchanged."""
    return F.translate(text, UPPER, LOWER)
