"""N-gram Jaccard self-join by a grouped prefix join.

A text is the set of its distinct word shingles (as 64-bit hashes). Texts with equal sets are one node; different
sets of one doc_id are nodes of their own, joined to one document at the end. Under
a global order of shingles, rarest first, two sets that are similar enough share a shingle within their
prefixes. That is applied twice:

1. over all texts, on a quarter of the hash space (further shingles only where a set has too few there), to
   find the sets that have any partner in sight: few, since a set's rarest shingles are mostly its own;
2. over those only, on all their shingles, so each set's own shingles fill its prefix first. Sets with equal
   prefixes and sizes form one group; groups are joined on prefix shingles under size and position limits,
   then expanded to members.

Candidates pass an exact bound from shingle counts per hash bin before texts are fetched, and then the exact
test on whole sets. Links are sought in two rounds: first each group with the first group of every list it is
in; then, once linked sets carry one label, only pairs of different labels, met under the sizes that their
positions allow, so that no pair is made only to fall to a limit. A big group of copies so costs one link per
member, not all pairs. No list is cut and no candidate dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.components import components
from quaylight.llm.shared import discard, settle, stored
from quaylight.llm.words import LOWER, mixed, text_parts, text_slices, windows, word_hashes

PERCENT, SHINGLE = 90, 3
CLASSES = 4
BINS = 128


def shingle_sets(column: pa.Array, size: int, values: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle of all its words."""
    for begin, stop in text_slices(column):
        hashes, places = word_hashes(*text_parts(column.slice(begin, stop - begin)), values)
        all_windows = windows(hashes, size)
        for a, b in zip(places.tolist(), places[1:].tolist(), strict=False):
            if b - a >= size:
                yield np.unique(all_windows[a : b - size + 1])
            elif b > a:
                yield np.unique(windows(hashes[a:b], b - a))
            else:
                yield hashes[:0]


def _least(n: Column | int, percent: int):
    """ceil(percent * n / 100)."""
    return (n * percent + 99) / 100 if isinstance(n, Column) else (n * percent + 99) // 100


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


SETS = "doc_id bigint, n bigint, front bigint, high bigint, low bigint"


def _described(docs: DataFrame, size: int) -> DataFrame:
    """Per row: the set's size, its number of front-class shingles and a 128-bit digest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([_digest(s) for s in shingle_sets(batch.column("text"), size)], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T)], names=["doc_id", "n", "front", "high", "low"])

    return docs.mapInArrow(task, SETS)


def _digest(s: np.ndarray) -> tuple[int, int, int, int]:
    high, low = mixed(s + np.uint64(1)).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5555)).sum(dtype=np.uint64)
    return len(s), int((s % np.uint64(CLASSES) == 0).sum()), int(high.astype(np.int64)), int(low.astype(np.int64))


TOKENS = "tok bigint, doc_id bigint"


def _token_rows(docs: DataFrame, size: int, percent: int, front: bool) -> DataFrame:
    """(tok, doc_id): all shingles, or those of the front class and the first others where the prefix is longer."""

    def chosen(s: np.ndarray) -> np.ndarray:
        first = s % np.uint64(CLASSES) == 0
        more = int(_prefix(np.int64(len(s)), percent)) - int(first.sum())
        return np.concatenate([s[first], s[~first][:more]]) if more > 0 else s[first]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            held, owners, total = [], [], 0
            for doc, s in zip(ids, shingle_sets(batch.column("text"), size), strict=True):
                s = chosen(s) if front and len(s) else s
                held.append(s)
                owners.append(np.full(len(s), doc, np.int64))
                total += len(s)
                if total > 1 << 20:
                    yield _tokens(held, owners)
                    held, owners, total = [], [], 0
            yield _tokens(held, owners)
        settle()

    return docs.mapInArrow(task, TOKENS)


def _tokens(held: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    toks = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    docs = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(toks), pa.array(docs)], names=["tok", "doc_id"])


def _shared(tokens: DataFrame) -> DataFrame:
    """Tokens that occur again, with their count; counted before the shuffle, so a common one is no heavy key."""
    common = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return tokens.join(common, "tok")


def _partnered(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Ids of the nodes that share a prefix shingle with another node (first pass)."""
    found = _shared(_token_rows(docs, size, percent, True)).join(nodes, "doc_id")
    front = F.pmod("tok", F.lit(CLASSES)) == 0
    rest = F.when(front, F.lit(0)).otherwise(1)
    entry = F.struct(rest.alias("rest"), F.when(front, F.col("df")).otherwise(0).alias("df"), "tok")
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("list"), F.count(F.when(front, 1)).alias("seen"), F.first("n").alias("n"), F.first("front").alias("front"))
    own = F.col("front") - F.col("seen")
    room = F.greatest(F.col("n") - F.floor(_least(F.col("n"), percent)) + 1 - own, F.lit(0))
    near = F.filter("list", lambda e, i: (e["rest"] == 1) | (i < room))
    return _several(lists.select("doc_id", F.explode(F.transform(near, lambda e: e["tok"])).alias("tok"))).select("doc_id").distinct()


def _several(postings: DataFrame) -> DataFrame:
    """Postings of tokens that more than one node has."""
    lists = postings.groupBy("tok").agg(F.min("doc_id").alias("__a"), F.max("doc_id").alias("__b")).where("__a < __b")
    return postings.join(lists.select("tok"), "tok", "left_semi")


def _postings(texts: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, own, prefix) of the second pass: shared prefix shingles in order, after ``own`` unshared ones."""
    found = _shared(_token_rows(texts, size, percent, False))
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("list"))
    lists = lists.join(nodes, "doc_id")
    own = F.col("n") - F.size("list")
    room = F.greatest(F.col("n") - F.floor(_least(F.col("n"), percent)) + 1 - own, F.lit(0)).cast("int")
    return lists.select("doc_id", "n", own.alias("own"), F.transform(F.slice("list", F.lit(1), room), lambda e: e["tok"]).alias("prefix")).where(F.size("prefix") > 0)


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """Shingle counts per hash bin: their differences bound how much two sets can share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BINS).astype(np.int32).tobytes() for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "bins"])

    return texts.mapInArrow(task, "doc_id bigint, bins binary")


def _bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets can still be similar enough by their bins: an exact upper bound."""
    a = sketches.select(F.col("doc_id").alias("a"), F.col("bins").alias("bins_a"))
    b = sketches.select(F.col("doc_id").alias("b"), F.col("bins").alias("bins_b"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, BINS) for c in ("bins_a", "bins_b"))
                both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                union = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - both
                yield batch.select(["a", "b"]).filter(pa.array(100 * both >= percent * union))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "bins_a", "bins_b").mapInArrow(task, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
        return len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (shingle_sets(batch.column(c), size) for c in ("text_a", "text_b"))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(task, "a bigint, b bigint")


def _compatible(percent: int) -> Column:
    """Size and position limits of two postings of one token."""
    small, big = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    reach = 1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (small * 100 >= big * percent) & (reach * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Sets link when 100 * intersection is at
    least ``percent`` * union; the component is the smallest doc_id that links reach. A null, empty or blank
    text has no shingles and links with nothing, and neither does a row without a doc_id (component null).
    Rows of one doc_id are one document: what any of them links with, it links with.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = stored(_described(rows, shingle), "sets")
    usable = sets.where("doc_id is not null and n > 0")
    same = usable.groupBy("n", "high", "low").agg(F.min("doc_id").alias("node"), F.first("front").alias("front"))
    known = rows.where("doc_id is not null")
    several_sets = _several_sets(sets)
    extra = None if several_sets.isEmpty() else _fresh_nodes(same, several_sets, usable)
    if extra is None:
        nodes = stored(same.select(F.col("node").alias("doc_id"), "n", "front"), "nodes")
    else:
        own = same.join(several_sets.withColumnRenamed("doc_id", "node"), "node", "left_anti").select(F.col("node").alias("doc_id"), "n", "front")
        nodes = stored(own.unionByName(extra.select(F.col("fresh").alias("doc_id"), "n", "front")), "nodes")
        known = known.join(several_sets, "doc_id", "left_anti").unionByName(_renamed(known.join(several_sets, "doc_id", "left_semi"), extra, shingle))
    near = stored(_partnered(known, nodes, shingle, percent), "partnered")
    texts = stored(known.join(near, "doc_id", "left_semi"), "candidate-texts")
    held = stored(_postings(texts, nodes.join(near, "doc_id", "left_semi"), shingle, percent), "prefixes")
    sketches = stored(_sketches(texts, shingle), "sketches")

    digest = F.xxhash64("n", "prefix", F.when(F.col("own") > 0, F.col("doc_id")))
    members = held.withColumn("group", digest)
    lowest = members.groupBy("n", "group").agg(F.min("doc_id").alias("gid"))
    members = stored(members.join(lowest, ["n", "group"]).select("doc_id", "gid", "n", "own", "prefix"), "members")
    postings = members.where("doc_id = gid").select("gid", "n", "own", F.posexplode("prefix").alias("at", "tok"))
    postings = postings.select("tok", "gid", "n", (F.col("own") + F.col("at") + 1).alias("pos"))
    several = postings.groupBy("tok").agg(F.min("gid").alias("__a"), F.max("gid").alias("__b")).where("__a < __b").select("tok")
    postings = stored(postings.join(several, "tok", "left_semi"), "postings")

    # Round 1: every group with the least changed one of each of its lists, every member with its group.
    band = F.floor(F.log("n") / -np.log(percent / 100))
    banded = postings.withColumn("band", band)
    center = banded.groupBy("tok", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("c")).select("tok", "band", F.col("c.gid").alias("gid"), F.col("c.n").alias("n"), F.col("c.pos").alias("pos"))
    stars = banded.alias("x").join(center.alias("y"), (F.col("x.tok") == F.col("y.tok")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.gid") != F.col("y.gid")) & _compatible(percent))
    stars = stars.select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b"))
    inner = members.where("doc_id <> gid").select(F.col("gid").alias("a"), F.col("doc_id").alias("b"))
    first = stored(_checked(stars.unionByName(inner), sketches, texts, shingle, percent), "links")
    labels = components(first)

    # Round 2: pairs of sets with different labels that the lists still allow.
    labelled = stored(members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "gid", F.coalesce("label", "doc_id").alias("label")), "labels")
    owners = labelled.select("gid", "label").distinct()
    labelled_lists = postings.join(owners, "gid")
    open_lists = labelled_lists.groupBy("tok").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("tok")
    pairs = _differing(labelled_lists.join(open_lists, "tok", "left_semi"), percent)
    left = labelled.select(F.col("gid").alias("ga"), F.col("doc_id").alias("a"), F.col("label").alias("la"))
    right = labelled.select(F.col("gid").alias("gb"), F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    crossing = pairs.join(left, ["ga", "la"]).join(right, ["gb", "lb"]).select("a", "b")
    # Inside a group only members of different labels meet: its labels are paired first, then their members.
    owned = owners.select(F.col("gid").alias("ga"), F.col("label").alias("la"))
    apart = owned.join(owned.withColumnRenamed("la", "lb"), "ga").where("la < lb")
    within = apart.join(left, ["ga", "la"]).join(right.withColumnRenamed("gb", "ga"), ["ga", "lb"]).select("a", "b")
    second = _checked(crossing.unionByName(within), sketches, texts, shingle, percent)
    links = stored(first.unionByName(second), "links")
    for spent in (sketches, texts, held, members, postings, labelled):
        discard(spent)
    if extra is not None:
        links = _between_documents(links, extra).unionByName(_of_one_document(usable, same, several_sets))
    found = stored(components(links), "labels")
    named = same.join(found, "node", "left").select("n", "high", "low", F.coalesce("label", "node").alias("component"))
    joined = sets.join(named, ["n", "high", "low"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    if extra is not None:
        # A row of no words has no set; it belongs to its document all the same.
        whole = several_sets.join(found.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("label", "whole")
        joined = joined.join(whole, "doc_id", "left")
        component = F.coalesce("whole", component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _differing(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (ga, la, gb, lb) of groups of different labels that share a token and fit each other by ``_compatible``.

    ``lists`` has a posting per label of each group. A posting's position bounds the sizes it can meet (``most``), and
    two postings fit if each one's size is within the other's bound. So under a pair of sizes every posting that can
    meet one side's size fits all that can meet the other's: they stand in sublists per label, sublists of different
    labels are paired, and only pairs that fit and differ are ever made.
    """
    most = f"(n - pos + 1) * {100 + percent} div {percent} - n"
    lists = lists.select("tok", "gid", "n", "label", F.expr(most).alias("most"))
    sizes = lists.groupBy("tok", "n").agg(F.max("most").alias("most"))
    met = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.n") <= F.col("y.n")) & (F.col("x.n") * 100 >= F.col("y.n") * percent)
    met = met & (F.col("x.most") >= F.col("y.n")) & (F.col("y.most") >= F.col("x.n"))
    pairs = sizes.alias("x").join(sizes.alias("y"), met).select("x.tok", F.col("x.n").alias("small"), F.col("y.n").alias("big"))

    under = ["tok", "small", "big"]
    x = lists.withColumnRenamed("n", "small").join(pairs, ["tok", "small"]).where("most >= big").select(*under, F.col("gid").alias("ga"), F.col("label").alias("la"))
    y = lists.withColumnRenamed("n", "big").join(pairs, ["tok", "big"]).where("most >= small").select(*under, F.col("gid").alias("gb"), F.col("label").alias("lb"))
    # Of equal sizes both sides are the same list: a pair of labels is taken once.
    apart = (F.col("small") < F.col("big")) & (F.col("la") != F.col("lb")) | (F.col("la") < F.col("lb"))
    labels = x.select(*under, "la").distinct().join(y.select(*under, "lb").distinct(), under).where(apart)
    found = labels.join(x, [*under, "la"]).join(y, [*under, "lb"]).where("ga <> gb")
    low = F.col("ga") < F.col("gb")
    return found.select(
        F.least("ga", "gb").alias("ga"), F.when(low, F.col("la")).otherwise(F.col("lb")).alias("la"),
        F.greatest("ga", "gb").alias("gb"), F.when(low, F.col("lb")).otherwise(F.col("la")).alias("lb"),
    ).distinct()


def _several_sets(sets: DataFrame) -> DataFrame:
    """Each doc_id whose rows have different sets."""
    ends = [e for c in ("n", "high", "low") for e in (F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b"))]
    found = sets.where("doc_id is not null").groupBy("doc_id").agg(*ends)
    return stored(found.where("n_a < n_b or high_a < high_b or low_a < low_b").select("doc_id"), "several-sets")


def _fresh_nodes(same: DataFrame, several_sets: DataFrame, usable: DataFrame) -> DataFrame:
    """The sets whose smallest doc_id has several, each with an id of its own (``fresh``) that no document has."""
    owned = same.join(several_sets.withColumnRenamed("doc_id", "node"), "node", "left_semi")
    for salt in count():
        made = stored(owned.withColumn("fresh", F.xxhash64(F.lit(salt), "n", "high", "low")), "fresh-nodes")
        twice = made.groupBy("fresh").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        if twice.isEmpty() and made.join(usable.select(F.col("doc_id").alias("fresh")), "fresh", "left_semi").isEmpty():
            return made
        discard(made)
    raise AssertionError


def _renamed(texts: DataFrame, extra: DataFrame, size: int) -> DataFrame:
    """One row (doc_id, text) for each set of ``extra``, under its fresh id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, _, high, low = np.array([_digest(s) for s in shingle_sets(batch.column("text"), size)], np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (n, high, low))], names=["node", "text", "n", "high", "low"])

    described = texts.select(F.col("doc_id").alias("node"), "text").mapInArrow(task, "node bigint, text string, n bigint, high bigint, low bigint")
    renamed = described.join(extra.drop("front"), ["node", "n", "high", "low"]).select(F.col("fresh").alias("doc_id"), "text")
    return stored(renamed.dropDuplicates(["doc_id"]), "renamed-texts")


def _between_documents(links: DataFrame, extra: DataFrame) -> DataFrame:
    """Links of sets as links of the documents that have them."""
    for side in ("a", "b"):
        owner = extra.select(F.col("fresh").alias(side), F.col("node").alias("owner"))
        links = links.join(owner, side, "left").withColumn(side, F.coalesce("owner", side)).drop("owner")
    return links.select("a", "b")


def _of_one_document(usable: DataFrame, same: DataFrame, several_sets: DataFrame) -> DataFrame:
    """Links of a document of several sets to the smallest document that has one of them."""
    own = usable.join(several_sets, "doc_id", "left_semi").select("doc_id", "n", "high", "low").distinct()
    return own.join(same.select("n", "high", "low", "node"), ["n", "high", "low"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))


def _checked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return _verified(stored(_bounded(distinct, sketches, percent), "pairs"), texts, size, percent).distinct()
