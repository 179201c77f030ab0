"""Shared building blocks for ordered work without one task per key.

A key may hold any share of the rows, so ordered steps are split: rows are first cut into bounded
pieces (an evaluation step, or a range of ids), each piece is reduced by a hash aggregate or
a window over that piece, and only the one-row-per-piece summary is ordered along the whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.times import step_number, step_time
from quaylight.operators import chains
from quaylight.schema import col
from quaylight.session import cut_lineage


def label_key(labels: Column) -> Column:
    """Canonical text of a label map: equal maps give equal text whatever their key order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))


def numbered(
    df: DataFrame, id_col: str, parts: int | None = None, name: str = "row_index"
) -> DataFrame:
    """Number rows 0, 1, 2, ... in the order of any orderable id.

    Rows are range partitioned by the id (in ``parts``, or the session's number), sorted and written to the shared checkpoint folder once. A row's
    number is its place in its partition plus the rows of all partitions before; only one count per partition
    is gathered. Equal ids keep the order they were written in.
    """
    by = [col(id_col)] if parts is None else [parts, col(id_col)]
    ranged = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(col(id_col)))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offset = F.element_at(F.lit(np.array(before or [0], np.int64)), part.cast("int") + 1)
    return placed.withColumn(name, offset + place).drop("__at")


def batches(
    df: DataFrame, id_col: str, size: int = 100, name: str = "batch_no"
) -> DataFrame:
    """Cut rows into batches of exactly ``size`` in id order (the last one may be shorter)."""
    out = numbered(df, id_col)
    index = F.col("row_index")
    return out.withColumn(
        name, F.call_function("div", index, F.lit(size)).cast("bigint")
    ).withColumn("batch_pos", F.pmod(index, F.lit(size)).cast("int")).drop("row_index")


def spread(df: DataFrame, step: str, n: int) -> DataFrame:
    """Repeat each per-step row for the ``n`` evaluation steps whose range covers it."""
    if n == 1:
        return df
    return df.withColumn(step, F.explode(F.sequence(F.col(step), F.col(step) + F.lit(n - 1))))


_JOINED = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max}


def sliding(cells: DataFrame, keys: Sequence[str], n: int, values: Mapping[str, str], step: str = "step") -> DataFrame:
    """``values`` (column: sum, min or max) over the ``n`` steps up to each evaluation step that has a cell in them.

    Cells, one per key and step, are cut into blocks of ``n`` steps. A range meets two blocks: the end of one and
    the beginning of the next, so it is a running value from the block's start joined with one from the other
    block's end; nothing is subtracted, so no digits are lost. A cell becomes at most three rows whatever the range,
    and no key is ordered beyond a block. Steps at which nothing changes are made from the row before them, at the end.
    """
    if n == 1:
        return cells.select(*keys, step, *values)
    at, base = F.col(step), F.col(step) - F.pmod(F.col(step), F.lit(n))
    rows = cells.withColumns({"__base": base, "__n": F.lit(1)})
    kinds = {**values, "__n": "sum"}
    block = [*[col(k) for k in keys], F.col("__base")]
    upto = Window.partitionBy(*block).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*block).orderBy(F.col(step).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*block)

    def over(window: Window) -> Column:
        return F.struct(*[_RUNNING[kind](c).over(window).alias(c) for c, kind in kinds.items()])

    first = F.row_number().over(Window.partitionBy(*block).orderBy(step)) == 1
    rows = rows.select(*keys, step, "__base", over(upto).alias("__upto"), over(after).alias("__after"), over(whole).alias("__whole"), first.alias("__first"))
    following, none = F.col("__base") + n, F.lit(None)
    changes = [
        F.struct(F.col("__base").alias("__base"), at.alias("__pos"), F.col("__upto").alias("__new"), none.alias("__old")),
        F.struct(following.alias("__base"), (at + n).alias("__pos"), none.alias("__new"), F.col("__after").alias("__old")),
        F.when(F.col("__first") & (at > F.col("__base")), F.struct(following.alias("__base"), following.alias("__pos"), none.alias("__new"), F.col("__whole").alias("__old"))),
    ]
    moved = rows.select(*keys, F.explode(F.array_compact(F.array(*changes))).alias("__c")).select(*keys, "__c.*")
    order = Window.partitionBy(*block).orderBy("__pos", F.col("__new").isNull())
    carried = order.rowsBetween(Window.unboundedPreceding, 0)
    state = moved.select(
        *keys,
        "__pos",
        F.coalesce(F.lead("__pos").over(order), F.col("__base") + n).alias("__next"),
        F.last("__new", ignorenulls=True).over(carried).alias("__new"),
        F.last("__old", ignorenulls=True).over(carried).alias("__old"),
    )
    found = {c: _JOINED[kind](F.col("__old")[c], F.col("__new")[c]) for c, kind in kinds.items()}
    live = state.select(*keys, "__pos", "__next", *[v.alias(c) for c, v in found.items()]).where("__next > __pos AND __n > 0")
    return live.select(*keys, F.explode(F.sequence(F.col("__pos"), F.col("__next") - 1)).alias(step), *values)


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on ``on`` where a missing value equals a missing value."""
    keys = right.select(*[col(c).alias(f"__on{i}") for i, c in enumerate(on)]).distinct()
    same = [left[f"`{c}`"].eqNullSafe(keys[f"__on{i}"]) for i, c in enumerate(on)]
    return left.join(keys, reduce(Column.__and__, same), how)


def joined_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner, left or full join on ``on`` where a missing value equals a missing value."""
    named = right.withColumnsRenamed({c: f"__on{i}" for i, c in enumerate(on)})
    same = [left[f"`{c}`"].eqNullSafe(named[f"__on{i}"]) for i, c in enumerate(on)]
    out = left.join(named, reduce(Column.__and__, same), how)
    if how == "full":
        out = out.withColumns({c: F.coalesce(col(c), F.col(f"__on{i}")) for i, c in enumerate(on)})
    return out.drop(*[f"__on{i}" for i in range(len(on))])


def steps_of(range_seconds: int, step_seconds: int) -> int:
    if range_seconds % step_seconds:
        raise ValueError("the range must be a multiple of the step")
    return range_seconds // step_seconds


def per_step(
    df: DataFrame, keys: Sequence[str], step_seconds: int, aggs: Sequence[Column], ts: str = "ts"
) -> DataFrame:
    """Aggregate rows into ``(keys, step)`` cells: partial sums combine before the shuffle."""
    return df.groupBy(*keys, step_number(col(ts), step_seconds).alias("step")).agg(*aggs)


#: Steps made at once: grids are made in two levels, so that no row holds a whole grid.
GRID = 10_000


def steps_between(df: DataFrame, low: Column, high: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Each row's steps from ``low`` to ``high``: first blocks of ``GRID`` steps, then the steps of a block."""
    ends = df.select(*keep, low.alias("__low"), high.alias("__high")).where("__low <= __high")
    part = F.sequence(F.expr(f"__low div {GRID}") - 1, F.expr(f"__high div {GRID}") + 1)
    blocks = ends.withColumn("__block", F.explode(part))
    first = F.greatest(F.col("__low"), F.col("__block") * GRID)
    last = F.least(F.col("__high"), F.col("__block") * GRID + (GRID - 1))
    return blocks.where(first <= last).select(*keep, F.explode(F.sequence(first, last)).alias("step"))


def time_grid(df: DataFrame, step_seconds: int, ts: str = "ts") -> DataFrame:
    """Every evaluation step between the first and the last row; its size is set by time alone."""
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return steps_between(ends, step_number(F.col("lo"), step_seconds), step_number(F.col("hi"), step_seconds))


def with_eval_time(df: DataFrame, step_seconds: int, name: str = "eval_ts") -> DataFrame:
    return df.withColumn(name, step_time(F.col("step"), step_seconds)).drop("step")


def first_sights(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window_seconds: int,
    inclusive: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """``(keys, ts)`` of every first sight of a key, and of each sight more than ``window_seconds``
    after the last kept one (at least that much with ``inclusive``).

    A kept sight is not refreshed by the duplicates it hides, so the rule is a chain, not a gap. Rows without a
    time are in no chain: they are not sights.
    Distinct sights are range partitioned by key and time (into ``parts``, or the session's number) and written
    once, so a key of any size is spread over as many tasks as its rows need; see ``chains``.
    """
    # A struct of the keys compares equal on nulls, which plain join keys do not.
    rows = df.select(F.struct(*[col(k) for k in keys]).alias("key"), F.unix_micros(col(ts)).alias("t"))
    seen = rows.where("t IS NOT NULL").distinct()
    named = seen.withColumn("name", F.to_json("key", {"ignoreNullFields": "false"}))
    by = [F.col("name"), F.col("t")]
    ranged = named.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    width = window_seconds * 1_000_000 - (1 if inclusive else 0)
    kept = chains.kept_sights(cut_lineage(ranged), "name", "t", width)
    return kept.select("key.*", F.timestamp_micros("t").alias(ts))
