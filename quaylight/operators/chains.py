"""Chains along range-partitioned rows: what is kept depends on the last kept before, over any number of tasks.

A sight is kept if it is more than ``width`` after its key's last kept one. What a partition does to its first
key is a map, "last kept on entry gives last kept on exit"; to a key that begins in it the exit is a constant.
Maps of neighbouring partitions compose into the map of both, so exits are found by composing maps in groups,
level by level, and entries by evaluating them from the top down. Each row is then visited once, in order,
with its partition's entry known. A map is a step function with at most one step per distinct sight of one
key within one ``width`` (steps that give the same exit are one): that, not the key, is what a task must hold.
The driver holds one entry per partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.session import cut_lineage

#: Maps that one task composes.
GROUP = 16

_MAPS = "part int, first string, last string, fixed bigint, begin bigint, limits binary, exits binary"
_ENTRIES = "part int, name string, entry bigint"


@dataclass
class Span:
    """What a run of partitions does: to its last key, given the last kept sight of its first key on entry.

    Either ``fixed`` (the exit does not depend on the entry) or, where all rows are of one key, a step
    function: an entry whose end, ``entry + width``, lies below ``limits[i]`` and not below ``limits[i - 1]``
    gives ``exits[i]``; beyond the last limit no sight is kept and the entry is the exit.
    """

    first: str
    last: str
    fixed: int | None
    begin: int
    limits: np.ndarray
    exits: np.ndarray

    def after(self, entry: int | None, width: int) -> int | None:
        if self.fixed is not None:
            return self.fixed
        if entry is None:
            return int(self.exits[0])
        at = int(np.searchsorted(self.limits, entry + width, side="right"))
        return int(self.exits[at]) if at < len(self.exits) else entry

    def then(self, other: Span, width: int) -> Span:
        """Both spans in a row."""
        if self.last != other.first:
            return Span(self.first, other.last, other.after(None, width), self.begin, *_NOTHING)
        if other.fixed is not None:
            return Span(self.first, other.last, other.fixed, self.begin, *_NOTHING)
        if self.fixed is not None:
            return Span(self.first, other.last, other.after(self.fixed, width), self.begin, *_NOTHING)
        at = np.searchsorted(other.limits, self.exits + width, side="right")
        through = np.append(other.exits, 0)[at]
        through = np.where(at < len(other.exits), through, self.exits)
        limits, exits = np.concatenate([self.limits, other.limits]), np.concatenate([through, other.exits])
        return Span(self.first, other.last, None, self.begin, *_steps(limits, exits, self.begin + width))


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _steps(limits: np.ndarray, exits: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps that an entry before ``end - width`` can reach, neighbours with one exit as one."""
    n = min(len(limits), int(np.searchsorted(limits, end, side="left")) + 1)
    limits, exits = limits[:n], exits[:n]
    last = np.append(exits[1:] != exits[:-1], True)
    return limits[last], exits[last]


def exits_of(times: np.ndarray, width: int) -> np.ndarray:
    """For each sight, the last one kept if it is kept itself: successors are followed in doubled strides."""
    after = np.searchsorted(times, times + width, side="right")
    jump = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return times[jump]
        jump = further


def _span(names: list[str], times: np.ndarray, width: int, whole: bool) -> Span:
    """The span of a partition: of its only key's times, or of its last key's when it has several."""
    exits = exits_of(times, width)
    if whole:
        return Span(names[0], names[1], None, int(times[0]), *_steps(times, exits, int(times[0]) + width))
    return Span(names[0], names[1], int(exits[0]), int(times[0]), *_NOTHING)


def _written(part: int, span: Span) -> dict[str, list]:
    return {
        "part": [part], "first": [span.first], "last": [span.last], "fixed": [span.fixed], "begin": [span.begin],
        "limits": [span.limits.astype(np.int64).tobytes()], "exits": [span.exits.astype(np.int64).tobytes()],
    }


_MAP_TYPES = pa.schema(
    [("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("fixed", pa.int64()), ("begin", pa.int64()), ("limits", pa.binary()), ("exits", pa.binary())]
)


def _read(maps: pa.Table) -> list[tuple[int, Span]]:
    rows = sorted(maps.to_pylist(), key=lambda r: r["part"])
    return [
        (r["part"], Span(r["first"], r["last"], r["fixed"], r["begin"], np.frombuffer(r["limits"], np.int64), np.frombuffer(r["exits"], np.int64)))
        for r in rows
    ]


def _maps(rows: DataFrame, name: str, t: str, width: int) -> DataFrame:
    """One span per partition that has rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        held: list[np.ndarray] = []  # times of the last key so far
        keys = 0
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes, times = names.indices.to_numpy(), batch.column(1).to_numpy()
            if not len(codes):
                continue
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            head, tail = names.dictionary[codes[0]].as_py(), names.dictionary[codes[-1]].as_py()
            if keys == 0:
                first, keys = head, len(begins)
            else:
                keys += len(begins) - (head == last)
            if head != last or len(begins) > 1:
                held = []
            held.append(times[begins[-1] :])
            last = tail
        if keys:
            span = _span([first, last], np.concatenate(held), width, keys == 1)
            yield pa.RecordBatch.from_pydict(_written(TaskContext.get().partitionId(), span), schema=_MAP_TYPES)

    return rows.select(name, t).mapInArrow(task, _MAPS)


def _composed(maps: DataFrame, width: int) -> DataFrame:
    """One span per group of neighbours, numbered by group."""

    def compose(group: pa.Table) -> pa.Table:
        spans = _read(group)
        out = spans[0][1]
        for _, span in spans[1:]:
            out = out.then(span, width)
        return pa.Table.from_pydict(_written(spans[0][0] // GROUP, out), schema=_MAP_TYPES)

    return maps.groupBy(F.expr(f"part div {GROUP}")).applyInArrow(compose, _MAPS)


def _entries(maps: DataFrame, above: dict[int, tuple[str, int]], width: int) -> dict[int, tuple[str, int]]:
    """The entry (key, last kept) of each partition whose first key begins earlier, given those of the groups."""

    def evaluate(group: pa.Table) -> pa.Table:
        spans = _read(group)
        state = above.get(spans[0][0] // GROUP)
        out: dict[str, list] = {"part": [], "name": [], "entry": []}
        for part, span in spans:
            entry = state[1] if state is not None and state[0] == span.first else None
            if entry is not None:
                out["part"].append(part)
                out["name"].append(span.first)
                out["entry"].append(entry)
            state = (span.last, span.after(entry, width))
        return pa.Table.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("entry", pa.int64())]))

    rows = maps.groupBy(F.expr(f"part div {GROUP}")).applyInArrow(evaluate, _ENTRIES).collect()
    return {r.part: (r.name, r.entry) for r in rows}


def kept_sights(rows: DataFrame, name: str, t: str, width: int) -> DataFrame:
    """The rows of ``rows`` that are kept: first of their ``name``, or more than ``width`` after the last kept.

    ``rows`` are distinct in (name, t), range partitioned and sorted by them, and materialised, so that each
    partition is the same whenever it is read. ``name`` and ``t`` (a whole number) have no nulls.
    """
    levels = [cut_lineage(_maps(rows, name, t, width))]
    size = rows.rdd.getNumPartitions()
    while size > GROUP:
        levels.append(cut_lineage(_composed(levels[-1], width)))
        size = -(-size // GROUP)
    entries: dict[int, tuple[str, int]] = {}
    for maps in reversed(levels):
        entries = _entries(maps, entries, width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = entries.get(TaskContext.get().partitionId(), (None, None))
        for batch in batches:
            kept = []
            for i, (k, at) in enumerate(zip(batch.column(name).to_pylist(), batch.column(t).to_pylist(), strict=True)):
                if k != key or at - last > width:
                    key, last = k, at
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(task, rows.schema)
