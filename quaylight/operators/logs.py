"""Log entries: conversion, labels, streams, selection and range aggregates.

Range aggregates are evaluated on a grid: the value at time t covers ``(t - range, t]``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions import payload as js
from quaylight.functions import times
from quaylight.functions.text import strip, whole_match
from quaylight.operators.series import (
    batches, joined_on, label_key, per_step, sliding, spread, steps_of, time_grid, with_eval_time,
)
from quaylight.schema import col, present
from quaylight.session import cut_lineage

DEFAULT_LABELS = {"service": "edge", "source": "central"}


def safe_label(c: Column) -> Column:
    """Trimmed value with every other character than letters, digits and ``-_.`` replaced."""
    text = strip(c.cast("string"))
    usable = (F.length(text) > 0) & (F.length(text) <= fixed.MAX_LABEL_LENGTH)
    return F.when(usable, F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_"))


def _own_labels(df: DataFrame, promote_tags: bool) -> list[tuple[str, Column]]:
    found = [(n, safe_label(col(n))) for n in present(df, fixed.SAFE_LABELS)]
    if promote_tags and "tags" in df.columns:
        named = dict(found)
        for label, tag in (("site", "site"), ("env", "environment")):
            value = safe_label(F.col("tags")[tag])
            named[label] = F.coalesce(named[label], value) if label in named else value
        found = list(named.items())
    return found


def labels_of(
    df: DataFrame,
    defaults: Mapping[str, str] = DEFAULT_LABELS,
    promote_tags: bool = False,
) -> Column:
    """Map of the safe labels present on a row, plus defaults for the ones that must exist."""
    found = dict(_own_labels(df, promote_tags))
    if "source" in found:
        found["source"] = F.when(~found["source"].isin("None", "null"), found["source"])
    for key, value in defaults.items():
        found[key] = F.coalesce(found[key], F.lit(value)) if key in found else F.lit(value)
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def entry_time_ns(df: DataFrame, as_of: Column, fields=fixed.LOG_TIME_FIELDS) -> Column:
    """Nanoseconds since the epoch of the first parseable time field."""
    types = {f.name: f.dataType for f in df.schema}
    found = [times.any_time(col(f), types[f]) for f in present(df, fields)]
    return F.unix_micros(F.coalesce(*found, as_of)) * 1000


def to_entries(
    df: DataFrame,
    as_of: Column,
    defaults: Mapping[str, str] = DEFAULT_LABELS,
    promote_tags: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(ts_ns, line, labels) rows: the line is the message and the JSON of all unlabelled fields."""
    with_labels = df.withColumn("__labels", labels_of(df, defaults, promote_tags))
    rest = []
    for name in df.columns:
        if name.startswith("_") or name == "message" or name in keep:
            continue
        c = col(name)
        if name in fixed.SAFE_LABELS:
            c = F.when(~F.map_contains_key("__labels", name), c)
        rest.append(c.alias(name))
    extra = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    message = col("message") if "message" in df.columns else F.lit(None).cast("string")
    line = F.when(
        message.isNotNull(), F.concat_ws(" ", message, F.nullif(extra, F.lit("{}")))
    ).otherwise(extra)
    return with_labels.select(
        *keep,
        entry_time_ns(df, as_of).alias("ts_ns"),
        line.alias("line"),
        F.col("__labels").alias("labels"),
    )


def group_streams(
    entries: DataFrame, id_col: str, batch_size: int = 100
) -> DataFrame:
    """Push batches: ``batch_size`` entries in arrival order, grouped by label set, sorted by time.

    A group never holds more than one batch, however common its label set is.
    """
    value = F.struct("ts_ns", col(id_col).alias("id"), "line")
    return (
        batches(entries, id_col, batch_size)
        .groupBy("batch_no", label_key(F.col("labels")).alias("stream"))
        .agg(F.sort_array(F.collect_list(value)).alias("sorted"))
        .select(
            "batch_no",
            "stream",
            F.transform(
                "sorted", lambda v: F.struct(v["ts_ns"].alias("ts_ns"), v["line"].alias("line"))
            ).alias("values"),
        )
    )


def write_log_store(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Sorted by label set and time inside each file: a stream is a run, selective scans skip.

    A hot stream is split over several files by adaptive execution.
    """
    (
        entries.withColumn("stream", label_key(F.col("labels")))
        .hint("rebalance", "stream")
        .sortWithinPartitions("stream", "ts_ns")
        .write.mode(mode)
        .parquet(path)
    )


# ---- selection -------------------------------------------------------------------------------


def label(df: DataFrame, name: str) -> Column:
    """A label as a column: a promoted column when the table has one, else the map entry."""
    return col(name) if name in df.columns else F.col("labels")[name]


def select_streams(df: DataFrame, **matchers: str | tuple[str, str]) -> DataFrame:
    """Stream selection. A value means equality; ``("=~", re)``, ``("!=", v)``, ``("!~", re)`` are
    the other matchers. Patterns match whole values; a missing label counts as empty text."""
    for name, want in matchers.items():
        op, value = want if isinstance(want, tuple) else ("=", want)
        c = label(df, name)
        if op == "=" and value:
            df = df.where(c == value)
            continue
        c = F.coalesce(c, F.lit(""))
        if op == "=":
            df = df.where(c == value)
        elif op == "!=":
            df = df.where(c != value)
        elif op == "=~":
            df = df.where(whole_match(c, value))
        elif op == "!~":
            df = df.where(~whole_match(c, value))
        else:
            raise ValueError(f"unknown matcher {op}")
    return df


def filter_lines(df: DataFrame, *filters: tuple[str, str], line: str = "line") -> DataFrame:
    """Line filters: ``|=`` contains, ``!=`` lacks, ``|~`` finds a pattern, ``!~`` does not."""
    c = col(line)
    for op, text in filters:
        if op == "|=":
            df = df.where(c.contains(text))
        elif op == "!=":
            df = df.where(~c.contains(text))
        elif op == "|~":
            df = df.where(c.rlike(text))
        elif op == "!~":
            df = df.where(~c.rlike(text))
        else:
            raise ValueError(f"unknown line filter {op}")
    return df


def json_stage(df: DataFrame, fields: Sequence[str], line: str = "line") -> DataFrame:
    """Lift fields of a JSON line to text columns; a line that is not JSON gives nulls."""
    out = df.withColumn("__doc", js.as_variant(col(line)))
    return out.withColumns(
        {f: F.try_variant_get(F.col("__doc"), js._key(f), "string") for f in fields}
    ).drop("__doc")


def field_not_empty(df: DataFrame, field: str) -> DataFrame:
    return df.where(F.coalesce(col(field), F.lit("")) != "")


def range_select(df: DataFrame, at: str, range_seconds: int, ts: str = "ts") -> DataFrame:
    """Lines in ``(at - range, at]``."""
    end = F.lit(at).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(range_seconds)} SECONDS")
    return df.where((col(ts) > start) & (col(ts) <= end))


# ---- range aggregates ------------------------------------------------------------------------


def _grouped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    missing = {b: label(df, b) for b in by if b not in df.columns}
    return df.withColumns(missing) if missing else df


def count_over_time(
    df: DataFrame, range_seconds: int, by: Sequence[str] = (), step_seconds: int | None = None
) -> DataFrame:
    """Lines per range and label values. Cells of one step are counted first, ranges are put together from cells."""
    step = step_seconds or range_seconds
    cells = per_step(_grouped(df, by), by, step, [F.count("*").alias("n")])
    out = sliding(cells, by, steps_of(range_seconds, step), {"n": "sum"})
    return with_eval_time(out.withColumnRenamed("n", "count"), step)


def log_rate(
    df: DataFrame, range_seconds: int, by: Sequence[str] = (), step_seconds: int | None = None
) -> DataFrame:
    """Lines per second."""
    counts = count_over_time(df, range_seconds, by, step_seconds)
    return counts.withColumn("rate", F.col("count") / F.lit(float(range_seconds))).drop("count")


def top_k(df: DataFrame, k: int, value: str, window: str, tie: Sequence[str]) -> DataFrame:
    """The ``k`` largest values per evaluation time.

    The rank filter is pushed below the shuffle, so a task sends at most ``k`` rows per window.
    """
    order = Window.partitionBy(window).orderBy(F.col(value).desc(), *tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantile_over_time(
    df: DataFrame,
    q: float,
    value: str,
    range_seconds: int,
    by: Sequence[str] = (),
    step_seconds: int | None = None,
    most: int = 10_000,
) -> DataFrame:
    """Exact interpolated quantile of a numeric column per range and label values, at every step.

    Equal values are counted before the shuffle, and those counts serve every range that covers their step.
    Counts are ordered by refinement: magnitude bins tell the bin of each wanted rank, bins with more than ``most``
    values are cut into equal parts of their span, and so on, so no task orders more than ``most`` values of a group
    (values closer than a double can tell are equal). Missing labels are a group of their own; infinities and NaN
    are values above (or below) all others.
    """
    step = step_seconds or range_seconds
    keys = [*by, "step"]
    rows = _grouped(df, by).where(col(value).isNotNull())
    cells = rows.groupBy(
        *by, times.step_number(F.col("ts"), step).alias("step"), col(value).cast("double").alias("v")
    ).agg(F.count("*").alias("n"))
    if range_seconds != step:
        spent = spread(cells, "step", steps_of(range_seconds, step))
        cells = spent.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    picked = _around_rank(cells, keys, q, most)
    inside = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    last = F.col("first") + F.col("n") - 1

    def at(position: str) -> Column:
        return F.max(F.when(F.col(position).between(F.col("first"), last), F.col("v")))

    frac = F.max(F.lit(q) * (F.col("total") - 1) - F.col("lo"))
    out = picked.groupBy(*keys).agg(at("lo").alias("a"), at("hi").alias("b"), frac.alias("f"))
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    out = out.withColumn("quantile", F.when((F.col("a") == F.col("b")) | (F.col("f") == 0), F.col("a")).otherwise(between))
    return with_eval_time(out.drop("a", "b", "f"), step)


#: Parts of a bin that holds too many values.
_PARTS = 1024


def _around_rank(cells: DataFrame, keys: Sequence[str], q: float, most: int) -> DataFrame:
    """The cells (v, n) of the bins that hold the ranks around ``q``: with ``bin``, the number of values ``before`` it,
    the group's ``total`` and the two ranks ``lo`` and ``hi``."""
    endless = F.isnan("v") | (F.abs("v") == float("inf"))
    finite = F.when(~endless, F.floor(F.log2(F.abs("v")) * 64).cast("bigint") + F.lit(100_000))
    size = F.coalesce(finite, F.when(F.isnan("v"), F.lit(1 << 41)), F.lit(1 << 40))
    magnitude = F.when(F.col("v") > 0, size).when(F.col("v") < 0, -size).otherwise(F.lit(0))
    cells = cut_lineage(cells.withColumn("bin", F.struct(magnitude.alias("m"))))
    sums = [F.sum("n").alias("bn"), F.count(F.lit(1)).alias("values"), F.min("v").alias("low"), F.max("v").alias("high")]
    rank = F.lit(q) * (F.col("total") - 1)
    bins = cells.groupBy(*keys, "bin").agg(*sums).withColumns({"base": F.lit(0).cast("bigint"), "total": F.sum("bn").over(Window.partitionBy(*keys))})
    bins = bins.withColumns({"lo": F.floor(rank), "hi": F.ceil(rank)})
    while True:
        along = Window.partitionBy(*keys, "base").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("base") + F.coalesce(F.sum("bn").over(along), F.lit(0)))
        upto = F.col("before") + F.col("bn") - 1
        wanted = cut_lineage(bins.where(F.col("lo").between(F.col("before"), upto) | F.col("hi").between(F.col("before"), upto)))
        large = (F.col("values") > most) & (F.col("low") < F.col("high"))
        picked = joined_on(cells.select(*keys, "v", "n", "bin"), wanted.drop("base", "bn"), [*keys, "bin"])
        if wanted.where(large).isEmpty():
            return picked
        part = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * _PARTS)
        part = F.when(large, F.least(part, F.lit(_PARTS - 1))).otherwise(F.lit(0))
        finer = F.struct("bin", part.cast("bigint").alias("part"))
        cells = cut_lineage(picked.select(*keys, "v", "n", finer.alias("bin"), F.col("before").alias("base"), "total", "lo", "hi"))
        bins = cells.groupBy(*keys, "bin", "base", "total", "lo", "hi").agg(*sums)


def absent_over_time(
    df: DataFrame, selected: DataFrame, range_seconds: int, step_seconds: int | None = None
) -> DataFrame:
    """Evaluation times of the grid of ``df`` whose range holds no selected line."""
    step = step_seconds or range_seconds
    cells = per_step(selected, [], step, [F.count("*").alias("n")])
    present_steps = sliding(cells, [], steps_of(range_seconds, step), {"n": "sum"}).select("step")
    out = time_grid(df, step).join(present_steps, "step", "left_anti")
    return with_eval_time(out, step).withColumn("absent", F.lit(1))


def label_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(label(df, name).alias("value")).where(F.col("value").isNotNull()).distinct()


def label_names(df: DataFrame) -> DataFrame:
    """Distinct label names; key sets are made distinct before they are exploded."""
    keys = df.select(F.array_sort(F.map_keys("labels")).alias("keys")).distinct()
    return keys.select(F.explode("keys").alias("name")).distinct()
