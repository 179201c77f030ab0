"""Delivery tables: batch keys, duplicate drop, dispositions, envelopes, dead letters, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.fixed import DELIVERY_STATUSES
from quaylight.functions.payload import as_variant
from quaylight.operators.project import sanitise
from quaylight.operators.series import batches, first_sights
from quaylight.schema import col


def batch_keys(
    df: DataFrame,
    id_col: str,
    size: int = 100,
    message: str = "message",
    timestamp: str = "timestamp",
) -> DataFrame:
    """md5 over the sorted message+timestamp texts of each batch of ``size`` rows.

    Batches are cut by number here, so a group is one batch and never grows with the data.
    """
    text = F.concat(
        F.coalesce(col(message).cast("string"), F.lit("")),
        F.coalesce(col(timestamp).cast("string"), F.lit("")),
    )
    return (
        batches(df.select(id_col, text.alias("__text")), id_col, size)
        .groupBy("batch_no")
        .agg(
            F.md5(F.array_join(F.sort_array(F.collect_list("__text")), "")).alias("batch_key"),
            F.count("*").alias("batch_size"),
        )
    )


def drop_repeats(
    df: DataFrame, keys: Sequence[str], ts: str, id_col: str, window_seconds: int = 3600
) -> DataFrame:
    """Rows that survive the windowed duplicate drop; of rows at one instant the lowest id does.

    A row without a time cannot be placed in a window: all of them stay.
    """
    kept = first_sights(df, keys, ts, window_seconds)
    rest = [c for c in df.columns if c not in (*keys, ts)]
    timed = df.where(F.col(ts).isNotNull())
    firsts = timed.groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), id_col).alias("__row"))
    on = [firsts[k].eqNullSafe(kept[k]) for k in keys] + [firsts[ts] == kept[ts]]
    joined = firsts.join(kept, on, "left_semi")
    found = joined.select(*keys, ts, "__row.*").select(*df.columns)
    return found.unionByName(df.where(F.col(ts).isNull()))


def fifo_batch(df: DataFrame, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The ``n`` oldest pending rows."""
    return df.where(F.col("status") == "pending").orderBy(ts, tie).limit(n)


def decoded(df: DataFrame, data: str = "message_data") -> DataFrame:
    """Pending rows whose payload is not JSON become ``failed``."""
    bad = (F.col("status") == "pending") & as_variant(col(data)).isNull()
    return df.withColumn("status", F.when(bad, "failed").otherwise(F.col("status")))


def disposition(
    attempts: DataFrame,
    id_col: str,
    failed: Column,
    order: Sequence[str],
    dead_after: int = 4,
) -> DataFrame:
    """Final state of each message from its attempt log.

    Completed at its first success, dead at its ``dead_after``-th failure, whichever comes first;
    otherwise pending. Only the first ``dead_after`` failures of a message matter, and the rank
    filter is applied before the shuffle, so a message with any number of attempts stays cheap.
    """
    rows = attempts.select(
        id_col, F.struct(*[col(c) for c in order]).alias("at"), failed.alias("failed")
    )
    nth = Window.partitionBy(id_col).orderBy("at")
    failures = (
        rows.where("failed").withColumn("n", F.row_number().over(nth)).where(F.col("n") <= dead_after)
    )
    successes = (
        rows.where("NOT failed").groupBy(id_col).agg(F.min("at").alias("at"))
        .withColumns({"failed": F.lit(False), "n": F.lit(0)})
    )
    seen = failures.unionByName(successes).groupBy(id_col).agg(
        F.min(F.when(~F.col("failed"), F.col("at"))).alias("ok_at"),
        F.min(F.when(F.col("failed") & (F.col("n") == dead_after), F.col("at"))).alias("dead_at"),
        F.sort_array(F.collect_list(F.when(F.col("failed"), F.col("at")))).alias("fails"),
    )
    dead = F.col("dead_at").isNotNull() & (
        F.col("ok_at").isNull() | (F.col("dead_at") < F.col("ok_at"))
    )
    before = F.size(F.filter("fails", lambda a: F.col("ok_at").isNull() | (a < F.col("ok_at"))))
    return seen.select(
        id_col,
        F.when(dead, "dlq").when(F.col("ok_at").isNotNull(), "completed").otherwise("pending").alias("status"),
        before.alias("retry_count"),
    )


def apply_retention(df: DataFrame, as_of: str, seconds: int = 86400) -> DataFrame:
    """The table without completed rows older than the cutoff."""
    return df.where(~_expired(as_of, seconds))


def expire(spark: SparkSession, path: str, shape: str, part: str, as_of: str, seconds: int = 86400) -> dict[str, int]:
    """Delete expired rows of the stored table at ``path``, which is partitioned by ``part``; gives what went, by part.

    Only parts with expired rows are written again, each replaced as a whole when the write commits; parts of which
    nothing is left are removed. All other folders stay as they are. The driver sees one count per such part.
    """
    rows = spark.read.schema(shape).parquet(path)
    old = F.count_if(_expired(as_of, seconds))
    found = rows.groupBy(part).agg(old.alias("old"), F.count(F.lit(1)).alias("n")).where("old > 0").collect()
    partly = [r[part] for r in found if r.old < r.n]
    if partly:
        left = apply_retention(rows.where(col(part).isin(partly)), as_of, seconds)
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in found:
        if r.old == r.n:
            folder = hadoop.Path(f"{path}/{part}={r[part]}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return {str(r[part]): r.old for r in found}


def retention_count(df: DataFrame, as_of: str, seconds: int = 86400) -> DataFrame:
    """Dry run: how many rows retention would delete."""
    return df.where(_expired(as_of, seconds)).agg(F.count("*").alias("to_delete"))


def _expired(as_of: str, seconds: int) -> Column:
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return F.coalesce(
        (F.col("status") == "completed") & (F.col("ts") < cutoff), F.lit(False)
    )


def newest(
    df: DataFrame, n: int = 10, status: str | None = None, ts: str = "ts", tie: str = "id"
) -> DataFrame:
    """The ``n`` newest rows, of one status when given."""
    if status:
        df = df.where(F.col("status") == status)
    return df.orderBy(F.col(ts).desc(), tie).limit(n)


def status_counts(df: DataFrame) -> DataFrame:
    """Total and one count per known status in a single row, missing statuses as zero."""
    return df.agg(
        F.count("*").alias("total_messages"),
        *[F.count_if(F.col("status") == s).alias(s) for s in DELIVERY_STATUSES],
    )


def status_breakdown(df: DataFrame) -> DataFrame:
    """Count per status, most frequent first."""
    return df.groupBy("status").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "status")


def time_span(df: DataFrame, ts: str = "ts") -> DataFrame:
    micros = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    return df.agg(
        F.min(ts).alias("first_message"),
        F.max(ts).alias("last_message"),
        (micros / 1_000_000.0).alias("timespan"),
    )


def queue_depth(df: DataFrame, data: str = "message_data") -> DataFrame:
    """Rows and payload characters in a queue table."""
    return df.agg(
        F.count("*").alias("depth"),
        F.coalesce(F.sum(F.length(col(data))), F.lit(0)).alias("bytes"),
    )


def canonical_json(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """JSON text of the non-null columns in key order, with a space after ``,`` and ``:``."""
    parts = []
    for name in sorted(names if names is not None else df.columns):
        text = F.to_json(F.array(col(name)))
        value = F.substring(text, F.lit(2), F.length(text) - 2)
        parts.append(F.when(col(name).isNotNull(), F.concat(F.lit(f'"{name}": '), value)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def dead_letters(
    df: DataFrame, reason: Column | str, attempts: Column | int, as_of: str
) -> DataFrame:
    """Quarantine rows: the original, when, why, after how many attempts, and a short content hash."""
    return df.select(
        canonical_json(df).alias("original_message"),
        F.lit(as_of).cast("timestamp").alias("dlq_timestamp"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (F.lit(attempts) if isinstance(attempts, int) else attempts).alias("attempts"),
        F.substring(F.md5(canonical_json(df)), 1, 8).alias("message_hash"),
    )


def envelopes(
    df: DataFrame,
    id_col: str,
    as_of: str,
    size: int = 100,
    source: str = "edge",
    is_retry: bool = False,
) -> DataFrame:
    """One JSON document per batch of ``size`` messages in id order, bookkeeping keys removed."""
    cut = batches(df, id_col, size)
    messages = sanitise(cut.drop("batch_no", "batch_pos")).columns
    item = F.struct("batch_pos", F.struct(*[col(c) for c in messages]).alias("m"))
    grouped = cut.groupBy("batch_no").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.count("*").cast("int").alias("batch_size")
    )
    doc = F.struct(
        F.transform("items", lambda i: i["m"]).alias("messages"),
        "batch_size",
        F.lit(as_of).alias("timestamp"),
        F.lit(source).alias("source"),
        F.lit(is_retry).alias("is_retry"),
    )
    return grouped.select("batch_no", "batch_size", F.to_json(doc).alias("payload"))


def write_envelopes(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Every document twice, gzip and plain, in sibling folders."""
    text = docs.select("payload")
    text.write.mode(mode).option("compression", "gzip").text(f"{path}/gzip")
    text.write.mode(mode).option("compression", "none").text(f"{path}/plain")
