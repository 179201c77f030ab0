"""Tables in the cluster's shared folder, and sums of count vectors without a large reducer."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-tables-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: lineage ends here.

    Shuffle files of the work that made it are not needed afterwards, so the driver asks for their
    release instead of holding them to the end of the query.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split("://")[-1].lstrip("/").startswith(shared_folder(spark).split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle() -> None:
    """Give memory that the allocators hold but nothing uses back to the system.

    Python workers live on for later stages, and what one stage needed at its height would stay theirs.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


VECTOR = "part int, salt int, counts binary"
PARTS = 32
SALTS = 16


def packed(vector: np.ndarray, salt: int) -> pa.RecordBatch:
    """A vector of counts as ``PARTS`` rows for :func:`summed`."""
    pieces = np.array_split(vector.astype(np.int64), PARTS)
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(range(PARTS), pa.int32()),
            "salt": pa.array([salt % SALTS] * PARTS, pa.int32()),
            "counts": pa.array([p.tobytes() for p in pieces], pa.binary()),
        }
    )


def _add(batches: list[bytes]) -> bytes:
    total = np.frombuffer(batches[0], np.int64).copy()
    for other in batches[1:]:
        total += np.frombuffer(other, np.int64)
    return total.tobytes()


def summed(vectors: DataFrame) -> np.ndarray:
    """The sum of all vectors of a ``VECTOR`` frame: (part, salt) groups first, then parts.

    The vector's length is fixed by the caller, so what reaches the driver does not grow with the data.
    """

    def add(group: pa.Table) -> pa.Table:
        return pa.table(
            {
                "part": group.column("part").slice(0, 1),
                "salt": group.column("salt").slice(0, 1),
                "counts": pa.array([_add(group.column("counts").to_pylist())], pa.binary()),
            }
        )

    level = vectors.groupBy("part", "salt").applyInArrow(add, VECTOR)
    rows = level.groupBy("part").applyInArrow(add, VECTOR).collect()
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(rows, key=lambda r: r.part)]) if rows else np.zeros(0, np.int64)


def counted(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], length: int) -> np.ndarray:
    """Counts over all rows: ``add`` puts each batch into its task's vector of ``length``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector = np.zeros(length, np.int64)
        for batch in batches:
            add(vector, batch)
        yield packed(vector, TaskContext.get().partitionId())

    total = summed(df.mapInArrow(task, VECTOR))
    return total if len(total) else np.zeros(length, np.int64)


def sampled(df: DataFrame, key: str, group: str, rows: int, text: str = "text") -> DataFrame:
    """About ``rows`` rows, spread evenly over all values of ``group``, chosen by a hash of ``key`` and ``text``.

    The rate of each value comes from its count over all data; no row is ranked and no group gathered. The counts
    are a stored table, which Spark broadcasts only below its own limit. Rows that share a key are chosen each
    for itself; of rows equal in key, group and text one is enough, so what is chosen stays bounded however
    often a row repeats. A null value of ``group`` is a value of its own.
    """
    counts = stored(df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n")), "sample-counts")
    values = counts.count()
    if not values:
        return df.limit(0)
    rate = F.least(F.lit(1.0), F.lit(rows / values) / F.col("__n"))
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col(key), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    joined = df.withColumn("__spot", spot).join(counts, F.col(group).eqNullSafe(F.col("__group")))
    return joined.where(F.col("__spot") < rate).select(*df.columns).dropDuplicates([key, group, text])
