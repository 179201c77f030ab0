"""Tables whose batches become visible at once.

A batch is written to a folder of its own; a small file in ``_commits`` then names that folder, put in place by one
atomic rename. Readers take the folders that are named, so a write that dies midway leaves what was there, and a
replayed batch replaces its predecessor in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMITS = "_commits"


def _files(spark: SparkSession, path: str):
    """The file system of a path, its path class and the context that can rename over a file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.Path(path).getFileSystem(conf), hadoop


def commit(rows: DataFrame, root: str, batch: str | int, by: Sequence[str] = ()) -> str:
    """Write ``rows`` as the batch ``batch`` of the table at ``root``, partitioned by ``by``; gives its folder.

    Of several commits of one batch the last counts; the folder it replaces is deleted afterwards.
    """
    spark = rows.sparkSession
    folder = f"batch={batch}-{uuid.uuid4().hex}"
    rows.write.mode("error").partitionBy(*by).parquet(f"{root}/{folder}")
    fs, hadoop = _files(spark, root)
    before = _folder(spark, root, batch)
    staged, final = hadoop.Path(f"{root}/{COMMITS}/.{folder}"), hadoop.Path(f"{root}/{COMMITS}/{batch}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"batch": str(batch), "folder": folder}), "utf-8"))
    out.close()
    context = hadoop.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(staged), context.makeQualified(final), options)
    if before:
        fs.delete(hadoop.Path(f"{root}/{before}"), True)
    return f"{root}/{folder}"


def _folder(spark: SparkSession, root: str, batch: str | int) -> str | None:
    fs, hadoop = _files(spark, root)
    path = hadoop.Path(f"{root}/{COMMITS}/{batch}.json")
    if not fs.exists(path):
        return None
    return spark.read.schema("folder string").json(f"{root}/{COMMITS}/{batch}.json").first().folder


def is_committed(spark: SparkSession, root: str) -> bool:
    """Whether the table at ``root`` was written by ``commit``."""
    fs, hadoop = _files(spark, root)
    return fs.exists(hadoop.Path(f"{root}/{COMMITS}"))


def committed(spark: SparkSession, root: str) -> list[str]:
    """The folders of all committed batches: one name per batch, which compaction keeps few."""
    if not is_committed(spark, root):
        return []
    rows = spark.read.schema("folder string").json(f"{root}/{COMMITS}/*.json").collect()
    return sorted(f"{root}/{r.folder}" for r in rows)


def read(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """All committed rows; ``schema`` names the columns, those that batches are partitioned by included."""
    folders = committed(spark, root)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*folders)
