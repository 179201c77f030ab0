"""Raw log lines and their file-derived service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight import fixed


def read(spark: SparkSession, path: str | list[str], glob: str | None = None, stream: bool = False) -> DataFrame:
    """(file_path, value) lines of files under a path; as a stream, new files are picked up once."""
    reader = spark.readStream if stream else spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")


def service_of_file(path: Column) -> Column:
    return F.when(path.contains("/nginx/") | path.endswith("access.log"), "web").when(
        path.rlike("dns|unbound|bind"), "dns"
    )


def events(lines: DataFrame, as_of: Column) -> DataFrame:
    """One log event per non-empty line."""
    return lines.where(F.length("value") > 0).select(
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("log").alias("type"),
        "file_path",
        F.col("value").alias("message"),
        service_of_file(F.col("file_path")).alias("service"),
    )


def size_guard(
    df: DataFrame, value: str = "value", limit: int = fixed.MAX_SYSLOG_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by size in bytes."""
    fits = F.octet_length(value) <= limit
    return df.where(fits), df.where(~fits)
