"""Operations telemetry on Spark: parse, redact, enrich, store, query and alert with DataFrames."""

__version__ = "0.1.0"
