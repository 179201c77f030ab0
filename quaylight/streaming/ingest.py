"""The live path: envelopes in, steps applied, one batch fanned out to every sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaylight import schema
from quaylight.operators import logs, store
from quaylight.operators.flow import Step, run_steps
from quaylight.operators.sinks import Sink, fan_out, file_sink
from quaylight.sources import envelopes


def event_stream(
    spark: SparkSession, path: str, event: str = schema.EVENT, max_files: int = 100
) -> DataFrame:
    """Messages of envelope files as they arrive, with ``rejected`` (a reason, or null).

    Undeclared keys are in ``data``. Unreadable documents and messages without a type are rows too, their
    text in ``data``: ``run_ingest`` sends them to quarantine, so each input is in exactly one output.
    """
    batches = envelopes.read(spark, path, "VARIANT", stream=True, maxFilesPerTrigger=str(max_files))
    broken = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.to_variant_object(F.struct(F.col("_corrupt_record").alias("__broken")))))
    held = batches.withColumn("messages", F.coalesce("messages", broken))
    events = envelopes.open_messages(held, event)
    text = F.try_variant_get(F.try_parse_json("data"), "$.__broken", "string")
    reason = F.when(text.isNotNull(), "corrupt document").when(F.col("type").isNull(), "no type")
    return events.withColumns({"rejected": reason, "data": F.coalesce(text, F.col("data"))})


def store_sink(path: str, as_of: str | None = None) -> Sink:
    """Event-store rows of a batch; the batch id goes into the row ids."""
    at = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()

    def write(batch: DataFrame, batch_id: int) -> dict[str, int]:
        prepare = lambda df: store.dated(store.numbered_repeats(store.store_rows(df, at, str(batch_id))))
        return file_sink(path, prepare, ("event_date",))(batch, batch_id)

    return write


def log_sink(path: str, as_of: str | None = None, **options) -> Sink:
    """Log entries of a batch."""
    at = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return file_sink(path, lambda df: logs.to_entries(df, at, **options))


def run_ingest(
    events: DataFrame,
    steps: Sequence[Step],
    sinks: Mapping[str, Sink],
    checkpoint: str,
    stats_path: str | None = None,
    seconds: int | None = None,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Start the stream; without ``seconds`` it drains what is there and stops.

    Delivery is at least once: every sink writes under its batch id, so a replay overwrites. Rows that
    ``event_stream`` marks as rejected go to the ``quarantine`` folder, which such a stream needs.
    """
    marked = "rejected" in events.columns
    if marked and not quarantine:
        raise ValueError("a stream with rejected rows needs a quarantine folder")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        if marked:
            refused = batch.where("rejected IS NOT NULL").select("rejected", F.to_json(F.struct(*[c for c in batch.columns if c != "rejected"])).alias("event"))
            refused.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
            batch = batch.where("rejected IS NULL").drop("rejected")
        fan_out(run_steps(batch, steps), batch_id, sinks, stats_path)

    writer = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    if seconds:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    return writer.trigger(availableNow=True).start()
