"""Health checks for batches of posted rows, as a micro-batch job over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators.ordering import AUTO, Layout
from shelfwise.plans.monitor import align, health, remember


def watch_posted(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    state_path: str,
    reports: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    layout: Layout = AUTO,
    once: bool = True,
) -> StreamingQuery:
    """Compare every batch of posted JSON rows with the stored reference.

    Batch ``id`` looks back into the tails that the batches before it left, and leaves its own as
    version ``id + 1``: lags reach across batches, and a repeated batch finds what it found first.
    Each batch overwrites its own ``batch=<id>`` folder, so a batch that runs twice after
    a lost driver leaves one report. ``once`` processes what is there and stops.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def check(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        current = align(session, state_path, batch, layout, before=batch_id + 1)
        found = health(session, state_path, current)
        found.write.mode("overwrite").parquet(f"{reports}/batch={batch_id}")
        remember(session, state_path, batch, batch_id + 1)

    writer = reader.json(source).writeStream.foreachBatch(check)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
