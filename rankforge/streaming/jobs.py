"""Streams over append-only logs: position counts, exactly-once queries, telemetry upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from .bucket_table import BucketTable


def comparison_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.COMPARISON).json(path)


def position_counts(stream: DataFrame) -> DataFrame:
    """Running ``type, position, count``; works on a stream (update or complete mode) and on a table."""
    at = F.array_position("positions", F.col("selected"))
    return stream.withColumn("position", at).where("position > 0").groupBy("type", "position").agg(F.count("*").alias("count"))


def once_per_query(stream: DataFrame, at: str = "finished_at", delay: str = "1 day", keys: tuple[str, ...] = ("protocol_hash", "qid")) -> DataFrame:
    """First row of each (protocol, query): a resumed run adds nothing twice.

    A stream remembers a key until its watermark is ``delay`` past the key's time
    ``at``, so its state is bounded by the keys of that span; a row later than
    the watermark is dropped. A table gives the row with the least time, nulls last.
    """
    if stream.isStreaming:
        return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(at)))
    return stream.withColumn("__r", first).where("__r = 1").drop("__r")


def append_once(stream: DataFrame, table_path: str, checkpoint: str, **options):
    """Appends ``once_per_query`` to Parquet files, whose log of batches makes each batch count once over restarts."""
    return once_per_query(stream, **options).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by hour and type, late ones within the watermark."""
    stream = events.withWatermark("ts", delay) if events.isStreaming else events
    return stream.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def upsert_telemetry(stream: DataFrame, table_path: str, checkpoint: str, name: str = "telemetry", keys: tuple[str, ...] = ("qid",), latest: tuple[str, ...] = ("finished_at",), buckets: int = 256):
    """Keeps the latest row of each query in a ``BucketTable``: a batch rewrites the buckets of its keys. ``name`` is the stream's, whatever its checkpoint folder."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for its buckets, then for its rows
        try:
            BucketTable(batch.sparkSession, table_path, list(keys), list(latest), buckets).upsert(batch, name, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
