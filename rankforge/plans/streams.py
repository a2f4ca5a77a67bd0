"""Registered queries of streams: the event table written as files, read as a stream, and what the stream left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import jobs
from ..streaming.bucket_table import BucketTable
from . import base
from .register import query

_COLUMNS = "protocol_hash string, qid string, finished_at timestamp, event_id long, value double"


def _as_stream(spark, d):
    """Telemetry rows out of the events, in files of a range of time each; three micro-batches read them."""
    e = base.read(spark, d, "events")
    rows = e.select(F.col("event_type").alias("protocol_hash"), F.col("user_id").cast("string").alias("qid"), F.col("ts").cast("timestamp").alias("finished_at"), "event_id", "value")
    path = shared_folder(spark, "events")
    rows.repartitionByRange(8, "finished_at").write.parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(_COLUMNS).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(path)


def _done(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("SELECT DISTINCT event_type AS protocol_hash, user_id::VARCHAR AS qid FROM events")
def once_per_query_stream(spark, d):
    """Each key once, by a stream whose delay spans the table."""
    table = shared_folder(spark, "once")
    _done(jobs.append_once(_as_stream(spark, d), table, shared_folder(spark, "log"), delay="36500 days"))
    return spark.read.parquet(table).select("protocol_hash", "qid")


@query("SELECT user_id::VARCHAR AS qid, event_id, event_type AS protocol_hash, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_stream(spark, d):
    """The latest event of each user, merged into buckets batch by batch."""
    table = shared_folder(spark, "upsert")
    _done(jobs.upsert_telemetry(_as_stream(spark, d), table, shared_folder(spark, "log"), latest=("finished_at", "event_id"), buckets=64))
    return BucketTable(spark, table, ["qid"], ["finished_at", "event_id"], 64).read().select("qid", "event_id", "protocol_hash", "value")
