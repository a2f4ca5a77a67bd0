"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's checkpoint folder; a local one only where none is named and executors share this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankforge-checkpoint-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a written table in the shared folder, for what is read more than once."""
    shared_folder(rows.sparkSession, "")
    return rows.checkpoint(eager=True)


def written_table(rows: DataFrame) -> DataFrame:
    """``rows`` as Parquet in the shared folder: made once, with column pruning and a size that joins can go by."""
    path = shared_folder(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
