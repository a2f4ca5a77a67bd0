"""Queries of overlaps met through the rarest words only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlap
from ..sources.shared import written_table
from . import base
from .register import query


def _sides(spark, d):
    """Both sides of the overlap operators, written as they are read more than once."""
    queries, docs = base.read(spark, d, "benchmark"), base.read(spark, d, "documents")
    kept = written_table(overlap.document_side(queries, docs))
    return written_table(overlap.query_side(queries, kept)), kept


@query(base.POOL_SQL + " SELECT qid, pos, docid, score::BIGINT AS n FROM pool")
def rarest_words_top_hits(spark, d):
    top = overlap.top_overlaps(*_sides(spark, d), base.HITS)
    return top.select(F.col("item_id").cast("string").alias("qid"), F.col("pos").cast("long").alias("pos"), F.col("doc_id").cast("string").alias("docid"), "n")


@query(base.POOL_SQL + " SELECT item_id::VARCHAR AS qid, doc_id::VARCHAR AS docid, n, size FROM ov JOIN (SELECT item_id, count(*) AS size FROM qt WHERE tok <> '' GROUP BY item_id) USING (item_id) WHERE 10 * n >= 3 * size")
def rarest_words_overlaps(spark, d):
    met = overlap.overlaps_of_at_least(*_sides(spark, d), lambda size: F.ceil(3 * size / 10))
    return met.select(F.col("item_id").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("docid"), "n", "size")
