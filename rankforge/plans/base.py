"""Retrieval tables derived from the test tables: queries, first stage, judgements, logs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import overlap

#: The reference's default depth of pools.
HITS = 100


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def overlaps(spark: SparkSession, sf_dir: str, hits: int | None = None, share: tuple[int, int] | None = None) -> DataFrame:
    """``item_id, doc_id, n, size``: distinct tokens in common, and those of the query; pairs without one never exist. ``hits`` and ``share`` are as in ``count_in_cells``."""
    queries, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    return overlap.count_in_cells(overlap.words(queries, "item_id"), docs.select("doc_id", "text"), queries.count(), docs.count(), hits, share, overlap.text_to_split())


def first_stage(spark: SparkSession, sf_dir: str, hits: int = HITS) -> DataFrame:
    """``qid, pos, docid, score, hidden``: the pool of each query and what a perfect comparator sees.

    Persisted: a session's queries share one plan, so the work is done once.
    """
    return _pools(spark, sf_dir, hits).persist()


@lru_cache(maxsize=16)  # a plan with a Python function is recognised as the same one only if it is the same object
def _pools(spark: SparkSession, sf_dir: str, hits: int) -> DataFrame:
    o = overlaps(spark, sf_dir, hits).withColumn("docid", F.col("doc_id").cast("string"))
    pos = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "docid"))
    o = o.withColumn("pos", pos).where(F.col("pos") <= hits)
    hidden = ((F.col("doc_id") * 7919 + F.col("item_id") * 104729) % 1000003).cast("double")
    return o.select(F.col("item_id").cast("string").alias("qid"), "pos", "docid", F.col("n").cast("double").alias("score"), hidden.alias("hidden"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, docid, rel``: 2 for six tenths of a query's tokens and more, 1 for three; persisted, as ``first_stage`` is."""
    return _judged(spark, sf_dir).persist()


@lru_cache(maxsize=16)
def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlaps(spark, sf_dir, share=(3, 10))
    rel = F.when(10 * F.col("n") >= 6 * F.col("size"), 2).when(10 * F.col("n") >= 3 * F.col("size"), 1).otherwise(0)
    return o.select(F.col("item_id").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("docid"), rel.alias("rel")).where("rel > 0")


def pool_sql(hits: int = HITS) -> str:
    """The same tables for the oracle."""
    return rf"""
WITH qt AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\s+'))) AS tok FROM benchmark),
dt AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\s+'))) AS tok FROM documents),
ov AS (SELECT item_id, doc_id, count(*) AS n FROM qt JOIN dt USING (tok) WHERE tok <> '' GROUP BY ALL),
pool AS (SELECT item_id::VARCHAR AS qid, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id::VARCHAR) AS pos, doc_id::VARCHAR AS docid, n::DOUBLE AS score, ((doc_id * 7919 + item_id * 104729) % 1000003)::DOUBLE AS hidden
 FROM ov QUALIFY pos <= {hits}),
qrels AS (SELECT item_id::VARCHAR AS qid, doc_id::VARCHAR AS docid, CASE WHEN 10 * n >= 6 * size THEN 2 WHEN 10 * n >= 3 * size THEN 1 ELSE 0 END AS rel
 FROM ov JOIN (SELECT item_id, count(*) AS size FROM qt WHERE tok <> '' GROUP BY item_id) USING (item_id))"""


POOL_SQL = pool_sql()


def comparison_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison log out of the event stream: windows of 3 to 7, some answers beyond them."""
    e = read(spark, sf_dir, "events")
    n = (3 + F.col("event_id") % 5).cast("int")
    places = F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("string"))
    return e.select(F.col("event_id").cast("string").alias("qid"), F.col("event_type").alias("type"), places.alias("positions"), (1 + (F.col("user_id") * 7 + F.col("event_id")) % (n + 1)).cast("string").alias("selected"))


LOG_SQL = "SELECT event_type AS type, 3 + event_id % 5 AS n, 1 + (user_id * 7 + event_id) % (4 + event_id % 5) AS sel FROM events"


def run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values of repeated runs: ``method, condition, run_id, qid, value, path``."""
    line = read(spark, sf_dir, "lineitem")
    cells = line.groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("condition"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run_id"), F.col("l_suppkey").cast("string").alias("qid"))
    return cells.agg(F.round(F.avg("l_discount"), 6).alias("value")).withColumn("path", F.col("run_id"))


VALUES_SQL = "SELECT l_returnflag AS method, l_linestatus AS condition, 'run' || l_linenumber AS run_id, l_suppkey::VARCHAR AS qid, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL"
