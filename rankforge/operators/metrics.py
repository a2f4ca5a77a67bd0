"""Retrieval metrics as column expressions: nDCG and average precision at cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trec_order(run: DataFrame) -> DataFrame:
    """Ranks as trec_eval takes them: by score, ties by docid from the end; given ranks are ignored."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docid"))))


def _discount(rank: str):
    return F.log2(F.col(rank) + 1)


def ndcg(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (10,)) -> DataFrame:
    """``metric, qid, value`` for each query of the run; linear gain, ideal over all judged documents.

    A query without a relevant document has value 0.
    """
    judged = qrels.select("qid", "docid", "rel")
    got = run.select("qid", "docid", "rank").join(judged, ["qid", "docid"], "left").withColumn("gain", F.coalesce("rel", F.lit(0)))
    ideal = judged.where("rel > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "docid")))
    dcg = got.groupBy("qid").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("gain") / _discount("rank")).otherwise(0.0)).alias(f"d{k}") for k in cuts])
    best = ideal.groupBy("qid").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("rel") / _discount("rank")).otherwise(0.0)).alias(f"i{k}") for k in cuts])
    both = dcg.join(best, "qid", "left")
    rows = F.explode(F.array(*[F.struct(F.lit(f"ndcg_cut_{k}").alias("metric"), F.coalesce(F.try_divide(f"d{k}", f"i{k}"), F.lit(0.0)).alias("value")) for k in cuts]))
    return both.select("qid", rows.alias("m")).select("m.metric", "qid", "m.value")


def average_precision(run: DataFrame, qrels: DataFrame, cut: int = 100, level: int = 1) -> DataFrame:
    """``metric, qid, value``: precision at each relevant rank up to ``cut``, over all documents relevant at ``level``."""
    relevant = qrels.where(F.col("rel") >= level).select("qid", "docid", F.lit(1).alias("hit"))
    total = relevant.groupBy("qid").agg(F.count("*").alias("n"))
    got = run.where(F.col("rank") <= cut).select("qid", "docid", "rank").join(relevant, ["qid", "docid"], "left")
    got = got.withColumn("found", F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("qid").orderBy("rank")))
    ap = got.groupBy("qid").agg(F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("rank")).otherwise(0.0)).alias("s"))
    return ap.join(total, "qid", "left").select(F.lit(f"map_cut_{cut}").alias("metric"), "qid", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("value"))


def with_all(values: DataFrame) -> DataFrame:
    """Per-query rows and an ``all`` row of each metric, the mean over its queries."""
    return values.unionAll(values.groupBy("metric").agg(F.avg("value").alias("value")).select("metric", F.lit("all").alias("qid"), "value"))
