"""Query likelihood under a smoothed unigram model of the collection, as one relational plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _tokens(text: str):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def query_likelihood(pool: DataFrame, queries: DataFrame, docs: DataFrame, mu: float = 1000.0, places: int = 9) -> DataFrame:
    """``qid, docid, pos, score, rank``: pool rows ``qid, pos, docid`` scored by the log-likelihood of the query's tokens, and ranked by it; ties keep their order.

    A token's probability is its count in the document with ``mu`` counts of
    the collection's distribution added (Dirichlet smoothing), repeats counted.
    Tokens that the collection doesn't have are the same for all documents and
    left out. Scores are rounded, so that the order of summation decides no tie.
    A document that isn't in ``docs`` counts as an empty one.

    Collection counts are summed up before their shuffle; only documents of some
    pool are counted by token, and pairs of document and token come from the
    pool, so nothing grows with queries times documents.
    """
    asked = queries.select("qid", F.explode(_tokens("text")).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("asked"))
    collection = docs.select(F.explode(_tokens("text")).alias("tok")).groupBy("tok").agg(F.count("*").alias("in_all"))
    known = asked.join(collection, "tok")
    total = collection.agg(F.sum("in_all").alias("tokens"))
    # texts are split after the join that picks them: they are shorter than their tokens, and their counts need no other exchange
    kept = docs.select("docid", "text").join(pool.select("docid").distinct(), "docid", "left_semi").select("docid", _tokens("text").alias("toks"))
    length = kept.groupBy("docid").agg(F.sum(F.size("toks")).alias("length"))
    counts = kept.select("docid", F.explode("toks").alias("tok")).groupBy("docid", "tok").agg(F.count("*").alias("in_doc"))
    rows = pool.select("qid", "docid", "pos").join(length, "docid", "left")
    pairs = rows.join(known, "qid", "left").join(counts, ["docid", "tok"], "left").crossJoin(F.broadcast(total))  # one row
    share = (F.coalesce("in_doc", F.lit(0)) + mu * F.col("in_all") / F.col("tokens")) / (F.coalesce("length", F.lit(0)) + mu)
    scored = pairs.groupBy("qid", "docid", "pos").agg(F.round(F.coalesce(F.sum(F.col("asked") * F.log(share)), F.lit(0.0)), places).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank.cast("long"))
