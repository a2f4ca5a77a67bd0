"""A corpus pipeline: quality rules, exact dedup, n-gram join, source mix, byte BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality_rules
from rankforge.llm._session import cut
from rankforge.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the quality rules: a null or empty text does not; repeated rows are judged each; an empty table stays empty."""
    return quality_rules.drop_failed(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of equal texts, the one with the largest id.

    Null and empty texts are one group; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near copies."""
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; nulls, ties and repeated rows are as in `plan_mix`; an empty table stays empty."""
    return mixing.draw_mix(docs).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again as a proof."""
    path, pattern = tokenizer()
    return byte_bpe.encode_and_decode(docs, path, pattern).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("source mix", mix), ("byte BPE", tokens)]

#: The mix and the tokens can't be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows materialised for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
