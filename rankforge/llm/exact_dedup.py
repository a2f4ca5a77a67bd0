"""Exact dedup by a heavy-hitter split, in native expressions only.

A Misra-Gries summary (Spark's ``approx_top_k`` keeps one: counters that are
decremented together when full) finds every digest that may hold more than
1 / ``counters`` of the rows. The candidates' exact counts and winners come
from a partial aggregation; those that are frequent indeed, at most
``counters`` rows whatever the input, are broadcast, and their rows are decided
where they lie. All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import cut


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def heavy_groups(rows: DataFrame, counters: int = 1024) -> DataFrame:
    """``text_sha256, keep_id, group_size, __last`` of the digests of rows ``doc_id, text_sha256, __tag`` that more than 1 / ``counters`` of the rows have.

    ``rows`` is read twice, so let it be cheap to read.
    """
    rows = rows.withColumn("__key", F.xxhash64("text_sha256"))
    summary = rows.agg(F.expr(f"approx_top_k(__key, {counters}, {4 * counters})").alias("top"))
    candidates = summary.select(F.explode("top.item").alias("__key"))
    total = rows.agg(F.count("*").alias("total"))
    # the summary's items and the one-row total are bounded by ``counters`` and 1
    counted = rows.join(F.broadcast(candidates), "__key", "left_semi").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(F.struct("doc_id", "__tag")).alias("__last"))
    return cut(counted.join(F.broadcast(total)).where(F.col("group_size") * counters > F.col("total")).drop("total"))


def decide(rows: DataFrame, counters: int = 1024) -> DataFrame:
    """Add ``keep_id, group_size, kept`` to rows ``doc_id, text_sha256, __tag``."""
    heavy = heavy_groups(rows, counters)
    return _light(rows, heavy).unionByName(_hot(rows, heavy))


def _hot(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    kept = F.struct("doc_id", "__tag").eqNullSafe(F.col("__last"))
    return rows.join(F.broadcast(heavy), "text_sha256").withColumn("kept", kept).drop("__last")


def _light(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Groups by partial aggregation, joined back: no task holds a group."""
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(F.struct("doc_id", "__tag")).alias("__last"))
    return rest.join(groups, "text_sha256").withColumn("kept", F.struct("doc_id", "__tag").eqNullSafe(F.col("__last"))).drop("__last")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each input row.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest id is kept (a null id counts
    as smallest; of repeated rows with that id, exactly one). ``keep_id`` is its
    id. Other columns are not read; an empty table gives an empty result.
    """
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("__tag"))
    return decide(cut(rows), counters).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Copies of frequent digests go where they lie, by the broadcast winners; the rest
    is aggregated by digest, so texts are exchanged once. Nulls and ties are as in
    ``find_copies``: of repeated rows that share id and text one stays; an empty
    table gives an empty result.
    """
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    heavy = heavy_groups(cut(own.withColumn("__tag", F.lit(0))), counters)
    # the row as a struct, in which no name clashes
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    light = rows.join(F.broadcast(heavy.select("text_sha256", "keep_id", F.lit(True).alias("hot"))), "text_sha256", "left")
    light = light.where(F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # a struct is never null, so a row without an id counts as well, as the smallest
    return light.groupBy("text_sha256").agg(F.max_by("row", F.struct("doc_id")).alias("row")).select("row.*")
