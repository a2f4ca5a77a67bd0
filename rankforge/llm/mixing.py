"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's place is a 64-bit hash of its id; its leading bits cut a source
into blocks. A source's sequence lists its blocks in an order permuted by hash,
as often as its target holds the source whole, then on to where the target is
reached; the last block drawn is cut at a finer cell. The number of blocks drawn
is the source's quota. The quotas are split down a binary tree of output shards:
at each node the left half's share of each source is a multivariate-
hypergeometric draw from what the node holds, so that shards have random
compositions with exact sums. Each shard draws its share as the next blocks of
each source's sequence, disjoint from all other shards. A document is taken once
for each draw of its block, into the shard that drew it, and a shard shuffles
its rows by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import cut

#: Weights of the sources by code point order, repeating.
WEIGHTS = (3, 1, 2)
#: A source has at most 512 blocks, whatever its size; cells are 2**17 times finer.
_BLOCK_BITS, _CELL_BITS = 9, 26
#: Rows of the table of drawn blocks up to which it is broadcast (about 40 bytes each); beyond it rows are shuffled.
BROADCAST_ROWS = 1 << 17


def _place(id_col: str, seed: int) -> Column:
    """A document's place in its source: an integer of ``_CELL_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(seed)), 64 - _CELL_BITS)


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size, and the excess is dealt again.

    Shares fill up in the order of their size per weight, so one pass does it.
    """
    out = [0.0] * len(sizes)
    left, weight = total, sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i]):
        out[i] = min(float(most * sizes[i]), left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard, an array (source, shard) whose rows sum to the quotas."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = held
            return
        mid = (lo + hi) // 2
        take = int(held.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, take, method="marginals") if len(held) else held
        split(lo, mid, left)
        split(mid, hi, held - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def _sources(blocks: DataFrame, total_share: float, most: float):
    """The sources in code point order with their sizes, and their targets."""
    rows = blocks.groupBy("source").agg(F.sum("words").alias("words")).collect()
    table = sorted(((r.source, r.words) for r in rows), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [w for _, w in table]
    return table, fill_targets(sizes, [WEIGHTS[k % 3] for k in range(len(table))], total_share * sum(sizes), most)


def draw_blocks(small: DataFrame, total_share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 8) -> DataFrame:
    """``source, block, source_size, target, draws``: the shards that draw each block, from rows ``source, place, size``.

    ``draws`` is an array of ``shard, past``, in the order of the source's
    sequence: the draw takes the block's documents whose place is below ``past``.
    The rows are at most 512 for a source.
    """
    spark = small.sparkSession
    block = F.shiftright("place", _CELL_BITS - _BLOCK_BITS).cast("int")
    blocks = cut(small.groupBy("source", block.alias("block")).agg(F.sum("size").alias("words")))
    table, targets = _sources(blocks, total_share, most)
    whole = [int(t // w) if w else 0 for (_, w), t in zip(table, targets, strict=True)]
    head = spark.createDataFrame([(k, s, w, t, n, t - n * w) for k, ((s, w), t, n) in enumerate(zip(table, targets, whole, strict=True))], "no int, source string, source_size long, target double, whole int, rest double")
    # each source's blocks in permuted order, and the one in which the rest of its target ends
    order = Window.partitionBy("no").orderBy(F.xxhash64("block", F.lit(seed)), "block")
    at = blocks.join(head.withColumnRenamed("source", "own"), blocks.source.eqNullSafe(F.col("own"))).drop("own")
    at = cut(at.select("*", (F.row_number().over(order) - 1).alias("rank"), F.sum("words").over(order).alias("upto")))
    ends = at.where("upto >= rest and upto - words < rest").select("no", "source", F.col("block").alias("end"), "rank", (F.col("rest") - F.col("upto") + F.col("words")).alias("within"))
    inside = small.join(ends.withColumnRenamed("source", "own"), small.source.eqNullSafe(F.col("own")) & (F.col("end") == block))
    cells = inside.groupBy("no", "rank", "within", "place").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("no").orderBy("place"))  # at most 2**17 cells
    past = F.when(upto - F.col("size") / 2 <= F.col("within"), F.col("place") + 1)
    last = {r.no: r for r in cells.select("no", "rank", "place", past.alias("past")).groupBy("no").agg(F.max("rank").alias("rank"), F.coalesce(F.max("past"), F.min("place")).alias("past")).collect()}
    number = {r.no: r.n for r in at.groupBy("no").agg(F.count("*").alias("n")).collect()}
    drawn = [whole[k] * number.get(k, 0) + (last[k].rank + 1 if k in last else 0) for k in range(len(table))]
    ends_at = np.cumsum(split_tree(np.array(drawn, np.int64), shards, seed), axis=1)
    shares = spark.createDataFrame([(k, number.get(k, 0), drawn[k] - 1 if k in last else -1, last[k].past if k in last else 0, ends_at[k].tolist()) for k in range(len(table))], "no int, n int, cut_at int, past long, ends array<long>")
    # position p of the sequence is the block of rank p mod n; the shard that draws it is the one whose share it lies in
    position = F.col("pass") * F.col("n") + F.col("rank")
    shard = F.size(F.filter("ends", lambda e: e <= position))
    below = F.when(position == F.col("cut_at"), F.col("past")).otherwise(F.lit(1 << _CELL_BITS)).cast("long")
    passes = at.join(shares, "no").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(most)))))
    draws = passes.where(shard < shards).select("no", "block", F.struct(position.alias("at"), shard.alias("shard"), below.alias("past")).alias("draw"))
    draws = draws.groupBy("no", "block").agg(F.transform(F.array_sort(F.collect_list("draw")), lambda d: F.struct(d["shard"].alias("shard"), d["past"].alias("past"))).alias("draws"))
    none = F.array().cast("array<struct<shard:int,past:bigint>>")
    return at.join(draws, ["no", "block"], "left").select("source", "block", "source_size", "target", F.coalesce("draws", none).alias("draws"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 8, size_col: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``row, block, source_size, target, shards``: each row of ``docs`` (a struct, so that no name clashes) and the shards that take it.

    One row for each input row, taken as often as ``shards`` is long. Sources
    are weighted 3, 1, 2 by code point order, null last. A source of no words,
    and an empty table, have nothing to take. Sizes are words of the text (null:
    0), or ``size_col`` where a caller has counted already; then no text is read. Rows
    that share an id, or have none, share a place, so they are taken alike. The
    table of sources, one small row each, is brought to the driver, where
    targets and the splitting tree are worked out; nothing else is. The table of
    drawn blocks is broadcast up to ``broadcast_rows`` rows.
    """
    source = F.col(f"`{source_col}`").cast("string")
    size = F.col(f"`{size_col}`") if size_col else word_count(text_col)
    small = cut(docs.select(source.alias("source"), _place(id_col, seed).alias("place"), size.alias("size")))
    drawn = cut(draw_blocks(small, total_share, most, shards, seed))
    if drawn.count() <= broadcast_rows:
        drawn = F.broadcast(drawn)
    place = _place(id_col, seed)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("own"), place.alias("place"), F.shiftright(place, _CELL_BITS - _BLOCK_BITS).cast("int").alias("at"))
    joined = named.join(drawn, F.col("own").eqNullSafe(F.col("source")) & (F.col("at") == F.col("block")), "left")
    taken = F.transform(F.filter("draws", lambda d: F.col("place") < d["past"]), lambda d: d["shard"])
    return joined.select("row", F.col("at").alias("block"), "source_size", "target", taken.alias("shards"))


def draw_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, seed: int = 8, **options) -> DataFrame:
    """The mix itself: ``docs``' columns as ``row`` and ``copy, shard``, a row for each copy taken, each shard shuffled by hash.

    Nulls, ties, repeated rows and empty tables are as in ``plan_mix``.
    """
    planned = plan_mix(docs, id_col, text_col, source_col, shards=shards, seed=seed, **options)
    rows = planned.select("row", F.posexplode("shards").alias("copy", "shard"))
    key = F.xxhash64(F.col("row").getField(id_col).cast("string"), "copy", F.lit(seed + 1))
    # a shard is spread over several tasks: whole shards may be large
    rows = rows.withColumn("key", key)
    return rows.repartition("shard", F.pmod("key", F.lit(8))).sortWithinPartitions("shard", "key").drop("key")
