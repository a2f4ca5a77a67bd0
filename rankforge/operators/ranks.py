"""Order statistics and percentiles of groups of any size, by counting passes over narrowing ranges.

A double's bits, as an integer that sorts as it does, are read 16 at a time: a
pass counts the rows of each range that a wanted rank may lie in by their next 16
bits, and the counts tell which of 65,536 smaller ranges the rank is in. After four
passes one value is left. Counts are merged before they are shuffled, so no task
holds a group, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows of a group that one task may hold; where all groups are as small, Spark's own percentiles are taken.
HELD = 1 << 16
_DIGIT, _SIGN = 16, (1 << 63) - 1


def _code(value: Column) -> Column:
    """An integer that sorts as the double does; both zeros are one, NaN is the largest."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))


def _value(code: Column) -> Column:
    bits = F.when(code >= 0, code).otherwise(code.bitwiseXOR(F.lit(_SIGN)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def order_statistics(values: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """``*keys, rank, value``: for each row ``*keys, rank`` of ``wanted`` the value that has ``rank`` values of its group before it in order.

    Null values don't count; a rank beyond a group gives no row. Null keys are keys like others.
    """
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    rows = written(values.where(F.col(value).isNotNull()).select(key.alias("key"), F.col(value).cast("double").alias("v")).select("key", _code(F.col("v")).alias("c")))
    state = wanted.select(key.alias("key"), F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("range"), F.col("rank").cast("long").alias("left")).distinct()
    for taken in range(_DIGIT, 65, _DIGIT):
        known = F.shiftright("c", 64 - taken + _DIGIT) if taken > _DIGIT else F.lit(0).cast("long")
        inside = rows.select("key", known.alias("range"), F.shiftright("c", 64 - taken).alias("next"))
        inside = inside.join(state.select("key", "range").distinct(), ["key", "range"], "left_semi")
        counts = inside.groupBy("key", "range", "next").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key", "range").orderBy("next"))  # at most 65,536 rows
        counts = counts.select("key", "range", "next", (upto - F.col("n")).alias("before"), upto.alias("upto"))
        found = state.join(counts, ["key", "range"]).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("upto")))
        state = written(found.select("key", "rank", F.col("next").alias("range"), (F.col("left") - F.col("before")).alias("left")))
    return state.select(*[F.col(f"key.{k}").alias(k) for k in keys], "rank", _value(F.col("range")).alias("value"))


def _largest(rows: DataFrame, keys: list[str]) -> int:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def percentiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], discrete: bool = False, held: int = HELD) -> DataFrame:
    """``*keys`` and a column for each name of ``shares``: exact percentiles, interpolated or (``discrete``) the least value that a share of the rows doesn't exceed.

    Groups of nulls alone have no row. Both ways, for small groups and beyond ``held`` rows, give the same.
    """
    rows = written(values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")))
    if _largest(rows, keys) <= held:
        of = (lambda p: F.expr(f"percentile_disc({p}D) within group (order by __v)")) if discrete else (lambda p: F.percentile("__v", F.lit(p)))
        return rows.groupBy(*keys).agg(*[of(p).alias(name) for name, p in shares.items()])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    place = F.greatest(F.ceil(F.col("__p") * F.col("__n")) - 1, F.lit(0)).cast("double") if discrete else F.col("__p") * (F.col("__n") - 1)
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("__name"), F.lit(float(p)).alias("__p")) for n, p in shares.items()]))
    places = sizes.select(*keys, "__n", names.alias("x")).select(*keys, "__n", "x.*").select(*keys, "__name", place.alias("__at"))
    ends = places.select(*keys, "__name", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("rank"))
    found = order_statistics(rows, keys, "__v", ends.select(*keys, "rank")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = ends.withColumnRenamed("rank", "__r").join(found, same & (F.col("__r") == F.col("rank")))
    low, high = F.floor("__at").cast("double"), F.ceil("__at").cast("double")
    weight = F.when(low == high, F.lit(1.0)).when(F.col("rank") == low, high - F.col("__at")).otherwise(F.col("__at") - low)
    wide = both.groupBy(*keys, "__name").agg((F.sum(weight * F.col("value"))).alias("v"))
    return wide.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("v"))).alias(n) for n in shares])
