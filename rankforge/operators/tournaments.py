"""Telemetry of tournament selections: counts of each event, and their roll-up by query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def selection_counts(events: DataFrame) -> DataFrame:
    """Events ``m, selected array`` with what a selection has too few, too many or twice; null where nothing was selected."""
    n = F.when(F.col("selected").isNotNull(), F.size("selected"))
    unique = F.when(F.col("selected").isNotNull(), F.size(F.array_distinct("selected")))
    out = events.withColumns({"selected_count": n, "unique_selected_count": unique, "duplicate_slots": n - unique, "count_delta": n - F.col("m")})
    # greatest and least skip nulls, so they are asked only where there is a count
    some = lambda c: F.when(F.col("count_delta").isNotNull(), c)
    return out.withColumns({"under_selection_slots": some(F.greatest(-F.col("count_delta"), F.lit(0))), "over_selection_slots": some(F.greatest(F.col("count_delta"), F.lit(0))), "count_matches": F.col("count_delta") == 0, "selection_unique": F.col("duplicate_slots") == 0})


def tournament_telemetry(counted: DataFrame, walls: DataFrame) -> DataFrame:
    """One row for each query from its counted events and ``qid, wall_seconds``.

    A call is an event; repairs are charged apart as retries. Slots are summed,
    calls with any such slot are counted.
    """
    f = F.col
    calls = lambda c: F.count_if(f(c) > 0)
    sums = [F.sum(c).alias(c) for c in ("retry_calls", "prompt_tokens", "completion_tokens", "retry_seconds")]
    slots = [x for c in ("duplicate_slots", "under_selection_slots", "over_selection_slots") for x in (F.sum(c).alias(c), calls(c).alias(c.replace("slots", "calls")))]
    flags = [F.count_if(~f("format_valid")).alias("format_failure_calls"), F.count_if(~f("initial_format_valid")).alias("initial_format_failure_calls"), F.count_if("format_repair_succeeded").alias("format_repair_successes")]
    rolled = counted.groupBy("qid").agg(F.count("*").alias("nominal_calls"), F.sum("duration_seconds").alias("request_seconds_sum"), *sums, *slots, *flags).join(walls, "qid")
    return rolled.withColumns({"retry_inclusive_llm_calls": f("nominal_calls") + f("retry_calls"), "retry_excluded_wall_seconds": F.greatest(f("wall_seconds") - f("retry_seconds"), F.lit(0.0))})


def tournament_points(selections: DataFrame, pool: DataFrame) -> DataFrame:
    """``qid, docid, points, rank``: a point for each selection ``qid, docid``; ties keep the order ``pos`` of the pool."""
    points = selections.groupBy("qid", "docid").agg(F.count("*").alias("points"))
    got = pool.select("qid", "docid", "pos").join(points, ["qid", "docid"], "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return got.select("qid", "docid", "points", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("points"), "pos")).alias("rank"))
