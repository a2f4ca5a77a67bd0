"""Statistics of runs: stability, paired tests, multiple testing, position bias, macro tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import random_parts, ranks

# --- fixed values: two-sided 95 % points of Student's t for 1 to 30 degrees of freedom, then the normal one ---
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
Z95 = 1.96
# --- end of fixed values ---


def _t95(df: Column) -> Column:
    table = F.array(*map(F.lit, T95))
    return F.when(df.between(1, len(T95)), F.try_element_at(table, df.cast("int"))).when(df > len(T95), F.lit(Z95))


def summarize(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample and population spread, 95 % interval, extremes and coefficient of variation of each group."""
    v = F.col(value)
    g = values.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var_sample"), F.var_pop(v).alias("var_pop"), F.stddev_samp(v).alias("std_sample"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    err = F.col("std_sample") / F.sqrt("n")
    half = err * _t95(F.col("n") - 1)
    return g.select("*", err.alias("stderr"), (F.col("mean") - half).alias("ci95_low"), (F.col("mean") + half).alias("ci95_high"), (F.col("max") - F.col("min")).alias("range"), F.try_divide(F.col("std_sample"), F.abs("mean")).alias("cv"))


def pivot_runs(values: DataFrame, keys: list[str], runs: list[str]) -> DataFrame:
    """A column for each run id and ``missing_run_ids``, joined by ``;``. The last file of a run counts."""
    last = values.groupBy(*keys, "run_id").agg(F.max_by("value", "path").alias("value"))
    wide = last.groupBy(*keys).pivot("run_id", runs).agg(F.first("value"))
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(f"`{r}`").isNull(), F.lit(r)) for r in runs]), lambda x: x.isNotNull()), ";")
    return wide.withColumn("missing_run_ids", missing)


def query_stability(values: DataFrame, keys: list[str], held: int = ranks.HELD) -> DataFrame:
    """Per-query spread over runs, summed up over queries; queries of one run have no spread and are left out. No task holds a group of more than ``held`` queries."""
    per = values.groupBy(*keys, "qid").agg(F.stddev_samp("value").alias("std"), (F.max("value") - F.min("value")).alias("range")).where("std is not null")
    per = written(per.select(F.struct(*keys).alias("key"), "std", "range"))
    aggs = [F.count("*").alias("queries")]
    for c in ("std", "range"):
        aggs += [F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    aggs += [F.count_if(F.col("std") > t).alias(f"std_above_{str(t).replace('.', '_')}") for t in (0.001, 0.005, 0.01)]
    out = per.groupBy("key").agg(*aggs)
    for c in ("std", "range"):
        out = out.join(ranks.percentiles(per, ["key"], c, {f"median_{c}": 0.5, f"p90_{c}": 0.9}, held=held), "key")
    return out.select("key.*", *[c for c in out.columns if c != "key"])


def nearest_rank_p95(values: DataFrame, keys: list[str], value: str = "value", held: int = ranks.HELD) -> DataFrame:
    """``*keys, p95``; null for a group without values."""
    groups = values.select(F.struct(*keys).alias("key"), F.col(value).alias("value"))
    found = ranks.percentiles(groups, ["key"], "value", {"p95": 0.95}, discrete=True, held=held)
    return groups.select("key").distinct().join(found, "key", "left").select("key.*", "p95")


def most_stable(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.asc("std_sample"), "method", "condition", "topk").limit(n)


def run_averages(telemetry: DataFrame) -> DataFrame:
    cols = ["llm_calls", "retry_inclusive_llm_calls", "actual_prompt_tokens", "actual_completion_tokens", "wall_seconds"]
    return telemetry.where("status = 'ok'").groupBy("method").agg(F.count("*").alias("queries"), *[F.avg(c).alias(f"avg_{c}") for c in cols])


# ---- paired tests -------------------------------------------------------------


def pair_strict(system: DataFrame, reference: DataFrame) -> DataFrame:
    """``metric, qid, a, b``; queries on one side only are an error when the rows are read."""
    both = system.select("metric", "qid", F.col("value").alias("a")).join(reference.select("metric", "qid", F.col("value").alias("b")), ["metric", "qid"], "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.withColumn("a", F.when(ok, F.col("a")).otherwise(F.raise_error(F.lit("qid mismatch")).cast("double")))


def pair_lenient(system: DataFrame, reference: DataFrame) -> DataFrame:
    return system.select("metric", "qid", F.col("value").alias("a")).join(reference.select("metric", "qid", F.col("value").alias("b")), ["metric", "qid"])


def bootstrap(values: list[float], samples: int, seed: int) -> tuple[float, float, float]:
    """Mean and percentile interval of resampled means, drawn as ``random.Random(seed).randrange`` would."""
    v = np.asarray(values, dtype=float)
    means = np.sort(random_parts.bootstrap_means(v, seed, samples, 0, 1, 0, 0))
    return sum(values) / len(values), float(means[int(0.025 * samples)]), float(means[min(samples - 1, int(0.975 * samples))])


def sign_flip(values: list[float], samples: int, seed: int, shift: float = 0.0, two_sided: bool = True) -> float:
    """Share of random signs, a sign kept where ``random.Random(seed).random() < 0.5``, with a mean at least as large; ties count up to rounding."""
    return (random_parts.sign_flip_hits(np.asarray(values, dtype=float), seed, 0, samples, [(shift, two_sided)])[0] + 1) / (samples + 1)


def randomization(a: list[float], b: list[float], samples: int, seed: int) -> float:
    d = np.asarray(a) - np.asarray(b)
    return 1.0 if d.mean() == 0 else (1 + random_parts.randomization_hits(d, seed, 0, samples)) / (samples + 1)


#: Numbers that a part draws, about, where that makes no more parts than the two below allow.
PART_DRAWS = 1 << 25
#: Parts of all comparisons together, and parts that each may have in any case. A part is sent the comparison's values, so their number must not grow with these.
MOST_PARTS, LEAST_PARTS = 1 << 10, 8
#: Numbers that a task draws, at least, where parts are dealt to more tasks than there are shuffle partitions.
TASK_DRAWS = 1 << 28


def parts_of(n: Column, draws: int, comparisons: int) -> Column:
    """Parts of a comparison of ``n`` values that draws ``draws`` numbers for each, one of ``comparisons``."""
    most = max(LEAST_PARTS, MOST_PARTS // max(1, comparisons))
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(draws * n.cast("long") / PART_DRAWS))).cast("int")


def paired_tests(pairs: DataFrame, samples: int = 10_000, seed: int = 929, delta: float = 0.01, random_samples: int = 100_000, parts: int | None = None) -> DataFrame:
    """Superiority and non-inferiority of each comparison in ``ordinal, name, family, qid, a, b``.

    The seed of a comparison is the base seed plus its ordinal. The bootstrap
    and the sign flips take ``samples``, the randomisation test
    ``random_samples``. A comparison's samples are drawn in ``parts`` (by default
    as many as ``parts_of`` says), each at its place in the seed's streams: results
    don't depend on their number. A bootstrap that is one part needs no count of the
    indices before it, hence no second drawing: so it is by default where the
    comparisons are enough to keep all cores busy. Counts of parts are summed up, the
    interval's ends are found by counting passes over all means; a row holds the
    comparison's values, one a query.
    """
    rows = F.array_sort(F.collect_list(F.struct("qid", "a", "b")))
    cells = pairs.groupBy("ordinal").agg(F.first("name").alias("name"), F.first("family").alias("family"), F.transform(rows, lambda x: x["a"] - x["b"]).alias("d"))
    cells = written(cells.select(F.col("ordinal").cast("int").alias("ordinal"), "name", "family", "d"))
    spark, (comparisons, values) = pairs.sparkSession, cells.agg(F.count("*"), F.coalesce(F.sum(F.size("d")), F.lit(0))).first()
    number = F.lit(parts) if parts else parts_of(F.size("d"), 2 * samples + random_samples, comparisons)
    alone = not parts and comparisons >= 4 * spark.sparkContext.defaultParallelism
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("means"), (F.lit(1) if alone else number).alias("parts")), F.struct(F.lit(False).alias("means"), number.alias("parts"))))
    asked = cells.select("ordinal", F.size("d").alias("n"), kinds.alias("kind")).select("ordinal", "n", "kind.*")
    dealt = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(dealt.count(), values * (2 * samples + random_samples) // TASK_DRAWS))  # few rows, long work: no core is to wait for a task of many

    def count(batches):
        for g in batches:
            g["found"] = [random_parts.count_indices(n, seed + o, samples, p, k) if means else 0 for o, n, means, p, k in zip(g.ordinal, g.n, g.means, g.part, g.parts, strict=True)]
            yield g[["ordinal", "means", "part", "parts", "found"]]

    if alone:
        counted = dealt.select("ordinal", "means", "part", "parts", F.lit(0).cast("long").alias("found"))
    else:
        counted = dealt.repartition(tasks, "ordinal", "means", "part").mapInPandas(count, "ordinal int, means boolean, part int, parts int, found long")
    before = F.coalesce(F.sum("found").over(Window.partitionBy("ordinal", "means").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.select("ordinal", "d").join(counted.withColumn("before", before), "ordinal").repartition(tasks, "ordinal", "means", "part")

    def draw(g):  # a part is a group, hence an Arrow batch: many rows' values never meet in one
        (o, p, d, n, found, start, resample), = g[["ordinal", "part", "d", "parts", "found", "before", "means"]].itertuples(index=False)
        d, s = np.asarray(d, dtype=float), seed + int(o)
        level = bool(d.mean() == 0)
        means, superior, noninferior, random = [], 0, 0, 0
        if resample:
            means = random_parts.bootstrap_means(d, s, samples, p, n, start, found)
        else:
            flips = [samples * k // n for k in (p, p + 1)]
            tries = [random_samples * k // n for k in (p, p + 1)]
            superior, noninferior = random_parts.sign_flip_hits(d, s, *flips, [(0.0, True), (delta, False)])
            random = 0 if level else random_parts.randomization_hits(d, s, *tries)
        return pd.DataFrame({"ordinal": [o], "mean": [sum(d.tolist()) / len(d)], "superior": [superior], "noninferior": [noninferior], "random": [random], "level": [level], "means": [means]})

    drawn = written(placed.groupBy("ordinal", "means", "part").applyInPandas(draw, "ordinal int, mean double, superior long, noninferior long, random long, level boolean, means array<double>")).coalesce(least)
    share = lambda c, n: (F.sum(c) + 1) / (n + 1)
    sums = drawn.groupBy("ordinal").agg(F.max("mean").alias("mean_delta"), share("superior", samples).alias("p_superior"), share("noninferior", samples).alias("p_noninferior"), F.when(F.max("level"), 1.0).otherwise(share("random", random_samples)).alias("p_random"))
    low, high = int(0.025 * samples), min(samples - 1, int(0.975 * samples))
    ends = cells.select("ordinal", F.explode(F.array(F.lit(low), F.lit(high))).alias("rank"))
    found = ranks.order_statistics(drawn.select("ordinal", F.explode("means").alias("mean")), ["ordinal"], "mean", ends)
    found = found.groupBy("ordinal").agg(F.max(F.when(F.col("rank") == low, F.col("value"))).alias("ci_low"), F.max(F.when(F.col("rank") == high, F.col("value"))).alias("ci_high"))
    out = cells.select("ordinal", "name", "family", F.size("d").cast("long").alias("n")).join(sums, "ordinal").join(found, "ordinal")
    return out.select("ordinal", "name", "family", "n", "mean_delta", "ci_low", "ci_high", "p_superior", "p_noninferior", "p_random")


def holm(tests: DataFrame, p: str = "p", family: str = "family", order: str = "ordinal", name: str = "p_holm") -> DataFrame:
    """Holm's step-down within a family: running maximum of (n - i + 1) * p, at most 1; ties keep their order."""
    by = Window.partitionBy(family).orderBy(p, order)
    n = F.count("*").over(Window.partitionBy(family))
    raw = F.least(F.lit(1.0), (n - F.row_number().over(by) + 1) * F.col(p))
    return tests.withColumn("__raw", raw).withColumn(name, F.max("__raw").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def bonferroni(tests: DataFrame, p: str = "p", delta: str = "mean_delta", alpha: float = 0.05) -> DataFrame:
    """``p`` times the number of all rows; the number comes from an aggregate, not from one window over all."""
    total = tests.agg(F.count("*").alias("__m"))
    out = tests.crossJoin(F.broadcast(total))  # one row
    adj = F.least(F.lit(1.0), F.col(p) * F.col("__m"))
    way = F.when(F.col(delta) > 0, "better").when(F.col(delta) < 0, "worse").otherwise("equal")
    return out.withColumn("p_bonferroni", adj).withColumn("significant", F.col(p) * F.col("__m") < alpha).withColumn("direction", way).drop("__m")


def sign_test(plus: Column, minus: Column) -> Column:
    """Exact two-sided sign test from counts of positive and negative differences.

    The binomial terms are scaled by 2 ** -512 whenever they grow beyond it, and
    ``e`` counts the binary places taken off, so no count overflows.
    """
    n = plus + minus
    low = F.least(plus, minus)

    def term(acc, k):
        scale = F.when(acc["s"] > 2.0**512, 2.0**-512).otherwise(1.0)
        c = acc["c"] * scale * (n - k + 1) / k
        return F.struct(c.alias("c"), (acc["s"] * scale + c).alias("s"), (acc["e"] + F.when(acc["s"] > 2.0**512, 512).otherwise(0)).alias("e"))

    def share(tail):
        places = tail["e"] - n
        half = F.floor(places / 2)  # in two parts: 2 ** places alone may underflow where the product does not
        return 2 * tail["s"] * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), places - half)

    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"), F.lit(0).alias("e"))
    p = F.aggregate(F.when(low >= 1, F.sequence(F.lit(1).cast("bigint"), low)).otherwise(F.array().cast("array<bigint>")), start, term, share)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def condition_deltas(values: DataFrame, keys: list[str], base: str = "forward") -> DataFrame:
    """Each condition against ``base`` over the same queries: mean difference, signs, exact sign test."""
    v = values.where("qid <> 'all'")
    f = v.where(F.col("condition") == base).select(*keys, "metric", "qid", F.col("value").alias("b"))
    both = v.where(F.col("condition") != base).join(f, [*keys, "metric", "qid"]).withColumn("d", F.col("value") - F.col("b"))
    g = both.groupBy(*keys, "metric", "condition").agg(F.count("*").alias("queries"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"), F.count_if(F.col("d") == 0).alias("ties"))
    return g.withColumn("p_sign", sign_test(F.col("plus"), F.col("minus")))


# ---- position bias --------------------------------------------------------------


def position_bias(log: DataFrame) -> DataFrame:
    """``type, position, label, count, frequency, expected, mark`` for all positions of a type's longest window, unused ones too.

    Labels are those of the longest window, the last by order if there are
    several. Types whose rows name more than one ``label_scheme`` are an error.
    """
    if "label_scheme" in log.columns:
        schemes = log.groupBy("type").agg(F.count_distinct("label_scheme").alias("schemes"))
        mixed = F.when(F.col("schemes") > 1, F.raise_error(F.concat(F.lit("mixed label schemes in "), "type")).cast("string")).otherwise(F.col("type"))
        log = log.join(schemes, "type").withColumn("type", mixed)
    one = log.select("type", "positions", F.array_position("positions", F.col("selected")).alias("position"))
    size = one.groupBy("type").agg(F.max(F.size("positions")).alias("n"), F.count_if(F.col("position") > 0).alias("total"), F.max(F.struct(F.size("positions"), "positions"))["positions"].alias("labels"))
    hits = one.where("position > 0").groupBy("type", F.col("position").cast("int").alias("position")).agg(F.count("*").alias("hits"))
    cells = size.select("type", "n", "total", "labels", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position")).where("n > 0")
    freq, exp = F.try_divide(F.coalesce("hits", F.lit(0)), F.col("total")), 1 / F.col("n")
    mark = F.when(freq > 1.3 * exp, "up").when(freq < 0.7 * exp, "down").otherwise("")
    got = cells.join(hits, ["type", "position"], "left")
    return got.select("type", "position", F.get("labels", F.col("position") - 1).alias("label"), F.coalesce("hits", F.lit(0)).alias("count"), freq.alias("frequency"), exp.alias("expected"), mark.alias("mark"))


def position_chi2(bias: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy("type"))
    e = bias.withColumn("e", total * F.col("expected"))
    return e.groupBy("type").agg(F.sum(F.try_divide(F.pow(F.col("count") - F.col("e"), F.lit(2)), F.col("e"))).alias("chi2"), (F.count("*") - 1).alias("df"))


def position_bias_adjusted(log: DataFrame) -> DataFrame:
    """As ``position_bias``, expected by each window's own size, for windows that shrink from round to round."""
    one = log.select("type", F.size("positions").alias("n"), F.array_position("positions", F.col("selected")).cast("int").alias("at")).where("at > 0")
    by_size = one.groupBy("type", "n").agg(F.count("*").alias("c"))
    expected = by_size.select("type", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position"), (F.col("c") / F.col("n")).alias("e")).groupBy("type", "position").agg(F.sum("e").alias("expected_count"))
    hits = one.groupBy("type", F.col("at").alias("position")).agg(F.count("*").alias("count"))
    return expected.join(hits, ["type", "position"], "left").fillna(0, ["count"])


# ---- tables ---------------------------------------------------------------------


def macro_means(cells: DataFrame, subsets: dict[str, list[str]], value: str = "value") -> DataFrame:
    """Mean over the models of each subset, null unless all members have a value; complete only if all are."""
    out = None
    for name, members in subsets.items():
        v = F.col(value)
        part = cells.where(F.col("model").isin(members)).groupBy("dataset", "method").agg(
            F.when(F.count(v) == F.count("*"), F.avg(v)).alias("mean"), F.when(F.bool_and(F.col("status") == "complete"), "complete").otherwise("incomplete").alias("status"), F.sum("queries").alias("queries")
        ).withColumn("subset", F.lit(name))
        out = part if out is None else out.unionAll(part)
    return out


def group_totals(telemetry: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of successful rows; rows of one batch share its wall time, which counts once."""
    ok = telemetry.where("status = 'ok'")
    wall = ok.groupBy(*keys, F.coalesce("batch_id", F.concat(F.lit("q:"), "qid")).alias("unit")).agg(F.max("wall_seconds").alias("w")).groupBy(*keys).agg(F.sum("w").alias("wall_seconds"))
    return ok.groupBy(*keys).agg(F.count("*").alias("queries"), F.sum("llm_calls").alias("llm_calls"), F.sum("total_tokens").alias("total_tokens")).join(wall, keys)


def selection_accuracy(log: DataFrame) -> DataFrame:
    """``type, position, correct, total, accuracy``: selections of the most (or for ``worst`` types the least) relevant of the window.

    ``log`` has ``type, positions, selected, relevances``; rows without relevances or
    with a label beyond the window don't count. Position -1 is all positions.
    """
    at = F.array_position("positions", F.col("selected")).cast("int")
    rows = log.where("relevances is not null").withColumn("at", at).where("at > 0")
    want = F.when(F.col("type").isin("best", "dual_best"), F.array_max("relevances")).when(F.col("type").isin("worst", "dual_worst"), F.array_min("relevances"))
    right = F.coalesce(F.element_at("relevances", F.col("at")) == want, F.lit(False))
    cells = rows.select("type", F.explode(F.array(F.col("at") - 1, F.lit(-1))).alias("position"), right.alias("right"))
    got = cells.groupBy("type", "position").agg(F.count_if("right").alias("correct"), F.count("*").alias("total"))
    return got.withColumn("accuracy", F.col("correct") / F.col("total"))


#: The whole-pool methods that tables over models keep.
WHOLE_POOL_METHODS = ("dualend", "maxctx_topdown", "maxctx_bottomup")


def cross_model_union(summaries: dict[str, DataFrame], family, every_method: bool = False) -> DataFrame:
    """Stability summaries of several models (by tag) in one table with ``model_tag, model_family``; only whole-pool methods unless ``every_method``."""
    out = None
    for tag, table in summaries.items():
        part = table.withColumn("model_tag", F.lit(tag)).withColumn("model_family", family(F.lit(tag)))
        part = part if every_method else part.where(F.col("method").isin(*WHOLE_POOL_METHODS))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def parse_specs(specs: DataFrame) -> DataFrame:
    """``name, family, system, reference, metric, direction`` of ``spec`` texts with six fields between bars; others are errors."""
    f = F.split("spec", r"\|")
    good = (F.size(f) == 6) & F.get(f, 5).isin("higher", "lower")
    f = F.when(good, f).otherwise(F.raise_error(F.concat(F.lit("bad comparison: "), "spec")).cast("array<string>"))
    names = ("name", "family", "system", "reference", "metric", "direction")
    return specs.select(f.alias("f")).select(*[F.get("f", k).alias(n) for k, n in enumerate(names)])


def valid_ordinals(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Comparisons ``…, n`` that have queries in common, with ``ordinal`` counted from 0 in the order of the loop; others take no number."""
    return pairs.where("n > 0").withColumn("ordinal", F.row_number().over(Window.orderBy(*order)) - 1)
