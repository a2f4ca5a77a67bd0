"""Registered queries, one for each operator or family, with DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels, text, udfs
from ..operators import audit, metrics, ranks, rerank, stats, tournaments
from ..operators.comparators import NoisyComparator, TextComparator
from ..sources import readers, writers
from ..streaming import jobs
from . import attempts, base, files, integrity, overlaps, streams  # noqa: F401  (these register queries)
from .base import LOG_SQL, POOL_SQL, VALUES_SQL
from .register import QUERIES, SQL, query

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of each query after whole-pool top-down re-ranking, with its nDCG@10."""
    got = rerank.rankings(rerank.rerank(base.first_stage(spark, sf_dir), "whole_topdown", base.HITS), 10)
    return got.join(metrics.ndcg(got, base.judgements(spark, sf_dir)), "qid").select("qid", "rank", "docid", "score", F.col("value").alias("ndcg_cut_10"))


# ---- first stage --------------------------------------------------------------


@query(POOL_SQL + " SELECT qid, pos, docid, score FROM pool")
def first_stage_top_hits(spark, d):
    return base.first_stage(spark, d).select("qid", F.col("pos").cast("long").alias("pos"), "docid", "score")


@query(POOL_SQL + " SELECT qid, sum(pos)::BIGINT AS ranks, sum(length(b.text))::BIGINT AS query_chars, sum(length(t.text))::BIGINT AS chars FROM pool JOIN benchmark b ON b.item_id::VARCHAR = qid JOIN documents t ON t.doc_id::VARCHAR = docid GROUP BY qid")
def pool_join(spark, d):
    run = base.first_stage(spark, d).withColumn("rank", F.col("pos"))
    qs = base.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    docs = base.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text")
    pool = readers.build_pool(run, qs, docs, base.HITS)
    return pool.groupBy("qid").agg(F.sum("pos").alias("ranks"), F.sum(F.length("query")).cast("long").alias("query_chars"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(POOL_SQL + " SELECT qid, string_agg(docid, ',' ORDER BY pos) AS docids FROM pool WHERE pos <= 5 GROUP BY qid")
def expected_pools(spark, d):
    return readers.expected_pools(base.first_stage(spark, d), 5).select("qid", F.array_join("docids", ",").alias("docids"))


# ---- re-ranking -----------------------------------------------------------------

_SORTED = " SELECT qid, docid, CASE WHEN r <= {k} THEN r ELSE {k} + row_number() OVER (PARTITION BY qid, r > {k} ORDER BY pos) END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hidden DESC) AS r FROM pool)"


def _ranked(spark, d, method, k=base.HITS, **o):
    return rerank.rankings(rerank.rerank(base.first_stage(spark, d), method, k, **o)).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


def _exact(name: str, method: str, k: int, **o):
    def f(spark, d):
        return _ranked(spark, d, method, k, **o)

    f.__name__ = name
    query(POOL_SQL + _SORTED.format(k=k))(f)


for _name, _method, _k, _o in [
    ("rerank_topdown_heapsort", "topdown_heapsort", 10, {"c": 3}),
    ("rerank_bottomup_heapsort", "bottomup_heapsort", 10, {"c": 3}),
    ("rerank_bottomup_bubblesort", "bottomup_bubblesort", 10, {"c": 3}),
    ("rerank_dual_selection_window", "dual_selection", base.HITS, {"c": base.HITS - 1}),
    ("rerank_dual_heapsort", "dual_heapsort", 10, {"c": 2}),
    ("rerank_selective_heapsort", "selective_heapsort", 10, {"c": 3, "gate": "uncertain"}),
    ("rerank_pairwise_heapsort", "pairwise_heapsort", 10, {}),
    ("rerank_pairwise_bubblesort", "pairwise_bubblesort", 10, {}),
    ("rerank_allpair_procedure", "allpair", 10, {}),
    ("rerank_whole_dualend", "whole_dualend", base.HITS, {}),
    ("rerank_full_list", "full_list", base.HITS, {}),
]:
    _exact(_name, _method, _k, **_o)


def _traced(name: str, method: str, k: int, **o):
    def f(spark, d):
        return _ranked(spark, d, method, k, **o)

    f.__name__ = name
    query()(f)


for _name, _method, _k, _o in [
    ("rerank_topdown_bubblesort", "topdown_bubblesort", 10, {"c": 3}),
    ("rerank_cocktail", "cocktail", 10, {"c": 3}),
    ("rerank_dual_selection_tournament", "dual_selection", 10, {"c": 3}),
    ("rerank_selective_bubblesort", "selective_bubblesort", 10, {"c": 3, "gate": "hybrid"}),
    ("rerank_bias_aware", "bias_aware_bubblesort", 10, {"c": 3, "orders": 3}),
    ("rerank_same_call", "same_call_bubblesort", 10, {"c": 3}),
    ("rerank_listwise_windows", "listwise", base.HITS, {"window": 4, "step": 2}),
    ("rerank_tournaments", "tournaments", 10, {"times": 2}),
    ("rerank_whole_shuffled", "whole_topdown", base.HITS, {"how": "shuffle"}),
]:
    _traced(_name, _method, _k, **_o)


@query(POOL_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hidden DESC) AS r, count(*) OVER (PARTITION BY qid) AS n FROM pool)
SELECT qid, docid, CASE WHEN r <= n - 2 THEN r ELSE n - 2 + row_number() OVER (PARTITION BY qid, r > n - 2 ORDER BY score DESC, pos) END AS rank FROM s""")
def rerank_whole_topdown(spark, d):
    return _ranked(spark, d, "whole_topdown")


@query(POOL_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hidden DESC) AS r FROM pool)
SELECT qid, docid, CASE WHEN r > 2 THEN r ELSE row_number() OVER (PARTITION BY qid, r > 2 ORDER BY score DESC, pos) END AS rank FROM s""")
def rerank_whole_bottomup(spark, d):
    return _ranked(spark, d, "whole_bottomup")


@query(POOL_SQL + " SELECT qid, count(*) - 2 AS llm_calls, 1::BIGINT AS non_llm_bypasses, count(*) - 1 AS selection_steps, 'ok' AS status FROM pool GROUP BY qid")
def rerank_telemetry(spark, d):
    out = rerank.rerank(base.first_stage(spark, d), "whole_bottomup", base.HITS)
    return rerank.telemetry(out, "whole_bottomup", base.HITS, base.HITS).select("qid", "llm_calls", "non_llm_bypasses", "selection_steps", "status")


@query(POOL_SQL + " SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY hidden DESC, pos) AS rank FROM pool")
def pointwise(spark, d):
    return rerank.pointwise(base.first_stage(spark, d), F.col("hidden")).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


@query(POOL_SQL + """, p AS (SELECT a.qid, a.docid AS d1, a.pos AS p1, b.docid AS d2, b.pos AS p2, CASE WHEN abs(a.hidden - b.hidden) < 50000 THEN 0.5 WHEN a.hidden > b.hidden THEN 1.0 ELSE 0.0 END AS w FROM pool a JOIN pool b ON a.qid = b.qid AND a.pos < b.pos),
s AS (SELECT qid, d1 AS docid, p1 AS pos, w AS p FROM p UNION ALL SELECT qid, d2, p2, 1 - w FROM p)
SELECT qid, docid, sum(p)::DOUBLE AS points, row_number() OVER (PARTITION BY qid ORDER BY sum(p) DESC, pos) AS rank FROM s GROUP BY qid, docid, pos""")
def allpair_points(spark, d):
    agree = lambda a, b: F.expr(f"{a}_hidden - {b}_hidden >= 50000")  # noqa: E731  close pairs: the two orders disagree
    return rerank.allpair_points(base.first_stage(spark, d), agree).select("qid", "docid", "points", F.col("rank").cast("long").alias("rank"))


_FUSED = POOL_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hidden DESC) AS r1, pos AS r2, count(*) OVER (PARTITION BY qid) AS n FROM pool),
s AS (SELECT qid, docid, r1, {0} AS v FROM r) SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY v DESC, r1) AS rank, round(v, 6) AS score FROM s"""


def _fusion(name, how, expr):
    def f(spark, d):
        pool = base.first_stage(spark, d)
        one, two = rerank.pointwise(pool, F.col("hidden")), pool.select("qid", "docid", F.col("pos").alias("rank"))
        return rerank.fuse(one, two, how, 0.25).select("qid", "docid", F.col("rank").cast("long").alias("rank"), _r("score"))

    f.__name__ = name
    query(_FUSED.format(expr))(f)


_fusion("fusion_rrf", "rrf", "1 / (60 + r1) + 1 / (60 + r2)")
_fusion("fusion_combsum", "combsum", "(n - r1 + 1) / n + (n - r2 + 1) / n")
_fusion("fusion_weighted", "weighted", "0.25::DOUBLE * (n - r1 + 1) / n + 0.75::DOUBLE * (n - r2 + 1) / n")


@query(POOL_SQL + """, w AS (SELECT qid, k, max(score) OVER f AS hi, min(score) OVER f AS lo, count(*) OVER f AS c FROM pool, (VALUES (2), (3), (4)) t(k) WINDOW f AS (PARTITION BY qid, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
v AS (SELECT p.qid, k, (SELECT max(score) FROM pool x WHERE x.qid = p.qid AND x.pos BETWEEN p.pos AND p.pos + k - 1) AS hi, (SELECT min(score) FROM pool x WHERE x.qid = p.qid AND x.pos BETWEEN p.pos AND p.pos + k - 1) AS lo
 FROM pool p, (VALUES (2), (3), (4)) t(k) WHERE EXISTS (SELECT 1 FROM pool x WHERE x.qid = p.qid AND x.pos = p.pos + k - 1))
SELECT qid, k AS "window", round(quantile_cont((hi - lo) / greatest(abs(hi), abs(lo), 1e-6), 0.15), 6) AS threshold FROM v GROUP BY qid, k""")
def uncertainty_thresholds(spark, d):
    return rerank.uncertainty_thresholds(base.first_stage(spark, d), 3, 0.15).select("qid", "window", _r("threshold"))


@query(POOL_SQL + " SELECT qid, docid FROM pool WHERE qid::INT % 3 <> 0")
def checkpoint_resume(spark, d):
    pool = base.first_stage(spark, d)
    done = pool.select("qid").distinct().where("cast(qid as int) % 3 = 0").withColumn("protocol_hash", F.lit("p"))
    return rerank.resume(pool, done, "p")[0].select("qid", "docid")


@query()
def text_comparator(spark, d):
    """Answers as text through the grammar, one in five unusable at first: retries are charged apart."""

    def make():
        calls = {"n": 0}

        def generate(kind, q, docs):
            calls["n"] += 1
            if calls["n"] % 5 == 0:
                return "let me think", 5, 3, 0.1
            order = sorted(range(len(docs)), key=lambda k: -docs[k].hidden)
            return {"best": f"Passage {order[0] + 1}", "worst": f"Passage {order[-1] + 1}"}.get(kind, f"Best: {order[0] + 1}, Worst: {order[-1] + 1}"), 10, 2, 0.1

        return TextComparator(generate)

    out = rerank.rerank(base.first_stage(spark, d), "whole_dualend", base.HITS, make)
    return rerank.telemetry(out, "whole_dualend", base.HITS, base.HITS).drop("wall_seconds", "retry_excluded_wall_seconds")


@query()
def noisy_runs(spark, d):
    """Three seeds of a noisy comparator."""
    pool, out = base.first_stage(spark, d), None
    for seed in range(3):
        part = rerank.rankings(rerank.rerank(pool, "topdown_heapsort", 10, NoisyComparator(seed)), 10).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionAll(part)
    return out


# ---- metrics --------------------------------------------------------------------

_NDCG = POOL_SQL + """, g AS (SELECT qid, pos, coalesce(rel, 0) AS rel FROM pool LEFT JOIN qrels USING (qid, docid)),
dcg AS (SELECT qid, k, sum(CASE WHEN pos <= k THEN rel / log2(pos + 1) ELSE 0 END) AS v FROM g, (VALUES (5), (10), (20)) t(k) GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS pos FROM qrels WHERE rel > 0),
idcg AS (SELECT qid, k, sum(CASE WHEN pos <= k THEN rel / log2(pos + 1) ELSE 0 END) AS v FROM i, (VALUES (5), (10), (20)) t(k) GROUP BY ALL),
e AS (SELECT 'ndcg_cut_' || k AS metric, qid, coalesce(dcg.v / nullif(idcg.v, 0), 0) AS value FROM dcg LEFT JOIN idcg USING (qid, k))"""


@query(_NDCG + " SELECT metric, qid, round(value, 6) AS value FROM e UNION ALL SELECT metric, 'all', round(avg(value), 6) FROM e GROUP BY metric")
def ndcg(spark, d):
    run = base.first_stage(spark, d).withColumn("rank", F.col("pos"))
    return metrics.with_all(metrics.ndcg(run, base.judgements(spark, d), (5, 10, 20))).select("metric", "qid", _r("value"))


@query(base.pool_sql(20) + """, rel AS (SELECT qid, docid FROM qrels WHERE rel >= 1), h AS (SELECT p.qid, p.pos, r.docid IS NOT NULL AS hit FROM pool p LEFT JOIN rel r USING (qid, docid)),
f AS (SELECT *, sum(hit::INT) OVER (PARTITION BY qid ORDER BY pos) AS found FROM h)
SELECT 'map_cut_20' AS metric, qid, round(coalesce(sum(CASE WHEN hit THEN found / pos ELSE 0 END) / max(n), 0), 6) AS value FROM f LEFT JOIN (SELECT qid, count(*) AS n FROM rel GROUP BY qid) USING (qid) GROUP BY qid""")
def average_precision(spark, d):
    """Cut at 20, as its SQL says; ``average_precision_hits`` has the whole depth."""
    run = base.first_stage(spark, d, 20).withColumn("rank", F.col("pos"))
    return metrics.average_precision(run, base.judgements(spark, d), 20, 1).select("metric", "qid", _r("value"))


@query(POOL_SQL + f""", rel AS (SELECT qid, docid FROM qrels WHERE rel >= 1), h AS (SELECT p.qid, p.pos, r.docid IS NOT NULL AS hit FROM pool p LEFT JOIN rel r USING (qid, docid)),
f AS (SELECT *, sum(hit::INT) OVER (PARTITION BY qid ORDER BY pos) AS found FROM h)
SELECT 'map_cut_{base.HITS}' AS metric, qid, round(coalesce(sum(CASE WHEN hit THEN found / pos ELSE 0 END) / max(n), 0), 6) AS value FROM f LEFT JOIN (SELECT qid, count(*) AS n FROM rel GROUP BY qid) USING (qid) GROUP BY qid""")
def average_precision_hits(spark, d):
    run = base.first_stage(spark, d).withColumn("rank", F.col("pos"))
    return metrics.average_precision(run, base.judgements(spark, d), base.HITS, 1).select("metric", "qid", _r("value"))


# ---- paired tests ---------------------------------------------------------------

_CELLS = "SELECT method, condition, qid, avg(CASE WHEN run_id IN ('run1', 'run2', 'run3') THEN value END) AS a, avg(CASE WHEN run_id IN ('run4', 'run5', 'run6', 'run7') THEN value END) AS b FROM v GROUP BY ALL"
_TESTS = f"WITH v AS ({VALUES_SQL}), c AS ({_CELLS}), t AS (SELECT method, condition, count_if(a > b) AS plus, count_if(a < b) AS minus, round(avg(a - b), 9) AS mean_delta FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), p AS (SELECT method AS family, method || '/' || condition AS name, mean_delta, round((1.0 + plus % 97) / (98.0 + minus % 13), 9) AS p FROM t)"


def _tests(spark, d):
    v = base.run_values(spark, d)
    half = lambda ids: F.avg(F.when(F.col("run_id").isin(ids), F.col("value")))
    c = v.groupBy("method", "condition", "qid").agg(half([f"run{k}" for k in (1, 2, 3)]).alias("a"), half([f"run{k}" for k in (4, 5, 6, 7)]).alias("b")).where("a is not null and b is not null")
    t = c.groupBy("method", "condition").agg(F.count_if(F.expr("a > b")).alias("plus"), F.count_if(F.expr("a < b")).alias("minus"), F.round(F.avg(F.expr("a - b")), 9).alias("mean_delta"))
    return t.select(F.col("method").alias("family"), F.concat_ws("/", "method", "condition").alias("name"), "mean_delta", F.round((1.0 + F.col("plus") % 97) / (98.0 + F.col("minus") % 13), 9).alias("p"))


@query(_TESTS + " SELECT family, name, p, round(max(raw) OVER (PARTITION BY family ORDER BY p, name), 6) AS p_holm FROM (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p) AS raw FROM p)")
def holm(spark, d):
    return stats.holm(_tests(spark, d), order="name").select("family", "name", "p", _r("p_holm"))


@query(_TESTS + " SELECT name, round(least(1, p * count(*) OVER ()), 6) AS p_bonferroni, p * count(*) OVER () < 0.05 AS significant, CASE WHEN mean_delta > 0 THEN 'better' WHEN mean_delta < 0 THEN 'worse' ELSE 'equal' END AS direction FROM p")
def bonferroni(spark, d):
    return stats.bonferroni(_tests(spark, d)).select("name", _r("p_bonferroni"), "significant", "direction")


_DELTA = f"""WITH v AS ({VALUES_SQL} ), x AS (SELECT method, qid, run_id, max(CASE WHEN condition = 'F' THEN value END) AS b, max(CASE WHEN condition = 'O' THEN value END) AS a FROM v GROUP BY ALL),
g AS (SELECT method, run_id AS metric, count(*) AS queries, avg(a - b) AS mean_delta, count_if(a > b) AS plus, count_if(a < b) AS minus, count_if(a = b) AS ties FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT method, metric, queries, round(mean_delta, 6) AS mean_delta, plus, minus, ties FROM g"""


@query(_DELTA)
def condition_deltas(spark, d):
    v = base.run_values(spark, d).withColumnRenamed("run_id", "metric")
    return stats.condition_deltas(v, ["method"], "F").select("method", "metric", "queries", _r("mean_delta"), "plus", "minus", "ties")


@query("""WITH n AS (SELECT DISTINCT p_size AS a, p_partkey % 30 AS b FROM part WHERE p_size <= 30),
f AS (SELECT a, b, least(a, b) AS k, a + b AS n FROM n)
SELECT a, b, round(least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)))) / pow(2, n)), 6) AS p FROM f""")
def sign_test(spark, d):
    n = base.read(spark, d, "part").where("p_size <= 30").select(F.col("p_size").alias("a"), (F.col("p_partkey") % 30).alias("b")).distinct()
    return n.select("a", "b", F.round(stats.sign_test(F.col("a").cast("long"), F.col("b")), 6).alias("p"))


@query(f"""WITH v AS ({VALUES_SQL} ), x AS (SELECT method, qid, run_id, max(CASE WHEN condition = 'F' THEN value END) AS b, max(CASE WHEN condition = 'O' THEN value END) AS a FROM v GROUP BY ALL),
g AS (SELECT method, run_id AS metric, count_if(a > b)::BIGINT AS plus, count_if(a < b)::BIGINT AS minus FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), f AS (SELECT *, least(plus, minus) AS k, plus + minus AS n FROM g)
SELECT method, metric, plus, minus, round(least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p_sign FROM f""")
def condition_signs(spark, d):
    """The sign tests of ``condition_deltas``, whose SQL has no column for them."""
    v = base.run_values(spark, d).withColumnRenamed("run_id", "metric")
    return stats.condition_deltas(v, ["method"], "F").select("method", "metric", "plus", "minus", _r("p_sign"))


@query("""WITH n AS (SELECT DISTINCT p_size::BIGINT * 40 AS a, p_partkey::BIGINT // 10 AS b FROM part),
f AS (SELECT a, b, least(a, b) AS k, a + b AS n FROM n)
SELECT a, b, round(least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p FROM f""")
def sign_test_parts(spark, d):
    """As ``sign_test`` over all parts, with counts in the thousands."""
    n = base.read(spark, d, "part").select((F.col("p_size").cast("long") * 40).alias("a"), F.expr("cast(p_partkey as bigint) div 10").alias("b")).distinct()
    return n.select("a", "b", F.round(stats.sign_test(F.col("a"), F.col("b")), 6).alias("p"))


@query()
def paired_resampling(spark, d):
    """Bootstrap, sign flips and randomisation of each pair of runs in each cell of method and condition."""
    v = base.run_values(spark, d).select("method", "condition", "run_id", "qid", "value")
    one, two = v.withColumnsRenamed({"run_id": "r1", "value": "a"}), v.withColumnsRenamed({"run_id": "r2", "value": "b"})
    wide = one.join(two, ["method", "condition", "qid"]).where("r1 < r2 and a is not null and b is not null")
    wide = wide.select(F.concat_ws("/", "method", "condition", F.concat_ws("-", "r1", "r2")).alias("name"), "qid", "a", "b")
    names = wide.select("name").distinct()
    ordinals = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("ordinal"))  # one row for each comparison
    pairs = wide.join(F.broadcast(ordinals), "name").select("ordinal", "name", F.lit("f").alias("family"), "qid", "a", "b")
    return stats.paired_tests(pairs)


# ---- stability ------------------------------------------------------------------


@query(f"""WITH v AS ({VALUES_SQL}) SELECT method, condition, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_sample, round(var_pop(value), 6) AS var_pop, round(min(value), 6) AS min, round(max(value), 6) AS max,
round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 5) AS ci95_low, round(stddev_samp(value) / abs(avg(value)), 6) AS cv FROM v GROUP BY ALL HAVING count(*) > 31""")
def summarize(spark, d):
    got = stats.summarize(base.run_values(spark, d), ["method", "condition"]).where("n > 31")
    return got.select("method", "condition", "n", _r("mean"), _r("std_sample"), _r("var_pop"), _r("min"), _r("max"), _r("ci95_low", 5), _r("cv"))


@query(f"""WITH v AS ({VALUES_SQL}), q AS (SELECT method, condition, qid, stddev_samp(value) AS s, max(value) - min(value) AS r FROM v GROUP BY ALL HAVING count(*) > 1)
SELECT method, condition, count(*) AS queries, round(avg(s), 6) AS mean_std, round(quantile_cont(s, 0.5), 6) AS median_std, round(quantile_cont(s, 0.9), 6) AS p90_std, round(max(s), 6) AS max_std, round(quantile_cont(r, 0.9), 6) AS p90_range, count_if(s > 0.01) AS std_above_0_01 FROM q GROUP BY ALL""")
def query_stability(spark, d):
    got = stats.query_stability(base.run_values(spark, d), ["method", "condition"])
    return got.select("method", "condition", "queries", _r("mean_std"), _r("median_std"), _r("p90_std"), _r("max_std"), _r("p90_range"), "std_above_0_01")


@query(f"WITH v AS ({VALUES_SQL}) SELECT method, qid, " + ", ".join(f"max(CASE WHEN run_id = 'run{k}' THEN value END) AS run{k}" for k in range(1, 8)) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN count_if(run_id = 'run{k}') = 0 THEN 'run{k}' END" for k in range(1, 8)) + "], lambda x: x IS NOT NULL), ';') AS missing_run_ids FROM v WHERE condition = 'O' GROUP BY ALL")
def pivot_runs(spark, d):
    return stats.pivot_runs(base.run_values(spark, d).where("condition = 'O'"), ["method", "qid"], [f"run{k}" for k in range(1, 8)])


@query(f"WITH v AS ({VALUES_SQL}) SELECT method, condition, quantile_disc(value, 0.95) AS p95 FROM v GROUP BY ALL")
def nearest_rank_p95(spark, d):
    return stats.nearest_rank_p95(base.run_values(spark, d), ["method", "condition"])


@query("SELECT l_returnflag AS method, quantile_disc(l_extendedprice, 0.05) AS p05, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL")
def percentiles_by_passes(spark, d):
    """Groups of a third of all rows: no task holds one."""
    line = base.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), "l_extendedprice")
    return ranks.percentiles(line, ["method"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, discrete=True, held=0)


_BIAS_RELS = "array(1 + event_id % 3, event_id % 5, 1, 2, event_id % 7, 3, 2)"


@query(f"""WITH l AS (SELECT event_type, 3 + event_id % 5 AS n, 1 + (user_id * 7 + event_id) % (4 + event_id % 5) AS sel, [1 + event_id % 3, event_id % 5, 1, 2, event_id % 7, 3, 2] AS r7 FROM events),
c AS (SELECT CASE WHEN event_type < 'm' THEN 'best' ELSE 'dual_worst' END AS type, sel, r7[1:n] AS r FROM l WHERE sel <= n),
k AS (SELECT type, sel - 1 AS place, (CASE WHEN type = 'best' THEN list_max(r) ELSE list_min(r) END) = r[sel] AS ok FROM c)
SELECT type, position, count_if(ok) AS correct, count(*) AS total, round(count_if(ok) / count(*), 6) AS accuracy FROM (SELECT type, unnest([place, -1]) AS position, ok FROM k) GROUP BY ALL""")
def selection_accuracy(spark, d):
    log = base.read(spark, d, "events").join(base.comparison_log(spark, d).withColumnRenamed("type", "t0"), F.col("event_id").cast("string") == F.col("qid"))
    kind = F.when(F.col("event_type") < "m", "best").otherwise("dual_worst")
    log = log.select(kind.alias("type"), "positions", "selected", F.slice(F.expr(_BIAS_RELS), F.lit(1), F.size("positions")).alias("relevances"))
    return stats.selection_accuracy(log).select("type", F.col("position").cast("long").alias("position"), "correct", "total", _r("accuracy"))


@query(f"""WITH v AS ({VALUES_SQL}), s AS (SELECT method, condition, run_id, count(*) AS n, round(avg(value), 6) AS mean FROM v GROUP BY ALL)
SELECT run_id AS model_tag, 'other' AS model_family, CASE method WHEN 'A' THEN 'dualend' WHEN 'N' THEN 'maxctx_topdown' END AS method, condition, n, mean FROM s WHERE method <> 'R'""")
def cross_model_union(spark, d):
    """The runs stand for models here; one of three methods is no whole-pool method."""
    name = F.when(F.col("method") == "A", "dualend").when(F.col("method") == "N", "maxctx_topdown").otherwise("topdown_heapsort")
    v = base.run_values(spark, d).withColumn("method", name).groupBy("method", "condition", "run_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    tables = {f"run{k}": v.where(F.col("run_id") == f"run{k}").drop("run_id") for k in range(1, 8)}
    return stats.cross_model_union(tables, lambda tag: F.lit("other")).select("model_tag", "model_family", "method", "condition", "n", "mean")


_MACRO = "SELECT o_orderstatus AS method, o_orderpriority AS dataset, (o_custkey % 9)::VARCHAR AS model, CASE WHEN count(*) > 5 THEN round(avg(o_totalprice), 4) END AS value, CASE WHEN count(*) > 5 THEN 'complete' ELSE 'incomplete' END AS status, count(*) AS queries FROM orders GROUP BY ALL"


@query(f"WITH c AS ({_MACRO}), s AS (SELECT *, 'all9' AS subset FROM c UNION ALL SELECT *, 'some' FROM c WHERE model IN ('1', '2', '3')) SELECT dataset, method, subset, CASE WHEN count(value) = count(*) THEN round(avg(value), 3) END AS mean, CASE WHEN bool_and(status = 'complete') THEN 'complete' ELSE 'incomplete' END AS status, sum(queries)::BIGINT AS queries FROM s GROUP BY ALL")
def macro_means(spark, d):
    o = base.read(spark, d, "orders")
    c = o.groupBy(F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 9).cast("string").alias("model")).agg(F.count("*").alias("queries"), F.round(F.avg("o_totalprice"), 4).alias("v"))
    c = c.withColumn("value", F.when(F.col("queries") > 5, F.col("v"))).withColumn("status", F.when(F.col("queries") > 5, "complete").otherwise("incomplete"))
    return stats.macro_means(c, {"all9": [str(k) for k in range(9)], "some": ["1", "2", "3"]}).select("dataset", "method", "subset", _r("mean", 3), "status", "queries")


@query("""WITH t AS (SELECT o_orderstatus AS cell, o_custkey::VARCHAR AS batch_id, o_orderkey % 13 AS w, o_orderkey % 7 AS calls, CASE WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status FROM orders),
b AS (SELECT cell, batch_id, max(w) AS w FROM t WHERE status = 'ok' GROUP BY ALL)
SELECT cell, count(*) AS queries, sum(calls)::BIGINT AS llm_calls, max(x.w)::DOUBLE AS wall_seconds FROM t JOIN (SELECT cell, sum(w) AS w FROM b GROUP BY cell) x USING (cell) WHERE status = 'ok' GROUP BY cell""")
def group_totals(spark, d):
    t = base.read(spark, d, "orders").select(F.col("o_orderstatus").alias("cell"), F.col("o_orderkey").cast("string").alias("qid"), F.col("o_custkey").cast("string").alias("batch_id"), (F.col("o_orderkey") % 13).cast("double").alias("wall_seconds"), (F.col("o_orderkey") % 7).alias("llm_calls"), F.lit(1).alias("total_tokens"), F.when(F.col("o_orderkey") % 11 == 0, "error").otherwise("ok").alias("status"))
    return stats.group_totals(t, ["cell"]).select("cell", "queries", "llm_calls", "wall_seconds")


# ---- position bias ----------------------------------------------------------------


@query(f"""WITH l AS ({LOG_SQL}), s AS (SELECT type, max(n) AS n, count_if(sel <= n) AS total FROM l GROUP BY type), c AS (SELECT type, sel, count(*) AS hits FROM l WHERE sel <= n GROUP BY ALL),
g AS (SELECT s.type, p AS position, s.n, coalesce(hits, 0) AS count, coalesce(hits, 0) / total AS f FROM s, unnest(range(1, s.n + 1)) AS t(p) LEFT JOIN c ON c.type = s.type AND c.sel = p)
SELECT type, position::INT AS position, position::VARCHAR AS label, count, round(f, 6) AS frequency, round(1 / n, 6) AS expected, CASE WHEN f > 1.3 / n THEN 'up' WHEN f < 0.7 / n THEN 'down' ELSE '' END AS mark FROM g""")
def position_bias(spark, d):
    return stats.position_bias(base.comparison_log(spark, d)).select("type", "position", "label", "count", _r("frequency"), _r("expected"), "mark")


@query(f"""WITH l AS ({LOG_SQL}), s AS (SELECT type, max(n) AS n, count_if(sel <= n) AS total FROM l GROUP BY type), c AS (SELECT type, sel, count(*) AS hits FROM l WHERE sel <= n GROUP BY ALL)
SELECT s.type, round(sum(pow(coalesce(hits, 0) - total / s.n, 2) / (total / s.n)), 6) AS chi2, count(*) - 1 AS df FROM s, unnest(range(1, s.n + 1)) AS t(p) LEFT JOIN c ON c.type = s.type AND c.sel = p GROUP BY s.type""")
def position_chi2(spark, d):
    return stats.position_chi2(stats.position_bias(base.comparison_log(spark, d))).select("type", _r("chi2"), "df")


@query(f"""WITH l AS ({LOG_SQL}), o AS (SELECT * FROM l WHERE sel <= n), e AS (SELECT type, p AS position, sum(1 / n) AS expected_count FROM o, unnest(range(1, n + 1)) AS t(p) GROUP BY ALL)
SELECT e.type, e.position::INT AS position, round(expected_count, 4) AS expected_count, count(o.sel) AS count FROM e LEFT JOIN o ON o.type = e.type AND o.sel = e.position GROUP BY ALL""")
def position_bias_adjusted(spark, d):
    return stats.position_bias_adjusted(base.comparison_log(spark, d)).select("type", "position", _r("expected_count", 4), "count")


# ---- audits -----------------------------------------------------------------------


@query(POOL_SQL + """, run AS (SELECT qid, docid FROM pool WHERE qid::INT % 5 <> 0 AND NOT (qid::INT % 7 = 1 AND pos = 2) UNION ALL SELECT qid, docid FROM pool WHERE qid::INT % 3 = 1 AND pos = 1 AND qid::INT % 5 <> 0 UNION ALL SELECT 'extra', 'd'),
o AS (SELECT qid, count(*) AS n, count(DISTINCT docid) AS u, list_sort(list(DISTINCT docid)) AS s FROM run GROUP BY qid), w AS (SELECT qid, count(*) AS w, list_sort(list(DISTINCT docid)) AS s FROM pool GROUP BY qid)
SELECT 'duplicate_docids:' || qid AS error FROM o WHERE n > u UNION ALL SELECT 'wrong_depth:' || qid || ':' || n || ':expected_' || w FROM o JOIN w USING (qid) WHERE n <> w
UNION ALL SELECT 'pool_membership_mismatch:' || qid FROM o JOIN w USING (qid) WHERE o.s <> w.s
UNION ALL SELECT 'missing_qids:' || count(*) FROM w ANTI JOIN o USING (qid) HAVING count(*) > 0 UNION ALL SELECT 'unexpected_qids:' || count(*) FROM o ANTI JOIN w USING (qid) HAVING count(*) > 0""")
def audit_run(spark, d):
    pool, n = base.first_stage(spark, d), F.col("qid").cast("int")
    run = pool.where((n % 5 != 0) & ~((n % 7 == 1) & (F.col("pos") == 2))).select("qid", "docid").unionAll(pool.where((n % 3 == 1) & (F.col("pos") == 1) & (n % 5 != 0)).select("qid", "docid"))
    run = run.unionAll(spark.createDataFrame([("extra", "d")], "qid string, docid string"))
    return audit.audit_run(run, pool.select("qid", "docid"))


_TEL = "SELECT o_orderkey::VARCHAR AS qid, o_orderkey % 50 AS p, o_orderkey % 9 AS c, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS off, CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS step FROM orders"


@query(f"WITH t AS ({_TEL}) SELECT qid, unnest(['nominal_total', 'actual_total']) AS rule FROM t WHERE off = 1 UNION ALL SELECT qid, 'steps' FROM t WHERE step = 1")
def telemetry_violations(spark, d):
    k = F.col("o_orderkey")
    t = base.read(spark, d, "orders").select(k.cast("string").alias("qid"), (k % 50).alias("p"), (k % 9).alias("c"), (k % 17 == 0).cast("long").alias("off"), (k % 19 == 0).cast("long").alias("step"))
    zero = ", ".join(f"0L as retry_{x}_tokens" for x in ("prompt", "completion", "total"))
    t = t.selectExpr("1 as schema_version", "qid", "p as nominal_prompt_tokens", "c as nominal_completion_tokens", "p + c + off as nominal_total_tokens", zero.split(", ")[0], zero.split(", ")[1], zero.split(", ")[2], "p as actual_prompt_tokens", "c as actual_completion_tokens", "p + c as actual_total_tokens", "c as llm_calls", "c as retry_inclusive_llm_calls", "c + 1 + step as selection_steps", "1L as non_llm_bypasses", "2.0D as wall_seconds", "0.5D as retry_seconds", "1.5D as retry_excluded_wall_seconds")
    # a nominal total that is off breaks its own identity too
    return audit.telemetry_violations(t)


@query(POOL_SQL + """, l AS (SELECT qid, pos, CASE WHEN qid::INT % 4 = 1 AND pos = 3 THEN 'x' || docid ELSE docid END AS docid, CASE WHEN qid::INT % 6 = 2 AND pos = 1 THEN score + 1 ELSE score END AS score FROM pool WHERE qid::INT % 9 <> 0 AND NOT (qid::INT % 9 = 4 AND pos = 20)),
dp AS (SELECT coalesce(a.qid, b.qid) AS qid, a.n AS o, b.n AS l FROM (SELECT qid, count(*) AS n FROM pool GROUP BY qid) a FULL JOIN (SELECT qid, count(*) AS n FROM l GROUP BY qid) b ON a.qid = b.qid)
SELECT qid, 'qid' AS field, NULL::INT AS pos FROM dp WHERE o IS NULL OR l IS NULL UNION ALL SELECT qid, 'depth', NULL FROM dp WHERE o <> l
UNION ALL SELECT qid, 'docid', pos::INT FROM pool p JOIN l USING (qid, pos) WHERE p.docid <> l.docid AND qid IN (SELECT qid FROM dp WHERE o = dp.l) UNION ALL SELECT qid, 'score', pos::INT FROM pool p JOIN l USING (qid, pos) WHERE p.score <> l.score AND qid IN (SELECT qid FROM dp WHERE o = dp.l)""")
def pool_differences(spark, d):
    pool, n = base.first_stage(spark, d).withColumn("rank", F.col("pos")).withColumn("content", F.col("docid")), F.col("qid").cast("int")
    local = pool.where((n % 9 != 0) & ~((n % 9 == 4) & (F.col("pos") == 20)))
    local = local.withColumn("docid", F.when((n % 4 == 1) & (F.col("pos") == 3), F.concat(F.lit("x"), "docid")).otherwise(F.col("docid"))).withColumn("score", F.when((n % 6 == 2) & (F.col("pos") == 1), F.col("score") + 1).otherwise(F.col("score")))
    return audit.ordered_pool_differences(pool, local).select("qid", "field", "pos")


@query("""WITH l AS (SELECT o_custkey::VARCHAR AS cell, o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.log' ELSE '.out' END AS path, o_orderkey % 2 = 0 AS complete FROM orders),
g AS (SELECT cell, min(CASE WHEN complete AND path LIKE '%.log' THEN path END) AS log, min(CASE WHEN complete AND path LIKE '%.out' THEN path END) AS o, count_if(complete AND path LIKE '%.out') AS n FROM l GROUP BY cell)
SELECT cell, coalesce(log, CASE WHEN n = 1 THEN o END) AS path, CASE WHEN log IS NOT NULL THEN 'log' WHEN n = 1 THEN 'out' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM g""")
def completion_marker(spark, d):
    k = F.col("o_orderkey")
    logs = base.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cell"), F.concat(k.cast("string"), F.when(k % 3 == 0, ".log").otherwise(".out")).alias("path"), (k % 2 == 0).alias("complete"))
    return audit.completion_marker(logs)


@query(POOL_SQL + ", t AS (SELECT DISTINCT qid FROM pool WHERE qid::INT % 4 <> 1), r AS (SELECT DISTINCT qid FROM pool WHERE qid::INT % 6 <> 2) SELECT qid, 'telemetry' AS missing_in FROM (SELECT DISTINCT qid FROM pool) ANTI JOIN t USING (qid) UNION ALL SELECT qid, 'run' FROM (SELECT DISTINCT qid FROM pool) ANTI JOIN r USING (qid)")
def query_sets(spark, d):
    p, n = base.first_stage(spark, d).select("qid").distinct(), F.col("qid").cast("int")
    return audit.query_sets(p, p.where(n % 4 != 1), p.where(n % 6 != 2))


@query("SELECT count(*) AS prompts, max(length(text)) AS most, quantile_disc(length(text), 0.95) AS p95, count_if(length(text) > 2000 - 256) AS too_long FROM documents")
def context_fit(spark, d):
    return audit.context_fit(base.read(spark, d, "documents").select(F.length("text").cast("long").alias("tokens")), 2000)


_TEL2 = "SELECT o_orderkey::VARCHAR AS qid, o_orderkey % 11 AS k FROM orders"


@query(f"WITH t AS ({_TEL2}) SELECT qid, 'status' AS rule FROM t WHERE k = 0 UNION ALL SELECT qid, 'depth' FROM t WHERE k = 1 UNION ALL SELECT qid, 'method' FROM t WHERE k = 2 UNION ALL SELECT qid, 'not_negative' FROM t WHERE k = 3 UNION ALL SELECT qid, 'steps' FROM t WHERE k = 3 UNION ALL SELECT qid, 'version' FROM t WHERE k = 4")
def native_row_violations(spark, d):
    k = F.col("o_orderkey") % 11
    t = base.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("qid"), F.when(k == 0, "error").otherwise("ok").alias("status"), F.when(k == 1, 0).otherwise(10).alias("output_depth"), F.when(k == 2, "").otherwise("m").alias("method"), F.when(k == 3, -1).otherwise(5).cast("long").alias("llm_calls"), F.when(k == 4, 2).otherwise(1).alias("schema_version"))
    zero = {f"{part}_{what}_tokens": F.lit(0) for part in ("nominal", "retry", "actual") for what in ("prompt", "completion", "total")}
    t = t.withColumns(zero | {"retry_inclusive_llm_calls": F.lit(5), "selection_steps": F.lit(6), "non_llm_bypasses": F.lit(1), "wall_seconds": F.lit(2.0), "retry_seconds": F.lit(0.5), "retry_excluded_wall_seconds": F.lit(1.5)})
    return audit.native_row_violations(t)


@query(POOL_SQL + """ SELECT sha256('[' || string_agg('["' || qid || '","' || docid || '",' || rel || ',"0"]', ',' ORDER BY qid, docid) || ']') AS hash FROM qrels WHERE rel > 0""")
def qrels_hash(spark, d):
    return audit.qrels_hash(base.judgements(spark, d))


@query(POOL_SQL + """, h AS (SELECT qid, string_agg('{"docid":"' || docid || '","rank":' || pos || '}', ',' ORDER BY pos) AS hits FROM pool GROUP BY qid)
SELECT sha256(string_agg('{"hits":[' || hits || '],"qid":"' || qid || '","query":"q ' || qid || '"}' || chr(10), '' ORDER BY qid)) AS hash FROM h""")
def input_hash(spark, d):
    hits = base.first_stage(spark, d).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "docid"))), lambda x: F.struct(x["pos"].alias("rank"), x["docid"].alias("docid"))).alias("hits"))
    record = F.to_json(F.struct("qid", F.concat(F.lit("q "), "qid").alias("query"), "hits"))
    return audit.input_hash(hits.select("qid", record.alias("record")))


@query(POOL_SQL + " SELECT qid, pos, docid, score, 'local ' || docid AS content FROM pool")
def local_passages(spark, d):
    pool = base.first_stage(spark, d).select("qid", F.col("pos").cast("long").alias("pos"), "docid", "score")
    return audit.local_passages(pool.withColumn("content", F.lit("official")), pool.withColumn("content", F.concat(F.lit("local "), "docid")))


# ---- tournaments ----------------------------------------------------------------------

_EVENTS = "SELECT o_custkey::VARCHAR AS qid, o_orderkey, 2 + o_orderkey % 3 AS m, o_orderkey % 5 AS s, o_orderkey % 2 AS dup, o_orderkey % 7 = 0 AS bad FROM orders"


@query(f"""WITH e AS ({_EVENTS}), c AS (SELECT *, s - CASE WHEN dup = 1 AND s > 1 THEN 1 ELSE 0 END AS u FROM e)
SELECT qid, count(*) AS nominal_calls, count_if(bad) AS retry_calls, count(*) + count_if(bad) AS retry_inclusive_llm_calls, sum(s - u)::BIGINT AS duplicate_slots, count_if(s > u) AS duplicate_calls, sum(greatest(m - s, 0))::BIGINT AS under_selection_slots, count_if(m > s) AS under_selection_calls,
sum(greatest(s - m, 0))::BIGINT AS over_selection_slots, count_if(s > m) AS over_selection_calls, count_if(bad) AS format_repair_successes, greatest(10 - 0.2 * count_if(bad), 0)::DOUBLE AS retry_excluded_wall_seconds FROM c GROUP BY qid""")
def tournament_telemetry(spark, d):
    """Events of one tournament call each: selections of 0 to 4 with doubles, every seventh after a repair."""
    k = F.col("o_orderkey")
    names = F.slice(F.when(k % 2 == 1, F.array(*map(F.lit, "aabcd"))).otherwise(F.array(*map(F.lit, "abcde"))), F.lit(1), (k % 5).cast("int"))
    bad = k % 7 == 0
    costs = [F.lit(10).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(0.5).alias("duration_seconds"), F.when(bad, 0.2).otherwise(0.0).alias("retry_seconds")]
    e = base.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("qid"), (2 + k % 3).alias("m"), names.alias("selected"), bad.cast("int").alias("retry_calls"), F.lit(True).alias("format_valid"), (~bad).alias("initial_format_valid"), bad.alias("format_repair_succeeded"), *costs)
    got = tournaments.tournament_telemetry(tournaments.selection_counts(e), e.select("qid").distinct().withColumn("wall_seconds", F.lit(10.0)))
    return got.select("qid", "nominal_calls", F.col("retry_calls").cast("long").alias("retry_calls"), "retry_inclusive_llm_calls", "duplicate_slots", "duplicate_calls", "under_selection_slots", "under_selection_calls", "over_selection_slots", "over_selection_calls", "format_repair_successes", _r("retry_excluded_wall_seconds"))


@query(POOL_SQL + ", s AS (SELECT qid, docid FROM pool WHERE hidden::BIGINT % 2 = 0 UNION ALL SELECT qid, docid FROM pool WHERE hidden::BIGINT % 3 = 0), c AS (SELECT qid, docid, count(*) AS points FROM s GROUP BY ALL) SELECT qid, docid, coalesce(points, 0) AS points, row_number() OVER (PARTITION BY qid ORDER BY coalesce(points, 0) DESC, pos) AS rank FROM pool LEFT JOIN c USING (qid, docid)")
def tournament_points(spark, d):
    pool = base.first_stage(spark, d)
    some = lambda k: pool.where(F.col("hidden").cast("long") % k == 0).select("qid", "docid")
    return tournaments.tournament_points(some(2).unionAll(some(3)), pool).select("qid", "docid", "points", F.col("rank").cast("long").alias("rank"))


# ---- other drivers of procedures ------------------------------------------------------


@query(POOL_SQL + _SORTED.format(k=10))
def rerank_batched(spark, d):
    """Many queries' requests answered in one batch each round."""
    got = rerank.rerank_batched(base.first_stage(spark, d), "topdown_heapsort", 10, rerank.answer_by_score, c=3)
    return rerank.rankings(got).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


@query(POOL_SQL + """, a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hidden DESC) AS r FROM pool), b AS (SELECT qid, docid, CASE WHEN r <= 10 THEN r ELSE 10 + row_number() OVER (PARTITION BY qid, r > 10 ORDER BY pos) END AS rank FROM a)
SELECT qid, docid, rank, round(2 / (60 + rank), 8) AS score FROM b""")
def bidirectional_ensemble(spark, d):
    """Top-down and bottom-up heaps of the same pool, fused by reciprocal rank; with exact answers the two agree."""
    got = rerank.ensemble(base.first_stage(spark, d), 10, c=3)
    return got.select("qid", "docid", F.col("rank").cast("long").alias("rank"), _r("score", 8))


@query(POOL_SQL + " SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY pos DESC) AS pos FROM pool")
def input_order(spark, d):
    return readers.input_order(base.first_stage(spark, d), "inverse").select("qid", "docid", F.col("pos").cast("long").alias("pos"))


# ---- functions ----------------------------------------------------------------------


@query(r"SELECT doc_id, array_to_string((regexp_split_to_array(regexp_replace(text, '^[ ]+|[ ]+$', '', 'g'), '\s+'))[1:12], ' ') AS head FROM documents")
def truncate(spark, d):
    return base.read(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 12).alias("head"))


@query(r"SELECT conv_id, turn, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM conversations")
def normal_hash(spark, d):
    return base.read(spark, d, "conversations").select("conv_id", "turn", text.normal_hash(F.col("text")).alias("h"))


@query("SELECT p_partkey, lower(replace(replace(list_extract(string_split('hub/' || p_brand || '/' || p_type || '.v' || p_size, '/'), -1), '.', '-'), '/', '-')) AS tag FROM part")
def model_tag(spark, d):
    p = base.read(spark, d, "part")
    return p.select("p_partkey", text.model_tag(F.concat(F.lit("hub/"), "p_brand", F.lit("/"), "p_type", F.lit(".v"), F.col("p_size").cast("string"))).alias("tag"))


@query("""WITH r AS (SELECT p_partkey, p_size % 6 AS n, [p_partkey % 8, p_size % 7, p_partkey % 5] AS x FROM part), m AS (SELECT p_partkey, n, list_filter(x, lambda v: v BETWEEN 1 AND n) AS y FROM r),
o AS (SELECT p_partkey, n, list_filter(range(1, n + 1), lambda v: NOT list_contains(y, v)) AS rest, list_filter(y, lambda v, i: list_position(y, v) = i) AS head FROM m)
SELECT p_partkey, array_to_string(list_transform(list_concat(head, rest), lambda v: v - 1), ',') AS ord FROM o""")
def permutation_parse(spark, d):
    p, k = base.read(spark, d, "part"), F.col("p_partkey")
    raw = F.concat(F.lit("["), (k % 8).cast("string"), F.lit("] > ["), (F.col("p_size") % 7).cast("string"), F.lit("] > ["), (k % 5).cast("string"), F.lit("]"))
    return p.select("p_partkey", F.array_join(text.permutation(raw, F.col("p_size") % 6), ",").alias("ord"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_size <= 30 THEN p_size::VARCHAR END AS label FROM part")
def label_parse(spark, d):
    p, s = base.read(spark, d, "part"), F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<think>7?</think> The **Passage "), s, F.lit("** is the most relevant."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Best: "), s, F.lit("</s>"))).otherwise(F.lit("None of the passages is relevant."))
    return p.select("p_partkey", udfs.parse_single(raw, F.lit(labels.NUMERIC), F.lit(30), F.lit(True)).alias("label"))


@query()
def label_noops(spark, d):
    p = base.read(spark, d, "part")
    raw = F.concat(F.lit("Best: "), F.col("p_size").cast("string"), F.lit(", Worst: "), (F.col("p_partkey") % 40).cast("string"))
    got = p.select("p_partkey", udfs.parse_dual(raw, F.lit(labels.NUMERIC), F.lit(30), F.lit(True)).alias("x"), udfs.noop_reason(raw, F.lit(labels.NUMERIC), F.lit(30)).alias("reason"))
    return got.select("p_partkey", "x.best", "x.worst", "reason")


@query(POOL_SQL + " SELECT qid, pos AS rank, qid || chr(9) || 'Q0' || chr(9) || docid || chr(9) || pos || chr(9) || '-' || pos || chr(9) || 't' AS value FROM pool WHERE pos <= 10")
def run_lines(spark, d):
    got = base.first_stage(spark, d).select("qid", "docid", F.col("pos").alias("rank"), "score")
    return writers.run_lines(got, "t", 10, by_rank=True).select("qid", F.col("rank").cast("long").alias("rank"), "value")


@query("SELECT event_type AS type, 1 + (user_id * 7 + event_id) % (4 + event_id % 5) AS position, count(*) AS count FROM events WHERE 1 + (user_id * 7 + event_id) % (4 + event_id % 5) <= 3 + event_id % 5 GROUP BY ALL")
def stream_position_counts(spark, d):
    return jobs.position_counts(base.comparison_log(spark, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_activity(spark, d):
    return jobs.windowed_activity(base.read(spark, d, "events")).select("start", "event_type", "events", _r("total", 4))
