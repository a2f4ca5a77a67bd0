"""Registered queries of scans: text lines made out of the test tables, read back by the parsers of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, stats
from ..sources import readers, writers
from ..sources.run_source import in_file_order, use_run_source
from ..sources.shared import shared_folder
from . import base
from .base import POOL_SQL
from .register import query


#: The pool as a run file has it whose lines follow a hash: rows in another order than their ranks.
_FILE = POOL_SQL + """, k AS (SELECT *, md5(qid || ':' || docid) AS h FROM pool), file AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h) AS place, 2 * row_number() OVER (ORDER BY h) - 1 AS file_pos FROM k)"""


def _written_run(spark, d, key=None):
    """The pool written as run files, in the order of a hash or of ``key``, with blank lines between; read back."""
    pool = base.first_stage(spark, d)
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "docid", F.col("pos").cast("string"), F.col("score").cast("string"), F.lit(" t "))
    key = F.md5(F.concat_ws(":", "qid", "docid")) if key is None else key
    lines = pool.select(key.alias("key"), F.posexplode(F.array(line, F.lit("  "))).alias("blank", "value"))
    path = shared_folder(spark, "run")
    writers.write_lines(lines, path, "key", "blank")
    return readers.read_run(spark, path)


@query(_FILE + " SELECT qid, docid, pos AS rank, score, 't' AS tag, place AS pos, file_pos FROM file")
def run_scan(spark, d):
    return _written_run(spark, d).select("qid", "docid", F.col("rank").cast("long").alias("rank"), "score", "tag", "pos", "file_pos")


@query(_FILE + " SELECT qid, docid, place AS pos FROM file WHERE place <= 40")
def load_run_to_depth(spark, d):
    """Longer runs are cut to the depth, and only then checked."""
    return readers.exact_depth(_written_run(spark, d), 40).select("qid", "docid", F.col("pos").cast("long").alias("pos"))


_FIRST = ", q AS (SELECT qid FROM file GROUP BY qid ORDER BY min(file_pos) LIMIT 7)"


@query(_FILE + _FIRST + " SELECT qid, string_agg(docid, ' ' ORDER BY place) AS docids FROM file SEMI JOIN q USING (qid) WHERE place <= 30 GROUP BY qid")
def strict_pools(spark, d):
    return readers.strict_pools(_written_run(spark, d), 30, 7).select("qid", F.array_join("docids", " ").alias("docids"))


@query(_FILE + _FIRST + " SELECT qid, docid FROM file SEMI JOIN q USING (qid)")
def query_limit(spark, d):
    return readers.first_queries(_written_run(spark, d), 7).select("qid", "docid")


@query(POOL_SQL + """, o AS (SELECT *, qid::BIGINT % 5 = 2 AND pos % 2 = 0 AS late, CASE WHEN qid::BIGINT % 3 = 1 THEN -pos ELSE pos END AS k FROM pool),
f AS (SELECT *, row_number() OVER w AS n, lag(qid) OVER w AS before FROM o WINDOW w AS (ORDER BY late, qid, k)), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS place FROM f)
SELECT qid, docid, pos AS rank, place AS "at", place > 1 AND before <> qid AS apart FROM g WHERE pos <> place OR (place > 1 AND before <> qid)""")
def rank_positions(spark, d):
    """A third of the queries stand in reverse order, a fifth have half of their rows behind all others."""
    n, pos = F.col("qid").cast("long"), F.col("pos")
    key = F.struct(((n % 5 == 2) & (pos % 2 == 0)).alias("late"), "qid", F.when(n % 3 == 1, -pos).otherwise(pos).alias("k"))
    return audit.rank_positions(_written_run(spark, d, key)).withColumn("rank", F.col("rank").cast("long"))


@query(POOL_SQL + " SELECT qid, docid, pos AS rank, score, 'made' AS tag, row_number() OVER (PARTITION BY qid ORDER BY pos) AS pos FROM pool WHERE pos <= 10")
def run_source(spark, d):
    """The pool written and read back through the data source of runs; the depth is cut while lines are read."""
    kind, path = use_run_source(spark), shared_folder(spark, "run")
    pool = base.first_stage(spark, d).select("qid", "docid", F.col("pos").alias("rank"), "score")
    pool.repartition("qid").sortWithinPartitions("qid", "rank").write.format(kind).option("tag", "made").mode("append").save(path)
    rows = in_file_order(spark.read.format(kind).load(path).where("rank <= 10"))
    return rows.select("qid", "docid", F.col("rank").cast("long").alias("rank"), "score", "tag", "pos")


_EVALS = "SELECT l_suppkey::VARCHAR AS qid, CASE WHEN l_linenumber = 1 THEN 'ndcg_cut_10' ELSE 'map_cut_100' END AS metric, round(avg(l_discount), 4) AS value FROM lineitem GROUP BY ALL"


def _evals(spark, d):
    """Evaluation lines with aggregates, and lines that are none."""
    line = base.read(spark, d, "lineitem")
    v = line.groupBy(F.col("l_suppkey").cast("string").alias("qid"), F.when(F.col("l_linenumber") == 1, "ndcg_cut_10").otherwise("map_cut_100").alias("metric")).agg(F.round(F.avg("l_discount"), 4).alias("value"))
    total = v.groupBy("metric").agg(F.lit("all").alias("qid"), F.round(F.avg("value"), 8).alias("value")).select("qid", "metric", "value")
    rows = v.unionByName(total).select(F.concat_ws("\t", F.rpad("metric", 22, " "), "qid", F.col("value").cast("string")).alias("value"))
    noise = spark.createDataFrame([("",), ("runid all x y",), ("ndcg_cut_10 q9 none",)], "value string")
    return readers.parse_evals(rows.unionAll(noise).select("value", F.lit("a.eval").alias("path"), F.monotonically_increasing_id().alias("at")))


@query(f"SELECT metric, qid, value FROM ({_EVALS}) WHERE metric = 'ndcg_cut_10'")
def eval_per_query(spark, d):
    return readers.per_query(_evals(spark, d), "ndcg_cut_10")


@query(f"SELECT metric, 'all' AS qid, round(avg(value), 8) AS value, 'a.eval' AS path FROM ({_EVALS}) GROUP BY metric")
def eval_aggregates(spark, d):
    return readers.aggregates(_evals(spark, d))


@query("SELECT 'recall_1000' AS metric, 'missing' AS reason")
def evaluation_gate(spark, d):
    return audit.evaluation_gate(_evals(spark, d), ["ndcg_cut_10", "map_cut_100", "recall_1000"])


def _logs(spark, d):
    """A log text for each order: comparisons always, fallbacks and retries at times, in other case."""
    k = F.col("o_orderkey")
    lines = [F.concat(F.lit("Avg comparisons: "), (k % 90).cast("string")), F.concat(F.lit("Avg prompt tokens: "), (k % 7).cast("string"), F.lit(".5")), F.lit("Avg completion tokens: 2.5e1")]
    lines += [F.when(k % 3 == 0, F.concat(F.lit("avg STRICT parse fallbacks:  "), (k % 4).cast("string"), F.lit(".25"))), F.when(k % 5 == 0, F.lit("Avg BM25 bypass: .5")), F.when(k % 2 == 0, F.concat(F.lit("Total retries fired: "), (k % 6).cast("string")))]
    return base.read(spark, d, "orders").select(k.cast("string").alias("path"), F.concat_ws("\n", *lines).alias("value"))


@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS path, o_orderkey AS k FROM orders)
SELECT path, 'parse_fallbacks' AS counter, NULL::DOUBLE AS value, 'average_per_query' AS aggregation FROM o UNION ALL SELECT path, 'strict_parse_fallbacks', CASE WHEN k % 3 = 0 THEN k % 4 + 0.25 END, 'average_per_query' FROM o
UNION ALL SELECT path, 'unparseable_after_exhaustion_fallbacks', NULL, 'average_per_query' FROM o UNION ALL SELECT path, 'bm25_bypasses', CASE WHEN k % 5 = 0 THEN 0.5 END, 'average_per_query' FROM o
UNION ALL SELECT path, 'parse_failure_bm25_fallback', NULL, 'average_per_query' FROM o UNION ALL SELECT path, 'retries_fired', CASE WHEN k % 2 = 0 THEN k % 6 ELSE 0 END, 'total' FROM o""")
def fallback_counters(spark, d):
    return readers.fallback_counters(_logs(spark, d))


@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS path, o_orderkey AS k FROM orders)
SELECT path, 'avg_comparisons' AS metric, (k % 90)::DOUBLE AS value FROM o UNION ALL SELECT path, 'avg_prompt_tokens', k % 7 + 0.5 FROM o UNION ALL SELECT path, 'avg_completion_tokens', 25 FROM o UNION ALL SELECT path, 'avg_total_tokens', k % 7 + 25.5 FROM o
UNION ALL SELECT path, 'retries_fired', CASE WHEN k % 2 = 0 THEN k % 6 ELSE 0 END FROM o""")
def log_measures(spark, d):
    return readers.log_measures(_logs(spark, d))


@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS path, o_orderkey AS k FROM orders) SELECT path, 'missing:duplicate label fallbacks' AS rule FROM o WHERE k % 13 = 0 UNION ALL SELECT path, 'parse_failure_strict' FROM o WHERE k % 11 = 0
UNION ALL SELECT path, 'retries' FROM o WHERE k % 13 <> 0 AND k % 4 > 0 AND k % 6 < 3 UNION ALL SELECT path, 'error_line' FROM o WHERE k % 17 = 0""")
def smoke_logs(spark, d):
    """A smoke run's log for each order, some with faults."""
    k = F.col("o_orderkey")
    value = {c: F.lit("0") for c in audit.SMOKE_COUNTERS}
    value["parse fallbacks"] = F.concat((k % 4).cast("string"), F.lit(".0"))
    value["parse_failure_strict"] = F.when(k % 11 == 0, "0.5").otherwise("0")
    value["duplicate label fallbacks"] = F.when(k % 13 != 0, "0")
    lines = [F.concat(F.lit(f"Avg {c}: "), v) for c, v in value.items()] + [F.concat(F.lit("Total retries fired: "), (k % 6).cast("string")), F.when(k % 17 == 0, "Traceback (most recent call last):")]
    return audit.smoke_logs(base.read(spark, d, "orders").select(k.cast("string").alias("path"), F.concat_ws("\n", *lines).alias("value")))


@query("SELECT o_orderkey::VARCHAR AS name, o_orderstatus AS family, 's' || o_custkey AS system, 'r' AS reference, 'ndcg_cut_10' AS metric, CASE WHEN o_orderkey % 2 = 0 THEN 'higher' ELSE 'lower' END AS direction FROM orders")
def comparison_specs(spark, d):
    o = base.read(spark, d, "orders")
    spec = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", F.concat(F.lit("s"), F.col("o_custkey").cast("string")), F.lit("r"), F.lit("ndcg_cut_10"), F.when(F.col("o_orderkey") % 2 == 0, "higher").otherwise("lower"))
    return stats.parse_specs(o.select(spec.alias("spec")))


@query("WITH p AS (SELECT o_orderpriority AS model, o_orderstatus AS dataset, count_if(o_custkey % 40 = 0) AS n FROM orders GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY model, dataset) - 1 AS ordinal FROM p WHERE n > 0")
def valid_ordinals(spark, d):
    p = base.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset")).agg(F.count_if(F.col("o_custkey") % 40 == 0).alias("n"))
    return stats.valid_ordinals(p, ["model", "dataset"]).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT doc_id::VARCHAR AS docid, CASE WHEN lang IS NULL THEN text ELSE lang || ' ' || text END AS text FROM documents")
def effective_text(spark, d):
    docs = base.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.col("lang").alias("title"), "text")
    raw = docs.select("docid", F.to_json(F.struct("title", "text")).alias("raw"))
    return readers.effective_text(readers.raw_documents(raw))


@query(POOL_SQL + " SELECT qid || chr(9) || 'Q0' || chr(9) || docid || chr(9) || pos || chr(9) || '-' || pos || chr(9) || 't' AS value FROM pool WHERE pos <= 5")
def run_lines_round_trip(spark, d):
    """Lines written, read back, and written again."""
    path = shared_folder(spark, "run")
    writers.write_run(base.first_stage(spark, d).select("qid", "docid", F.col("pos").alias("rank"), "score"), path, "t", 5, by_rank=True)
    return writers.run_lines(readers.read_run(spark, path).select("qid", "docid", "rank", "score"), "t", 5, by_rank=True).select("value")
