"""Registered queries of prompts, fitted lists and the final checks of attempts, over derived pools."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import labels, prompts
from ..operators import audit
from . import base
from .base import POOL_SQL
from .register import query

_SHOWN = POOL_SQL + """, s AS (SELECT qid, b.text AS query, pos, t.text AS txt FROM pool JOIN benchmark b ON b.item_id::VARCHAR = qid JOIN documents t ON t.doc_id::VARCHAR = docid WHERE pos <= {k})"""


def _windows(spark, d, k):
    """``qid, query, passages``: the first ``k`` of each pool, in order."""
    qs = base.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))
    docs = base.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.col("text").alias("txt"))
    rows = base.first_stage(spark, d).where(F.col("pos") <= k).join(qs, "qid").join(docs, "docid")
    return rows.groupBy("qid", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "txt"))), lambda x: x["txt"]).alias("passages"))


@query(_SHOWN.format(k=3) + """, w AS (SELECT qid, query, count(*) AS n, string_agg('Passage ' || chr(64 + pos::INT) || ': "' || txt || '"', chr(10) || chr(10) ORDER BY pos) AS lettered, string_agg('Passage ' || pos || ': "' || txt || '"', chr(10) || chr(10) ORDER BY pos) AS numbered,
 string_agg(chr(64 + pos::INT), ', ' ORDER BY pos) AS labels FROM s GROUP BY qid, query), x AS (SELECT *, 'Given a query "' || query || '", which of the following passages is the ' AS ask, chr(10) || chr(10) AS gap FROM w)
SELECT qid, 'best' AS kind, ask || 'most relevant one to the query?' || gap || lettered || gap || 'Output only the passage label of the most relevant passage:' || gap || 'Reply with exactly one passage label, one of these labels: ' || labels || '. Do not explain. Do not output any other label. If none of the passages are clearly relevant, still pick the single closest one.' AS prompt FROM x
UNION ALL SELECT qid, 'worst', ask || 'least relevant one to the query?' || gap || numbered || gap || 'Output only the passage label of the least relevant passage:' || gap || 'Reply with exactly one passage number from 1 to ' || n || '. Do not explain. Do not output 0 or any number outside 1 to ' || n || '. If none of the passages are clearly irrelevant, still pick the single least relevant one.' FROM x
UNION ALL SELECT qid, 'dual', ask || 'most relevant and which is the least relevant to the query?' || gap || lettered || gap || 'Reply with exactly two distinct passage labels, each one of these labels: ' || labels || '. Do not explain. Strict format on one line: Best: <label>, Worst: <label>' FROM x""")
def window_prompts(spark, d):
    w = _windows(spark, d, 3)
    made = [("best", labels.LETTERS), ("worst", labels.NUMERIC), ("dual", labels.LETTERS)]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), prompts.window(k, F.col("query"), F.col("passages"), scheme).alias("prompt")) for k, scheme in made]))
    return w.select("qid", rows.alias("x")).select("qid", "x.kind", "x.prompt")


@query(_SHOWN.format(k=2) + """, w AS (SELECT qid, query, max_by(txt, -pos) AS one, max_by(txt, pos) AS two FROM s GROUP BY qid, query HAVING count(*) = 2)
SELECT qid, 'pair' AS kind, 'Given a query "' || query || '", which of the following two passages is more relevant to the query?' || chr(10) || chr(10) || 'Passage A: "' || one || '"' || chr(10) || chr(10) || 'Passage B: "' || two || '"' || chr(10) || chr(10) || 'Output Passage A or Passage B:' AS prompt FROM w
UNION ALL SELECT qid, 'duo', 'Query: ' || query || ' Document0: ' || one || ' Document1: ' || two || ' Relevant:' FROM w UNION ALL SELECT qid, 'qlm', 'Passage: ' || one || chr(10) || 'Please write a question based on this passage.' FROM w
UNION ALL SELECT qid, 'yes_no', 'Passage: ' || one || chr(10) || 'Query: ' || query || chr(10) || 'Does the passage answer the query? Answer ''Yes'' or ''No''' FROM w UNION ALL SELECT qid, 'mono', 'Query: ' || query || ' Document: ' || one || ' Relevant:' FROM w""")
def pair_and_point_prompts(spark, d):
    w = _windows(spark, d, 2).where("size(passages) = 2").select("qid", "query", F.col("passages")[0].alias("one"), F.col("passages")[1].alias("two"))
    q, one, two = F.col("query"), F.col("one"), F.col("two")
    made = {"pair": prompts.pair(q, one, two), "duo": prompts.duo(q, one, two)} | {k: prompts.point(k, q, one) for k in ("qlm", "yes_no", "mono")}
    return w.select("qid", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in made.items()])).alias("x")).select("qid", "x.kind", "x.prompt")


#: A list's limit, in words: pools of 100 long passages don't fit, so they are cut.
ROOM = 6000


#: Words of a dialogue but for passages, their labels and the query, whose last word takes a full stop in two places.
FIXED = sum(len(x.replace("{query}", "").split()) for x in (prompts._LIST_OPEN, prompts._LIST_READY, prompts._LIST_ASK)) - 2


@query(_SHOWN.format(k=base.HITS) + rf""", c AS (SELECT qid, query, len(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')) AS q, len(list_filter(regexp_split_to_array(replace(coalesce(txt, ''), 'Title: Content: ', ''), '\s+'), lambda x: x <> '')) AS k FROM s),
f AS (SELECT qid, m, count(*) * 4 + sum(least(k, m)) + any_value(2 * q) + {FIXED} AS took FROM c, (SELECT unnest(range(0, 301)) AS m) GROUP BY qid, m) SELECT qid, max(m)::INT AS words FROM f WHERE took <= {ROOM} GROUP BY qid""")
def fitted_lists(spark, d):
    fitted = prompts.FittedList(lambda s: len(re.findall(r"[^ \t\n\r\f\v]+", s)), ROOM)
    return _windows(spark, d, base.HITS).select("qid", fitted.column(F.col("query"), F.col("passages")).alias("x")).select("qid", "x.words")


_NATIVE = POOL_SQL + """, q AS (SELECT qid, qid::BIGINT % 9 AS k, count(*) AS size, count_if(pos <= 10) AS n FROM pool GROUP BY qid)"""


@query(_NATIVE + """, r AS (SELECT qid, CASE k WHEN 1 THEN n - 1 WHEN 2 THEN 0 ELSE n END AS n, k FROM q)
SELECT qid, 'depth_or_uniqueness' AS reason FROM r WHERE n NOT IN (0, 10) OR k = 7 UNION ALL SELECT qid, 'not_in_run' FROM r WHERE n = 0 UNION ALL SELECT qid, 'not_in_telemetry' FROM r WHERE k = 3 UNION ALL SELECT qid, 'launch:model' FROM r WHERE k = 4
UNION ALL SELECT qid, 'live_pool_size' FROM r WHERE k = 5 UNION ALL SELECT qid, 'repeated_in_telemetry' FROM r WHERE k = 6 UNION ALL SELECT qid, 'outside_pool' FROM r WHERE k = 7 UNION ALL SELECT qid, 'steps' FROM r WHERE k = 8 UNION ALL SELECT NULL, 'summary:llm_calls'""")
def native_attempt(spark, d):
    """An attempt with one fault for each ninth of its queries, and a sum of calls that is 1 too large."""
    pool = base.first_stage(spark, d)
    k = F.col("qid").cast("long") % 9
    run = pool.where(F.col("pos") <= F.when(k == 1, 9).when(k == 2, 0).otherwise(10)).select("qid", "docid").unionAll(pool.where((k == 7) & (F.col("pos") == 1)).select("qid", F.lit("none").alias("docid")))
    launch = {"method": "m", "model": "o'1", "dataset": "d", "output_objective": "top10", "output_depth": 10, "pool_cap": base.HITS}
    rows = pool.groupBy("qid").agg(F.count("*").alias("size")).withColumns({c: F.lit(v) for c, v in launch.items()})
    zero = {f"{part}_{what}_tokens": F.lit(0) for part in ("nominal", "retry", "actual") for what in ("prompt", "completion", "total")}
    rows = rows.withColumns(zero | {"status": F.when(k == 3, "error").otherwise("ok"), "model": F.when(k == 4, "other").otherwise(F.col("model")), "live_pool_size": F.col("size") + (k == 5).cast("int"), "llm_calls": F.lit(5), "retry_inclusive_llm_calls": F.lit(5), "schema_version": F.lit(1)})
    rows = rows.withColumns({"non_llm_bypasses": F.lit(1), "selection_steps": F.when(k == 8, 7).otherwise(6), "wall_seconds": F.lit(2.0), "retry_seconds": F.lit(0.5), "retry_excluded_wall_seconds": F.lit(1.5)})
    rows = rows.withColumn("time", F.explode(F.when(k == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    ok = rows.where("status = 'ok'")
    summary = ok.agg((F.sum("llm_calls") + 1).alias("llm_calls"), F.sum("actual_prompt_tokens").alias("actual_prompt_tokens"), F.sum("actual_completion_tokens").alias("actual_completion_tokens"), F.lit(10).alias("output_depth"))
    summary = summary.crossJoin(run.agg(F.count_distinct("qid").alias("queries")))  # one row each
    return audit.native_attempt(run, rows, pool, launch, summary)


@query(_NATIVE + """, r AS (SELECT qid, CASE k WHEN 1 THEN n - 1 ELSE n END AS n, k FROM q)
SELECT qid, 'depth_or_uniqueness' AS reason FROM r WHERE n NOT IN (0, 10) UNION ALL SELECT qid, 'no_calls' FROM r WHERE k = 2 UNION ALL SELECT qid, 'calls' FROM r WHERE k = 3 UNION ALL SELECT qid, 'launch:output_objective' FROM r WHERE k = 4 UNION ALL SELECT qid, 'not_in_telemetry' FROM r WHERE k = 5""")
def official_attempt(spark, d):
    pool = base.first_stage(spark, d)
    k = F.col("qid").cast("long") % 9
    run = pool.where(F.col("pos") <= F.when(k == 1, 9).otherwise(10)).select("qid", "docid")
    rows = pool.select("qid").distinct().where(k != 5).withColumns({"output_objective": F.when(k == 4, "full").otherwise("top10"), "output_depth": F.lit(10), "llm_calls": F.when(k == 2, 0).when(k == 3, 4).otherwise(13)})
    return audit.official_attempt(run, rows, pool, {"output_objective": "top10", "output_depth": 10}, 13, base.HITS)
