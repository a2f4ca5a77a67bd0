"""Registered queries of likelihood ranking, of attempts in folders of files, and of their integrity."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import integrity, likelihood
from ..sources import attempt_files
from ..sources.shared import shared_folder
from . import base
from .base import POOL_SQL
from .register import query

_SPLIT = r"unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS tok"


@query(POOL_SQL + rf""", qa AS (SELECT qid, tok, count(*) AS asked FROM (SELECT item_id::VARCHAR AS qid, {_SPLIT} FROM benchmark) WHERE tok <> '' GROUP BY ALL),
tf AS (SELECT docid, tok, count(*) AS n FROM (SELECT doc_id::VARCHAR AS docid, {_SPLIT} FROM documents) WHERE tok <> '' GROUP BY ALL), cf AS (SELECT tok, sum(n) AS c FROM tf GROUP BY tok),
len AS (SELECT docid, sum(n) AS l FROM tf GROUP BY docid), tot AS (SELECT sum(n) AS t FROM tf), q AS (SELECT * FROM qa JOIN cf USING (tok)),
s AS (SELECT p.qid, p.docid, p.pos, round(coalesce(sum(asked * ln((coalesce(n, 0) + 1000::DOUBLE * c / t) / (coalesce(l, 0) + 1000::DOUBLE))), 0), 9) AS score
 FROM pool p LEFT JOIN q ON q.qid = p.qid LEFT JOIN tf ON tf.docid = p.docid AND tf.tok = q.tok LEFT JOIN len ON len.docid = p.docid, tot GROUP BY ALL)
SELECT qid, docid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM s""")
def query_likelihood(spark, d):
    queries = base.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    docs = base.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text")
    got = likelihood.query_likelihood(base.first_stage(spark, d), queries, docs)
    return got.select("qid", "docid", F.round("score", 6).alias("score"), "rank")


# ---- attempts in folders ----------------------------------------------------------

_ORDERS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus || left(o_orderpriority, 1) AS cell, CASE WHEN o_custkey % 2 = 0 THEN 'a1' ELSE 'a2' END AS attempt FROM orders)"""


def _attempts(spark, d):
    """Folders of attempts out of the orders: a cell for each status and priority, of which five have a fault, with a superseded attempt each."""
    o = base.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("cell"), F.when(F.col("o_custkey") % 2 == 0, "a1").otherwise("a2").alias("attempt"))
    told = {
        0: '{"qid":"%d","llm_calls":%d,"retry_inclusive_llm_calls":9,"actual_prompt_tokens":10,"wall_seconds":1.5,"status":"ok","dataset":"own"}',
        1: '{"qid":"%d","total_calls":13,"retry_calls":1,"prompt_tokens":%d,"query_wall_seconds":2.5,"batch_wall_seconds":null,"status":"ok"}',
        2: '{"qid":"%d","llm_calls":null,"total_calls":%d,"output_depth":10,"status":"error"}',
    }
    line = F.lit(None).cast("string")
    for n, text in told.items():
        line = F.when(F.col("k") % 3 == n, F.format_string(text, "k", "c")).otherwise(line)
    root = shared_folder(spark, "attempts")
    rows = o.where("not (cell = 'F5' and attempt = 'a2')").select("cell", "attempt", line.alias("value"))
    rows.repartition("cell", "attempt").write.partitionBy("cell", "attempt").text(root)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{root}/cell=*/attempt=*/part-*")):  # a file for each attempt
        fs.rename(part.getPath(), path(part.getPath().getParent(), part.getPath().getName().split("-")[1] + "_telemetry.jsonl"))
    return root, fs, path, sorted(r.cell for r in o.select("cell").distinct().collect())  # one for each status and priority


def _collected(spark, d):
    root, fs, path, cells = _attempts(spark, d)
    for cell in cells:
        at, latest = f"{root}/cell={cell}", "../x" if cell == "F1" else "attempt=a2"
        for attempt in ("attempt=a1", "attempt=a2"):
            manifest = {"dataset": f"d-{cell}", "baseline": "m", "model": "x", "output_objective": "top10", "output_depth": 100} | ({"baseline_category": "official"} if cell[0] == "O" else {})
            if (cell, attempt) != ("F2", "attempt=a2"):
                attempt_files.write_small(spark, f"{at}/{attempt}/{attempt_files.MANIFEST}", json.dumps(manifest))
            if (cell, attempt) != ("F3", "attempt=a2"):
                attempt_files.write_small(spark, f"{at}/{attempt}/{attempt_files.DONE}", "ok\n")
        attempt_files.write_small(spark, f"{at}/{attempt_files.LATEST}", f"{latest}\n")
    fs.rename(path(f"{root}/cell=F4"), path(f"{root}/smoke-q4"))
    return attempt_files.collect_attempts(spark, root)


@query(_ORDERS + """ SELECT cell, k::VARCHAR AS qid, CASE WHEN k % 3 = 0 THEN 'own' ELSE 'd-' || cell END AS dataset, 'm' AS method, CASE WHEN cell[1] = 'O' THEN 'official' ELSE 'native' END AS baseline_category,
 CASE k % 3 WHEN 0 THEN c WHEN 1 THEN 13 END AS llm_calls, CASE k % 3 WHEN 0 THEN 9 WHEN 1 THEN 14 ELSE 0 END AS retry_inclusive_llm_calls, CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN c END AS actual_prompt_tokens,
 CASE k % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.5 END AS retry_excluded_wall_seconds, CASE WHEN k % 3 = 2 THEN 10 ELSE 100 END AS output_depth, CASE WHEN k % 3 = 2 THEN 'error' ELSE 'ok' END AS status
 FROM o WHERE attempt = 'a2' AND cell NOT IN ('F1', 'F2', 'F3', 'F4', 'F5')""")
def collected_attempts(spark, d):
    rows, _ = _collected(spark, d)
    cell = F.regexp_extract("attempt", "cell=([^/]*)/", 1).alias("cell")
    return rows.select(cell, "qid", "dataset", "method", "baseline_category", "llm_calls", "retry_inclusive_llm_calls", "actual_prompt_tokens", "retry_excluded_wall_seconds", "output_depth", "status")


@query(_ORDERS + """ SELECT DISTINCT cell, CASE cell WHEN 'F1' THEN 'invalid_LATEST_pointer' WHEN 'F2' THEN 'missing_manifest' WHEN 'F3' THEN 'incomplete_no_DONE' ELSE 'missing_telemetry' END AS reason FROM o WHERE cell IN ('F1', 'F2', 'F3', 'F5')""")
def attempt_discrepancies(spark, d):
    _, left_out = _collected(spark, d)
    return left_out.select(F.regexp_extract("attempt", "cell=([^/]*)", 1).alias("cell"), "reason")


@query(_ORDERS + """, c AS (SELECT DISTINCT cell FROM o) SELECT cell, 'telemetry' AS part, CASE cell WHEN 'O1' THEN 'changed_file' WHEN 'O2' THEN 'no_hash' ELSE 'missing_file' END AS reason FROM c WHERE cell IN ('O1', 'O2', 'O3')
 UNION ALL SELECT cell, 'template', CASE cell WHEN 'O4' THEN 'stale_template_hash' ELSE 'missing_template' END FROM c WHERE cell IN ('O4', 'O5')""")
def artefact_integrity(spark, d):
    """Telemetry files against the hashes in manifests, of which three are at fault, and two templates."""
    root, _, _, cells = _attempts(spark, d)
    found = {r.path.split("/cell=")[1].split("/")[0]: r for r in attempt_files.hashed_files(spark, root, attempt_files.TELEMETRY).where("path like '%attempt=a1%'").collect()}  # one file a cell
    for cell in cells:
        prompt, file = f"<user> {cell}", found[cell]
        said = {"O1": file.sha256[:-1] + ("0" if file.sha256[-1] != "0" else "1"), "O2": "none"}.get(cell, file.sha256)
        template = {} if cell == "O5" else {"rendered_chat_prompt": prompt, "rendered_chat_prompt_sha256": integrity_hash(prompt + (" " if cell == "O4" else ""))}
        manifest = {"telemetry_file": "gone_telemetry.jsonl" if cell == "O3" else file.path.rsplit("/", 1)[1], "telemetry_sha256": said, "prompt_contract": {"direction": "maxcontext_topdown"}, "prompt_template_contract": template}
        attempt_files.write_small(spark, f"{root}/cell={cell}/attempt=a1/{attempt_files.MANIFEST}", json.dumps(manifest))
    manifests = attempt_files.read_manifests(spark, root)
    files = integrity.artefact_mismatches(manifests, attempt_files.hashed_files(spark, root, attempt_files.TELEMETRY)).select("attempt", F.col("artefact").alias("part"), "reason")
    both = integrity.all_reasons(files, integrity.template_mismatches(manifests).select("attempt", F.lit("template").alias("part"), "reason"))
    return both.select(F.regexp_extract("attempt", "cell=([^/]*)", 1).alias("cell"), "part", "reason")


def integrity_hash(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


# ---- accounting of repairs ----------------------------------------------------------


def _events(spark, d):
    """Generation events out of the event table: every other one was repaired, and some don't add up."""
    e = base.read(spark, d, "events")
    n, f = F.col("event_id"), F.col("event_id") % 12
    view = lambda ok: F.when(ok, F.concat(F.lit("Document "), n.cast("string"))).otherwise(F.lit("none"))

    def generation(k, valid, tokens):
        flag = F.lit(False) if k else f == 4
        return F.struct(
            F.lit(k).alias("attempt_index"), F.lit("format_repair" if k else "initial").alias("attempt_kind"), view(valid).alias("raw_output"), view(valid).alias("content_output"), view(valid).alias("parser_input"), flag.alias("special_tokens_removed"),
            valid.alias("format_valid"), F.when(valid, "ok").otherwise("format_invalid").alias("status"), F.lit("p").alias("parser_input_policy"), F.lit("n").alias("no_document_policy"), F.lit(64).alias("generation_budget"),
            F.sha2(F.concat(n.cast("string"), F.lit(f"/{k}")), 256).alias("rendered_prompt_sha256"), tokens.alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"), F.lit(0.5).alias("duration_seconds"),
        )

    twice = n % 2 == 0
    attempts = F.when(twice, F.array(generation(0, F.lit(False), n % 50), generation(1, F.lit(True), n % 70))).otherwise(F.array(generation(0, F.lit(True), n % 50)))
    more = twice.cast("long")
    prompt = n % 50 + F.when(twice, n % 70).otherwise(0)
    rows = e.select(n.alias("n"), F.col("user_id").cast("string").alias("qid"), n.cast("int").alias("event"), f.alias("f"), attempts.alias("generation_attempts"), more.alias("more"), prompt.alias("prompt"))
    rows = rows.withColumn("last", F.element_at("generation_attempts", -1))
    made = {
        "format_repair_policy": F.lit("r"), "generation_attempt_count": (F.col("more") + 1 + (F.col("f") == 5).cast("long")).cast("int"), "retry_calls": F.col("more") + (F.col("f") == 1).cast("long"), "retry_seconds": F.col("more") * 0.5,
        "format_repair_triggered": F.col("more") == 1, "format_repair_succeeded": F.col("more") == 1, "initial_format_valid": F.col("more") == 0, "prompt_tokens": F.col("prompt") - (F.col("f") == 2).cast("long"), "completion_tokens": 3 * (F.col("more") + 1), "duration_seconds": 0.5 * (F.col("more") + 1),
    }
    made |= {c: F.col(f"last.{c}") for c in integrity._FINAL}
    made["rendered_prompt_sha256"] = F.when(F.col("f") == 3, F.sha2(F.lit("stale"), 256)).otherwise(F.col("last.rendered_prompt_sha256"))
    return rows.select("qid", "event", "generation_attempts", *[c.alias(name) for name, c in made.items()])


@query("""SELECT user_id::VARCHAR AS qid, event_id AS event, ['retry_calls', 'prompt_tokens', 'final_view:rendered_prompt_sha256', 'control_tokens', 'attempt_count'][event_id % 12] AS reason FROM events WHERE event_id % 12 BETWEEN 1 AND 5""")
def repair_violations(spark, d):
    return integrity.repair_violations(_events(spark, d), "r", "p", "n", 64).withColumn("event", F.col("event").cast("long"))


@query("""WITH u AS (SELECT user_id AS u, count_if(event_id % 12 = 2) AS short FROM events GROUP BY user_id)
SELECT u::VARCHAR AS qid, 'uncharged' AS reason FROM u WHERE u % 7 = 3 UNION ALL SELECT u::VARCHAR, 'charge:retry_calls' FROM u WHERE u % 7 <> 3 AND u % 5 = 1 UNION ALL SELECT u::VARCHAR, 'charge:prompt_tokens' FROM u WHERE u % 7 <> 3 AND short > 0""")
def repair_charges(spark, d):
    """Telemetry that charges what the table's events took: a fifth of the queries misses one retry, and events that tell a token too few don't add up."""
    n = F.col("event_id")
    e = base.read(spark, d, "events").select(F.col("user_id").alias("u"), (n % 2 == 0).cast("long").alias("more"), (n % 50 + F.when(n % 2 == 0, n % 70).otherwise(0)).alias("prompt"))
    sums = {
        "calls": F.count("*"), "retry_calls": F.sum("more") - F.when(F.col("u") % 5 == 1, 1).otherwise(0), "retry_seconds": F.sum("more") * 0.5, "prompt_tokens": F.sum("prompt"), "completion_tokens": F.sum(3 * (F.col("more") + 1)),
        "duration_seconds": F.sum(F.col("more") + 1) * 0.5, "generations": F.sum(F.col("more") + 1), "initial_format_failures": F.sum("more"), "format_repair_successes": F.sum("more"),
    }
    told = e.groupBy("u").agg(*[c.alias(name) for name, c in sums.items()]).where("u % 7 <> 3").withColumn("qid", F.col("u").cast("string")).drop("u")
    return integrity.charge_violations(told, _events(spark, d))
