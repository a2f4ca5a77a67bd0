"""Integrity constraints: each check returns the rows that break it."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import top_hits
from ..sources.shared import written


def _run_errors(run: DataFrame, pools: DataFrame) -> DataFrame:
    """One pass over both sides: they are counted by query and document, then by query, then by error."""
    sides = run.select("qid", "docid", F.lit(1).alias("r"), F.lit(0).alias("p")).unionAll(pools.select("qid", "docid", F.lit(0), F.lit(1)))
    cells = sides.groupBy("qid", "docid").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    per = cells.groupBy("qid").agg(F.sum("r").alias("n"), F.count_if(F.expr("r > 0")).alias("u"), F.sum("p").alias("w"), F.count_if(F.expr("(r > 0) <> (p > 0)")).alias("other"))
    both = (F.col("n") > 0) & (F.col("w") > 0)
    found = [
        F.when(F.col("n") > F.col("u"), F.concat(F.lit("duplicate_docids:"), "qid")),
        F.when(both & (F.col("n") != F.col("w")), F.concat(F.lit("wrong_depth:"), "qid", F.lit(":"), F.col("n").cast("string"), F.lit(":expected_"), F.col("w").cast("string"))),
        F.when(both & (F.col("other") > 0), F.concat(F.lit("pool_membership_mismatch:"), "qid")),
    ]
    sides_only = [F.when(F.col("n") == 0, F.lit("missing_qids")), F.when(F.col("w") == 0, F.lit("unexpected_qids"))]
    kinds = per.select(F.explode(F.array(*[F.struct(e.alias("error"), F.lit(counted).alias("counted")) for es, counted in ((found, False), (sides_only, True)) for e in es])).alias("x")).select("x.*").where("error is not null")
    counts = kinds.groupBy("error", "counted").agg(F.count("*").alias("times"))
    return counts.select(F.when(F.col("counted"), F.concat("error", F.lit(":"), F.col("times").cast("string"))).otherwise(F.col("error")).alias("error"))


def audit_run(run: DataFrame | None, pools: DataFrame) -> DataFrame:
    """``error`` strings of a run ``qid, docid`` against expected pools ``qid, docid``.

    Duplicates, wrong depth and membership name the query; missing and
    unexpected queries are counted. Order within a query is free. No run at all is
    the one error ``missing_run``.
    """
    if run is None:
        return pools.sparkSession.createDataFrame([("missing_run",)], "error string")
    return _run_errors(run, pools)


def audit_run_lines(lines: DataFrame | None, pools: DataFrame) -> DataFrame:
    """As ``audit_run``, of the lines ``line_number, value`` of a run file; a line without six fields is an error and is left out."""
    if lines is None:
        return audit_run(None, pools)
    f = F.split(F.trim("value"), r"\s+")
    bad = lines.where((F.size(f) != 6) | (F.trim("value") == ""))
    run = lines.where((F.size(f) == 6) & (F.trim("value") != "")).select(F.get(f, 0).alias("qid"), F.get(f, 2).alias("docid"))
    return bad.select(F.concat(F.lit("malformed_line:"), F.col("line_number").cast("string")).alias("error")).unionAll(audit_run(run, pools))


def run_summary(run: DataFrame) -> DataFrame:
    """``queries, min_depth, max_depth`` of a run."""
    per = run.groupBy("qid").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("queries"), F.coalesce(F.min("n"), F.lit(0)).alias("min_depth"), F.coalesce(F.max("n"), F.lit(0)).alias("max_depth"))


def telemetry_violations(t: DataFrame) -> DataFrame:
    """``qid, rule`` for each identity that a telemetry row breaks."""
    rules = {f"{k}_total": f"{k}_prompt_tokens + {k}_completion_tokens = {k}_total_tokens" for k in ("nominal", "retry", "actual")}
    rules |= {f"actual_{k}": f"nominal_{k}_tokens + retry_{k}_tokens = actual_{k}_tokens" for k in ("prompt", "completion", "total")}
    rules |= {
        "steps": "selection_steps = llm_calls + non_llm_bypasses",
        "retry_excluded": "abs(retry_excluded_wall_seconds - greatest(0, wall_seconds - retry_seconds)) <= 1e-9",
        "not_negative": "least(llm_calls, retry_inclusive_llm_calls, selection_steps, non_llm_bypasses, nominal_total_tokens, retry_total_tokens) >= 0 and least(wall_seconds, retry_seconds) >= 0",
        "version": "schema_version = 1",
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return t.select("qid", F.explode(broken).alias("rule"))


def raw_capture_violations(comparisons: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Attempts must be numbered in order, only the last accepted, and add up to the charged calls and tokens."""
    c = comparisons.where("type <> 'dual_worst'")
    bad = c.where("raw_attempts is null or exists(transform(raw_attempts, (x, i) -> x.attempt_index <> i or (x.accepted and i < size(raw_attempts) - 1)), y -> y)").select("qid", F.lit("attempt_order").alias("rule"))
    total = c.groupBy("qid").agg(F.sum(F.size("raw_attempts")).alias("n"), F.sum(F.expr("aggregate(raw_attempts, 0L, (a, x) -> a + x.prompt_tokens + x.completion_tokens)")).alias("tokens"))
    both = telemetry.join(total, "qid", "left").where("coalesce(n, 0) <> retry_inclusive_llm_calls or coalesce(tokens, 0) <> actual_total_tokens")
    return bad.unionAll(both.select("qid", F.lit("charged_total").alias("rule")))


def ordered_pool_differences(official: DataFrame, local: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``qid, field, pos, official, local`` of two ordered pools ``qid, pos, docid, rank, score, content``.

    A query on one side only, or of another depth, gives one row and no others.
    """
    depth = lambda df, n: df.groupBy("qid").agg(F.count("*").alias(n))
    d = depth(official, "o").join(depth(local, "l"), "qid", "full")
    row = lambda df, field, pos, o, v: df.select("qid", F.lit(field).alias("field"), pos.cast("int").alias("pos"), o.cast("string").alias("official"), v.cast("string").alias("local"))
    none = F.lit(None)
    heads = row(d.where("o is null or l is null"), "qid", none, F.when(F.col("o").isNotNull(), F.col("qid")), F.when(F.col("l").isNotNull(), F.col("qid"))).unionAll(row(d.where("o <> l"), "depth", none, F.col("o"), F.col("l")))
    same = d.where("o = l").select("qid")
    tag = lambda df, p: df.select("qid", "pos", *[F.col(c).alias(f"{p}_{c}") for c in ("docid", "rank", "score")], F.sha2(F.regexp_replace(F.trim("content"), r"(?U)\s+", " "), 256).alias(f"{p}_content"))
    both = tag(official, "o").join(tag(local, "l"), ["qid", "pos"]).join(same, "qid", "left_semi")
    differs = {c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"l_{c}")) for c in ("docid", "rank", "content")}
    differs["score"] = ~F.coalesce(F.abs(F.col("o_score") - F.col("l_score")) <= tolerance, F.lit(False))
    cells = [F.when(cond, F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").cast("string").alias("official"), F.col(f"l_{c}").cast("string").alias("local"))) for c, cond in differs.items()]
    return heads.unionAll(both.select("qid", "pos", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("qid", "x.field", "pos", "x.official", "x.local"))


def completeness(telemetry: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries without exactly one successful row."""
    ok = telemetry.where("status = 'ok'").groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").distinct().join(ok, "qid", "left").where("coalesce(n, 0) <> 1").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def query_sets(first_stage: DataFrame, telemetry: DataFrame, run: DataFrame) -> DataFrame:
    """``qid`` and where it is missing, unless it is in all three."""
    mark = lambda df, n: df.select("qid").distinct().withColumn(n, F.lit(True))
    all3 = mark(first_stage, "first_stage").join(mark(telemetry, "telemetry"), "qid", "full").join(mark(run, "run"), "qid", "full")
    lost = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("first_stage", "telemetry", "run")]), lambda x: x.isNotNull())
    return all3.select("qid", F.explode(lost).alias("missing_in"))


#: Lines of a block in which rows look for the row before.
_BLOCK = 1 << 16


def _query_before(run: DataFrame) -> DataFrame:
    """``run`` with ``before``, the query of the row before it in the file, null for the first.

    Rows meet in blocks of file positions; the last query of each block, one row
    a block, is handed on to the next.
    """
    rows = run.withColumn("__block", F.floor(F.col("file_pos") / _BLOCK))
    lasts = rows.groupBy("__block").agg(F.max(F.struct("file_pos", "qid"))["qid"].alias("last"))
    lasts = lasts.select("__block", F.lag("last").over(Window.orderBy("__block")).alias("__carried"))  # a row for each 65,536 lines
    own = F.lag("qid").over(Window.partitionBy("__block").orderBy("file_pos"))
    return rows.join(lasts, "__block").withColumn("before", F.coalesce(own, "__carried")).drop("__block", "__carried")


def rank_positions(run: DataFrame) -> DataFrame:
    """``qid, docid, rank, at, apart`` of the rows whose rank isn't their 1-based position in the file, or that another query's rows part from those before.

    ``run`` has ``pos`` and ``file_pos``, as ``parse_run`` gives them.
    """
    apart = (F.col("pos") > 1) & (F.col("before") != F.col("qid"))
    return _query_before(run).where((F.col("rank") != F.col("pos")) | apart).select("qid", "docid", "rank", F.col("pos").alias("at"), apart.alias("apart"))


def completion_marker(logs: DataFrame) -> DataFrame:
    """``cell, path, status`` from ``cell, path, complete``: a complete ``.log`` wins, else the only complete ``.out``."""
    done = logs.where("complete")
    g = done.groupBy("cell").agg(F.min(F.when(F.col("path").endswith(".log"), F.col("path"))).alias("log"), F.min(F.when(F.col("path").endswith(".out"), F.col("path"))).alias("out"), F.count_if(F.col("path").endswith(".out")).alias("n"))
    every = logs.select("cell").distinct().join(g, "cell", "left")
    return every.select("cell", F.coalesce("log", F.when(F.col("n") == 1, F.col("out"))).alias("path"), F.when(F.col("log").isNotNull(), "log").when(F.col("n") == 1, "out").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("status"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two reports has."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionAll(new.exceptAll(old).withColumn("side", F.lit("new")))


def smoke_gate(run: DataFrame, metrics: DataFrame, depth: int) -> DataFrame:
    """Queries with another number of rows than ``depth``, a doubled document in the top 10, or no nDCG at all."""
    g = run.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 10).alias("t"), F.count_distinct(F.when(F.col("rank") <= 10, F.col("docid"))).alias("u"))
    all_ = metrics.where("qid = 'all' and metric like 'ndcg_cut_%'").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("v")).where("v <= 0")
    return g.where(F.col("n") != depth).select("qid", F.lit("row_count").alias("rule")).unionAll(g.where("t <> u").select("qid", F.lit("top10_distinct").alias("rule"))).unionAll(all_.select(F.lit("all").alias("qid"), F.lit("ndcg_zero").alias("rule")))


#: The averages that a smoke run's log must have; the first five are answers that a fallback stood in for.
SMOKE_COUNTERS = (
    "parse fallbacks",
    "numeric out-of-range fallbacks",
    "degenerate repetition fallbacks",
    "unparseable after exhaustion fallbacks",
    "duplicate label fallbacks",
    "parse_failure_strict",
    "parse_failure_bm25_fallback",
)


def smoke_logs(logs: DataFrame, least_retries: int = 3) -> DataFrame:
    """``path, rule`` for each rule that a smoke run's log text ``path, value`` breaks.

    No line of an error; all counters there; no strict or first-stage failure; and where
    fallbacks were accepted, at least ``least_retries`` retries before them.
    """
    counter = {c: F.nullif(F.regexp_extract("value", rf"(?m)^Avg {c}: ([0-9]+(?:\.[0-9]+)?)$", 1), F.lit("")).cast("double") for c in SMOKE_COUNTERS}
    retries = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^Total retries fired: ([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(0))
    rules = [F.when(F.col("value").rlike("Traceback|ERROR|exceeds model limit"), F.lit("error_line"))]
    rules += [F.when(v.isNull(), F.lit(f"missing:{c}")) for c, v in counter.items()]
    rules += [F.when(counter[c] != 0, F.lit(c)) for c in SMOKE_COUNTERS[5:]]
    accepted = reduce(lambda a, b: a + b, [counter[c] for c in SMOKE_COUNTERS[:5]])
    rules.append(F.when((accepted > 0) & (retries < least_retries), F.lit("retries")))
    return logs.select("path", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def context_fit(prompts: DataFrame, limit: int, reserve: int = 256) -> DataFrame:
    """How many prompts ``qid, tokens`` fit a context of ``limit`` tokens with ``reserve`` kept for the answer."""
    return prompts.agg(F.count("*").alias("prompts"), F.max("tokens").alias("most"), F.expr("percentile_disc(0.95) within group (order by tokens)").alias("p95"), F.count_if(F.col("tokens") > limit - reserve).alias("too_long"))


def canonical_hash(values: pd.Series) -> pd.Series:
    """sha256 of JSON texts with sorted keys and no spaces."""
    import hashlib

    return values.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest())


def protocol_hash(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn("protocol_hash", F.pandas_udf(canonical_hash, "string")(column))


def _json_list(*cols: str):
    """A compact JSON array: strings quoted, numbers as they are."""
    return F.concat(F.lit("["), F.concat_ws(",", *cols), F.lit("]"))


def _quoted(col: str):
    """A JSON string; ``to_json`` of a one-element array without its brackets."""
    text = F.to_json(F.array(F.col(col).cast("string")))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def ordered_digest(lines: DataFrame, order: list[str], line: str = "line", opening: str = "", between: str = "", closing: str = "") -> DataFrame:
    """``hash``: sha256 of the lines, strung together in the order of the columns ``order``.

    Rows are dealt and sorted by ranges over the cluster and written; then one
    task, which a hash of a whole needs, reads them as a stream into one hash
    state. It holds one batch at any number of rows, and fails unless they
    come in order.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = written(dealt.select(F.monotonically_increasing_id().alias("at"), F.col(line).alias("line")))

    def digest(batches):
        state, last, gap = hashlib.sha256(opening.encode()), -1, b""
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at <= last:
                    raise ValueError("lines out of order")
                state.update(gap + text.encode("utf-8", "surrogatepass"))
                last, gap = at, between.encode()
        state.update(closing.encode())
        yield pa.record_batch([pa.array([state.hexdigest()])], ["hash"])

    none = hashlib.sha256((opening + closing).encode()).hexdigest()
    return rows.coalesce(1).mapInArrow(digest, "hash string").agg(F.coalesce(F.max("hash"), F.lit(none)).alias("hash"))


def qrels_hash(qrels: DataFrame) -> DataFrame:
    """``hash``: sha256 of the compact JSON list of all judgements ``[qid, docid, rel, iteration]``, sorted.

    ``iteration`` is "0" where there is no such column.
    """
    it = F.col("iteration").cast("string") if "iteration" in qrels.columns else F.lit("0")
    rows = qrels.select(F.col("qid").cast("string").alias("q"), F.col("docid").cast("string").alias("d"), F.col("rel").cast("int").alias("r"), it.alias("i"))
    rows = rows.withColumn("line", _json_list(_quoted("q"), _quoted("d"), F.col("r").cast("string"), _quoted("i")))
    return ordered_digest(rows, ["q", "d", "r", "i"], opening="[", between=",", closing="]")


def canonical_json(values: pd.Series) -> pd.Series:
    """JSON texts with sorted keys and no spaces."""
    return values.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def input_hash(records: DataFrame) -> DataFrame:
    """``hash``: sha256 of the canonical JSON ``record`` of each ``qid``, in the order of ids, each with a line end."""
    lines = records.select("qid", F.pandas_udf(canonical_json, "string")("record").alias("line"))
    return ordered_digest(lines.withColumn("line", F.concat("line", F.lit("\n"))), ["qid", "line"])


def local_passages(official: DataFrame, local: DataFrame) -> DataFrame:
    """The official pool with the local passages' content, once the two agree in ids and depth: else an error for the query."""
    own = local.select("qid", "pos", F.col("docid").alias("own"), F.col("content").alias("text"))
    both = official.join(own, ["qid", "pos"], "full")
    bad = ~F.coalesce(F.col("docid") == F.col("own"), F.lit(False))
    content = F.when(bad, F.raise_error(F.concat(F.lit("pools differ for "), "qid")).cast("string")).otherwise(F.col("text"))
    return both.withColumn("content", content).select(official.columns)


def native_row_violations(telemetry: DataFrame) -> DataFrame:
    """``qid, rule`` where a native row breaks an identity, isn't ``ok``, or has no method or no depth."""
    extra = {"status": "status = 'ok'", "method": "length(method) > 0", "depth": "output_depth > 0"}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in extra.items()]))
    return telemetry_violations(telemetry).unionAll(telemetry.select("qid", F.explode(broken).alias("rule")))


def evaluation_gate(aggregates: DataFrame, required: list[str]) -> DataFrame:
    """``metric, reason`` of the required aggregate metrics that are missing or not above 0."""
    want = aggregates.sparkSession.createDataFrame([(m,) for m in required], "metric string")
    got = want.join(aggregates.where("qid = 'all'").groupBy("metric").agg(F.max("value").alias("value")), "metric", "left")
    return got.where("value is null or isnan(value) or value <= 0").select("metric", F.when(F.col("value").isNull(), "missing").otherwise("not_positive").alias("reason"))


def _attempt_counts(run: DataFrame, expected: DataFrame) -> DataFrame:
    """``qid, n, distinct, outside, size``: rows, documents and documents beyond the pool of a run, and the pool's size; one shuffle by document, one by query."""
    sides = run.select("qid", "docid", F.lit(1).alias("r"), F.lit(0).alias("p")).unionAll(expected.select("qid", "docid", F.lit(0), F.lit(1)))
    cells = sides.groupBy("qid", "docid").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    return cells.groupBy("qid").agg(F.sum("r").alias("n"), F.count_if(F.expr("r > 0")).alias("distinct"), F.count_if(F.expr("r > 0 and p = 0")).alias("outside"), F.sum("p").alias("size"))


def _reasons(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``qid, reason`` for each rule that isn't true of a row; null is not true."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select("qid", F.explode(broken).alias("reason"))


def _as_launched(launch: dict, names: tuple[str, ...]) -> dict[str, str]:
    say = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return {f"launch:{name}": f"{name} <=> {say(launch[name])}" for name in names}


def _attempt(run: DataFrame, told: DataFrame, expected: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Counts of an attempt, and what is wrong with its sets of queries, its depths and its members; ``told`` has a row for each answered query."""
    counts = _attempt_counts(run, expected)
    both = counts.join(told.groupBy("qid").agg(F.count("*").alias("told")), "qid", "full")
    rules = {
        "not_in_run": "n > 0",
        "not_in_telemetry": "told > 0",
        "not_in_first_stage": "size > 0",
        "repeated_in_telemetry": "coalesce(told, 0) <= 1",
        "depth_or_uniqueness": f"coalesce(n, 0) = 0 or (n = {depth} and distinct = {depth})",
        "outside_pool": "coalesce(size, 0) = 0 or outside = 0",
    }
    return counts, _reasons(both, rules)


def native_attempt(run: DataFrame, telemetry: DataFrame, pools: DataFrame, launch: dict, summary: DataFrame) -> DataFrame:
    """``qid, reason`` of all that keeps an attempt from being done; none if it is.

    ``launch`` has ``method, model, dataset, output_objective, output_depth,
    pool_cap``, which each row of ``telemetry`` must repeat, failed ones
    too. A failed query may be told of again, an answered one may not. The
    run, the answered queries and the first stage cut to ``pool_cap`` must
    have the same queries. ``summary`` is one row of totals over the
    answered queries; what differs has a null ``qid``. Null fields differ
    from all values; an empty attempt of an empty first stage is only held
    against its summary.
    """
    if launch["pool_cap"] < launch["output_depth"]:
        raise ValueError(f"a pool of {launch['pool_cap']} can't fill a depth of {launch['output_depth']}")
    answered = telemetry.where("status = 'ok'")
    counts, found = _attempt(run, answered, top_hits(pools, launch["pool_cap"]), launch["output_depth"])
    rows = telemetry.join(counts.select("qid", F.col("size").alias("__size")), "qid", "left")
    rules = _as_launched(launch, ("method", "model", "dataset", "output_objective", "output_depth", "pool_cap"))
    rules |= {"status": "status in ('ok', 'error')", "outside_first_stage": "__size > 0", "live_pool_size": "coalesce(__size, 0) = 0 or live_pool_size = __size"}
    sums = ("llm_calls", "actual_prompt_tokens", "actual_completion_tokens")
    total = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"want_{c}") for c in sums]).crossJoin(counts.agg(F.count_if(F.expr("n > 0")).alias("want_queries")))  # one row each
    held = {f"summary:{c}": f"{c} <=> want_{c}" for c in ("queries", *sums)} | {"summary:output_depth": f"output_depth <=> {launch['output_depth']}"}
    totals = _reasons(summary.crossJoin(total).withColumn("qid", F.lit(None).cast("string")), held)
    own = telemetry_violations(telemetry).withColumnRenamed("rule", "reason")
    return reduce(DataFrame.unionAll, [found, _reasons(rows, rules), own, totals])


def official_attempt(run: DataFrame, telemetry: DataFrame, pools: DataFrame, launch: dict, calls: int | None = None, hits: int = 100) -> DataFrame:
    """``qid, reason`` of what is wrong with an attempt of another project's method.

    Sets of queries, depth and pools as in ``native_attempt``; each row must
    repeat the launch's ``output_objective`` and ``output_depth`` and have
    ``llm_calls`` above 0, and as many as ``calls`` where that is given.
    """
    _, found = _attempt(run, telemetry, top_hits(pools, hits), launch["output_depth"])
    rules = _as_launched(launch, ("output_objective", "output_depth")) | {"no_calls": "llm_calls > 0"}
    if calls is not None:
        rules["calls"] = f"coalesce(llm_calls, 0) <= 0 or llm_calls = {calls}"
    return found.unionAll(_reasons(telemetry, rules))
