"""Scans: run files, evaluations, logs, telemetry, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema


def _fail(cond: Column, message: Column | str, value: Column) -> Column:
    """``value``, or an error where ``cond`` holds."""
    return F.when(cond, F.raise_error(message).cast("string")).otherwise(value)


def parse_run(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Run rows of text lines ``value`` numbered by ``position`` or ``line_number``; ``pos`` is the order within a query in the file, whatever the ranks say, and ``file_pos`` the line's number.

    Blank lines are passed over. Under ``strict`` a line without six fields, or
    without numbers, is an error that names it; else it is dropped.
    """
    at = next((c for c in ("position", "line_number") if c in lines.columns), None)
    if at is None:
        raise ValueError("lines without position or line_number have no order")
    f = F.split(F.trim("value"), r"\s+")
    lines = lines.where(F.trim("value") != "")
    rank, score = F.get(f, 3).try_cast("int"), F.get(f, 4).try_cast("double")
    ok = (F.size(f) == 6) & rank.isNotNull() & score.isNotNull()
    if strict:
        where = [F.col(c).cast("string") for c in ("path", "line_number") if c in lines.columns] or [F.col(at).cast("string")]
        f = F.when(ok, f).otherwise(F.raise_error(F.concat(F.lit("malformed run line "), F.concat_ws(":", *where), F.lit(": "), "value")).cast("array<string>"))
    else:
        lines = lines.where(ok)
    rows = lines.select(f.alias("f"), F.col(at).cast("long").alias("file_pos")).select(F.get("f", 0).alias("qid"), F.get("f", 2).alias("docid"), F.get("f", 3).cast("int").alias("rank"), F.get("f", 4).cast("double").alias("score"), F.get("f", 5).alias("tag"), "file_pos")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("file_pos")).cast("long"))


def read_run(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Six-column run files, of any size; see ``parse_run``."""
    return parse_run(numbered_lines(spark, path), strict)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``path, line_number, position, value``: lines numbered from 1 in each file, and over all files in the order of their paths.

    Files are read in splits, side by side. A first pass counts each split's
    lines; sums over the splits before give its offset, and a line's number is
    that offset and its place in the split. Both passes cut the same files into
    the same splits. What is broadcast has one row for each split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy("path", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.orderBy("path", "__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("path", "__split", "__first", before(Window.partitionBy("path")).alias("__in_file"), before(Window).alias("__in_all"))
    place = F.col("__id") - F.col("__first") + 1
    return lines.join(F.broadcast(offsets), ["path", "__split"]).select("path", (F.col("__in_file") + place).alias("line_number"), (F.col("__in_all") + place).alias("position"), "value")


def top_hits(run: DataFrame, hits: int) -> DataFrame:
    """First ``hits`` of each query, before any join: joins only see what is kept."""
    return run.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("pos") <= hits)


def exact_depth(run: DataFrame, depth: int = 100) -> DataFrame:
    """The first ``depth`` rows of each query, with an error unless they are ``depth`` distinct documents."""
    run = top_hits(run, depth)
    n = run.groupBy("qid").agg(F.count("*").alias("__n"), F.count_distinct("docid").alias("__u"))
    joined = run.join(n, "qid")
    bad = (F.col("__n") != depth) | (F.col("__u") != depth)
    return joined.withColumn("docid", _fail(bad, F.concat(F.lit("wrong depth for "), "qid"), F.col("docid"))).drop("__n", "__u")


def strict_pools(run: DataFrame, cap: int = 100, limit: int | None = None) -> DataFrame:
    """``qid, docids`` of the first ``limit`` queries, each pool of exactly ``cap`` distinct documents: short ones and doubled ones are errors."""
    return expected_pools(exact_depth(run if limit is None else first_queries(run, limit), cap), cap)


def expected_pools(run: DataFrame, cap: int = 100) -> DataFrame:
    return top_hits(run, cap).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "docid"))), lambda x: x["docid"]).alias("docids"))


def first_queries(run: DataFrame, limit: int) -> DataFrame:
    """Rows of the first ``limit`` queries, by the file order ``file_pos`` of their first row (by id without one)."""
    key = F.min("file_pos") if "file_pos" in run.columns else F.lit(0)
    keep = run.groupBy("qid").agg(key.alias("k")).orderBy("k", "qid").limit(limit).select("qid")
    return run.join(keep, "qid", "left_semi")


def effective_text(docs: DataFrame) -> DataFrame:
    """``docid, text`` with the title, if there is one, before the text."""
    return docs.select("docid", F.when(F.col("title").isNotNull(), F.concat_ws(" ", "title", "text")).otherwise(F.col("text")).alias("text"))


def raw_documents(raw: DataFrame) -> DataFrame:
    """``docid, title, text`` from stored JSON in ``docid, raw``."""
    return raw.select("docid", F.from_json("raw", "text string, title string").alias("r")).select("docid", "r.title", "r.text")


def build_pool(run: DataFrame, queries: DataFrame, docs: DataFrame, hits: int) -> DataFrame:
    """``qid, query, pos, docid, score, text``; a query or document that isn't found is an error."""
    cut = top_hits(run, hits)
    q = queries.select("qid", F.col("text").alias("query"))
    d = docs.select("docid", "text", F.lit(True).alias("__d"))
    out = cut.join(q, "qid", "left").join(d, "docid", "left")
    query = _fail(F.col("query").isNull(), F.concat(F.lit("no query "), "qid"), F.col("query"))
    docid = _fail(F.col("__d").isNull(), F.concat(F.lit("no document "), "docid"), F.col("docid"))
    return out.select("qid", query.alias("query"), F.col("pos").cast("int").alias("pos"), docid.alias("docid"), "score", "text")


def read_hits_jsonl(spark: SparkSession, path, depth: int = 100) -> DataFrame:
    """A row for each hit of ``{qid, query, hits: [{docid, rank, score, content}]}`` lines."""
    rows = read_jsonl(spark, path, "qid string, query string, hits array<struct<docid:string,rank:int,score:double,content:string>>")
    bad = (F.size("hits") != depth) | (F.size(F.array_distinct(F.transform("hits", lambda h: h["docid"]))) != depth)
    bad = bad | (F.count("*").over(Window.partitionBy("qid")) > 1)  # one line for each query
    rows = rows.withColumn("qid", _fail(bad, F.concat(F.lit("wrong hits for "), "qid"), F.col("qid")))
    return rows.select("qid", "query", F.posexplode("hits").alias("pos", "h")).select("qid", "query", (F.col("pos") + 1).alias("pos"), "h.*")


def read_jsonl(spark: SparkSession, path, schema_: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones are skipped. Under ``strict`` one that isn't JSON is an error, else a row of nulls."""
    reader = spark.read.schema(schema_).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path)


def broken_json(lines: DataFrame) -> DataFrame:
    """``path, line_number, value`` of the lines, as ``numbered_lines`` gives them, that are no JSON."""
    return lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def read_comparisons(spark: SparkSession, path) -> DataFrame:
    return read_jsonl(spark, path, schema.COMPARISON).withColumn("label_scheme", F.coalesce("label_scheme", F.lit("letters_a_w")))


def read_telemetry(spark: SparkSession, path) -> DataFrame:
    """Telemetry rows; one that isn't ``ok``, or a query twice, is an error."""
    rows = read_jsonl(spark, path, schema.TELEMETRY)
    n = F.count("*").over(Window.partitionBy("qid"))
    bad = (F.col("status") != "ok") | (n > 1)
    return rows.withColumn("qid", _fail(bad, F.concat(F.lit("bad telemetry for "), F.coalesce("qid", F.lit("?"))), F.col("qid")))


# ---- evaluations ----------------------------------------------------------------


def parse_evals(lines: DataFrame) -> DataFrame:
    """``metric, qid, value, path, at`` of lines ``value, path, at`` with three fields and a number."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(f) == 3).select(F.get(f, 0).alias("metric"), F.get(f, 1).alias("qid"), F.get(f, 2).try_cast("double").alias("value"), "path", "at")
    return rows.where("value is not null")


def read_evals(spark: SparkSession, path) -> DataFrame:
    """All ``metric qid value`` lines with three fields and a number, as ``metric, qid, value, path, at``."""
    return parse_evals(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at")))


def per_query(evals: DataFrame, metric: str, strict: bool = True) -> DataFrame:
    """Rows of one metric without ``all``. Under ``strict`` a query twice, or no row at all, is an error; else the last line counts."""
    rows = evals.where((F.col("metric") == metric) & (F.col("qid") != "all"))
    g = rows.groupBy("metric", "qid").agg(F.max_by("value", "at").alias("value"), F.count("*").alias("n"))
    if strict and g.isEmpty():
        raise ValueError(f"no rows for metric {metric}")
    qid = _fail(F.col("n") > 1, F.concat(F.lit("duplicate qid "), "qid"), F.col("qid")) if strict else F.col("qid")
    return g.select("metric", qid.alias("qid"), "value")


def aggregates(evals: DataFrame) -> DataFrame:
    return evals.where("qid = 'all'").select("metric", "qid", "value", "path")


# ---- logs -----------------------------------------------------------------------

#: The lines of an execution log, by measure.
LOG_LINES = {
    "avg_comparisons": r"Avg comparisons:\s*([0-9.eE+-]+)",
    "avg_prompt_tokens": r"Avg prompt tokens:\s*([0-9.eE+-]+)",
    "avg_completion_tokens": r"Avg completion tokens:\s*([0-9.eE+-]+)",
    "avg_time_per_query": r"Avg time per query:\s*([0-9.eE+-]+)",
    "avg_parse_fallbacks": r"Avg parse fallbacks:\s*([0-9.eE+-]+)",
    "avg_lexical_refusal_fallbacks": r"Avg lexical refusal fallbacks:\s*([0-9.eE+-]+)",
    "avg_numeric_out_of_range_fallbacks": r"Avg numeric out-of-range fallbacks:\s*([0-9.eE+-]+)",
    "retries_fired": r"Total retries fired:\s*([0-9.eE+-]+)",
}


def _measures(text: DataFrame, patterns: dict[str, str], flags: str = "") -> DataFrame:
    """``path, metric, value`` for every pattern, null where it isn't found in the ``value`` of a ``path``."""
    found = [F.struct(F.lit(k).alias("metric"), F.nullif(F.regexp_extract("value", flags + p, 1), F.lit("")).try_cast("double").alias("value")) for k, p in patterns.items()]
    return text.select("path", F.explode(F.array(*found)).alias("m")).select("path", "m.metric", "m.value")


def log_measures(text: DataFrame) -> DataFrame:
    """``path, metric, value`` for each measure found in log texts ``path, value``; prompt and completion tokens also as their total. No retries line means 0."""
    found = _measures(text, LOG_LINES).withColumn("value", F.when(F.col("metric") == "retries_fired", F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))
    tokens = found.where("metric in ('avg_prompt_tokens', 'avg_completion_tokens')").groupBy("path").agg(F.when(F.count("value") == 2, F.sum("value")).alias("value"))
    return found.unionAll(tokens.select("path", F.lit("avg_total_tokens"), "value")).where("value is not null")


def read_logs(spark: SparkSession, path) -> DataFrame:
    return log_measures(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))


#: The counters of fallbacks in a log, with their labels, and how they are aggregated.
FALLBACK_LINES = {
    "parse_fallbacks": ("Avg parse fallbacks", "average_per_query"),
    "strict_parse_fallbacks": ("Avg strict parse fallbacks", "average_per_query"),
    "unparseable_after_exhaustion_fallbacks": ("Avg unparseable after exhaustion fallbacks", "average_per_query"),
    "bm25_bypasses": ("Avg BM25 bypass", "average_per_query"),
    "parse_failure_bm25_fallback": ("Avg parse_failure_bm25_fallback", "average_per_query"),
    "retries_fired": ("Total retries fired", "total"),
}
_NUMBER = r":\s*([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)"


def fallback_counters(text: DataFrame) -> DataFrame:
    """``path, counter, value, aggregation``, a row for each counter of each log text ``path, value``: null if it isn't there, but 0 retries."""
    found = _measures(text, {k: label + _NUMBER for k, (label, _) in FALLBACK_LINES.items()}, "(?i)")
    how = F.create_map(*[F.lit(x) for k, (_, kind) in FALLBACK_LINES.items() for x in (k, kind)])
    value = F.when(F.col("metric") == "retries_fired", F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return found.select("path", F.col("metric").alias("counter"), value.alias("value"), how[F.col("metric")].alias("aggregation"))


def cell_of(path: Column) -> Column:
    """Dimensions of ``…/tag/model/dataset/method/poolNN[_reverse|_shuffle]/file``."""
    parts = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/pool(\d+)(?:_(reverse|shuffle))?/[^/]+$"
    at = lambda k: F.regexp_extract(path, parts, k)
    return F.when(path.rlike(parts), F.struct(at(1).alias("tag"), at(2).alias("model"), at(3).alias("dataset"), at(4).alias("method"), at(5).cast("int").alias("pool"), F.when(at(6) == "", "forward").otherwise(at(6)).alias("condition")))


#: Directories that name a method family, the prefix of the method, and the part taken off the file's stem. First match wins.
METHOD_PATHS = [
    ("/max-context/topdown/", "max-context", "maxctx_topdown", None),
    ("/max-context/bottomup/", "max-context", "maxctx_bottomup", None),
    ("/original/bottomup/ws-3/", "original_bottomup_ws3", "orig_bu_ws3_", "bottomup_"),
    ("/original/bottomup/ws-ps/", "original_bottomup_wsps", "orig_bu_wsps_", "bottomup_"),
    ("/original/bottomup/", "original_bottomup", "orig_bu_", "bottomup_"),
    ("/original/ws-3/", "original_ws3", "orig_ws3_", "topdown_"),
    ("/original/ws-ps/", "original_wsps", "orig_wsps_", "topdown_"),
]


def run_dimensions(path: Column) -> Column:
    """``run_id, model, topk, condition, method, method_family`` of a path below the folder of results."""
    parts, slashed = F.split(path, "/"), F.concat(F.lit("/"), path, F.lit("/"))
    first = lambda pattern: F.get(F.filter(parts, lambda x: x.rlike(pattern)), 0)
    top = first(r"^top\d+(_(reverse|shuffle))?$")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    dual = slashed.contains("/phase1/") & (stem == "maxcontext_dualend")
    method, family = F.when(dual, "dualend"), F.when(dual, "phase1")
    for folder, name, prefix, off in METHOD_PATHS:
        inside = slashed.contains(folder)
        method = method.when(inside, F.lit(prefix) if off is None else F.concat(F.lit(prefix), F.replace(stem, F.lit(off), F.lit(""))))
        family = family.when(inside, name)
    condition = F.coalesce(F.nullif(F.regexp_extract(top, r"_(reverse|shuffle)$", 1), F.lit("")), F.lit("forward"))
    return F.struct(
        F.get(parts, 0).alias("run_id"),
        F.coalesce(first(r"^.+-dl\d+$"), F.lit("unknown")).alias("model"),
        F.coalesce(F.nullif(F.regexp_extract(top, r"^(top\d+)", 1), F.lit("")), F.lit("unknown")).alias("topk"),
        condition.alias("condition"),
        method.otherwise(stem).alias("method"),
        family.otherwise("unknown").alias("method_family"),
    )


def input_order(pool: DataFrame, how: str, seed: int = 929) -> DataFrame:
    """The pool with ``pos`` in reverse (``inverse``) or shuffled (``random``: by a hash of seed, query and document, so that reruns agree)."""
    key = {"inverse": F.desc("pos"), "random": F.xxhash64(F.lit(seed), "qid", "docid")}[how]
    return pool.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(key, "docid")))


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, length`` of the files below ``root`` whose name fits the glob ``pattern``, at any depth; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")
