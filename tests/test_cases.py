"""Grammars over fixed cases, and small operators, with the results that they must have."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rankforge.functions import labels, text, udfs
from rankforge.operators import audit, metrics, stats
from rankforge.sources import readers

CASES = {}


def query(sql):
    return lambda f: CASES.setdefault(f.__name__, (f, sql))

L, B, N = labels.LETTERS, labels.BIGRAMS, labels.NUMERIC

#: Text, scheme, documents, strict, and the label that must be read.
SINGLE = [
    ("10", L, 10, True, "J"), ("**7**</s>", L, 10, True, "G"), ("**7**</s>", L, 3, True, None), ("D</s>", L, 3, True, None), ("Basking Shark</s>", L, 4, True, None),
    ("AB</s>", B, 100, True, "AB"), ("D</s>", B, 100, True, "AD"), ("**7**</s>", B, 100, True, "AG"),
    ("0", N, 50, True, None), ("-1", N, 50, True, None), ("51", N, 50, True, None), ("(Passage 21) is the least relevant", N, 50, True, "21"), ("D</s>", N, 100, True, "4"),
    ("Passage [B]", L, 4, False, "B"), ("The best is [C].", L, 4, False, "C"), ("<think>A or B</think> D", L, 4, False, "D"), ("", L, 3, False, None), ("3", N, 5, False, "3"),
]
#: Text, scheme, documents, strict, and the best and worst label.
DUAL = [
    ("Best: 3, Worst: 4", N, 10, True, "3", "4"), ("**Best**: 3, **Worst**: 4", N, 10, True, "3", "4"), ("Best: 17, Worst: 42", N, 10, True, None, None), ("Best: 17, Worst: 42", N, 10, False, None, None),
    ("Passage 3 and Passage 3, then 7", N, 10, True, "3", "7"), ("Passage 5 beats 7", N, 10, True, "5", "7"), ("only 5", N, 10, True, None, None), ("only 5", N, 10, False, None, None), ("Best: 2", N, 10, True, None, None),
    ("Best: A, Worst: C", L, 4, True, "A", "C"), ("Best: [A], Worst: [C]", L, 4, True, "A", "C"), ("Best: 1, Worst: 3", L, 4, False, "A", "C"), ("Passage A, Passage C", L, 4, True, "A", "C"), ("A, C", L, 4, True, "A", "C"),
    ("1, 3", L, 4, True, "A", "C"), ("Best: A, Worst: Q", L, 4, True, None, None), ("Most relevant: B. Least relevant: D", L, 4, True, "B", "D"), ("mangled output", N, 4, True, None, None),
]
#: Text, documents, and why it is no answer of the numeric scheme.
NOOPS = [
    ("None of the passages is relevant", 5, "lexical_refusal"), ("9", 5, "numeric_out_of_range"), ("Best: 3, Worst: 42", 10, "numeric_out_of_range"), ("4", 5, None),
    ("again and again " * 12, 5, "degenerate_repetition"), (" ".join(f"word{k}" for k in range(40)), 5, "unparseable_after_exhaustion"), ("hm", 5, None),
]
#: Path below the results, and run, model, top, condition, method, family.
PATHS = [
    ("run3/qwen-dl19/top50_reverse/phase1/maxcontext_dualend.eval", "run3", "qwen-dl19", "top50", "reverse", "dualend", "phase1"),
    ("run1/qwen-dl20/top100/max-context/topdown/x.eval", "run1", "qwen-dl20", "top100", "forward", "maxctx_topdown", "max-context"),
    ("run1/m-dl20/top10_shuffle/max-context/bottomup/x.eval", "run1", "m-dl20", "top10", "shuffle", "maxctx_bottomup", "max-context"),
    ("run2/m-dl19/original/bottomup/ws-3/bottomup_heapsort.eval", "run2", "m-dl19", "unknown", "forward", "orig_bu_ws3_heapsort", "original_bottomup_ws3"),
    ("run2/m-dl19/original/bottomup/ws-ps/bottomup_bubblesort.eval", "run2", "m-dl19", "unknown", "forward", "orig_bu_wsps_bubblesort", "original_bottomup_wsps"),
    ("run2/m-dl19/original/bottomup/bottomup_bubblesort.eval", "run2", "m-dl19", "unknown", "forward", "orig_bu_bubblesort", "original_bottomup"),
    ("run2/m-dl19/original/ws-3/topdown_heapsort.eval", "run2", "m-dl19", "unknown", "forward", "orig_ws3_heapsort", "original_ws3"),
    ("run2/m-dl19/original/ws-ps/topdown_heapsort.eval", "run2", "m-dl19", "unknown", "forward", "orig_wsps_heapsort", "original_wsps"),
    ("run2/other/listwise.eval", "run2", "unknown", "unknown", "forward", "listwise", "unknown"),
]
#: Values, and the half width of their 95 % interval, from the t table.
SMALL = [("two", [1.0, 3.0], 12.706), ("three", [1.0, 2.0, 3.0], 4.303 / 3**0.5), ("five", [1.0, 2.0, 3.0, 4.0, 5.0], 2.776 / 2**0.5)]


def _sql(rows: list[tuple], names: str) -> str:
    """The rows as SQL values."""
    say = lambda v: "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) AS t({names})"


@query(_sql([(k, c[-1]) for k, c in enumerate(SINGLE)], "place, label"))
def label_cases(spark, d):
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(SINGLE)], "place int, raw string, scheme string, n int, strict boolean")
    return rows.select("place", udfs.parse_single("raw", "scheme", "n", "strict").alias("label"))


@query(_sql([(k, *c[-2:]) for k, c in enumerate(DUAL)], "place, best, worst"))
def dual_label_cases(spark, d):
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(DUAL)], "place int, raw string, scheme string, n int, strict boolean")
    return rows.select("place", udfs.parse_dual("raw", "scheme", "n", "strict").alias("x")).select("place", "x.best", "x.worst")


@query(_sql([(k, c[-1]) for k, c in enumerate(NOOPS)], "place, reason"))
def noop_cases(spark, d):
    rows = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(NOOPS)], "place int, raw string, n int")
    return rows.select("place", udfs.noop_reason("raw", F.lit(N), "n").alias("reason"))


@query(_sql(PATHS, "path, run_id, model, topk, condition, method, method_family"))
def run_path_cases(spark, d):
    rows = spark.createDataFrame([(p[0],) for p in PATHS], "path string")
    return rows.select("path", readers.run_dimensions(F.col("path")).alias("x")).select("path", "x.*")


@query(_sql([(n, len(v), round(sum(v) / len(v) - h, 5), round(sum(v) / len(v) + h, 5)) for n, v, h in SMALL], "name, n, ci95_low, ci95_high"))
def small_sample_intervals(spark, d):
    rows = spark.createDataFrame([(n, x) for n, v, _ in SMALL for x in v], "name string, value double")
    return stats.summarize(rows, ["name"]).select("name", F.col("n").cast("int").alias("n"), F.round("ci95_low", 5).alias("ci95_low"), F.round("ci95_high", 5).alias("ci95_high"))


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    make, sql = CASES[name]
    got, want = make(spark, None), duckdb.sql(sql)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_small_audits(spark):
    told = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "ok"), ("c", "ok")], "qid string, status string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    assert sorted(map(tuple, audit.completeness(told, asked).collect())) == [("b", 0), ("c", 2), ("d", 0)]
    old, new = (spark.createDataFrame(rows, "k string, v int") for rows in ([("x", 1), ("y", 2), ("y", 2)], [("x", 1), ("y", 2), ("z", 3)]))
    assert sorted(map(tuple, audit.drift(old, new).collect())) == [("y", 2, "old"), ("z", 3, "new")]
    hashed = audit.protocol_hash(spark.createDataFrame([('{"b": 1, "a": "\u00e9"}',), (None,)], "p string"), "p").collect()
    assert [r.protocol_hash for r in hashed] == [hashlib.sha256('{"a":"\u00e9","b":1}'.encode()).hexdigest(), None]


def test_smoke_gate(spark):
    run = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2), ("b", "d1", 1), ("b", "d1", 2), ("c", "d1", 1)], "qid string, docid string, rank int")
    evals = spark.createDataFrame([("ndcg_cut_10", "all", 0.0), ("map", "all", 0.5)], "metric string, qid string, value double")
    assert sorted(map(tuple, audit.smoke_gate(run, evals, 2).collect())) == [("all", "ndcg_zero"), ("b", "top10_distinct"), ("c", "row_count")]


def test_smoke_logs(spark):
    zero = {c: 0 for c in audit.SMOKE_COUNTERS}
    say = lambda counters, retries=None, more="": "\n".join([f"Avg {k}: {v}" for k, v in counters.items()] + ([f"Total retries fired: {retries}"] if retries is not None else []) + [more])
    logs = {
        "good": say(zero), "retried": say(zero | {"parse fallbacks": 0.5}, 3), "hasty": say(zero | {"duplicate label fallbacks": 0.25}, 2), "silent": say(zero | {"parse fallbacks": 1}),
        "strict": say(zero | {"parse_failure_strict": 0.5}), "bm25": say(zero | {"parse_failure_bm25_fallback": 1}), "short": say({k: v for k, v in zero.items() if k != "parse fallbacks"}), "dead": say(zero, None, "Traceback (most recent call last):"),
    }
    got = sorted(map(tuple, audit.smoke_logs(spark.createDataFrame(list(logs.items()), "path string, value string")).collect()))
    assert got == [("bm25", "parse_failure_bm25_fallback"), ("dead", "error_line"), ("hasty", "retries"), ("short", "missing:parse fallbacks"), ("silent", "retries"), ("strict", "parse_failure_strict")]


def test_raw_capture(spark):
    one = lambda k, accepted: (k, "raw", 3, 1, accepted, "ok", None)
    rows = [("a", "best", [one(0, False), one(1, True)]), ("b", "best", [one(0, True), one(1, True)]), ("c", "best", [one(1, True)]), ("d", "best", None), ("e", "dual_worst", None), ("f", "best", [one(0, True)])]
    from rankforge import schema

    log = spark.createDataFrame(rows, f"qid string, type string, raw_attempts array<{schema.ATTEMPT}>")
    told = spark.createDataFrame([("a", 2, 8), ("b", 2, 8), ("c", 1, 4), ("f", 2, 4)], "qid string, retry_inclusive_llm_calls long, actual_total_tokens long")
    assert sorted(map(tuple, audit.raw_capture_violations(log, told).collect())) == [("b", "attempt_order"), ("c", "attempt_order"), ("d", "attempt_order"), ("f", "charged_total")]


def test_orders_and_averages(spark):
    names = spark.createDataFrame([("run10",), ("run2",), ("beta",), ("run1",), ("alpha",)], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["run1", "run2", "run10", "alpha", "beta"]
    summary = spark.createDataFrame([("m", "f", "t", 0.3), ("a", "f", "t", 0.1), ("b", "f", "t", 0.1), ("n", "f", "t", None)], "method string, condition string, topk string, std_sample double").where("std_sample is not null")
    assert [r.method for r in stats.most_stable(summary, 2).collect()] == ["a", "b"]
    told = spark.createDataFrame([("m", "ok", 2, 3, 10, 1, 2.0), ("m", "ok", 4, 4, 20, 3, 4.0), ("m", "error", 9, 9, 9, 9, 9.0)], "method string, status string, llm_calls long, retry_inclusive_llm_calls long, actual_prompt_tokens long, actual_completion_tokens long, wall_seconds double")
    assert [tuple(r) for r in stats.run_averages(told).collect()] == [("m", 2, 3.0, 3.5, 15.0, 2.0, 3.0)]
    run = spark.createDataFrame([("q", "a", 9, 1.0), ("q", "b", 1, 1.0), ("q", "c", 2, 3.0)], "qid string, docid string, rank int, score double")
    assert {r.docid: r["rank"] for r in metrics.trec_order(run).collect()} == {"c": 1, "b": 2, "a": 3}


def test_permutation_table(spark):
    spark.udtf.register("permutation_table", udfs.PermutationTable)
    rows = spark.createDataFrame([("x", "[2] > [1]", 3), ("y", "nothing", 2)], "k string, raw string, n int")
    rows.createOrReplaceTempView("answers")
    got = spark.sql("select k, pos, idx from answers, lateral permutation_table(raw, n)").collect()
    want = [(k, pos, idx) for k, raw, n in (("x", "[2] > [1]", 3), ("y", "nothing", 2)) for pos, idx in enumerate(labels.parse_permutation(raw, n))]
    assert sorted(map(tuple, got)) == sorted(want)
