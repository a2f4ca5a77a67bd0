"""Attempts in folders, integrity of artefacts, accounting of repairs, ordered digests and likelihood scores."""

import copy
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rankforge.operators import audit, integrity, likelihood
from rankforge.sources import attempt_files


def attempt(folder, manifest='{"baseline": "b", "dataset": "d"}', done=True, rows=('{"qid": "1", "llm_calls": 2}',)):
    folder.mkdir(parents=True)
    if manifest is not None:
        (folder / "protocol_manifest.json").write_text(manifest)
    if done:
        (folder / "DONE").write_text("ok\n")
    if rows is not None:
        (folder / "x_telemetry.jsonl").write_text("\n".join(rows) + "\n")


def test_collect_attempts(spark, tmp_path):
    rows = ['{"qid": "1", "llm_calls": 3, "wall_seconds": 2.5}', "", '{"qid": "2", "total_calls": 13, "retry_calls": 2, "query_wall_seconds": 4, "dataset": "own"}', '{"qid": "3", "llm_calls": null, "total_calls": 9, "wall_seconds": 1, "retry_excluded_wall_seconds": null}']
    attempt(tmp_path / "m/new", rows=rows)
    attempt(tmp_path / "m/old")
    attempt(tmp_path / "unfinished/a", done=False)
    attempt(tmp_path / "bare/a", manifest=None)
    attempt(tmp_path / "silent/a", rows=None)
    attempt(tmp_path / "smoke-q2/s/a")
    for name, latest in {"m": "new\n", "unfinished": "a", "bare": "a", "silent": " a\n", "smoke-q2/s": "a", "odd": "../m/new", "empty": "\n"}.items():
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "LATEST").write_text(latest)
    got, left_out = attempt_files.collect_attempts(spark, str(tmp_path))
    told = {r.qid: r for r in got.collect()}
    assert set(told) == {"1", "2", "3"} and {r.attempt.rsplit("/", 2)[-2:][1] for r in told.values()} == {"new"}
    assert (told["1"].llm_calls, told["1"].retry_inclusive_llm_calls, told["1"].retry_excluded_wall_seconds, told["1"].dataset, told["1"].method) == (3, 3, 2.5, "d", "b")
    assert (told["2"].llm_calls, told["2"].retry_inclusive_llm_calls, told["2"].wall_seconds, told["2"].dataset) == (13, 15, 4.0, "own")
    assert (told["3"].llm_calls, told["3"].retry_inclusive_llm_calls, told["3"].retry_excluded_wall_seconds) == (None, 0, None)  # a null of its own is kept
    reasons = {r.attempt.rsplit("/")[-2 if r.attempt.endswith("/a") else -1]: r.reason for r in left_out.collect()}
    assert reasons == {"unfinished": "incomplete_no_DONE", "bare": "missing_manifest", "silent": "missing_telemetry", "odd": "invalid_LATEST_pointer", "empty": "invalid_LATEST_pointer"}
    assert attempt_files.collect_attempts(spark, str(tmp_path), include_smoke=True)[0].count() == 4
    attempt_files.publish(spark, str(tmp_path / "m"), "old", '{"baseline": "z"}')
    assert [(r.method, r.qid) for r in attempt_files.collect_attempts(spark, str(tmp_path / "m"))[0].collect()] == [("z", "1")]


def test_artefacts_against_their_manifest(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    prompt = {"direction": "maxcontext_dualend"}
    cases = {
        "good": {},
        "changed": {"output_run_sha256": sha("run ")},
        "stale": {"prompt_contract": prompt, "prompt_template_contract": {"rendered_chat_prompt": "a", "rendered_chat_prompt_sha256": sha("b")}},
        "bare": {"prompt_contract": prompt},
        "fine": {"prompt_contract": prompt, "prompt_template_contract": {"rendered_chat_prompt": "a", "rendered_chat_prompt_sha256": sha("a")}},
        "lost": {"summary_file": "none.json", "summary_sha256": sha("")},
        "unhashed": {"telemetry_file": "run.txt"},
    }
    for name, more in cases.items():
        attempt(tmp_path / name, json.dumps({"run_file": "run.txt", "output_run_sha256": sha("run")} | more))
        (tmp_path / name / "run.txt").write_text("run")
    (tmp_path / "good/run.txt").write_text("run")
    manifests = attempt_files.read_manifests(spark, str(tmp_path))
    name = F.regexp_extract("attempt", "([^/]*)$", 1).alias("name")
    files = lambda: {tuple(r) for r in integrity.artefact_mismatches(manifests, attempt_files.hashed_files(spark, str(tmp_path))).select(name, "artefact", "reason").collect()}
    want = {("changed", "run", "changed_file"), ("lost", "summary", "missing_file"), ("unhashed", "telemetry", "no_hash")}
    assert files() == want
    (tmp_path / "good/run.txt").write_text("rum")  # one byte
    assert files() == want | {("good", "run", "changed_file")}
    assert {tuple(r) for r in integrity.template_mismatches(manifests).select(name, "reason").collect()} == {("stale", "stale_template_hash"), ("bare", "missing_template")}


def event(repaired):
    hashes = [hashlib.sha256(bytes([k])).hexdigest() for k in range(2)]
    made = lambda k, text, valid: {"attempt_index": k, "attempt_kind": ["initial", "format_repair"][k], "raw_output": text + "</s>", "content_output": text, "parser_input": text, "special_tokens_removed": True, "format_valid": valid, "status": "ok" if valid else "format_invalid", "parser_input_policy": "p", "no_document_policy": "n", "generation_budget": 9, "rendered_prompt_sha256": hashes[k], "prompt_tokens": 5 + k, "completion_tokens": 2, "duration_seconds": 0.25 + k}
    attempts = [made(0, "no", False), made(1, "a\nDocument 1", True)] if repaired else [made(0, "Document 3", True)]
    total = {"retry_calls": int(repaired), "retry_seconds": 1.25 if repaired else 0.0, "format_repair_triggered": repaired, "format_repair_succeeded": repaired, "initial_format_valid": not repaired, "prompt_tokens": 11 if repaired else 5, "completion_tokens": 2 * len(attempts), "duration_seconds": 1.5 if repaired else 0.25}
    last = {k: attempts[-1][k] for k in integrity._FINAL}
    return {"qid": "q", "event": 0, "format_repair_policy": "r", "generation_attempts": attempts, "generation_attempt_count": len(attempts)} | total | last


FAULTS = [
    ("policy", lambda e: e.update(format_repair_policy="x")),
    ("attempts", lambda e: e.update(generation_attempts=[], generation_attempt_count=0)),
    ("attempt_count", lambda e: e.update(generation_attempt_count=3)),
    ("attempt_index", lambda e: e["generation_attempts"][1].update(attempt_index=0)),
    ("attempt_kind", lambda e: e["generation_attempts"][1].update(attempt_kind="initial")),
    ("views", lambda e: e["generation_attempts"][0].update(raw_output=None)),
    ("parser_input", lambda e: e["generation_attempts"][0].update(parser_input="other")),
    ("control_tokens", lambda e: e["generation_attempts"][0].update(special_tokens_removed=False)),
    ("format_flag", lambda e: e["generation_attempts"][0].update(parser_input="Document", content_output="Document")),
    ("attempt_status", lambda e: e["generation_attempts"][0].update(status="ok")),
    ("parser_policy", lambda e: e["generation_attempts"][0].update(parser_input_policy="q")),
    ("no_document_policy", lambda e: e["generation_attempts"][0].update(no_document_policy=None)),
    ("generation_budget", lambda e: e["generation_attempts"][0].update(generation_budget=8)),
    ("prompt_hash", lambda e: e["generation_attempts"][0].update(rendered_prompt_sha256="AB")),
    ("attempt_tokens", lambda e: e["generation_attempts"][0].update(prompt_tokens=-1)),
    ("attempt_seconds", lambda e: e["generation_attempts"][0].update(duration_seconds=-1.0)),
    ("repair_after_valid", lambda e: e["generation_attempts"][0].update(format_valid=True)),
    ("invalid_in_the_end", lambda e: e["generation_attempts"][1].update(format_valid=False)),
    ("retry_calls", lambda e: e.update(retry_calls=0)),
    ("retry_seconds", lambda e: e.update(retry_seconds=None)),
    ("triggered", lambda e: e.update(format_repair_triggered=False)),
    ("succeeded", lambda e: e.update(format_repair_succeeded=False)),
    ("initial_flag", lambda e: e.update(initial_format_valid=True)),
    ("prompt_tokens", lambda e: e.update(prompt_tokens=6)),
    ("completion_tokens", lambda e: e.update(completion_tokens=2)),
    ("seconds", lambda e: e.update(duration_seconds=1.25)),
    ("final_view:raw_output", lambda e: e.update(raw_output="other")),
    ("final_view:format_valid", lambda e: e.update(format_valid=False)),
]


def test_repair_rules(spark):
    events = []
    for k, fault in enumerate([None, None, *FAULTS]):
        e = event(k != 1)
        if fault:
            fault[1](e)
        events.append(e | {"qid": str(k), "event": k})
    got: dict = {}
    for r in integrity.repair_violations(spark.createDataFrame(events, integrity.EVENT), "r", "p", "n", 9).collect():
        got.setdefault(r.event, set()).add(r.reason)
    assert 0 not in got and 1 not in got
    for k, (name, _) in enumerate(FAULTS, 2):
        assert name in got.get(k, ()), name
    alone = {name for k, (name, _) in enumerate(FAULTS, 2) if got[k] == {name}}
    assert {"attempt_count", "control_tokens", "retry_calls", "prompt_tokens", "final_view:raw_output", "prompt_hash"} <= alone
    legacy = {k: None for k in event(True)} | {"qid": "l", "event": 0, "prompt_tokens": 1}
    rows = spark.createDataFrame([legacy, legacy | {"event": 1, "retry_calls": 1}, legacy | {"event": 2, "format_repair_policy": "r"}, event(True) | {"event": 3}], integrity.EVENT)
    assert sorted((r.event, r.reason) for r in integrity.repair_violations(rows, None).collect()) == [(1, "legacy_retries"), (2, "legacy_policy"), (3, "legacy_generations"), (3, "legacy_policy"), (3, "legacy_retries")]


def test_charges(spark):
    events = [event(True) | {"qid": q, "event": k} for q in "abc" for k in range(3)] + [event(False) | {"qid": q} for q in "abc"]
    right = {"calls": 4, "retry_calls": 3, "retry_seconds": 3.75, "prompt_tokens": 38, "completion_tokens": 14, "duration_seconds": 4.75, "generations": 7, "initial_format_failures": 3, "format_repair_successes": 3}
    told = [right | {"qid": "a"}, right | {"qid": "b", "retry_calls": 2}, right | {"qid": "d", "calls": None}]
    schema = "qid string, calls long, retry_calls long, retry_seconds double, prompt_tokens long, completion_tokens long, duration_seconds double, generations long, initial_format_failures long, format_repair_successes long"
    telemetry = spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in told], schema)
    got = copy.deepcopy(sorted((r.qid, r.reason) for r in integrity.charge_violations(telemetry, spark.createDataFrame(events, integrity.EVENT)).collect()))
    assert got == sorted([("b", "charge:retry_calls"), ("c", "uncharged"), *[("d", f"charge:{c}") for c in integrity.CHARGES]])


def test_ordered_digest(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcdé"), rng.randrange(50), f"line {k} 日本") for k in range(3000)]
    df = spark.createDataFrame(rows, "q string, n int, line string").repartition(13)
    want = hashlib.sha256(("<" + "|".join(r[2] for r in sorted(rows)) + ">").encode()).hexdigest()
    assert audit.ordered_digest(df, ["q", "n", "line"], opening="<", between="|", closing=">").first().hash == want
    none = audit.ordered_digest(df.limit(0), ["q"], opening="[", closing="]").collect()
    assert [r.hash for r in none] == [hashlib.sha256(b"[]").hexdigest()]


def test_digests_hold_one_batch(spark):
    """Ten times the rows, the same memory in the task that hashes."""

    def peak(n):
        rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("q"), F.repeat(F.lit("x"), 200).alias("line"))
        audit.ordered_digest(rows, ["q"]).collect()
        return max(spark.sparkContext.parallelize(range(8), 8).map(lambda _: __import__("resource").getrusage(__import__("resource").RUSAGE_SELF).ru_maxrss).collect())

    small = peak(40_000)
    assert peak(400_000) - small < 60_000  # KB; all its lines are 80 MB


def test_likelihood(spark):
    docs = [("d1", "a b a c"), ("d2", "a"), ("d3", ""), ("d4", None), ("d5", "b b b x"), ("d6", "a b a c")]
    queries = [("q1", "A b a zzz"), ("q2", ""), ("q3", "x")]
    pool = [(q, k, d) for q, _ in queries for k, (d, _) in enumerate([*docs, ("gone", "")], 1)]
    got = likelihood.query_likelihood(spark.createDataFrame(pool, "qid string, pos int, docid string"), spark.createDataFrame(queries, "qid string, text string"), spark.createDataFrame(docs, "docid string, text string"), mu=10.0)
    toks = {d: (t or "").lower().split() for d, t in docs} | {"gone": []}
    every = [t for d in toks.values() for t in d]
    score = lambda q, d: round(sum(math.log((toks[d].count(t) + 10 * every.count(t) / len(every)) / (len(toks[d]) + 10)) for t in q.lower().split() if t in every), 9)
    want = {}
    for q, text in queries:
        order = sorted((-score(text, d), k, d) for k, (d, _) in enumerate([*docs, ("gone", "")], 1))
        want |= {(q, d): (-s, n) for n, (s, _, d) in enumerate(order, 1)}
    rows = {(r.qid, r.docid): (r.score, r["rank"]) for r in got.collect()}
    assert {k: r for k, (_, r) in rows.items()} == {k: r for k, (_, r) in want.items()}
    assert all(rows[k][0] == pytest.approx(want[k][0], abs=1e-8) for k in want)
