"""Sources, sinks, audits and registered queries on small data."""

import duckdb
import pytest

import __spark_entry__ as entry
from rankforge.operators import audit, rerank, stats
from rankforge.plans import registry
from rankforge.sources import readers, writers
from rankforge.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["qid", "rank", "docid", "score", "ndcg_cut_10"] and got.count() > 0


@pytest.mark.parametrize("name", ["first_stage_top_hits", "rerank_whole_topdown", "rerank_topdown_heapsort", "allpair_points", "fusion_rrf", "ndcg", "holm", "position_bias", "audit_run", "permutation_parse"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, ([r[c] for c in cols] for r in got.collect()))) == sorted(map(str, ([r[i] for i in at] for r in want.fetchall())))


def test_run_round_trip(spark, tmp_path):
    ranking = spark.createDataFrame([("q1", "b", 1, -1.0), ("q1", "a", 2, -2.0), ("q2", "c", 1, -1.0)], "qid string, docid string, rank int, score double")
    writers.write_run(ranking, str(tmp_path / "run"), "t", by_rank=True)
    got = readers.read_run(spark, str(tmp_path / "run"))
    assert sorted((r.qid, r.docid, r.rank, r.pos) for r in got.collect()) == [("q1", "a", 2, 2), ("q1", "b", 1, 1), ("q2", "c", 1, 1)]
    with pytest.raises(Exception, match="wrong depth"):
        readers.exact_depth(got, 2).collect()


def test_malformed_run_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("q1 Q0 d1 1 2.0\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_run(spark, str(tmp_path / "x.txt")).collect()
    assert readers.read_run(spark, str(tmp_path / "x.txt"), strict=False).count() == 0


def test_evals_and_logs(spark, tmp_path):
    (tmp_path / "a.eval").write_text("ndcg_cut_10 q1 0.5\nndcg_cut_10 all 0.5\nruntag all x\n")
    e = readers.read_evals(spark, str(tmp_path / "a.eval"))
    assert [(r.qid, r.value) for r in readers.per_query(e, "ndcg_cut_10").collect()] == [("q1", 0.5)]
    assert readers.aggregates(e).count() == 1
    (tmp_path / "a.log").write_text("Avg comparisons: 4.5\nAvg prompt tokens: 10\nAvg completion tokens: 2\n")
    got = {r.metric: r.value for r in readers.read_logs(spark, str(tmp_path / "a.log")).collect()}
    assert got["avg_comparisons"] == 4.5 and got["avg_total_tokens"] == 12 and got["retries_fired"] == 0


def test_audit_strings(spark):
    pool = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "qid string, docid string")
    clean = spark.createDataFrame([("q1", "b"), ("q1", "a"), ("q2", "c")], "qid string, docid string")
    dirty = spark.createDataFrame([("q1", "b"), ("q1", "b")], "qid string, docid string")
    assert audit.audit_run(clean, pool).count() == 0
    assert {r.error for r in audit.audit_run(dirty, pool).collect()} == {"duplicate_docids:q1", "pool_membership_mismatch:q1", "missing_qids:1"}


def test_paired_mismatch_is_an_error(spark):
    a, b = (spark.createDataFrame([("m", q, 0.5)], "metric string, qid string, value double") for q in ("q1", "q2"))
    with pytest.raises(Exception, match="qid mismatch"):
        stats.pair_strict(a, b).collect()
    assert stats.pair_lenient(a, b).count() == 0


def test_short_pools_need_no_call(spark):
    pool = spark.createDataFrame([("q", 1, "d", 1.0, 1.0)], "qid string, pos int, docid string, score double, hidden double")
    out = rerank.rerank(pool, "whole_topdown", 1)
    t = rerank.telemetry(out, "whole_topdown", 1, 1)
    assert t.first().llm_calls == 0 and audit.telemetry_violations(t).count() == 0


def test_one_bad_query_does_not_stop_others(spark):
    pool = spark.createDataFrame([("a", 1, "d", float("nan"), 1.0), ("a", 2, "e", 1.0, 2.0), ("b", 1, "d", 1.0, 1.0), ("b", 2, "e", 1.0, 2.0)], "qid string, pos int, docid string, score double, hidden double")
    out = rerank.rerank(pool, "whole_topdown", 2)
    assert {(r.qid, r.status) for r in out.where("kind = 'telemetry'").collect()} == {("a", "error"), ("b", "ok")}


def test_position_stream_equals_batch(spark, tmp_path):
    from rankforge.plans import base

    log = base.comparison_log(spark, SF)
    log.write.json(str(tmp_path / "log"))
    q = jobs.position_counts(jobs.comparison_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("counts").collect()) == sorted(jobs.position_counts(log).collect())


def test_a_run_and_its_pools_are_read_once_by_the_audit(spark):
    side = lambda n: spark.range(n).selectExpr("string(id % 7) as qid", "string(id) as docid")
    found = audit.audit_run(side(40).where("qid <> '3'").unionAll(side(1).selectExpr("'new'", "docid")), side(42))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 3
    assert sorted(r.error for r in found.collect()) == sorted(["missing_qids:1", "unexpected_qids:1", *(f"{e}:{q}{more}" for q in (5, 6) for e, more in (("wrong_depth", ":5:expected_6"), ("pool_membership_mismatch", "")))])
