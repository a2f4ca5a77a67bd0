"""Drivers, adapters and checks that no registered query shows: errors, repairs, retries, strict readers."""

import pytest

from rankforge.functions import labels
from rankforge.operators import audit, procedures, rerank, stats
from rankforge.operators.comparators import ChatPairwise, ChatSetwise, Doc, DuoComparator, LikelihoodComparator, SelectionComparator, bounded_retry
from rankforge.sources import readers

DOCS = [Doc(f"d{k}", float(k), None, k, float(k * 7 % 5)) for k in range(5)]


def test_round_by_round_equals_one_by_one_and_errors_stay_apart():
    pools = {q: [Doc(f"{q}{k}", 0.0, None, k, float((k * 7 + len(q)) % 11)) for k in range(n)] for q, n in (("a", 6), ("bb", 9), ("ccc", 4))}
    rounds = []

    def answers(asked):
        rounds.append(len(asked))
        return [ValueError("no") if q == "ccc" and len(rounds) > 2 else rerank.answer_by_score([(r[0], q, [pools[q][i] for i in r[1]])])[0] for q, r in asked]

    got = procedures.run_rounds({q: procedures.build("topdown_heapsort", q, docs, 3, 2) for q, docs in pools.items()}, answers)
    for q in ("a", "bb"):
        want, trace = procedures.run(procedures.build("topdown_heapsort", q, pools[q], 3, 2), rerank.ScoreComparator(), q, pools[q])
        assert (got[q][0], got[q][1].calls, got[q][2]) == (want, trace.calls, None)
    assert got["ccc"][0] is None and got["ccc"][2] == "ValueError: no" and max(rounds) == 3


def test_settings_are_checked(spark):
    pool = spark.createDataFrame([("q", 1, "d", 1.0, 1.0)], "qid string, pos int, docid string, score double, hidden double")
    for bad in (dict(method="none", k=3), dict(method="topdown_heapsort", k=0), dict(method="topdown_heapsort", k=3, how="shuffle")):
        with pytest.raises(ValueError):
            rerank.rerank(pool, **bad)


def test_model_adapters():
    like = LikelihoodComparator(lambda q, docs: [-abs(d.hidden - 3) for d in docs])
    assert (like.best("q", DOCS), like.worst("q", DOCS), like.both("q", DOCS)) == (4, 0, (4, 0))
    duo = DuoComparator(lambda q, a, b: 0.9 if a.hidden > b.hidden else 0.4)
    assert duo.prefers("q", DOCS[4], DOCS[0]) and not duo.prefers("q", DOCS[0], DOCS[4])
    chat = ChatPairwise(lambda q, a, b: "Passage A" if a.hidden > b.hidden else "passage b")
    assert chat.prefers("q", DOCS[4], DOCS[0]) and not ChatPairwise(lambda *x: "Passage A").prefers("q", *DOCS[:2])
    assert [ChatSetwise(lambda *x, t=t: t).best("q", DOCS) for t in ("Passage C", "???")] == [2, 0]
    assert [ChatSetwise(lambda *x, t=t: t, brackets=True).best("q", DOCS) for t in ("I say [4]", "[9]")] == [3, 0]
    left = [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise TimeoutError
        return "done"

    assert bounded_retry(call, (TimeoutError,), 3)() == "done"
    with pytest.raises(TimeoutError):
        left[0] = 9
        bounded_retry(call, (TimeoutError,), 3)()


def test_one_corrective_turn_then_failure():
    says = iter(["nothing", "Document 2\nDocument 2, Document 9"])
    fixed = SelectionComparator(lambda q, docs, m, before: (next(says), 10, 2, 0.2))
    assert fixed.select("q", DOCS, 2) == [1, 1]
    assert fixed.events[0] == {"n": 5, "m": 2, "status": "ok", "retry_calls": 1, "initial_format_valid": False, "format_valid": True, "format_repair_succeeded": True, "prompt_tokens": 20, "completion_tokens": 4, "duration_seconds": 0.4, "retry_seconds": 0.2, "selected": ["d1", "d1"]}
    lost = SelectionComparator(lambda q, docs, m, before: ("nothing", 10, 2, 0.2))
    with pytest.raises(ValueError, match="corrective"):
        lost.select("q", DOCS, 2)
    assert lost.events[0]["status"] == "failed"


def test_run_files(spark, tmp_path):
    (tmp_path / "a.run").write_text("q1 Q0 b 1 2.0 t\nq1 Q0 b 2 1.0 t\nbroken line\n")
    pool = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q1", "c"), ("q2", "c")], "qid string, docid string")
    lines = readers.numbered_lines(spark, str(tmp_path / "a.run"))
    want = {"malformed_line:3", "duplicate_docids:q1", "wrong_depth:q1:2:expected_3", "pool_membership_mismatch:q1", "missing_qids:1"}
    assert {r.error for r in audit.audit_run_lines(lines, pool).collect()} == want
    assert [r.error for r in audit.audit_run_lines(None, pool).collect()] == ["missing_run"]
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in readers.discover(spark, str(tmp_path), "*.run").collect()] == [("a.run", 44)]
    with pytest.raises(Exception, match="malformed run line"):
        readers.read_run(spark, str(tmp_path / "a.run")).collect()
    run = readers.read_run(spark, str(tmp_path / "a.run"), strict=False)
    with pytest.raises(Exception, match="wrong depth"):
        readers.exact_depth(run, 2).collect()
    assert readers.exact_depth(run, 1).count() == 1
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    assert [r.line_number for r in readers.broken_json(readers.numbered_lines(spark, str(tmp_path / "x.jsonl"))).collect()] == [3]
    (tmp_path / "a.eval").write_text("ndcg_cut_10 all 0.5\nndcg_cut_10 q1 0.5\n")
    evals = readers.read_evals(spark, str(tmp_path / "a.eval"))
    assert readers.per_query(evals, "ndcg_cut_10").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        readers.per_query(evals, "map")


def test_errors_in_tables(spark):
    log = spark.createDataFrame([("best", ["A", "B"], "A", "letters_a_w"), ("best", ["1", "2"], "1", "numeric_1_based")], "type string, positions array<string>, selected string, label_scheme string")
    with pytest.raises(Exception, match="mixed label schemes"):
        stats.position_bias(log).collect()
    with pytest.raises(Exception, match="bad comparison"):
        stats.parse_specs(spark.createDataFrame([("a|b|c|d|e|up",)], "spec string")).collect()
    one = spark.createDataFrame([("q", 1, "d", "x")], "qid string, pos int, docid string, content string")
    with pytest.raises(Exception, match="pools differ"):
        audit.local_passages(one, one.selectExpr("qid", "pos", "'e' as docid", "content")).collect()


def test_dual_labels_of_other_models():
    text = "Best: None of them. In the end the BEST (nearest): 15. And the WORST one is 3"
    assert labels.parse_dual(text, labels.NUMERIC, 20, True, multimodal=True) == ("15", "3")
    assert labels.parse_dual("Worst: 12, then 4", labels.NUMERIC, 20, True) is None
    assert labels.parse_dual("Worst: 12, then 4", labels.NUMERIC, 20, True, half_numbers_fail=False) == ("12", "4")


def test_one_number_beyond_all_is_out_of_range(spark):
    from pyspark.sql import functions as F

    from rankforge.functions import text

    got = spark.range(1).select(text.permutation(F.lit("12345678902"), F.lit(5)).alias("x")).first().x
    assert got == [0, 1, 2, 3, 4] == labels.parse_permutation("12345678902", 5)
