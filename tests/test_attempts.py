"""Prompts, fitted lists and the final checks of attempts, against fixed values and plain loops."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rankforge.functions import labels, prompts
from rankforge.operators import audit
from rankforge.plans import registry
from test_tables import SF, TABLES


@pytest.mark.parametrize("name", ["window_prompts", "pair_and_point_prompts", "fitted_lists", "native_attempt", "official_attempt"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    rows = sorted(map(str, ([r[c] for c in cols] for r in got.collect())))
    assert rows and rows == sorted(map(str, ([r[i] for i in at] for r in want.fetchall())))


def test_window_prompt_and_guardrails(spark):
    row = spark.createDataFrame([("a {n} query", ["one {labels}", "two"])], "q string, p array<string>")
    say = lambda kind, scheme, guard="plain": row.select(prompts.window(kind, F.col("q"), F.col("p"), scheme, guard)).first()[0]
    best = say("best", labels.LETTERS)
    assert best.startswith('Given a query "a {n} query", which') and 'Passage A: "one {labels}"\n\nPassage B: "two"\n\nOutput only' in best
    assert "labels: A, B. Do not" in best and best.endswith("clearly relevant, still pick the single closest one.")
    assert "labels: AA, AB. Do not" in say("worst", labels.BIGRAMS) and say("worst", labels.BIGRAMS).endswith("clearly irrelevant, still pick the single least relevant one.")
    assert "number from 1 to 2. Do not" in say("best", labels.NUMERIC)
    assert "labels: 1, 2. Do not" in say("dual", labels.NUMERIC)
    assert "or any number outside the range" in say("dual", labels.NUMERIC, "multimodal") and "Do not output letters" in say("dual", labels.NUMERIC, "llama")
    assert "labels: A, B. Do not" in say("dual", labels.LETTERS, "llama")
    many = spark.createDataFrame([("q", ["x"] * 24)], "q string, p array<string>")
    with pytest.raises(Exception, match="more passages"):
        many.select(prompts.window("best", F.col("q"), F.col("p"))).collect()
    assert many.select(prompts.label_names(labels.BIGRAMS, F.lit(28)).alias("x")).first().x == labels.labels(labels.BIGRAMS, 28)
    empty = spark.createDataFrame([(None, ["x"]), ("q", None)], "q string, p array<string>")
    assert [r[0] for r in empty.select(prompts.window("dual", F.col("q"), F.col("p"))).collect()] == [None, None]


def test_fitted_list_is_the_longest_that_fits(spark):
    count = lambda s: len(s.split())
    passages = ["Title: Content: " + "a " * 9, "b " * 4, None, "", "c " * 30]

    def brute(limit):
        for cap in range(20, -1, -1):
            shown = [f"[{i + 1}] " + " ".join((p or "").replace("Title: Content: ", "").split()[:cap]) for i, p in enumerate(passages)]
            if sum(count(t) + 3 for _, t in prompts.FittedList(count, 0, "be short").messages("q r", shown)) + 2 + count(prompts.order_text(5)) <= limit:
                return cap, shown
        return None

    assert prompts.order_text(3) == "[1] > [2] > [3]"
    caps = set()
    for limit in range(130, 200):
        fitted = prompts.FittedList(count, limit, "be short", 20, 3, 2, True)
        want = brute(limit)
        if want is None:
            with pytest.raises(ValueError, match="don't fit"):
                fitted.fit("q r", passages)
        else:
            assert fitted.fit("q r", passages) == want
            caps.add(want[0])
    assert {0, 20} <= caps and len(caps) > 10
    rows = spark.createDataFrame([(1, "q r", passages), (2, None, None)], "k int, q string, p array<string>")
    got = {r.k: r.x for r in rows.select("k", prompts.FittedList(count, 1000).column(F.col("q"), F.col("p")).alias("x")).collect()}
    assert got[1].words == 300 and len(got[1].passages) == 5 and got[2].passages == []


def test_attempts(spark):
    pool = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1), ("q2", "d", 2)], "qid string, docid string, pos int")
    run = pool.where("pos = 1").select("qid", "docid")
    launch = {"method": "m", "model": "o'", "dataset": "d", "output_objective": "top10", "output_depth": 1, "pool_cap": 2}
    zero = {f"{p}_{w}_tokens": 0 for p in ("nominal", "retry", "actual") for w in ("prompt", "completion", "total")}
    row = launch | zero | {"schema_version": 1, "status": "ok", "live_pool_size": 2, "llm_calls": 3, "retry_inclusive_llm_calls": 3, "selection_steps": 3, "non_llm_bypasses": 0, "wall_seconds": 1.0, "retry_seconds": 0.0, "retry_excluded_wall_seconds": 1.0, "size": 9, "n": 9}
    total = {"queries": 2, "output_depth": 1, "llm_calls": 6, "actual_prompt_tokens": 0, "actual_completion_tokens": 0}
    table = lambda *rows: spark.createDataFrame(list(rows))
    both = [row | {"qid": "q1"}, row | {"qid": "q2"}]

    def native(run, rows, total=total):
        return sorted((r.qid or "", r.reason) for r in audit.native_attempt(run, table(*rows), pool, launch, table(total)).collect())

    assert native(run, both) == []
    assert native(run, [*both, row | {"qid": "q1", "status": "error"}]) == []
    assert native(run, [*both, row | {"qid": "q9"}], total | {"llm_calls": 9}) == [("q9", "not_in_first_stage"), ("q9", "not_in_run"), ("q9", "outside_first_stage")]
    assert native(run, [both[0], both[1] | {"status": "lost"}], total | {"llm_calls": 3}) == [("q2", "not_in_telemetry"), ("q2", "status")]
    assert native(run.unionAll(run.where("qid = 'q1'")), both) == [("q1", "depth_or_uniqueness")]
    assert native(run, [both[0], both[1] | {"dataset": None}], total | {"queries": 3}) == [("", "summary:queries"), ("q2", "launch:dataset")]
    with pytest.raises(ValueError, match="can't fill"):
        audit.native_attempt(run, table(*both), pool, launch | {"output_depth": 3}, table(total))
    assert audit.native_attempt(run.limit(0), table(*both).limit(0), pool.limit(0), launch, table(dict.fromkeys(total, 0) | {"output_depth": 1})).count() == 0
    assert sorted((r.qid, r.reason) for r in audit.official_attempt(run, table(both[0]), pool, launch, 13, 2).collect()) == [("q1", "calls"), ("q2", "not_in_telemetry")]
