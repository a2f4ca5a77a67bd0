"""Statistics against exact arithmetic and brute force."""

import inspect
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import stats
from rankforge.plans import registry

SF = "/root/testdata/sf0.001"


def exact_sign_test(plus, minus):
    n = plus + minus
    return float(min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(min(plus, minus) + 1)), 2**n)))


def test_sign_test_of_any_count(spark):
    counts = [(0, 0), (0, 5), (3, 4), (20, 39), (400, 700), (480, 560), (460, 570), (700, 400), (0, 1070), (2400, 2600), (5000, 5000), (300, 1500), (900, 3000)]
    got = spark.createDataFrame(counts, "a long, b long").select("a", "b", stats.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(exact_sign_test(r.a, r.b), rel=1e-9, abs=0)


def test_condition_deltas_test_signs_in_the_thousands(spark):
    rows = [("m", c, "ndcg", str(q), 0.5 if c == "forward" else 0.6 if q < 1500 else 0.4) for q in range(3200) for c in ("forward", "reverse")]
    values = spark.createDataFrame(rows, "method string, condition string, metric string, qid string, value double")
    got = stats.condition_deltas(values, ["method"]).first()
    assert (got.plus, got.minus) == (1500, 1700) and got.p_sign == pytest.approx(exact_sign_test(1500, 1700), rel=1e-9)


@pytest.mark.parametrize("name", ["sign_test", "sign_test_parts", "condition_signs"])
def test_sign_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def brute_bootstrap(values, samples, seed):
    rng = random.Random(seed)
    means = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(samples))
    return sum(values) / len(values), means[int(0.025 * samples)], means[min(samples - 1, int(0.975 * samples))]


def brute_sign_flip(values, samples, seed, shift=0.0, two_sided=True):
    rng, v = random.Random(seed), [Fraction(round((x + shift) * 10**6), 10**6) for x in values]
    size = abs if two_sided else Fraction
    hits = sum(size(sum(x if rng.random() < 0.5 else -x for x in v)) >= size(sum(v)) for _ in range(samples))
    return (hits + 1) / (samples + 1)


def brute_randomization(a, b, samples, seed):
    d = np.asarray(a) - np.asarray(b)
    signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(samples, d.size))
    return (np.count_nonzero(np.abs((signs * d).mean(axis=1)) >= abs(d.mean()) - 1e-12) + 1.0) / (samples + 1.0)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 40, 3001])
def test_resampling_equals_brute_force(n):
    rng, samples = random.Random(n), 400 if n > 1000 else 1500
    d = [round(rng.uniform(-0.1, 0.11), 6) for _ in range(n)]
    assert stats.bootstrap(d, samples, 7) == pytest.approx(brute_bootstrap(d, samples, 7), abs=1e-12)
    assert stats.sign_flip(d, samples, 7) == brute_sign_flip(d, samples, 7)
    assert stats.sign_flip(d, samples, 7, 0.01, False) == brute_sign_flip(d, samples, 7, 0.01, False)
    assert stats.randomization(d, [0.0] * n, samples, 7) == brute_randomization(d, [0.0] * n, samples, 7)


def test_paired_tests_draw_enough_for_many_comparisons(spark):
    rows = [(k, f"c{k}", "f", str(q), 0.5 + 0.001 * (q % 7 + 1), 0.5) for k in range(2) for q in range(40)]
    got = stats.paired_tests(spark.createDataFrame(rows, "ordinal int, name string, family string, qid string, a double, b double"))
    for r in got.collect():
        assert (r.n, r.p_superior, r.p_random) == (40, 1 / 10_001, 1 / 100_001) and r.ci_low < r.mean_delta < r.ci_high
    defaults = {k: p.default for k, p in inspect.signature(stats.paired_tests).parameters.items()}
    assert (defaults["samples"], defaults["random_samples"]) == (10_000, 100_000)


def test_paired_resampling_takes_every_cell_and_pair_of_runs(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    v = con.sql(registry.VALUES_SQL)
    want = con.sql("select a.method || '/' || a.condition || '/' || a.run_id || '-' || b.run_id, count(*), round(avg(a.value - b.value), 6) from v a join v b using (method, condition, qid) where a.run_id < b.run_id group by all").fetchall()
    got = registry.queries()["paired_resampling"](spark, SF).collect()
    assert len(got) == 126 and sorted(r.ordinal for r in got) == list(range(126))
    assert {r.name: r.n for r in got} == {w[0]: w[1] for w in want}
    assert all(r.mean_delta == pytest.approx(w, abs=1e-6) for r in got for w in [next(x[2] for x in want if x[0] == r.name)])
