"""Random streams in parts, and ranks by counting passes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import random_parts, ranks, stats


@pytest.mark.parametrize("words", [0, 1, 623, 70_000, 1_234_567, 2**33 + 12_345])
def test_twister_jumps_to_its_place(words):
    got = random_parts.twister_at(5, words).randint(0, 2**32, 700, dtype=np.uint32)
    if words < 2**30:
        stream = random.Random(5)
        for _ in range(words):
            stream.getrandbits(32)
        assert got.tolist() == [stream.getrandbits(32) for _ in range(700)]
    else:  # two jumps are one
        half = random_parts.twister_at(5, words - 100_000)
        half.bytes(400_000)
        assert got.tolist() == half.randint(0, 2**32, 700, dtype=np.uint32).tolist()


@pytest.mark.parametrize("drawn", [0, 1, 2, 1001])
def test_choices_jump_to_their_place(drawn):
    whole = np.random.default_rng(8).choice([-1.0, 1.0], size=drawn + 50)
    assert (random_parts.signs_at(8, drawn).choice([-1.0, 1.0], size=50) == whole[drawn:]).all()


def test_parts_of_the_bootstrap_are_its_whole():
    v = np.random.default_rng(1).normal(size=37)
    whole = random_parts.bootstrap_means(v, 3, 500, 0, 1, 0, 0)
    stream = random.Random(3)
    assert whole[:20] == pytest.approx([sum(v[stream.randrange(37)] for _ in v) / 37 for _ in range(20)])
    for parts in (2, 7, 40):
        found = [random_parts.count_indices(37, 3, 500, p, parts) for p in range(parts)]
        got = np.concatenate([random_parts.bootstrap_means(v, 3, 500, p, parts, sum(found[:p]), found[p]) for p in range(parts)])
        assert (got == whole).all()


def test_results_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(o, f"c{o}", "f", f"q{q:03}", float(np.round(rng.normal(0.02 * o), 3)), float(np.round(rng.normal(), 3))) for o, n in enumerate((1, 5, 64, 130)) for q in range(n)]
    rows += [(9, "level", "f", f"q{q}", 0.5, 0.5) for q in range(6)]
    pairs = spark.createDataFrame(rows, "ordinal int, name string, family string, qid string, a double, b double")
    got = [sorted(map(tuple, stats.paired_tests(pairs, samples=400, random_samples=900, parts=n).collect())) for n in (1, 2, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 5
    for ordinal, _, _, n, mean, lo, hi, sup, non, rnd in got[0]:
        mine = sorted(r for r in rows if r[0] == ordinal)
        d = [r[4] - r[5] for r in sorted(mine, key=lambda r: r[3])]
        assert n == len(d) and (mean, lo, hi) == stats.bootstrap(d, 400, 929 + ordinal)
        assert sup == stats.sign_flip(d, 400, 929 + ordinal) and non == stats.sign_flip(d, 400, 929 + ordinal, 0.01, False)
        assert rnd == stats.randomization([r[4] for r in sorted(mine, key=lambda r: r[3])], [r[5] for r in sorted(mine, key=lambda r: r[3])], 900, 929 + ordinal)


def test_a_comparison_has_no_more_parts_with_more_values(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 1_000, 60_000, 360_000, 2**31 - 1)], "n int")
    got = [[r.p for r in sizes.select(stats.parts_of(F.col("n"), 120_000, k).alias("p")).collect()] for k in (126, 10**6, 1)]
    assert got[0] == got[1] == [1, 1, 4, 8, 8, 8] and got[2] == [1, 1, 4, 215, 1024, 1024]


def test_odd_and_even_places_of_randomisation_add_up():
    v = np.round(np.random.default_rng(3).normal(0.01, 0.1, 1237), 6)
    whole = np.random.default_rng(5).choice([-1.0, 1.0], size=(3000, 1237)) @ v / 1237
    hits = [random_parts.randomization_hits(v, 5, *ends) for ends in ((0, 1), (1, 1000), (1000, 3000))]
    assert sum(hits) == (abs(whole) >= abs(v.mean()) - 1e-12).sum()


def test_order_statistics(spark):
    rng = random.Random(4)
    odd = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), float("-inf"), 2.0, 2.0, 2.0 + 2**-51, -5.5]
    groups = {"a": odd, None: [rng.gauss(0, 1) for _ in range(300)], "c": [7.25], "d": [rng.choice([1.0, 2.0]) for _ in range(50)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    values = spark.createDataFrame(rows, "k string, v double")
    wanted = spark.createDataFrame([(k, r) for k, vs in groups.items() for r in range(len(vs) + 2)] + [("e", 0)], "k string, rank long")
    got = {(r.k, r["rank"]): r.value for r in ranks.order_statistics(values, ["k"], "v", wanted).collect()}
    assert got == {(k, i): v for k, vs in groups.items() for i, v in enumerate(sorted(vs))}


@pytest.mark.parametrize("discrete", [False, True])
def test_percentiles_both_ways(spark, discrete):
    rng = random.Random(9)
    rows = [(k, j, rng.choice([rng.random(), 0.5, None])) for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400), (None, 30)) for j in (0, 1) for _ in range(n)]
    values = spark.createDataFrame(rows, "k string, j int, v double")
    shares = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    small, large = (ranks.percentiles(values, ["k", "j"], "v", shares, discrete, held) for held in (10**6, 0))
    a, b = ({(r.k, r.j): r[2:] for r in x.collect()} for x in (small, large))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-15) for k in a)


def test_stability_of_large_groups(spark):
    rng = random.Random(6)
    values = spark.createDataFrame([(m, f"q{q}", r, rng.random()) for m in "xy" for q in range(40) for r in range(3)], "m string, qid string, run int, value double")
    a, b = (sorted(map(str, stats.query_stability(values.withColumn("value", F.round("value", 2)), ["m"], held).collect())) for held in (10**6, 0))
    assert len(a) == 2 and a == b
    c, d = (sorted(map(tuple, stats.nearest_rank_p95(values, ["m"], held=held).collect())) for held in (10**6, 0))
    assert c == d


class Counting:
    """A generator that counts the words taken from it."""

    def __init__(self, twister):
        self.twister, self.words = twister, 0

    def randint(self, low, high, size, dtype):
        self.words += size
        return self.twister.randint(low, high, size, dtype)


@pytest.mark.parametrize("first, bits", [(0, 1), (3, 1000), (70_001, 20_000_000)])
def test_signs_follow_from_the_first_ones(first, bits):
    twister = Counting(random_parts.twister_at(5, 2 * first))
    got = np.unpackbits(np.concatenate(list(random_parts._top_bits(twister, bits))).view(np.uint8), bitorder="little")
    want = random_parts.twister_at(5, 2 * first).random_sample(bits) >= 0.5
    assert len(got) >= bits and (got[:bits] == want).all() and twister.words <= 128 * min(19937, -(-bits // 64))


@pytest.mark.parametrize("values", [[1.0, -1.0, 0.0, 1.0] * 10, [1e-9, 1e9, -1e9, 3e8] * 9, list(np.random.default_rng(7).normal(0.001, 0.1, 40_001)), [0.0] * 5])
def test_rows_near_the_limit_are_counted_in_double_precision(values):
    v = np.asarray(values)
    signs = np.where(np.random.default_rng(1).random((300, len(v))) < 0.5, np.float32(1), np.float32(-1))
    signs[:2], signs[2] = 1, -1  # ties
    for two_sided, size in ((True, np.abs), (False, np.asarray)):
        want = (size(signs.astype(float) @ v / len(v)) >= size(v.mean()) - 1e-12).sum()
        assert random_parts.Reached(v, two_sided).count(signs) == want >= 2


def test_resampled_sums_do_not_depend_on_parts_of_large_comparisons():
    n, samples = 70_001, 12
    v = np.random.default_rng(1).normal(size=n)
    whole, stream = random_parts.bootstrap_means(v, 3, samples, 0, 1, 0, 0), random.Random(3)
    assert whole[:2] == pytest.approx([sum(v[stream.randrange(n)] for _ in range(n)) / n for _ in range(2)], abs=1e-13)
    found = [random_parts.count_indices(n, 3, samples, p, 5) for p in range(5)]
    assert (np.concatenate([random_parts.bootstrap_means(v, 3, samples, p, 5, sum(found[:p]), found[p]) for p in range(5)]) == whole).all()


def test_many_comparisons_draw_their_bootstraps_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(o, f"c{o}", "f", f"q{q}", float(rng.normal()), 0.0) for o in range(4 * spark.sparkContext.defaultParallelism) for q in range(1 + o % 5)]
    pairs = spark.createDataFrame(rows, "ordinal int, name string, family string, qid string, a double, b double")
    want = sorted(map(tuple, stats.paired_tests(pairs, samples=200, random_samples=300, parts=2).collect()))
    monkeypatch.setattr(type(pairs), "mapInPandas", lambda *_: pytest.fail("indices are counted"))
    assert sorted(map(tuple, stats.paired_tests(pairs, samples=200, random_samples=300).collect())) == want
