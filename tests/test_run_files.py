"""Run files: order and line numbers over splits, the data source, and faults of order."""

import random

import pytest
from pyspark.sql import functions as F

from rankforge.operators import audit
from rankforge.sources import readers
from rankforge.sources.run_source import in_file_order, use_run_source


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def shuffled_run(n=600, seed=4):
    rng = random.Random(seed)
    lines = [f"q{rng.randrange(9)} Q0 d{k}{'x' * rng.randrange(30)} {rng.randrange(1, 99)} {rng.random()} t" for k in range(n)]
    for k in range(0, n, 50):
        lines.insert(k, "")
    return lines


def test_lines_are_numbered_over_splits(small_splits, tmp_path):
    a, b = shuffled_run(), shuffled_run(80, 5)
    (tmp_path / "a.run").write_text("\n".join(a) + "\n")
    (tmp_path / "b.run").write_text("\n".join(b))
    got = readers.numbered_lines(small_splits, str(tmp_path)).orderBy("position").collect()
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert [r.value for r in got] == a + b and [r.position for r in got] == list(range(1, len(a + b) + 1))
    assert [r.line_number for r in got] == [*range(1, len(a) + 1), *range(1, len(b) + 1)]


def test_run_order_is_the_file_order(small_splits, tmp_path):
    lines = shuffled_run()
    (tmp_path / "a.run").write_text("\n".join(lines))
    want: dict = {}
    for line in filter(None, lines):
        want.setdefault(line.split()[0], []).append(line.split()[2])
    run = readers.read_run(small_splits, str(tmp_path / "a.run"))
    got: dict = {}
    for r in run.orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.docid)
    assert got == want
    assert {r.qid for r in readers.first_queries(run, 4).select("qid").distinct().collect()} == set(list(want)[:4])
    pools = {r.qid: r.docids for r in readers.expected_pools(run, 10).collect()}
    assert pools == {q: d[:10] for q, d in want.items()}


def test_ranks_do_not_order_a_run(spark, tmp_path):
    (tmp_path / "a.run").write_text("q2 Q0 b 2 1 t\nq1 Q0 x 1 1 t\nq2 Q0 a 1 2 t\n")
    run = readers.read_run(spark, str(tmp_path / "a.run"))
    assert [(r.docid, r.pos) for r in run.where("qid = 'q2'").orderBy("pos").collect()] == [("b", 1), ("a", 2)]
    assert readers.first_queries(run, 1).first().qid == "q2"
    got = {(r.qid, r.docid): (r.rank, r["at"], r.apart) for r in audit.rank_positions(run).collect()}
    assert got == {("q2", "b"): (2, 1, False), ("q2", "a"): (1, 2, True)}


def test_rank_positions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "_BLOCK", 4)
    rng = random.Random(1)
    order = [rng.choice("abc") for _ in range(60)]
    rows, seen, want, last = [], {}, [], None
    for k, q in enumerate(order):
        seen[q] = seen.get(q, 0) + 1
        rank = seen[q] + rng.choice([0, 0, 1])
        rows.append((q, f"d{k}", rank, seen[q], 3 * k + 1))  # positions with gaps, so that some blocks are thin
        apart = seen[q] > 1 and last != q
        if rank != seen[q] or apart:
            want.append((q, f"d{k}", rank, seen[q], apart))
        last = q
    run = spark.createDataFrame(rows, "qid string, docid string, rank int, pos long, file_pos long")
    assert sorted(map(tuple, audit.rank_positions(run).collect())) == sorted(want)


def test_errors_name_the_line_in_a_file_of_several_splits(small_splits, tmp_path):
    lines = shuffled_run()
    lines[431] = "q1 Q0 d 1 2.0"
    (tmp_path / "a.run").write_text("\n".join(lines))
    with pytest.raises(Exception, match=r"a\.run:432: q1 Q0 d 1 2\.0"):
        readers.read_run(small_splits, str(tmp_path / "a.run")).collect()
    pools = readers.read_run(small_splits, str(tmp_path / "a.run"), strict=False).select("qid", "docid")
    errors = [r.error for r in audit.audit_run_lines(readers.numbered_lines(small_splits, str(tmp_path / "a.run")).where("value <> ''"), pools).collect()]
    assert errors == ["malformed_line:432"]
    with pytest.raises(ValueError, match="no order"):
        readers.parse_run(small_splits.createDataFrame([("q Q0 d 1 1 t",)], "value string"))


# ---- the data source ----------------------------------------------------------------


def test_source_reads_splits_in_file_order(spark, tmp_path):
    lines = shuffled_run()
    (tmp_path / "a.run").write_text("\n".join(lines))
    kind = use_run_source(spark)
    for size in (97, 700, 10**9):
        run = in_file_order(spark.read.format(kind).option("splitBytes", str(size)).load(str(tmp_path / "a.run")))
        got = [f"{r.qid} Q0 {r.docid} {r['rank']} {r.score!r} {r.tag}" for r in run.orderBy("start").collect()]
        assert got == [x for x in lines if x]
        assert run.rdd.getNumPartitions() >= 1
    want = readers.read_run(spark, str(tmp_path / "a.run")).select("qid", "docid", "pos")
    assert sorted(run.select("qid", "docid", "pos").collect()) == sorted(want.collect())


def test_source_takes_filters_down(spark, tmp_path, capsys):
    (tmp_path / "a.run").write_text("\n".join(shuffled_run()))
    run = spark.read.format(use_run_source(spark)).load(str(tmp_path / "a.run"))
    cut = run.where("qid in ('q1', 'q2') and rank < 20 and score > 0.5")
    every = run.collect()
    assert sorted(cut.collect()) == sorted(r for r in every if r.qid in ("q1", "q2") and r["rank"] < 20 and r.score > 0.5)
    assert sorted(run.where("qid = 'q3' and qid in ('q3', 'q4') and rank <= 5 and rank < 4").collect()) == sorted(r for r in every if r.qid == "q3" and r["rank"] < 4)
    cut.explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert "qid" in pushed and "rank" in pushed
    condition = [line for line in plan.splitlines() if line.startswith("Condition")]
    assert all("score" in c and "rank" not in c for c in condition)


def test_source_names_the_byte_of_a_malformed_line(spark, tmp_path):
    (tmp_path / "a.run").write_text("q1 Q0 a 1 2 t\nq1 Q0 b 2 2\nq1 Q0 c 3 1 t\n")
    kind = use_run_source(spark)
    with pytest.raises(Exception, match=r"a\.run, byte 14"):
        spark.read.format(kind).load(str(tmp_path / "a.run")).collect()
    assert spark.read.format(kind).option("strict", "false").load(str(tmp_path / "a.run")).count() == 2


def test_source_writes_whole_or_nothing(spark, tmp_path):
    kind, path = use_run_source(spark), tmp_path / "out"
    run = spark.range(200).selectExpr("concat('q', id % 7) qid", "concat('d', id) docid", "cast(id as int) rank", "-id / 4 score")
    run.repartition(5).write.format(kind).option("tag", "mine").mode("append").save(str(path))
    back = spark.read.format(kind).load(str(path))
    assert sorted(map(tuple, back.select("qid", "docid", "rank", "score").collect())) == sorted(map(tuple, run.collect())) and back.where("tag <> 'mine'").count() == 0
    assert readers.read_run(spark, str(path)).count() == 200 and not (path / "_temporary").exists()

    bad = run.repartition(5).withColumn("docid", F.when(F.col("rank") == 150, F.raise_error(F.lit("no"))).otherwise(F.col("docid")))
    for mode, where in (("append", path), ("overwrite", path), ("append", tmp_path / "never")):
        with pytest.raises(Exception, match="no"):
            bad.write.format(kind).mode(mode).save(str(where))
    assert spark.read.format(kind).load(str(path)).count() == 200 and not (path / "_temporary").exists() and not (tmp_path / "never").exists()

    run.limit(3).write.format(kind).mode("overwrite").save(str(path))
    assert spark.read.format(kind).load(str(path)).count() == 3
    run.limit(4).write.format(kind).mode("append").save(str(path))
    assert spark.read.format(kind).load(str(path)).count() == 7
