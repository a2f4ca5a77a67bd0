"""Streams over restarts: state that ends, and upserts of touched buckets."""

import datetime as dt
import json
import os
import random

import pytest

from rankforge.streaming import jobs
from rankforge.streaming.bucket_table import BucketTable

SCHEMA = "protocol_hash string, qid string, finished_at timestamp, calls long"
T0 = dt.datetime(2024, 5, 1, 12)


def put(folder, number, rows):
    """A file of telemetry lines: (qid, minutes, calls)."""
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"protocol_hash": "p", "qid": q, "finished_at": (T0 + dt.timedelta(minutes=m)).isoformat(), "calls": c}) for q, m, c in rows]
    (folder / f"{number:03}.json").write_text("\n".join(lines))


def run(query):
    assert query.awaitTermination(120) is not False
    if query.exception():
        raise query.exception()
    return query


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_once_over_two_restarts_with_state_that_ends(spark, tmp_path):
    src, table, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    start = lambda: run(jobs.append_once(source(spark, src), table, log, delay="60 minutes"))
    rows = lambda: sorted((r.qid, r.calls) for r in spark.read.parquet(table).collect())
    state = lambda q: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    put(src, 0, [(f"a{k}", k % 10, k) for k in range(50)])
    put(src, 1, [("a0", 5, 99), ("b", 12, 1), ("b", 13, 2)])
    q = start()
    assert len(rows()) == 51 and max(state(q)) == 51
    put(src, 2, [(f"a{k}", 20, -1) for k in range(50)] + [("c", 25, 3)])  # a resumed run tells all again
    q = start()
    assert len(rows()) == 52 and all(c != -1 for _, c in rows())
    put(src, 3, [("d", 200, 4)])
    put(src, 4, [("e", 210, 5)])
    q = start()
    assert rows()[-2:] == [("d", 4), ("e", 5)]
    assert state(q)[-1] <= 3  # keys of an hour ago are forgotten
    put(src, 5, [("a1", 215, 7), ("d", 215, 8)])
    start()
    assert ("a1", 7) in rows() and ("d", 8) not in rows()  # beyond the delay a key is new


def test_once_per_query_of_a_table(spark):
    rows = spark.createDataFrame([("p", "a", T0, 1), ("p", "a", T0 - dt.timedelta(1), 2), ("p", "b", None, 3), ("r", "a", T0, 4)], SCHEMA)
    assert sorted((r.protocol_hash, r.qid, r.calls) for r in jobs.once_per_query(rows).collect()) == [("p", "a", 2), ("p", "b", 3), ("r", "a", 4)]


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


def test_upsert_over_restarts(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    start = lambda log: run(jobs.upsert_telemetry(source(spark, src), table, str(tmp_path / log), buckets=16))
    read = lambda: {r.qid: r.calls for r in BucketTable(spark, table, ["qid"], ["finished_at"], 16).read().collect()}
    rng, want = random.Random(3), {}

    def more(number, keys):
        rows = [(f"q{rng.choice(keys)}", rng.randrange(10_000), rng.randrange(10**6)) for _ in range(len(keys))]
        put(src, number, rows)
        for q, m, c in rows:
            if q not in want or m > want[q][0]:
                want[q] = (m, c)

    for n in range(3):
        more(n, range(40))
    start("log")
    more(3, [3, 7])
    start("log")
    table_ = BucketTable(spark, table, ["qid"], ["finished_at"], 16)
    assert table_.state()["version"] == 3 and table_.state()["applied"] == {"telemetry": 3}
    got = read()
    ties = {q for q in want if got[q] != want[q][1]}
    assert got.keys() == want.keys() and not ties
    # another checkpoint folder begins at batch 0 again: known batches change nothing
    before = files(table)
    start("other log")
    assert files(table) == before and read() == got


def test_upsert_writes_what_it_touches(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["qid"], ["finished_at"], 32)
    make = lambda qids, m: spark.createDataFrame([("p", q, T0 + dt.timedelta(minutes=m), m) for q in qids], SCHEMA)
    assert table.read() is None
    assert table.upsert(make([f"q{k}" for k in range(20_000)], 0), "s", 0)
    full = sum(files(tmp_path / "t/data").values())
    old = set(files(tmp_path / "t/data"))
    assert table.upsert(make(["q5"], 1), "s", 1)
    new = {f: n for f, n in files(tmp_path / "t/data").items() if f not in old}
    assert sum(new.values()) < full / 16 and len({f for f in new if f.endswith(".parquet")}) == 1
    assert not table.upsert(make(["q5"], 2), "s", 1)  # a replayed batch
    assert table.upsert(make([], 3), "s", 2) and table.state()["version"] == 2
    assert table.upsert(make(["q5"], 0), "other", 0)  # an older row doesn't win
    assert {r.calls for r in table.read().where("qid = 'q5'").collect()} == {1} and table.read().count() == 20_000
    table.vacuum(1)
    assert table.read().count() == 20_000 and len(os.listdir(tmp_path / "t/versions")) <= 2
    assert sum(files(tmp_path / "t/data").values()) < 1.5 * full
    with pytest.raises(ValueError, match="32 buckets"):
        BucketTable(spark, str(tmp_path / "t"), ["qid"], ["finished_at"], 8).read()


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["qid"], ["finished_at"], 4)
    rows = spark.createDataFrame([("p", "a", T0, 1)], SCHEMA)
    table.upsert(rows, "s", 0)
    with pytest.raises(Exception, match="lost"):
        table.upsert(rows.selectExpr("protocol_hash", "qid", "finished_at", "if(calls = 1, raise_error('lost'), calls) calls"), "s", 1)
    assert [tuple(r) for r in table.read().select("qid", "calls").collect()] == [("a", 1)] and table.state()["version"] == 0
    assert table.upsert(rows.selectExpr("protocol_hash", "qid", "finished_at + interval 1 day finished_at", "2L calls"), "s", 1)
    assert [r.calls for r in table.read().collect()] == [2]
