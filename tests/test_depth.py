"""The registered depth of pools, and what it means for tournaments."""

import duckdb
import pytest

from rankforge.operators import procedures as p
from rankforge.operators.comparators import Doc, ScoreComparator
from rankforge.plans import base, registry

SF = "/root/testdata/sf0.001"


def tournament(n):
    docs = [Doc(f"d{i}", float(i), None, i, float(i)) for i in range(n)]
    return p.run(p.tournaments(n, n, "q"), ScoreComparator(), "q", docs, "q")


def test_tournaments_reject_pools_beyond_their_groups():
    assert len(tournament(100)[0]) == 100
    with pytest.raises(ValueError, match="101 documents"):
        tournament(101)


@pytest.mark.parametrize("name", ["rerank_whole_dualend", "rerank_full_list", "average_precision", "average_precision_hits"])
def test_queries_at_full_depth_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_pools_are_a_hundred_deep(spark):
    assert base.HITS == 100
    got = registry.queries()["rerank_tournaments"](spark, SF).groupBy("qid").count().agg({"count": "max"}).first()[0]
    assert got == base.first_stage(spark, SF).agg({"pos": "max"}).first()[0] > 20
