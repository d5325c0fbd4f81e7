import duckdb
import pytest

import corpus_pipeline as C
from wreath.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_all_stages(spark):
    docs = C.read(spark, SF, "documents")
    before = docs.count()
    for name, stage in C.STAGES[:-1]:
        kept = C.stored(stage(spark, docs, SF), name)
        assert kept.schema == docs.schema
        assert 0 < kept.count() <= docs.count()
        docs = kept
    last = C.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() < before
    assert C.run(spark, SF).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(cur.fetchall(), key=key)
