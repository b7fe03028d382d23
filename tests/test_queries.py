"""Every registered query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from symlake.plans import code  # noqa: F401
from symlake.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert name in ORACLE
    rel = duck.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=key)


def test_literal_hits_of_short_items_and_within_tokens(spark, tmp_path):
    from symlake.plans.queries import _literal_hits

    docs = [(1, 'He said "amber stone is old".'), (2, "amberstone"), (3, None), (4, "is")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "amber stone is old"), (2, "amber"), (3, "is"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.query_id, r.id) for r in _literal_hits(spark, str(tmp_path)).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 4)]
