"""Every registered query against its SQL twin on the small tables."""

import duckdb
import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _sorted(found):
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    if name not in ORACLE:
        assert got
        return
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    at = [list(relation.columns).index(c) for c in columns]
    want = _sorted(tuple(r[i] for i in at) for r in duck.execute(ORACLE[name]).fetchall())
    assert len(got) == len(want)
    for left, right in zip(got, want):
        assert all(map(_same, left, right)), (left, right)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
