import duckdb
import pytest

import __spark_entry__
from tallybridge import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    kinds = dict(got.dtypes)
    assert {c: KINDS.get(kinds[c], kinds[c].upper()) for c in columns} == dict(zip(want.columns, map(str, want.types), strict=True))
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_shuffle_of_each_side(spark):
    plan = catalogue.QUERIES["reconcile_multi_metric"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1
