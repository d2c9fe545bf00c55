import os

import duckdb
import pytest

import __spark_entry__
from quillsift.plans import queries

SF = "/root/testdata/sf0.001"


def rows(names, values):
    return sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for _, v in sorted(zip(names, row))) for row in values)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert got.schema and got.collect() is not None
        return
    want = sql.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["filename", "datatype", "key", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_bench_times_every_query(monkeypatch, capsys):
    import json
    from unittest.mock import MagicMock

    import bench

    monkeypatch.setattr(bench, "SparkSession", MagicMock())
    told = {name: MagicMock() for name in __spark_entry__.queries()}
    monkeypatch.setattr(__spark_entry__, "queries", lambda: told)
    bench.main()
    assert set(json.loads(capsys.readouterr().out)["queries"]) == set(told) and all(q.called for q in told.values())
