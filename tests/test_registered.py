"""The registered queries against their SQL, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from factweave.plans import catalogue, compiler

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, key):
    df = catalogue.queries()[key](spark, SF)
    result = duck.sql(catalogue.oracle_sql()[key])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    places = [list(result.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=str)
    assert got == want


def test_entry_module():
    spec = importlib.util.spec_from_file_location("entry_module", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_made_distinct_by_owners_go_to_tasks_by_bytes(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ask = lambda: catalogue.queries()["E20_regroup"](spark, SF)
    small = ask()
    assert "REPARTITION_BY_NUM" not in plan(small)
    monkeypatch.setattr(compiler, "TASK_BYTES", 10_000, raising=False)
    # too few owners to share the rows out among
    assert "REPARTITION_BY_NUM" not in plan(ask())
    monkeypatch.setattr(compiler, "OWNER_BYTES", 100, raising=False)
    wide = ask()
    exchange = next(x for x in plan(wide).splitlines() if "REPARTITION_BY_NUM" in x)
    assert "l_orderkey" in exchange and int(exchange.split("), REPARTITION_BY_NUM")[0].split()[-1]) > 4
    assert sorted(map(plain, wide.collect())) == sorted(map(plain, small.collect()))
