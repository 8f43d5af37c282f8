"""Every registered query that has SQL against DuckDB on the smallest tables, and plans that must hold at scale."""

import glob
import os

import duckdb
import pytest

from loomsight.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows(columns, data):
    text = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_as_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    res = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, res.fetchall())


def test_entry(spark):
    assert 0 < catalogue.flagship(spark, SF).count() <= 20


def test_scans_read_what_they_need(spark):
    plan = catalogue.queries()["due_topn_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[1] and "WindowGroupLimit" in plan
    assert "PushedFilters: [" in catalogue.queries()["cleaned_filter_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
