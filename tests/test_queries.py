"""Every query of the catalogue against its SQL at the smallest scale, and the shape of the driver's contract."""

import importlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fanloom.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(catalogue.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(str([plain(r[c]) for c in columns]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_contract_without_optional_parts(spark, monkeypatch):
    real = importlib.import_module

    def missing(name, *a):
        if name in ("fanloom.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)
    if os.path.isdir(SF):
        assert entry.entry(spark).count() == 2


def test_claim_plan_has_no_full_sort(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    plan = catalogue.QUERIES["claim_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("size, times", [("sf0.001", 1), ("sf0.01", 3)])
def test_rows_of_a_task_do_not_grow(spark, monkeypatch, size, times):
    """One task of the join behind ``task``, and of the counts by job after it, gets about as many rows whatever the size."""
    if not os.path.isdir(sf := f"/root/testdata/{size}"):
        pytest.skip("no test data")
    most = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    want = catalogue.QUERIES["running_counts"](spark, sf).toPandas()
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100, raising=False)
    counts = catalogue.QUERIES["running_counts"](spark, sf)
    assert most(fixtures.task(spark, sf)) <= 2 * times * 100 and most(counts) <= 2 * times * 100
    assert sorted(counts.toPandas().itertuples(index=False)) == sorted(want.itertuples(index=False))
