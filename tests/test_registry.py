"""Every registered query: runs on the smallest tables, matches its DuckDB
twin, and has an acceptable plan shape."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from vitrine.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# operators whose Python work is the feature (vector block products, caller-supplied generation)
PYTHON_OK = {"recommend_batch", "recommend_batch_blended", "search_batch", "generate_memo", "prompt_recommend",
             "recommend_indexed"}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "similarity" in df.columns


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(key)
    assert sql is not None, key
    cur = duck.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(dcols, drows)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan, key      # never row-at-a-time Python
    if key not in PYTHON_OK:
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan, key


# scans, exchanges and one-partition exchanges of the plan that runs, subqueries included
MOST = {"scans": 14, "exchanges": 18, "single": 5}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_size(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "AdaptiveSparkPlan" not in x]
    scans = sum("Scan parquet" in x for x in lines)
    exchanges = sum("Exchange " in x and "Reused" not in x for x in lines)
    single = sum("SinglePartition" in x for x in lines)
    found = {"scans": scans, "exchanges": exchanges, "single": single}
    assert all(found[k] <= MOST[k] for k in MOST), (key, found)
