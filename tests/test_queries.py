"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from chainfold.plans import driver_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) or "int" in type(v).__name__ else v


def rows(df: pd.DataFrame):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(driver_queries.QUERIES))
def test_query(spark, duck, name):
    got = driver_queries.QUERIES[name](spark, DATA).toPandas()
    if name in driver_queries.ORACLE_SQL:
        expect = duck.execute(driver_queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expect.columns)
        assert rows(got) == rows(expect)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "balance"]
    assert set(driver_queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["call_chain", "call_missing", "call_dedupe"])
def test_calls_of_large_ids(spark, tmp_path, name):
    """Users and customers with ids beyond those of the small tables."""
    read = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("events", "customer", "nation")}
    read["events"] = read["events"].selectExpr("* except (user_id)", "user_id + if(user_id % 2 = 1, 200, 0) as user_id")
    read["customer"] = read["customer"].unionByName(read["customer"].selectExpr("* except (c_custkey)", "c_custkey + 200 as c_custkey"))
    con = duckdb.connect()
    for t, df in read.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = driver_queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(driver_queries.ORACLE_SQL[name]).df())


def test_commits_of_layers_read_their_own_legs(spark, monkeypatch):
    """Twelve commits are not twelve scans of the events."""
    from chainfold.sources import store

    plans, real = [], store.StateStore.commit
    monkeypatch.setattr(store.StateStore, "commit", lambda self, mutable, *a, **b: plans.append(mutable["accounts"][0].inputFiles()) or real(self, mutable, *a, **b))
    driver_queries.QUERIES["layered_commits"](spark, DATA).collect()
    assert len(plans) == 12 and not any("events.parquet" in f for files in plans for f in files)
