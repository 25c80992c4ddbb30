"""Every registered query against its DuckDB statement on sf0.001, plus the
expected values of FIXTURES.md section 5 at sf0.01."""

import datetime as dt
import hashlib
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from quorum.plans.catalog import QUERIES as CATALOG
from quorum.sources.tables import TABLES


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _digest(rows):
    keys = sorted(json.dumps([_norm(x) for x in r], default=str) for r in rows)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


QUERIES = E.queries()
SQL = E.oracle_sql()


def test_every_query_has_oracle_or_is_streaming():
    # of this library's own queries: the training-data operators may have none
    assert not set(CATALOG) - set(SQL)


@pytest.mark.parametrize("name", sorted(set(SQL) - {"serve_stream", "serve_stateful"}))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    perm = [rel.columns.index(c) for c in df.columns]
    orows = [tuple(r[i] for i in perm) for r in rel.fetchall()]
    assert len(srows) == len(orows)
    assert _digest(srows) == _digest(orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1000 and "result" in df.columns


def test_fixture_totals_sf001(spark):
    from quorum.plans.catalog import _rows
    from quorum.operators.collect import collect_vote
    rows = _rows(spark, SF_MID).cache()
    assert rows.filter("data_model is not null").count() == 14388
    assert rows.filter("answered and latency_ms > timeout_ms").count() == 6361
    res = collect_vote(rows)
    st = {r["data_type"]: (r["usage"], r["total"], r["lo"], r["hi"]) for r in
          res.filter("processed").groupBy("data_type").agg(
              F.count("*").alias("usage"), F.sum("duration_ms").alias("total"),
              F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi")).collect()}
    assert st == {"click": (1697, 240412, 100, 200), "error": (1524, 210125, 77, 150),
                  "purchase": (974, 146100, 150, 150), "view": (497, 38614, 0, 150)}
    rows.unpersist()
