"""The skew-safe physical forms equal simple brute force on small fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import T, config_df, measurements_df, registry_df
from quorum.operators.asof import asof_join
from quorum.operators.route import route_requests, with_epoch
from quorum.operators.window import last_n_window


def _rows(n, seed, dense_every=None):
    rnd = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        # mixed density: bursts inside one bucket and long gaps across many
        t += rnd.choice([1, 2, 5, 4000, 9000]) if dense_every is None else dense_every
        v = None if rnd.random() < 0.05 else round(rnd.uniform(-3, 3), 3)
        out.append((i, T(1, t), rnd.choice(["a", "b"]), 1 if rnd.random() < 0.5 else 2, v))
    return out


def _brute_window(rows, width_of):
    df = pd.DataFrame(rows, columns=["event_id", "ts", "k", "ver", "v"])
    out = {}
    for _, g in df.sort_values(["ts", "event_id"]).groupby(["k", "ver"]):
        vals = list(g["v"])
        for j, eid in enumerate(g["event_id"]):
            w = width_of[g["k"].iloc[0]]
            out[eid] = None if j + 1 < w else [None if pd.isna(x) else x for x in vals[j + 1 - w:j + 1]]
    return out


@pytest.mark.parametrize("bucket", [None, 1, 3600, 86400])
def test_last_n_window_matches_brute_force(spark, bucket):
    rows = _rows(400, seed=7)
    width_of = {"a": 5, "b": 2}
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, k string, ver int, v double")
    df = df.withColumn("width", F.when(F.col("k") == "a", 5).otherwise(2))
    got = last_n_window(df, "v", "width", 5, partition=["k", "ver"], bucket_seconds=bucket)
    got = {r["event_id"]: r["window"] for r in got.collect()}
    exp = _brute_window(rows, width_of)
    assert got == exp


def test_asof_strategies_agree_with_merge_asof(spark):
    rnd = random.Random(3)
    left = [(i, T(1 + rnd.randrange(20), rnd.randrange(86400)), rnd.choice("xyz")) for i in range(300)]
    right = [(T(1 + rnd.randrange(20), rnd.randrange(86400)), rnd.choice("xyz"), j) for j in range(40)]
    L = spark.createDataFrame(left, "id long, ts timestamp_ntz, key string")
    R = spark.createDataFrame(right, "at timestamp_ntz, key string, val long")
    b = {r["id"]: r["val"] for r in asof_join(L, R, ["key"], "ts", "at", strategy="broadcast").collect()}
    s = {r["id"]: r["val"] for r in asof_join(L, R, ["key"], "ts", "at", strategy="scan",
                                                 bucket_seconds=7 * 3600).collect()}
    lp = pd.DataFrame(left, columns=["id", "ts", "key"]).sort_values("ts")
    rp = pd.DataFrame(right, columns=["at", "key", "val"]).sort_values("at")
    mp = pd.merge_asof(lp, rp, left_on="ts", right_on="at", by="key", direction="backward")
    exp = {int(r.id): (None if pd.isna(r.val) else int(r.val)) for r in mp.itertuples()}
    assert b == exp and s == exp


def test_route_scan_equals_broadcast(spark):
    from quorum import demo
    from quorum.sources.tables import measurements
    m = measurements(spark, "/root/testdata/sf0.001")
    reg = demo.registry(spark)
    cols = ["event_id", "data_model", "version", "n_models"]
    a = route_requests(m, reg, strategy="broadcast").select(*cols)
    b = route_requests(m, reg, strategy="scan").select(*cols)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    e1 = with_epoch(m, reg, strategy="broadcast").select("event_id", "n_models").collect()
    e2 = with_epoch(m, reg, strategy="scan").select("event_id", "n_models").collect()
    assert sorted(e1) == sorted(e2)


def test_timeout_asof_with_live_change(spark):
    from quorum.operators.route import with_timeout
    cfg = config_df(spark, [("cpu", 100, T(1)), ("cpu", 200, T(5)), ("io", 0, T(1))])
    m = measurements_df(spark, [(1, T(2), "cpu", 0.0, 0), (2, T(6), "cpu", 0.0, 0),
                                (3, T(2), "io", 0.0, 0), (4, T(2), "net", 0.0, 0)])
    got = {r["event_id"]: r["timeout_ms"] for r in with_timeout(m, cfg).collect()}
    assert got == {1: 100, 2: 200, 3: 150, 4: 150}


def test_python_scorer_matches_native(spark):
    from quorum import demo
    from quorum.plans.serve import scored_requests
    from quorum.sources.tables import measurements
    m = measurements(spark, "/root/testdata/sf0.001")
    reg, cfg = demo.registry(spark), demo.config(spark)
    a = scored_requests(m, reg, cfg).filter("answered").select("event_id", "data_model", "result")
    b = scored_requests(m, reg, cfg, scorer="python").filter("answered").select("event_id", "data_model", "result")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_registry_rows_build(spark):
    reg = registry_df(spark, [("cpu", "m", "d", 0, T(1), 1, 0.0, 1.0, 0.0, 1)])
    assert reg.count() == 1


def test_serve_scan_strategy_equals_broadcast(spark):
    from quorum import demo
    from quorum.plans.serve import serve
    from quorum.sources.tables import measurements
    m = measurements(spark, "/root/testdata/sf0.001")
    args = (m, demo.registry(spark), demo.config(spark))
    a = serve(*args, latency=demo.latency()).results
    b = serve(*args, latency=demo.latency(), strategy="scan").results
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_registry_profile_bounds_rows_and_bytes(spark):
    from quorum import demo
    from quorum.plans.serve import registry_profile
    reg, cfg = demo.registry(spark), demo.config(spark)
    assert registry_profile(reg, cfg)[:3] == (True, True, 8)
    assert registry_profile(reg, cfg, max_rows=5)[:2] == (False, True)
    assert registry_profile(reg, cfg, max_bytes=50)[:2] == (False, False)   # config ~84 B
