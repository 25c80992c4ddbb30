"""One window per measurement: bucket borders by density, context rows, cuts by version."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import T, measurements_df, registry_df
from quorum.operators import window
from quorum.plans.serve import scored_requests, serve


def _measurements(spark, n, seed):
    rnd, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += rnd.choice([0, 0, 1, 2, 5, 40_000])         # bursts with equal times, and long gaps
        out.append((i, T(1, t), rnd.choice(["a", "a", "a", "b", "none"]), None if rnd.random() < .05 else round(rnd.uniform(0, 99), 2), i % 2))
    return out


REG = [("a", "m1", "w5", 0, T(1), 5, 50., 25., 0., 1), ("a", "m1", "w3", 0, T(6), 3, 40., 20., .1, 1),
       ("a", "m2", "w1", 0, T(3), 1, 50., 0., 0., 2), ("b", "m1", "w9", 0, T(1), 9, 50., 25., 0., 1)]


def _brute(rows):
    """Last values of each version, measurement by measurement."""
    out = {}
    for data_type, name in {(r[0], r[1]) for r in REG}:
        versions = sorted(r for r in REG if r[:2] == (data_type, name))
        versions.sort(key=lambda r: r[4])
        seen, active = [], None
        for i, ts, dt, v, _ in sorted((m for m in rows if m[2] == data_type), key=lambda m: (m[1], m[0])):
            now = [r for r in versions if r[4] <= ts]
            if not now:
                continue
            if now[-1] != active:
                active, seen = now[-1], []
            seen.append(None if v is None or active[7] == 0 else (v - active[6]) / active[7])
            out[i, f"{data_type}-{name}"] = None if len(seen) < active[5] else seen[-active[5]:]
    return out


@pytest.mark.parametrize("bucket_rows,slot_rows,share", [(10 ** 6, 64, 100), (40, 1, 1), (7, 1, 0), (1, 1, 0), (1, 30, 0)])
def test_windows_equal_brute_force(spark, monkeypatch, bucket_rows, slot_rows, share):
    """Buckets larger and smaller than a window give the same windows."""
    monkeypatch.setattr(window, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(window, "CONTEXT_SHARE", share)
    rows = _measurements(spark, 300, 11)
    got = scored_requests(measurements_df(spark, rows), registry_df(spark, REG), bucket_rows=bucket_rows)
    got = {(r.event_id, r.data_model): r.window for r in got.filter("data_model is not null").collect()}
    want = _brute(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None), k
        if w is not None:
            assert [x if x is None else round(x, 4) for x in got[k]] == [x if x is None else round(x, 4) for x in w], k


def test_every_border_has_its_context():
    rnd = random.Random(2)
    for _ in range(300):
        slots = [(i * 3, rnd.randrange(1, 6)) for i in range(rnd.randrange(1, 30))]
        enough, back = rnd.randrange(1, 12), rnd.randrange(0, 9)
        got = window._assign(slots, enough, back)
        assert [s for s, _, _ in got] == [s for s, _ in slots]
        for b in {b for _, b, _ in got}:
            first = next(i for i, x in enumerate(got) if x[1] == b)
            before = sum(n for _, n in slots[:first])
            context = sum(n for (_, n), (_, _, to) in zip(slots, got) if b in to)
            assert context >= min(back, before)
            assert all(i < first for i, x in enumerate(got) if b in x[2])


def test_borders_follow_density(spark, monkeypatch):
    """A burst inside a long quiet time is cut; quiet measurements share a bucket."""
    monkeypatch.setattr(window, "SLOT_ROWS", 1)
    quiet = [(i, T(1 + i % 25, 0), "a", 1., 0) for i in range(50)]
    burst = [(1000 + i, T(27, i), "a", 1., 0) for i in range(2000)]
    m = measurements_df(spark, quiet + burst)
    slots = window.density_slots(m, spark.createDataFrame([("a",)], "data_type string"), 4, bucket_rows=500)
    placed = window.with_last_values(m, "utilization", 4, slots, "p").groupBy("p").count().collect()
    assert sum(r["count"] for r in placed) == 2050 and len(placed) >= 2
    assert window.density_slots(m, spark.createDataFrame([("x",)], "data_type string"), 4, bucket_rows=5) is None


def test_results_do_not_depend_on_buckets(spark):
    m = measurements_df(spark, _measurements(spark, 400, 4))
    reg = registry_df(spark, REG)
    a, b = (serve(m, reg, latency=(F.col("event_id") * 7 % 300).cast("long"), quorum=1, bucket_rows=n).results for n in (10 ** 6, 100))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 400
