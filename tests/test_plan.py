"""Plan shape: pruning reaches the scan, and one exchange moves the measurements."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, T, registry_df
from quorum import demo
from quorum.operators import deciders
from quorum.plans.serve import serve
from quorum.sources.tables import measurements


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _static_plan(spark, make) -> str:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _plan(make())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("quorum,decider", [("all", None), (1, None), (2, deciders.first_answer())])
@pytest.mark.parametrize("shape", ["as given", "sparse", "hot"])
def test_one_exchange_carries_the_measurements(spark, monkeypatch, quorum, decider, shape):
    from quorum.operators import window
    monkeypatch.setattr(window, "CONTEXT_SHARE", 1)
    monkeypatch.setattr(window, "SLOT_ROWS", 1)
    m = measurements(spark, SF_SMALL)
    if shape == "sparse":       # days between two measurements of a type
        m = m.withColumn("ts", F.timestamp_add("DAY", (F.col("event_id") % 1000).cast("int"), F.col("ts")))
    if shape == "hot":          # one model has them all, many windows in a second
        m = m.withColumn("data_type", F.when(F.col("event_id") >= 0, "click").otherwise(F.col("data_type")))
    plan = _static_plan(spark, lambda: serve(m, demo.registry(spark), demo.config(spark), latency=demo.latency(),
                                             quorum=quorum, decider=decider, bucket_rows=100).results)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert len(scans) == 1 and "user_id" not in scans[0]      # read once, unused columns never
    # the only exchange by a key is the window's: the small sides lie in one partition
    by_key = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(by_key) == 1 and "__place" in by_key[0], by_key
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_responses_meet_their_requests_in_one_partitioning(spark):
    m = measurements(spark, SF_SMALL)
    answers = m.selectExpr("sha2(string(event_id), 256) guid", "'click-m1' data_model", "1 result", "ts arrived_at")
    plan = _static_plan(spark, lambda: serve(m, demo.registry(spark), demo.config(spark), responses=answers,
                                             decider=deciders.vote()).results)
    by_key = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # starts by guid; answers by (guid, model) to be merged, then by guid
    assert len(by_key) <= 3, by_key


def test_empty_registry_gives_no_model_for_all(spark):
    m = measurements(spark, SF_SMALL)
    res = serve(m, registry_df(spark, []), demo.config(spark)).results
    got = {r["outcome"]: r["count"] for r in res.groupBy("outcome").count().collect()}
    assert got == {"no_model": m.count()}


def test_thousands_of_versions_meet_few_at_a_time(spark):
    """A type with 4,000 versions: a measurement meets those of its time cell, not all."""
    from quorum.operators.asof import grid_cell
    from quorum.operators.route import registry_grid, route_requests, version_intervals
    rows = [("click", f"m{i % 4}", f"v{i}", 0, T(1, i * 600), 2, 50.0, 50.0, 0.0, 1) for i in range(4000)]
    reg = registry_df(spark, rows)
    grid = registry_grid(reg)
    assert grid.n == 1000
    iv = version_intervals(reg)
    cells = iv.select(F.explode(F.sequence(grid_cell("valid_from", grid), F.coalesce(grid_cell("valid_to", grid), F.lit(grid.n - 1)))).alias("c"))
    assert cells.count() <= 3 * 4000                       # linear in the versions
    assert cells.groupBy("c").count().agg(F.max("count")).first()[0] <= 16
    m = measurements(spark, SF_SMALL).filter("data_type = 'click'")
    a = route_requests(m, reg, strategy="broadcast", grid=grid).select("event_id", "data_model", "version", "n_models")
    b = route_requests(m, reg, strategy="broadcast").select("event_id", "data_model", "version", "n_models")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_no_grid_where_all_models_hold_at_once(spark):
    from quorum.operators.route import registry_grid
    assert registry_grid(registry_df(spark, [("c", f"m{i}", "d", 0, T(1, i), 1, 0., 1., 0., 1) for i in range(300)])) is None
    assert registry_grid(registry_df(spark, [])) is None
