"""Model payloads at the scorer, the load probe, measured answer times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quorum import demo
from quorum.operators import score
from quorum.operators.collect import with_answers
from quorum.operators.score import ModelCache, PayloadScorer, load_failures, score_with, with_load_probe
from quorum.plans.catalog import _payload_rows, _rows
from quorum.plans.serve import MEASURED, scored_requests, serve
from quorum.sources.tables import measurements


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_large_payload_tables_meet_their_rows_in_shards(spark, monkeypatch):
    """Beyond the broadcast bound the same results, a version split over several shards."""
    monkeypatch.setattr(score, "SHARD_ROWS", 50)
    rows = _payload_rows(spark, SF_SMALL, latency=demo.latency()).drop("result", "score_ms", "__place")
    payloads = demo.payload_registry(spark).select(
        F.concat_ws("-", "data_type", F.replace("name", F.lit(" "), F.lit("_"))).alias("data_model"),
        F.col("registered_at").alias("version"), "payload")
    a = score_with(rows, {0: PayloadScorer()}, payloads)
    b = score_with(rows, {0: PayloadScorer()}, payloads, max_broadcast_bytes=0)
    cols = ["event_id", "data_model", "version", "result"]
    assert _same(a.select(*cols), b.select(*cols)) and a.filter("result is not null").count() > 500
    assert b.filter("result is not null").agg(F.min("score_ms")).first()[0] > 0


def test_only_what_a_model_needs_crosses_arrow(spark):
    plan = score_with(_rows(spark, SF_SMALL).drop("result"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    sent = plan[plan.index("ArrowEvalPython"):].split("\n")[0]
    assert "label" not in sent and "description" not in sent


def test_versions_that_do_not_load(spark):
    probed = with_load_probe(demo.payload_registry(spark), {0: PayloadScorer()})
    bad = {r.description: r.load_error for r in load_failures(probed).collect()}
    assert set(bad) == set(demo.BROKEN) and all(e.startswith("ValueError") for e in bad.values())
    rows = _payload_rows(spark, SF_SMALL)
    assert rows.filter("answered").filter(F.col("description").isin(*demo.BROKEN)).count() == 0
    # a model that never loaded is known: requests wait for it
    res = serve(measurements(spark, SF_SMALL), demo.payload_registry(spark), scorer="python",
                scorer_map={0: PayloadScorer()}).results
    late = res.filter("data_type = 'error' AND ts >= '2024-01-05'")
    assert late.filter("n_models = 3 AND outcome = 'deadline'").count() == late.count() > 0


def test_measured_times_reach_responses(spark):
    class Slow(PayloadScorer):
        def predict(self, model, windows):
            import time
            time.sleep(.02 * len(windows))          # 20 ms a row
            return super().predict(model, windows)

    m = measurements(spark, SF_SMALL).filter("data_type = 'click' AND event_id < 100")
    rows = scored_requests(m, demo.payload_registry(spark), demo.config(spark), latency=MEASURED, scorer="python",
                           scorer_map={0: Slow()})
    scored = rows.filter("result is not null").select("latency_ms").collect()
    assert scored and all(20 <= r.latency_ms < 1000 for r in scored)
    with pytest.raises(ValueError):
        scored_requests(m, demo.registry(spark), latency="guessed")


def test_model_cache_is_bounded_by_bytes():
    closed = []

    class Kept(PayloadScorer):
        def load(self, params):
            return params["payload"]

        def close(self, model):
            closed.append(model)

    cache = ModelCache({0: Kept()}, 10)
    get = lambda k, n: cache.get((k, 0), lambda: {"payload": k.encode() * n})
    get("a", 4), get("b", 4), get("a", 4), get("c", 4)
    assert closed == [b"bbbb"] and cache.bytes == 8 and cache.loads == 3        # the least recently used left
    get("d", 50)                                                               # larger than the bound: alone
    assert list(cache.models) == [("d", 0)]
    cache.close()
    assert cache.bytes == 0 and len(closed) == 4


def test_payload_scorer_refuses_other_payloads():
    for raw in (None, b"", b"1234567", np.array([1., 2.]).tobytes(), np.array([0., 1., np.nan]).tobytes()):
        with pytest.raises(ValueError):
            PayloadScorer().load({"payload": raw, "width": 2})
    model = PayloadScorer().load({"payload": np.array([-1., 1., 2.]).tobytes(), "width": 2})
    assert list(PayloadScorer().predict(model, np.array([[1., 0.], [0., 1.]], dtype=np.float32))) == [0, 1]


def test_answers_need_a_version_that_loads(spark):
    rows = spark.createDataFrame([("a", 0, True), ("b", 0, False), ("c", 1, True), ("d", 0, None), (None, 0, True)],
                                 "data_model string, model_type int, loads boolean").withColumn("ts", F.current_timestamp())
    assert {r.data_model for r in with_answers(rows).filter("answered").collect()} == {"a", "d"}     # null: not tried
