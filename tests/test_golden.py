"""Hand-worked micro cases (FIXTURES.md section 6)."""

from pyspark.sql import functions as F

from conftest import T, config_df, measurements_df, registry_df
from quorum.functions.columns import argmax2, data_model_key, serving_line
from quorum.operators.collect import collect_vote, late_responses
from quorum.operators.route import known_models, route
from quorum.plans.serve import scored_requests, serve


def _one_model(width=1, mean=0.0, std=1.0, thr=0.0, model_type=0, name="m1", at=T(1), ord_=1):
    return ("cpu", name, f"d-{name}", model_type, at, width, mean, std, thr, ord_)


def _by_event(df):
    return {r["event_id"]: r for r in df.collect()}


def test_window_fills_then_slides(spark):
    reg = registry_df(spark, [_one_model(width=3)])
    m = measurements_df(spark, [(i, T(2, i), "cpu", float(i), 0) for i in (1, 2, 3, 4)])
    rows = _by_event(scored_requests(m, reg))
    assert rows[1]["window"] is None and rows[2]["window"] is None
    assert rows[3]["window"] == [1.0, 2.0, 3.0]
    assert rows[4]["window"] == [2.0, 3.0, 4.0]


def test_hot_swap_restarts_window(spark):
    reg = registry_df(spark, [_one_model(width=2, at=T(1)), _one_model(width=2, at=T(2, 3))])
    m = measurements_df(spark, [(i, T(2, i), "cpu", float(i), 0) for i in range(1, 6)])
    rows = _by_event(scored_requests(m, reg))
    assert [rows[i]["result"] is None for i in range(1, 6)] == [True, False, True, False, False]
    assert rows[2]["version"] == T(1) and rows[3]["version"] == T(2, 3)


def test_tie_votes_one_and_warmup_votes_zero(spark):
    # two models: one answers 0 (z=-1), one answers 1 (z=+1) -> tie -> 1
    reg = registry_df(spark, [
        ("cpu", "lo", "lo", 0, T(1), 1, 1.0, 1.0, 0.0, 1),   # z = v - 1
        ("cpu", "hi", "hi", 0, T(1), 1, -1.0, 1.0, 0.0, 2),  # z = v + 1
    ])
    m = measurements_df(spark, [(1, T(2), "cpu", 0.5, 1)])  # lo: -0.5 -> 0, hi: 1.5 -> 1
    r = serve(m, reg).results.collect()[0]
    assert (r["processed"], r["result"], r["model"], r["source"]) == (True, 1, "voter model", 1)
    # warming-up model (width 2) answers NULL and votes 0: NULL, 1 -> mean .5 -> 1
    reg2 = registry_df(spark, [("cpu", "w", "w", 0, T(1), 2, 0.0, 1.0, 0.0, 1),
                               ("cpu", "hi", "hi", 0, T(1), 1, -1.0, 1.0, 0.0, 2)])
    r2 = serve(m, reg2).results.collect()[0]
    assert r2["result"] == 1
    # NULL, NULL, 1 -> mean 1/3 -> 0
    reg3 = registry_df(spark, [("cpu", "w", "w", 0, T(1), 2, 0.0, 1.0, 0.0, 1),
                               ("cpu", "w2", "w2", 0, T(1), 3, 0.0, 1.0, 0.0, 2),
                               ("cpu", "hi", "hi", 0, T(1), 1, -1.0, 1.0, 0.0, 3)])
    assert serve(m, reg3).results.collect()[0]["result"] == 0


def test_no_model_and_nothing_in_time(spark):
    reg = registry_df(spark, [_one_model()])
    m = measurements_df(spark, [(1, T(2), "cpu", 1.0, 0), (2, T(2, 1), "disk", 1.0, 0)])
    res = _by_event(serve(m, reg, latency=F.lit(500)).results)
    assert res[2]["outcome"] == "no_model" and not res[2]["processed"]
    assert res[1]["outcome"] == "timeout" and not res[1]["processed"]
    assert res[1]["result"] is None and res[1]["duration_ms"] == 0


def test_exact_deadline_counts_and_late_answer_does_not(spark):
    reg = registry_df(spark, [_one_model()])
    cfg = config_df(spark, [("cpu", 150, T(1))])
    m = measurements_df(spark, [(1, T(2), "cpu", 1.0, 0)])
    ok = serve(m, reg, cfg, latency=F.lit(150)).results.collect()[0]
    assert ok["outcome"] == "complete" and ok["duration_ms"] == 150
    rows = scored_requests(m, reg, cfg, latency=F.lit(151))
    assert collect_vote(rows).collect()[0]["outcome"] == "timeout"
    assert late_responses(rows).count() == 1


def test_zero_timeout_means_default(spark):
    reg = registry_df(spark, [_one_model()])
    cfg = config_df(spark, [("cpu", 0, T(1))])
    m = measurements_df(spark, [(1, T(2), "cpu", 1.0, 0)])
    assert serve(m, reg, cfg, latency=F.lit(150)).results.collect()[0]["processed"]
    assert not serve(m, reg, cfg, latency=F.lit(151)).results.collect()[0]["processed"]


def test_quorum_one_takes_first_answer(spark):
    reg = registry_df(spark, [("cpu", "a", "a", 0, T(1), 1, 1.0, 1.0, 0.0, 1),
                              ("cpu", "b", "b", 0, T(1), 1, -1.0, 1.0, 0.0, 2)])
    m = measurements_df(spark, [(1, T(2), "cpu", 0.5, 0)])  # a -> 0, b -> 1
    lat = F.when(F.col("ord") == 1, 10).otherwise(20)
    r = serve(m, reg, latency=lat, quorum=1).results.collect()[0]
    assert (r["result"], r["duration_ms"], r["outcome"]) == (0, 10, "complete")
    r_all = serve(m, reg, latency=lat).results.collect()[0]
    assert (r_all["result"], r_all["duration_ms"]) == (1, 20)


def test_unsupported_type_never_answers(spark):
    reg = registry_df(spark, [_one_model(), _one_model(name="p", model_type=1, ord_=2)])
    m = measurements_df(spark, [(1, T(2), "cpu", 1.0, 0)])
    r = serve(m, reg).results.collect()[0]
    assert r["n_models"] == 2 and r["outcome"] == "deadline" and r["duration_ms"] == 150


def test_argmax_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, float("nan")), (float("nan"), 1.0), (1.0, 0.5),
                                (0.0, None)], "p0 double, p1 double")
    got = [r[0] for r in df.select(argmax2("p0", "p1")).collect()]
    assert got == [0, 1, 1, 0, None]


def test_blank_in_name_and_reregistration(spark):
    reg = registry_df(spark, [("cpu", "m 3", "x", 0, T(1), 1, 0.0, 1.0, 0.0, 1),
                              ("cpu", "m 3", "x", 0, T(3), 1, 0.0, 1.0, 0.0, 1)])
    km = known_models(reg).collect()[0]
    assert km["models"] == ["cpu-m_3"] and km["n_models"] == 1
    assert spark.range(1).select(data_model_key(F.lit("a"), F.lit("b c"))).first()[0] == "a-b_c"
    m = measurements_df(spark, [(1, T(2), "cpu", 1.0, 0), (2, T(4), "cpu", 1.0, 0)])
    req = _by_event(route(m, reg).requests)
    assert req[1]["version"] == T(1) and req[2]["version"] == T(3)


def test_serving_lines(spark):
    df = spark.createDataFrame([(True, "voter model", 1, 0, 12), (False, "", None, 0, 0),
                                (True, "voter model", None, 0, 5)],
                               "processed boolean, model string, result int, source int, duration_ms long")
    got = [r[0] for r in df.select(serving_line()).collect()]
    assert got == ["Using model voter model. Calculated result 1, expected 0 calculated in 12 ms",
                   "No model available - skipping", None]
