"""Answers as an input of their own, and deciders as column expressions."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import T, config_df, measurements_df, registry_df
from quorum.functions.columns import request_guid
from quorum.operators import deciders
from quorum.operators.collect import collect_vote
from quorum.operators.responses import RESPONSE_INPUT, collect_responses
from quorum.plans.serve import request_starts, serve


def _ms(ts, ms):
    return ts + dt.timedelta(microseconds=round(ms * 1000))


def _guid(spark, i):
    return spark.range(1).select(request_guid(F.lit(i)).alias("g")).first().g


def _case(spark, answers):
    """Requests 1 and 2 of a type with two models and 100 ms, request 3 of a type without; answers by (event, model, result, ms)."""
    m = measurements_df(spark, [(1, T(2, 10), "c", 1., 1), (2, T(2, 10), "c", 1., 0), (3, T(2, 10), "x", 1., 1)])
    reg = registry_df(spark, [("c", k, k, 0, T(1), 1, 0., 1., 0., 1) for k in ("m1", "m2")])
    cfg = config_df(spark, [("c", 100, T(1))])
    rows = [(None if e is None else _guid(spark, e), k, r, None if ms is None else _ms(T(2, 10), ms)) for e, k, r, ms in answers]
    return m, reg, cfg, spark.createDataFrame(rows, RESPONSE_INPUT)


def test_answers_from_outside(spark):
    m, reg, cfg, got = _case(spark, [
        (1, "c-m1", 1, 100.), (1, "c-m2", 0, 100.001),       # at the deadline, and a microsecond after
        (2, "c-m1", 0, 50.), (2, "c-m1", 1, 40.), (2, "c-m1", 1, 40.), (2, "c-m2", 1, -5.),   # repeated; before its start
        (9, "c-m1", 1, 1.), (None, "c-m1", 1, 1.), (2, None, 1, 1.), (2, "c-m2", 1, None)])
    out = serve(m, reg, cfg, responses=got)
    res = {r.event_id: (r.outcome, r.result, r.duration_ms, r.processed) for r in out.results.collect()}
    assert res == {1: ("deadline", 1, 100, True), 2: ("complete", 1, 40, True), 3: ("no_model", None, 0, False)}
    assert [(r.event_id, r.data_model, r.latency_ms) for r in out.late.collect()] == [(1, "c-m2", 101)]
    assert sorted((r.reason, r.data_model) for r in out.unknown.collect() if r.data_model) == [
        ("incomplete", "c-m1"), ("incomplete", "c-m2"), ("no_request", "c-m1")]
    assert out.unknown.count() == 4


def test_first_k_answers_from_outside(spark):
    m, reg, cfg, got = _case(spark, [(1, "c-m1", 1, 30.), (1, "c-m2", 0, 20.), (2, "c-m2", 1, 101.)])
    res = {r.event_id: (r.outcome, r.result, r.duration_ms) for r in serve(m, reg, cfg, responses=got, quorum=1).results.collect()}
    assert res == {1: ("complete", 0, 20), 2: ("timeout", None, 0), 3: ("no_model", None, 0)}


def test_no_answers_and_no_requests(spark):
    m, reg, cfg, none = _case(spark, [])
    assert {r.outcome for r in serve(m, reg, cfg, responses=none).results.collect()} == {"timeout", "no_model"}
    _, _, _, some = _case(spark, [(1, "c-m1", 1, 1.)])
    out = collect_responses(request_starts(m.limit(0), reg, cfg), some)
    assert out.results.count() == 0 and out.unknown.count() == 1


def test_a_storm_of_answers_to_one_request(spark):
    """A third of all answers repeat one: merged before they move; extra columns stay with the unknown ones."""
    m, reg, cfg, one = _case(spark, [(1, "c-m1", 1, 10.)])
    storm = spark.range(3000).crossJoin(one).drop("id").withColumn("sender", F.lit("s"))
    astray = spark.range(3000).select(F.lit("nobody").alias("guid"), F.lit("m").alias("data_model"), F.lit(1).alias("result"),
                                      F.lit(T(2)).cast("timestamp_ntz").alias("arrived_at"), F.lit("s").alias("sender"))
    out = serve(m, reg, cfg, responses=storm.unionByName(astray))
    assert out.rows.filter("answered").select("n_answers").collect()[0][0] == 3000
    assert out.unknown.filter("sender = 's' AND reason = 'no_request'").count() == 3000


def _rows(spark, answers):
    """Rows of one request with the given (latency, model, result)."""
    rows = [(1, "c", T(1), 1, len(answers), 100, m, True, lat, r) for lat, m, r in answers]
    return spark.createDataFrame(rows, "event_id long, data_type string, ts timestamp_ntz, label int, n_models int, timeout_ms long, "
                                       "data_model string, answered boolean, latency_ms long, result int")


def _decide(spark, answers, decider, quorum="all"):
    return collect_vote(_rows(spark, answers), quorum, decider=decider).first().result


def test_deciders(spark):
    votes = [(30, "a", 1), (10, "b", None), (20, "c", 0), (500, "d", 1)]       # the last is late
    assert _decide(spark, votes, deciders.first_answer()) == 0
    assert _decide(spark, votes, deciders.vote()) == 0 and _decide(spark, votes, deciders.vote(.3)) == 1
    assert _decide(spark, votes, None) == 0
    assert _decide(spark, votes, deciders.weighted_vote({"a": 5.})) == 1
    assert _decide(spark, votes, deciders.weighted_vote({}, other=0.)) == 0
    assert _decide(spark, votes, deciders.all_agree(default=7)) == 7
    assert _decide(spark, [(1, "a", 1), (2, "b", 1)], deciders.all_agree()) == 1
    assert _decide(spark, [(10, "b", 0), (10, "a", 1)], deciders.first_answer()) == 1       # a tie: by model key
    assert _decide(spark, [(10, "b", None)], deciders.first_answer(default=1)) == 1
    assert _decide(spark, [(30, "a", 1), (10, "b", 0)], deciders.first_answer(), 1) == 0


def test_vote_and_its_decider_agree(spark):
    from conftest import SF_SMALL
    from quorum.plans.catalog import _rows as all_rows
    rows = all_rows(spark, SF_SMALL)
    for quorum in ("all", 1):
        a, b = collect_vote(rows, quorum), collect_vote(rows, quorum, decider=deciders.vote())
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()
