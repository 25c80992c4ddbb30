
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quorum import demo
from quorum.operators.collect import collect_vote, late_responses, responses_in_time
from quorum.operators.stats import model_stats
from quorum.plans.serve import scored_requests
from quorum.sources.tables import measurements


def _rows(spark, m=None, **kw):
    m = m if m is not None else measurements(spark, SF_SMALL)
    return scored_requests(m, demo.registry(spark), demo.config(spark),
                           latency=demo.latency(), **kw)


def test_one_result_per_measurement(spark):
    m = measurements(spark, SF_SMALL)
    res = collect_vote(_rows(spark, m))
    assert res.count() == m.count()
    assert res.select("guid").distinct().count() == m.count()


def test_on_time_plus_late_is_answers(spark):
    rows = _rows(spark).cache()
    answers = rows.filter("answered").count()
    for q in ("all", 1, 2):
        assert responses_in_time(rows, q).count() + late_responses(rows, q).count() == answers
    usage = model_stats(rows).agg(F.sum("usage")).first()[0]
    assert usage == answers
    rows.unpersist()


def test_vote_independent_of_partitioning(spark):
    m = measurements(spark, SF_SMALL)
    a = collect_vote(_rows(spark, m))
    b = collect_vote(_rows(spark, m.repartition(7, "user_id" if "user_id" in m.columns else "event_id")
                            .sortWithinPartitions(F.rand(5))))
    c = collect_vote(_rows(spark, m, bucket_rows=700))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.exceptAll(c).count() == 0


def test_quorum_monotone(spark):
    rows = _rows(spark).cache()
    c1 = collect_vote(rows, 1).filter("outcome = 'complete'").count()
    call = collect_vote(rows, "all").filter("outcome = 'complete'").count()
    assert c1 >= call
    rows.unpersist()
