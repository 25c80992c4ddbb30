"""One result per measurement, whatever the registry's size, the log's
partitions or the order of arrival."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL, T, measurements_df, registry_df
from quorum import demo
from quorum.operators.asof import fits_broadcast
from quorum.operators.ensemble import SliceModel, ensemble_score
from quorum.operators.route import known_model_epochs, known_models, prepare_registry
from quorum.plans.serve import serve
from quorum.session import rocksdb_state, work_dir
from quorum.sources.tables import measurements
from quorum.streaming.collector import OUTPUT, collect_stream
from quorum.streaming.serve_stream import RESPONSES, measurements_from_log
from quorum.streaming.tables import ensure_dir


def test_broadcast_and_scan_agree_on_a_replayed_registry(spark):
    m = measurements(spark, SF_SMALL)
    reg = demo.registry(spark, demo.REPLAYED_ROWS)
    a, b = (serve(m, reg, demo.config(spark), latency=demo.latency(), strategy=s).results
            for s in ("broadcast", "scan"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == m.count()


def test_repeated_message_adds_no_answer(spark):
    row = ("cpu", "m", "d", 0, T(1), 1, 0.0, 1.0, 0.0, 1)
    m = measurements_df(spark, [(1, T(2), "cpu", 1.0, 1)])
    for s in ("broadcast", "scan"):
        out = serve(m, registry_df(spark, [row, row, row]), strategy=s)
        assert out.rows.count() == 1
        assert [r["result"] for r in out.results.collect()] == [1]


def test_last_in_the_log_holds(spark):
    reg = registry_df(spark, [("cpu", "m", "z first", 0, T(1), 1, 0.0, 1.0, 5.0, 1),
                              ("cpu", "m", "a last", 0, T(1), 1, 0.0, 1.0, 0.0, 1)])
    reg = reg.withColumn("log_pos", F.when(F.col("description") == "a last", 9).otherwise(3))
    assert [r["description"] for r in prepare_registry(reg).collect()] == ["a last"]


def test_version_without_scorer_does_not_displace(spark):
    reg = registry_df(spark, [("cpu", "a", "serves", 0, T(1), 1, 0.0, 1.0, 0.0, 1),
                              ("cpu", "a", "no scorer", 1, T(3), 1, 0.0, 1.0, 0.0, 1),
                              ("cpu", "b", "never serves", 1, T(1), 1, 0.0, 1.0, 0.0, 2)])
    m = measurements_df(spark, [(1, T(4), "cpu", 1.0, 1)])
    for s in ("broadcast", "scan"):
        out = serve(m, reg, strategy=s)
        got = {r["data_model"]: r["description"] for r in out.rows.collect()}
        assert got == {"cpu-a": "serves", "cpu-b": "never serves"}
        r = out.results.collect()[0]
        assert (r["processed"], r["result"], r["outcome"]) == (True, 1, "deadline")
    assert known_models(reg).collect()[0]["models"] == ["cpu-a", "cpu-b"]


def test_colliding_offsets_stay_apart(spark):
    val = b'{"utilization": 1.0, "class": 1, "dataType": "cpu"}'
    log = spark.createDataFrame(
        [(None, val, "mdata", p, 7, dt.datetime(2024, 1, 2)) for p in (0, 1)],
        "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    meas, _ = measurements_from_log(log)
    reg = registry_df(spark, [("cpu", "m", "d", 0, T(1), 1, 0.0, 1.0, 0.0, 1)])
    res = serve(meas, reg).results.collect()
    assert len({r["guid"] for r in res}) == len(res) == 2


def test_size_check_counts_what_lists_hold(spark):
    reg = registry_df(spark, [("cpu", f"model-{i:04d}-" + "x" * 40, "d", 0, T(1, i), 1, 0.0, 1.0, 0.0, i)
                              for i in range(400)])
    ep = known_model_epochs(reg)
    assert not fits_broadcast(ep, max_bytes=1_000_000)
    assert fits_broadcast(reg, max_bytes=1_000_000)


def test_short_vector_has_no_class(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0],)], "v array<double>")
    ms = [SliceModel("u", 1, 2), SliceModel("w", 1, 2, weights=(1.0, 1.0))]
    got = [(r["u"], r["w"]) for r in ensemble_score(df, "v", ms).orderBy(F.size("v")).collect()]
    assert got == [(None, None), (1, 1)]


def test_collector_keeps_requests_that_come_out_of_order(spark):
    """Four micro-batches: the third is five minutes, the last a day older."""
    root = work_dir(spark, "disorder")

    def start(name, ts):
        return [(name, 1, "cpu", ts, 1, 2, 100, None, None, None, None, False, None, None, None, True)]

    def rows(name, ts, latencies):
        return [(name, i, "cpu", ts, 1, 2, 100, f"cpu-m{j}", T(1), "d", 0, True, 1, lat,
                 ts + dt.timedelta(milliseconds=lat), False) for i, (j, lat) in enumerate(latencies)]
    batches = [rows("a", T(5, 600), [(1, 10), (2, 20)]) + start("a", T(5, 600)),
               rows("b", T(5, 900), [(1, 10)]) + start("b", T(5, 900)),
               rows("c", T(5, 300), [(1, 10), (2, 20)]) + start("c", T(5, 300)),
               rows("d", T(4), [(1, 10), (2, 30)]) + start("d", T(4)) + rows("b", T(5, 900), [(2, 30)])
               + rows("a", T(5, 600), [(3, 500)])]
    import time
    for i, b in enumerate(batches):
        spark.createDataFrame(b, RESPONSES).coalesce(1).write.parquet(f"{root}/in/batch_id={i}")
        time.sleep(1.1)
    src = (spark.readStream.schema(RESPONSES).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", "1").parquet(f"{root}/in"))
    ensure_dir(spark, f"{root}/out")
    with rocksdb_state(spark):
        # the second answer of b is on its way for three micro-batches
        q = (collect_stream(src, settle_ms=60_000).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/ck").outputMode("append")
             .trigger(processingTime="1 second").start())
    # (with processing-time timers there is always a next micro-batch: nothing to wait for but rows)
    end, out = time.monotonic() + 90, []
    while len(out) < 5 and time.monotonic() < end:
        time.sleep(1)
        out = spark.read.schema(OUTPUT).parquet(f"{root}/out").collect()
    q.stop()
    res = sorted((r["guid"], r["outcome"], r["processed"], r["duration_ms"])
                 for r in out if r["kind"] == "result")
    assert res == [("a", "complete", True, 20), ("b", "complete", True, 30),
                   ("c", "complete", True, 20), ("d", "complete", True, 30)]
    assert [(r["guid"], r["late_model"], r["late_ms"]) for r in out if r["kind"] == "late"] == \
        [("a", "cpu-m3", 500)]
