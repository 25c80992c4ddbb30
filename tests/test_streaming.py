"""Streaming equals batch (parity), survives a restart, and the state
reports agree with the batch statistics."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quorum import demo, schemas
from quorum.operators.collect import late_responses
from quorum.plans.catalog import _rows, q_serve
from quorum.session import work_dir
from quorum.sources.logs import CONFIG_TOPIC, MODELS_TOPIC, LogConfig, as_log, write_log
from quorum.streaming.demo_run import publish_events, run, run_collector
from quorum.streaming.registry_job import Tables, config_payloads, model_payloads, registry_job
from quorum.streaming.serve_stream import serve_stream
from quorum.streaming.tables import read_table


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_serve_stream_equals_batch(spark):
    assert _same(run(spark, SF_SMALL, n_files=3), q_serve(spark, SF_SMALL))


def test_restart_from_checkpoint_no_loss_no_duplicates(spark):
    root = work_dir(spark, "restart")
    logs, tables, ckpt = LogConfig(root=f"{root}/logs"), Tables(f"{root}/tables"), f"{root}/ckpt"
    write_log(as_log(model_payloads(demo.registry(spark)).coalesce(1), MODELS_TOPIC,
                     timestamp="registered_at"), logs, MODELS_TOPIC)
    write_log(as_log(config_payloads(demo.config(spark)).coalesce(1), CONFIG_TOPIC,
                     timestamp="effective_at"), logs, CONFIG_TOPIC)
    for q in registry_job(spark, logs, tables, ckpt, trigger={"availableNow": True}):
        q.awaitTermination()
    # first half of the log, stop; then the rest, restart from the same checkpoint
    stage = LogConfig(root=f"{root}/stage")
    publish_events(spark, SF_SMALL, stage, 1)
    staged = spark.read.schema(schemas.LOG).parquet(f"{stage.root}/mdata")
    half = staged.approxQuantile("offset", [0.5], 0)[0]
    middle = staged.filter(F.col("offset") <= half).agg(F.max("timestamp")).first()[0]
    for part in (staged.filter(F.col("timestamp") <= middle), staged.filter(F.col("timestamp") > middle)):
        write_log(part.coalesce(2), logs, "mdata")
        q = serve_stream(spark, logs, tables, ckpt, latency=demo.latency,
                         trigger={"availableNow": True})
        q.awaitTermination()
    got = read_table(spark, tables.results, schemas.RESULTS)
    assert got.count() == got.select("guid").distinct().count()
    assert _same(got, q_serve(spark, SF_SMALL))
    # the stateful collector over the same responses gives the same results
    # and exactly the batch's late answers
    out = run_collector(spark, tables, ckpt)
    res = out.filter("kind = 'result'").select(*schemas.RESULTS.fieldNames())
    assert _same(res, q_serve(spark, SF_SMALL))
    late = out.filter("kind = 'late'").select("event_id", F.col("late_model").alias("data_model"))
    exp = late_responses(_rows(spark, SF_SMALL)).select("event_id", "data_model")
    assert _same(late, exp)


def test_collector_state_is_readable_and_cleaned(spark):
    from quorum.streaming.reports import open_requests, stream_state_report
    from quorum.streaming.demo_run import run_with_collector
    from quorum.session import checkpoint_root
    import glob
    res, late = run_with_collector(spark, SF_SMALL, n_files=1)
    assert res.count() == 1000
    root = sorted(glob.glob(checkpoint_root(spark).replace("file:", "") + "/serve-collect-*"))[-1]
    # what is left in the state store are tombstones of decided requests
    # (removed by clean-up timers as event time moves on): none is undecided
    held = open_requests(spark, root + "/ckpt/collector").select(F.col("key.guid").alias("guid"))
    assert held.subtract(res.select("guid")).count() == 0
    rep = stream_state_report(spark, Tables(root + "/tables"))
    assert rep["model_versions"].agg(F.sum("usage")).first()[0] == \
        _rows(spark, SF_SMALL).filter("answered").count()


def test_processing_time_collector_decides_every_request(spark):
    import time as _time
    from quorum.streaming.collector import OUTPUT, collect_stream
    from quorum.streaming.serve_stream import RESPONSES, response_rows
    root = work_dir(spark, "ptime")
    rows = _rows(spark, SF_SMALL)
    response_rows(rows).write.parquet(f"{root}/in/batch_id=0")
    src = spark.readStream.schema(RESPONSES).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    from quorum.session import rocksdb_state
    with rocksdb_state(spark):
        q = (collect_stream(src, time_mode="processing").writeStream.format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck")
             .outputMode("append").trigger(processingTime="1 second").start())
    try:
        t0, n = _time.time(), 0
        while _time.time() - t0 < 120 and n < 1000:
            _time.sleep(2)
            try:
                n = spark.read.schema(OUTPUT).parquet(f"{root}/out").filter("kind = 'result'").count()
            except Exception:  # noqa: BLE001 - nothing written yet
                n = 0
    finally:
        q.stop()
    out = spark.read.schema(OUTPUT).parquet(f"{root}/out").filter("kind = 'result'")
    got = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
    # answers come in the same micro-batch as their start (wall-clock latency ~0):
    # a request completes iff every model answers; else its timer decides it
    per = rows.groupBy("event_id").agg(F.max("n_models").alias("n"),
                                       F.count_if("answered").alias("a"))
    exp_complete = per.filter("n > 0 AND a = n").count()
    exp_deadline = per.filter("n > 0 AND a < n").count()
    exp_none = per.filter("n = 0").count()
    assert out.count() == out.select("guid").distinct().count() == 1000
    assert got.get("complete", 0) == exp_complete
    assert got.get("deadline", 0) + got.get("timeout", 0) == exp_deadline
    assert got.get("no_model", 0) == exp_none


def test_stateful_collector_quorum_one_equals_batch(spark):
    from quorum.plans.catalog import _results
    from quorum.streaming.demo_run import run_with_collector
    res, late = run_with_collector(spark, SF_SMALL, n_files=1, quorum=1)
    assert _same(res, _results(spark, SF_SMALL, 1))
    exp_late = late_responses(_rows(spark, SF_SMALL), 1).select("event_id", "data_model")
    assert _same(late.select("event_id", F.col("late_model").alias("data_model")), exp_late)


def test_collector_with_a_decider_equals_batch(spark):
    """The same decider object in the batch plan, the serving stream and the collector."""
    from quorum.operators import deciders
    from quorum.plans.catalog import q_custom_decider
    from quorum.streaming.demo_run import run_with_collector
    want = q_custom_decider(spark, SF_SMALL)
    res, _ = run_with_collector(spark, SF_SMALL, n_files=1, decider=deciders.first_answer())
    assert _same(res, want)
    assert _same(run(spark, SF_SMALL, n_files=2, decider=deciders.first_answer()), want)


def _answers(*rows):
    """(guid, is_start, model, latency) as response rows of a type with two models and 100 ms."""
    from conftest import T
    return [(g, 1, "cpu", T(5), 1, 2, 100, m, None if s else T(1), None, 0, not s, None if s else 1, lat, None, s)
            for g, s, m, lat in rows]


def _collector(spark, root, **kw):
    from quorum.session import rocksdb_state
    from quorum.streaming.collector import collect_stream
    from quorum.streaming.serve_stream import RESPONSES
    src = spark.readStream.schema(RESPONSES).parquet(f"{root}/in")
    with rocksdb_state(spark):
        return (collect_stream(src, **kw).writeStream.format("parquet").option("path", f"{root}/out")
                .option("checkpointLocation", f"{root}/ck").trigger(processingTime="200 milliseconds").start())


def _collected(spark, root):
    from quorum.streaming.collector import OUTPUT
    rows = spark.read.schema(OUTPUT).parquet(f"{root}/out").collect()
    return sorted((r.guid, r.kind, r.outcome, r.duration_ms, r.late_model or "") for r in rows)


def _wait(spark, root, n, seconds=90):
    import time
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        got = _collected(spark, root)
        if len(got) >= n:
            return got
        time.sleep(.5)
    return _collected(spark, root)


def test_restart_with_open_requests_and_bounded_state(spark):
    """An open request is decided after a restart, by an answer or by its timer; answers come late and
    without a request; when the grace is over, no state is left."""
    import time
    from quorum.streaming.reports import open_requests
    from quorum.streaming.serve_stream import RESPONSES
    from quorum.streaming.tables import ensure_dir
    root = work_dir(spark, "open")
    for name in ("in", "out"):
        ensure_dir(spark, f"{root}/{name}")

    def publish(*rows):
        spark.createDataFrame(_answers(*rows), RESPONSES).coalesce(1).write.mode("append").parquet(f"{root}/in")

    # b's answer comes before its start, x never starts
    publish(("a", True, None, None), ("a", False, "m1", 10), ("b", False, "m1", 20), ("x", False, "m1", 5), ("c", True, None, None))
    q = _collector(spark, root, settle_ms=25_000, grace_ms=20_000)
    end = time.monotonic() + 60
    while not (q.lastProgress and q.lastProgress["batchId"] >= 1) and time.monotonic() < end:
        time.sleep(.5)
    q.stop()
    assert _collected(spark, root) == []
    assert {r.key.guid for r in open_requests(spark, f"{root}/ck").collect()} == {"a", "c"}
    publish(("a", False, "m2", 30), ("b", True, None, None), ("b", False, "m2", 15))
    q = _collector(spark, root, settle_ms=25_000, grace_ms=20_000)
    try:
        got = _wait(spark, root, 2, 60)
        assert ("a", "result", "complete", 30, "") in got and ("b", "result", "complete", 20, "") in got
        publish(("a", False, "m3", 40))                 # decided, and still remembered
        got = _wait(spark, root, 5)
        assert ("a", "late", "late", 0, "m3") in got and ("c", "result", "timeout", 0, "") in got
        assert ("x", "unknown", "unknown", 0, "m1") in got and len(got) == 5
        end = time.monotonic() + 60
        while open_requests(spark, f"{root}/ck").count() and time.monotonic() < end:
            time.sleep(1)
        assert open_requests(spark, f"{root}/ck").count() == 0
        publish(("a", False, "m4", 50))                 # forgotten: opens nothing
        assert _wait(spark, root, 6)[-1] == ("x", "unknown", "unknown", 0, "m1")
        assert ("a", "unknown", "unknown", 0, "m4") in _collected(spark, root)
    finally:
        q.stop()


def test_batches_are_appended_once_under_a_running_reader(spark):
    """A batch that is done again, wholly or after a break while its files were moved, comes once."""
    from quorum.session import file_system
    from quorum.streaming.tables import append_once, ensure_dir
    root = work_dir(spark, "once")
    table = f"{root}/t"
    ensure_dir(spark, table)
    rows = lambda n: spark.range(n * 100, n * 100 + 40).repartition(4)
    q = (spark.readStream.schema("id long").parquet(table).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(processingTime="100 milliseconds").start())
    try:
        append_once(rows(0), table, 0)
        q.processAllAvailable()
        append_once(rows(0), table, 0)
        append_once(rows(1), table, 1)
        # a break: one file of batch 1 is still in the staging folder
        fs, folder = file_system(spark, table)
        moved = sorted(f.getPath().toString() for f in fs.listStatus(folder) if "batch-000000000001" in f.getPath().getName())[0]
        name = moved.split("batch-000000000001-")[1]
        q.processAllAvailable()
        append_once(rows(2), table, 2)
        append_once(rows(2).limit(3), table, 2)         # complete once: what is written later does not count
        assert not fs.exists(file_system(spark, f"{table}_staged/batch_id=1/{name}")[1])
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(r.id for r in spark.read.schema("id long").parquet(f"{root}/out").collect())
    assert got == [n * 100 + i for n in range(3) for i in range(40)]


def test_a_break_while_files_are_moved(spark, monkeypatch):
    from quorum.session import file_system
    from quorum.streaming import tables
    root = work_dir(spark, "break")
    table = f"{root}/t"
    real, calls = tables.file_system, []

    def breaking(spark, path):
        calls.append(path)
        if sum("/batch-" in p for p in calls) == 3:
            raise OSError("lost")
        return real(spark, path)

    monkeypatch.setattr(tables, "file_system", breaking)
    df = spark.range(40).repartition(4)
    try:
        tables.append_once(df, table, 7)
        raise AssertionError("no break")
    except OSError:
        pass
    monkeypatch.setattr(tables, "file_system", real)
    assert 0 < spark.read.schema("id long").parquet(table).count() < 40
    tables.append_once(spark.range(100, 140), table, 7)
    assert sorted(r.id for r in spark.read.schema("id long").parquet(table).collect()) == list(range(40))
    assert file_system(spark, table)[0] is not None


def test_reports_merge_partials_and_survive_a_replay(spark):
    """Reports read partials only, equal the batch figures after any number of batches, a replayed batch and compaction."""
    from quorum.operators.collect import collect_vote
    from quorum.operators.stats import collector_stats, model_stats
    from quorum.streaming import reports
    from quorum.streaming.registry_job import Tables
    rows = _rows(spark, SF_SMALL).persist()
    t = Tables(work_dir(spark, "partials"))
    cols = ["usage", "duration_ms", "min_ms", "max_ms", "avg_ms", "since"]
    for i in range(7):
        part = rows.filter(F.col("event_id") % 7 == i)
        for _ in range(2 if i in (2, 4, 6) else 1):        # batches done again, one right after a compaction
            reports.write_partials(part, collect_vote(part), t, i, compact_every=4)
    assert reports._generations(spark, t.model_partials) == [3]
    got = reports.merged_model_stats(reports.read_partials(spark, t.model_partials, reports.MODEL_PARTIALS))
    want = model_stats(rows)
    assert _same(got.select("data_model", "version", *cols), want.select("data_model", "version", *cols)) and want.count() > 5
    got = reports.merged_collector_stats(reports.read_partials(spark, t.collector_partials, reports.COLLECTOR_PARTIALS), demo.config(spark))
    want = collector_stats(collect_vote(rows), demo.config(spark))
    assert _same(got.select("data_type", "tmout_ms", *cols), want.select("data_type", "tmout_ms", *cols))
    reports.compact(spark, t.model_partials, reports.MODEL_PARTIALS, reports.MODEL_KEYS, 6)
    again = reports.merged_model_stats(reports.read_partials(spark, t.model_partials, reports.MODEL_PARTIALS))
    assert _same(again.select("data_model", "version", *cols), model_stats(rows).select("data_model", "version", *cols))
    # an older end: only what was there then
    older = reports.read_partials(spark, t.model_partials, reports.MODEL_PARTIALS, upto=1)
    assert older.agg(F.sum("usage")).first()[0] == rows.filter("event_id % 7 <= 1 AND answered").count()
    rows.unpersist()


def test_workers_find_the_package_from_another_folder(tmp_path):
    """The core's Python functions run where neither the working folder nor the path has the package."""
    import subprocess
    import sys
    from conftest import ROOT
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from quorum.session import get_spark
spark = get_spark('local[2]', shuffle_partitions=2)
from quorum.plans.catalog import QUERIES
assert QUERIES['score_python_model'](spark, {SF_SMALL!r}).filter('result = 1').count() > 0
assert QUERIES['python_decider'](spark, {SF_SMALL!r}).count() == 1000
"""
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=300)


class _Handle:
    """The state of one key, with the calls that reach it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_requests_of_a_state_key_share_its_calls():
    """A read, a write and a timer for a key's requests, however many; each is decided by itself."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import TimerValues
    from quorum.streaming.collector import START, CollectorProcessor
    from conftest import T
    cols = Row("state_key", "guid", *START, "is_start", "answered", "data_model", "latency_ms", "result")

    def rows(*of):
        return iter([cols(7, g, 1, "cpu", T(1), 1, 2, 100, m is None, m is not None, m, lat, 1) for g, m, lat in of])

    h, p = _Handle(), CollectorProcessor(settle_ms=0, grace_ms=1000)
    p.init(h)

    def took(came):
        return sorted((r.guid, r.kind, r.outcome, r.late_model or "", len(r.answers)) for r in came)

    first = [(f"g{i}", None, None) for i in range(50)] + [(f"g{i}", m, 10) for i in range(40) for m in ("a", "b")]
    got = took(p.handleInputRows((7,), rows(*first, ("x", "a", 5)), TimerValues(0)))
    assert got == sorted((f"g{i}", "result", "complete", "", 2) for i in range(40))
    assert h.calls == 3 and h.timers == {100}
    # an answer to a decided request, one past its deadline, and one that came before
    assert took(p.handleInputRows((7,), rows(("g0", "c", 20), ("g49", "a", 101)), TimerValues(50))) == [
        ("g0", "late", "late", "c", 0)]
    h.timers.remove(100)                                 # Spark removes the timer that came
    got = took(p.handleExpiredTimer((7,), TimerValues(100), None))
    assert got == sorted([(f"g{i}", "result", "timeout", "", 0) for i in range(40, 50)] + [("g49", "late", "late", "a", 0)])
    assert h.timers == {1000}
    h.timers.remove(1000)
    assert took(p.handleExpiredTimer((7,), TimerValues(1000), None)) == [("x", "unknown", "unknown", "a", 0)]
    h.timers.remove(1100)
    assert took(p.handleExpiredTimer((7,), TimerValues(1100), None)) == [] and h.value is None and not h.timers


def _packed_rows(spark, rows):
    """Response rows -> pieces by state key, as the collector's stream packs them."""
    import pyarrow as pa
    from quorum.streaming import collector
    from quorum.streaming.serve_stream import RESPONSES
    df = spark.createDataFrame(rows, RESPONSES).select(*collector._CAME, (F.coalesce(F.length("guid"), F.lit(0)) % 2).cast("long").alias("state_key"))
    batches = df.coalesce(1).toArrow().to_batches()
    return {r["state_key"]: r["rows"] for b in collector.packed(iter(batches)) for r in pa.RecordBatch.to_pylist(b)}


def test_a_key_gets_its_rows_as_one_piece(spark):
    """The rows of a key cross the Python worker as one value each way, and give what the rows by themselves give."""
    import pyarrow as pa
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import TimerValues
    from quorum.streaming import collector
    from quorum.streaming.serve_stream import RESPONSES
    rows = _answers(("a", True, None, None), ("a", False, "m1", 10), ("a", False, "m2", 30), ("bb", False, "m1", 20),
                    ("bb", True, None, None), ("bb", False, "m2", 120), ("c", False, "m1", 5), (None, False, "m1", 5),
                    ("a", False, "m2", 30), ("ee", True, None, None), ("ee", True, None, None), ("f", True, None, None))
    rows[-1] = rows[-1][:5] + (0,) + rows[-1][6:]        # a type without models
    rows[6] = rows[6][:1] + (None,) * 6 + rows[6][7:]    # an answer that knows its guid only
    pieces = _packed_rows(spark, rows)
    assert set(pieces) == {0, 1}
    came = [Row(*RESPONSES.fieldNames())(*r) for r in rows]

    def out(processor, plain):
        got = []
        for key, piece in pieces.items():
            h, p = _Handle(), processor(settle_ms=0, grace_ms=1000)
            p.init(h)
            mine = [r for r in came if len(r.guid or "") % 2 == key]
            got += p.handleInputRows((key,), iter(mine if plain else [Row(rows=piece)]), TimerValues(0))
            for now in (100, 1000, 1100):
                h.timers.discard(min(h.timers, default=None))
                got += p.handleExpiredTimer((key,), TimerValues(now), None)
            assert h.value is None
        if plain:
            return [r.asDict(True) for r in got]
        batch = pa.RecordBatch.from_pylist([{"rows": r.rows} for r in got])
        return [r for b in collector.unpacked(iter([batch])) for r in b.to_pylist()]

    order = lambda of: sorted(of, key=str)
    want = out(collector.CollectorProcessor, True)
    assert order(out(collector.PackedCollector, False)) == order(want)
    assert sorted((r["guid"] or "", r["kind"], r["outcome"], r["late_model"] or "") for r in want) == [
        ("", "unknown", "unknown", "m1"), ("a", "result", "complete", ""), ("bb", "late", "late", "m2"), ("bb", "result", "deadline", ""),
        ("c", "unknown", "unknown", "m1"), ("ee", "result", "timeout", ""), ("f", "result", "no_model", "")]


def test_marks_of_decided_requests_are_not_packed_again():
    """A micro-batch that asks for none of the decided requests leaves their marks as they are; any that it asks
    for is found, in whatever piece, until its grace is over."""
    from quorum.streaming.collector import MARK_PIECES, START, CollectorProcessor, _Held
    from conftest import T
    h, p = _Handle(), CollectorProcessor(settle_ms=0, grace_ms=1000)
    p.init(h)
    start = (1, "cpu", T(1), 1, 1, 100)
    assert len(start) == len(START)
    n = 3 * MARK_PIECES
    for i in range(n):
        got = p.collect({f"g{i}": start, f"h{i}": start}, {f"g{i}": [(5, "m", 1)], f"h{i}": [(5, "m", 0)]}, i)
        assert [r.outcome for r in got] == ["complete"] * 2
        pieces = _Held(h.value[1]).pieces
        assert len(pieces) <= MARK_PIECES and sum(x.n for x in pieces) == 2 * (i + 1)
        if i == 2:
            before = [x.requests for x in pieces[:2]]
            assert [x.n for x in pieces] == [2, 2, 2]
        if i == 3:
            assert [x.requests for x in pieces[:2]] == before
    # late, each of them, and no start opens one again
    late = p.collect({"g3": start}, {f"g{i}": [(50, "z", 1)] for i in range(n)}, n)
    assert sorted(r.guid for r in late) == sorted(f"g{i}" for i in range(n)) and {r.kind for r in late} == {"late"}
    h.timers.clear()
    assert p.expire(1000 + 5) == []
    assert sorted(r[0] for r in _Held(h.value[1]).requests()) == sorted(f"{c}{i}" for c in "gh" for i in range(6, n))
    assert [r.kind for r in p.collect({}, {"g3": [(50, "z", 1)], "g7": [(50, "z", 1)]}, 1006)] == ["late"]   # g3 is forgotten


def test_a_start_lies_beside_its_answers(spark):
    """A file of the responses has the start rows of all its answers: they do not wait for it in the collector's state."""
    from quorum.streaming.demo_run import served
    from quorum.streaming.serve_stream import RESPONSES
    tables, _ = served(spark, SF_SMALL, "beside", 1, "all")
    rows = spark.read.schema(RESPONSES).parquet(tables.responses).withColumn("f", F.input_file_name())
    per = rows.groupBy("guid").agg(F.countDistinct("f").alias("files"), F.count_if("is_start").alias("starts"))
    assert per.filter("files = 1 AND starts = 1").count() == per.count() == 1000
    assert rows.filter("answered").count() == _rows(spark, SF_SMALL).filter("answered").count()
