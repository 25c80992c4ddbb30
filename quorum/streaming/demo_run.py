"""Drive the streaming jobs end to end over the given tables (E2 check).

The ``events`` table is published as a measurement log in slices of time (a few
files and one micro-batch each), the inline registry and config
as model and config logs; the registry job and the serving stream then run
with an ``availableNow`` trigger and the results are read back.  All files
live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum import demo, schemas
from quorum.functions.decode import encode_measurements
from quorum.session import rocksdb_state, work_dir
from quorum.sources.logs import CONFIG_TOPIC, DATA_TOPIC, MODELS_TOPIC, LogConfig, as_log, write_log
from quorum.sources.tables import measurements
from quorum.streaming.registry_job import Tables, config_payloads, model_payloads, registry_job
from quorum.streaming.collector import OUTPUT, collect_stream
from quorum.streaming.serve_stream import RESPONSES, responses_stream, serve_stream
from quorum.streaming.tables import ensure_dir, read_table


FILES_PER_SLICE = 4


def files_per_slice(spark: SparkSession) -> int:
    """Files of the log in a slice: a micro-batch is read and decoded by a task for each, so
    at least as many as there are cores."""
    return max(FILES_PER_SLICE, spark.sparkContext.defaultParallelism)


def publish_events(spark: SparkSession, sf_dir: str, logs: LogConfig, n_slices: int) -> None:
    """The events in slices of time, each as ``files_per_slice`` files of the log."""
    m = measurements(spark, sf_dir)
    bounds = m.agg(F.min("ts"), F.max("ts")).first()
    lo, hi = bounds[0], bounds[1]
    step = (hi - lo) / n_slices
    for i in range(n_slices):
        a = lo + step * i
        cond = (F.col("ts") >= a) & ((F.col("ts") < lo + step * (i + 1)) if i < n_slices - 1 else F.lit(True))
        part = encode_measurements(m.filter(cond)).repartition(files_per_slice(spark))
        write_log(as_log(part, DATA_TOPIC, offset="event_id", timestamp="ts"), logs, DATA_TOPIC)


@contextmanager
def utc(spark: SparkSession):
    """Log times are ``timestamp`` (zoned) while the tables use
    ``timestamp_ntz``: run the jobs in UTC so the casts are exact, then put
    the session's zone back."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def run(spark: SparkSession, sf_dir: str, n_files: int = 3, quorum="all", decider=None) -> DataFrame:
    """The serving stream over ``n_files`` slices of the events; its results."""
    with utc(spark):
        tables, _ = served(spark, sf_dir, "serve-stream", n_files, quorum, decider=decider)
        return read_table(spark, tables.results, schemas.RESULTS)


def served(spark: SparkSession, sf_dir: str, name: str, n_files: int, quorum, registry: DataFrame | None = None,
           scorer_map=None, **kw) -> tuple[Tables, str]:
    """Publish registry, config and events, run the registry job and the serving
    stream to their ends; (tables, checkpoint folder)."""
    root = work_dir(spark, name)
    logs, tables, ckpt = LogConfig(root=f"{root}/logs"), Tables(f"{root}/tables"), f"{root}/ckpt"
    mp = model_payloads(demo.registry(spark) if registry is None else registry)
    write_log(as_log(mp.coalesce(1), MODELS_TOPIC, timestamp="registered_at"), logs, MODELS_TOPIC)
    cp = config_payloads(demo.config(spark))
    write_log(as_log(cp.coalesce(1), CONFIG_TOPIC, timestamp="effective_at"), logs, CONFIG_TOPIC)
    for q in registry_job(spark, logs, tables, ckpt, trigger={"availableNow": True}, scorer_map=scorer_map):
        q.awaitTermination()
    publish_events(spark, sf_dir, logs, n_files)
    serve_stream(spark, logs, tables, ckpt, latency=demo.latency, quorum=quorum, trigger={"availableNow": True},
                 max_files_per_trigger=files_per_slice(spark), scorer_map=scorer_map, **kw).awaitTermination()
    return tables, ckpt


def _decided(spark: SparkSession, tables: Tables) -> int:
    return spark.read.schema(OUTPUT).parquet(tables.collected).filter("kind = 'result'").count()


def _with_input(query) -> int:
    """The last micro-batch that read rows; -1 before the first."""
    return max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1)


def _batch(query):
    """The micro-batch last reported, and when."""
    p = query.lastProgress
    return p and (p["batchId"], p["timestamp"])


def stop_between_batches(query, wait_s: float = 60) -> None:
    """Stop a query when a micro-batch has just ended: broken off, a task with state can end
    its executor, and with it what else runs there."""
    last, end = _batch(query), time.monotonic() + wait_s
    while query.isActive and query.status["isTriggerActive"] and _batch(query) == last and time.monotonic() < end:
        time.sleep(.02)
    query.stop()


def state_partitions(spark: SparkSession) -> int:
    """Partitions of the collector's state: every one is committed in every micro-batch,
    whatever came to it, so no more than two for each core."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def run_collector(spark: SparkSession, tables: Tables, ckpt: str, quorum="all", decider=None,
                  settle_ms: int = 500, wait_s: float = 300, **kw) -> DataFrame:
    """Stateful collector over the ``responses`` table written by ``serve_stream``
    (T3), until every request that has started is decided; returns results and
    late rows (``kind``).  It gives up when ``wait_s`` seconds bring no new result and no
    micro-batch: what a run may take in all grows with its requests."""
    ensure_dir(spark, tables.collected)
    started = read_table(spark, tables.responses, RESPONSES).filter("is_start").count()
    with rocksdb_state(spark, state_partitions(spark)):
        q = (collect_stream(responses_stream(spark, tables), quorum, decider=decider, settle_ms=settle_ms, **kw)
             .writeStream.format("parquet").option("path", tables.collected)
             .option("checkpointLocation", f"{ckpt}/collector")
             .outputMode("append").trigger(processingTime="1 second").start())
    try:
        seen, end, at, n = None, 0.0, None, -1
        while n < started:
            # what is decided changes with micro-batches only
            now = _batch(q)
            if n < 0 or now != at:
                at, n = now, _decided(spark, tables)
            if q.exception() is not None:
                raise q.exception()
            progress = n, _with_input(q)
            if progress != seen:
                seen, end = progress, time.monotonic() + wait_s
            if time.monotonic() > end:
                raise TimeoutError(f"{started - n} requests still open, no progress for {wait_s} s")
            time.sleep(1)
    finally:
        stop_between_batches(q)
    return spark.read.schema(OUTPUT).parquet(tables.collected)


def run_with_collector(spark: SparkSession, sf_dir: str, n_files: int = 3, quorum="all", decider=None):
    """Serving stream, then the stateful collector; (results, late answers)."""
    with utc(spark):
        tables, ckpt = served(spark, sf_dir, "serve-collect", n_files, quorum)
        out = run_collector(spark, tables, ckpt, quorum, decider)
        res = out.filter("kind = 'result'").select(*schemas.RESULTS.fieldNames())
        return res, out.filter("kind = 'late'")
