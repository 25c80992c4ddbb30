"""The serving graph as a Structured Streaming query.

``serve_stream`` reads the measurement log and hands every micro-batch to
the same batch operators as ``serve``:

* the registry and config tables are re-read in each micro-batch, so model
  and timeout changes apply from the next micro-batch (a static DataFrame
  joined to a stream would keep its first file listing);
* the last-N window continues across micro-batches through a small *carry*
  table: the last ``W-1`` values of every model version, written under the
  batch id (durable, replay-safe).  The carry rows are put in front of the
  batch's rows and the bucketed window runs as in batch mode, so a hot model
  is still split over many tasks;
* in event-time deadline mode every answer of a request belongs to the
  micro-batch of its measurement, so collection and vote finish inside the
  batch; start and answer rows are also added to ``responses``, exactly once, for the
  stateful collector (``quorum.streaming.collector``), and the batch's statistics
  to the state reports (``quorum.streaming.reports``).

Order: micro-batches in arrival order, then ``(ts, event_id)`` inside one.
Outputs are written with overwrite under ``batch_id=<n>``: a replayed batch
replaces its own files, so the job survives executor and driver loss with
the checkpoint (exactly-once results).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.columns import request_guid, source_id
from quorum.functions.decode import decode_measurements, split_bad
from quorum.operators.asof import time_bucket
from quorum.operators.collect import KEY, START_COLS, collect_vote
from quorum.operators.route import prepare_registry
from quorum.operators.window import DEFAULT_WINDOW_BUCKET_SECONDS, last_n_window
from quorum.plans.serve import answering_types, max_width, routed_rows, score_rows
from quorum.sources.logs import DATA_TOPIC, LogConfig, read_log
from quorum.streaming.registry_job import Tables, config_table, registry_table
from quorum.streaming.reports import write_partials
from quorum.streaming.tables import append_once, ensure_dir, read_batch, write_batch

CARRY = T.StructType([
    T.StructField("data_model", T.StringType()),
    T.StructField("version", T.TimestampNTZType()),
    T.StructField("__seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("z", T.FloatType()),
])

_SEQ_SCALE = 1_000_000_000  # time buckets per micro-batch number (monotone bucket key)

RESPONSES = T.StructType([
    T.StructField("guid", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("data_type", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("label", T.IntegerType()), T.StructField("n_models", T.IntegerType()),
    T.StructField("timeout_ms", T.LongType()), T.StructField("data_model", T.StringType()),
    T.StructField("version", T.TimestampNTZType()), T.StructField("description", T.StringType()),
    T.StructField("model_type", T.IntegerType()), T.StructField("answered", T.BooleanType()),
    T.StructField("result", T.IntegerType()), T.StructField("latency_ms", T.LongType()),
    T.StructField("arrived_at", T.TimestampNTZType()), T.StructField("is_start", T.BooleanType()),
])
RESPONSE_COLS = RESPONSES.fieldNames()


def measurements_from_log(log: DataFrame, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Decoded measurement log -> (measurements, quarantine).  The source
    position is the measurement id and the log time its time."""
    good, bad = split_bad(decode_measurements(log, fmt))
    meas = good.select(source_id().alias("event_id"),
                       F.col("timestamp").cast("timestamp_ntz").alias("ts"),
                       "data_type", "utilization", "label")
    return meas, bad


def _window_with_carry(rows: DataFrame, carry: DataFrame, batch_id: int, W: int,
                       bucket_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``window``, next carry)."""
    new = rows.withColumn("__seq", F.lit(batch_id).cast("long")).withColumn("__ctx", F.lit(False))
    ctx = carry.withColumn("__ctx", F.lit(True))
    both = new.unionByName(ctx, allowMissingColumns=True)
    bucket = F.col("__seq") * F.lit(_SEQ_SCALE) + time_bucket("ts", bucket_seconds)
    win = last_n_window(both, "z", "width", W, order=("__seq", "ts", "event_id"),
                        bucket=bucket)
    out = win.filter(~F.col("__ctx")).drop("__ctx", "__seq")
    # next carry: the last W-1 values per version among old carry + this batch
    # (row_number filter -> map-side group limit before the exchange)
    keep = both.filter(F.col("data_model").isNotNull()).select(*CARRY.fieldNames())
    w = Window.partitionBy("data_model", "version").orderBy(
        F.col("__seq").desc(), F.col("ts").desc(), F.col("event_id").desc())
    nxt = (keep.withColumn("__r", F.row_number().over(w))
           .filter(F.col("__r") <= max(W - 1, 1)).drop("__r"))
    return out, nxt


def response_rows(rows: DataFrame) -> DataFrame:
    """Answered requests as answer rows, and one start row per measurement."""
    def shaped(df, is_start):
        df = df.withColumns({"guid": request_guid("event_id"), "is_start": F.lit(is_start)})
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in RESPONSES.fields])
    starts = rows.select(KEY, *START_COLS).distinct().withColumn("answered", F.lit(False))
    return shaped(rows.filter("answered"), False).union(shaped(starts, True))


class ServeBatch:
    """The ``foreachBatch`` handler of ``serve_stream``."""

    def __init__(self, tables: Tables, latency: Callable[[], Column] | str | None = None,
                 quorum="all", scorer: str = "linear", bucket_seconds: int = DEFAULT_WINDOW_BUCKET_SECONDS,
                 fmt: str = "json", decider=None, scorer_map=None):
        self.tables, self.latency, self.quorum, self.decider = tables, latency, quorum, decider
        self.scorer, self.scorer_map, self.bucket_seconds, self.fmt = scorer, scorer_map, bucket_seconds, fmt

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        t = self.tables
        batch = batch.persist()
        held = [batch]
        try:
            meas, bad = measurements_from_log(batch, self.fmt)
            write_batch(bad.withColumn("value", F.col("value").cast("string")),
                        t.quarantine, batch_id)
            reg = prepare_registry(registry_table(spark, t))
            payloads = reg.select("data_model", "version", "payload") if self.scorer == "python" else None
            reg = reg.drop("payload")
            W = max_width(reg)
            types = answering_types(self.scorer, self.scorer_map)
            # routed once: the window, the next carry and the answers all read these rows
            rows = routed_rows(meas, reg, config_table(spark, t), model_types=types).persist()
            held.append(rows)
            carry = read_batch(spark, t.carry, CARRY, batch_id - 1)
            rows, nxt = _window_with_carry(rows, carry, batch_id, W, self.bucket_seconds)
            lat = self.latency() if callable(self.latency) else self.latency
            rows = score_rows(rows, self.scorer, self.scorer_map, lat, payloads).persist()
            held.append(rows)
            results = collect_vote(rows, self.quorum, decider=self.decider).persist()
            held.append(results)
            # a request's start lies beside its answers, so that they do not wait for it in the collector's state
            append_once(response_rows(rows).repartition("guid"), t.responses, batch_id)
            write_batch(results, t.results, batch_id)
            write_partials(rows, results, t, batch_id)
            write_batch(nxt, t.carry, batch_id)
        finally:
            for df in held:
                df.unpersist()


def serve_stream(spark: SparkSession, logs: LogConfig, tables: Tables, checkpoint: str,
                 latency: Callable[[], Column] | str | None = None, quorum="all",
                 trigger: dict | None = None, max_files_per_trigger: int | None = None,
                 scorer: str = "linear", fmt: str = "json", decider=None, scorer_map=None,
                 start: str | None = None):
    """Start the serving query (E2); returns its handle.  ``decider``: see
    ``quorum.operators.deciders``; ``start``: ``"latest"`` or ``"earliest"`` measurements,
    by default all of a folder log and the new ones of a topic."""
    src = read_log(spark, logs, DATA_TOPIC, start=start or ("earliest" if logs.root else "latest"),
                   max_files_per_trigger=max_files_per_trigger, position=f"{checkpoint}/serve-start")
    handler = ServeBatch(tables, latency, quorum, scorer, fmt=fmt, decider=decider, scorer_map=scorer_map)
    return (src.writeStream.foreachBatch(handler)
            .option("checkpointLocation", f"{checkpoint}/serve")
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


#: bytes of files in a micro-batch of the collector, for each core
CORE_BYTES = 32 << 20


def responses_stream(spark: SparkSession, tables: Tables, batch_bytes: int | None = None) -> DataFrame:
    """The ``responses`` table as a stream (input of the stateful collector), at most about
    ``batch_bytes`` of its files in a micro-batch (``CORE_BYTES`` for each core: a micro-batch
    has costs of its own, a commit for each partition of the state); the folder is created
    first, so the collector may start before serving."""
    ensure_dir(spark, tables.responses)
    batch_bytes = batch_bytes or CORE_BYTES * spark.sparkContext.defaultParallelism
    return spark.readStream.schema(RESPONSES).option("maxBytesPerTrigger", str(batch_bytes)).parquet(tables.responses)
