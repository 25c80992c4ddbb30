"""Log sources and sinks.

A *log* is a stream of records with the columns of a Kafka source row
(``key, value, topic, partition, offset, timestamp``).  Two transports:

* ``LogConfig(bootstrap=...)`` - Kafka topics (``format("kafka")``; needs the
  spark-sql-kafka package on the cluster);
* ``LogConfig(root=...)`` - a folder per topic of Parquet files with the same
  columns (used offline and in tests; append-only, file-source streaming).

Measurements are read from the latest offset, models and config from the
earliest (a restart replays every model), as in the reference job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum import schemas
from quorum.session import file_system

# Topic names and start positions of the three inputs
DATA_TOPIC = "mdata"
MODELS_TOPIC = "models"
CONFIG_TOPIC = "speculative"
START = {DATA_TOPIC: "latest", MODELS_TOPIC: "earliest", CONFIG_TOPIC: "earliest"}


@dataclass
class LogConfig:
    """Where the topics live."""
    root: str | None = None              # folder-per-topic Parquet logs
    bootstrap: str | None = None         # Kafka brokers
    group: str = "quorum"
    producer: dict = field(default_factory=lambda: {
        "kafka.acks": "all", "kafka.retries": "1",
        "kafka.batch.size": "1024", "kafka.linger.ms": "1"})

    def path(self, topic: str) -> str:
        return f"{self.root.rstrip('/')}/{topic}"


def read_log(spark: SparkSession, cfg: LogConfig, topic: str, start: str | None = None,
             max_files_per_trigger: int | None = None, position: str | None = None) -> DataFrame:
    """Streaming read of one topic (S1-S4); ``value`` stays binary.

    ``start="latest"`` on a folder log skips the files that are there when the query
    first starts: their newest modification time is written to ``position`` (a folder
    beside the query's checkpoint) once, and found there by later starts."""
    start = start or START.get(topic, "latest")
    if cfg.bootstrap:
        return (spark.readStream.format("kafka")
                .option("kafka.bootstrap.servers", cfg.bootstrap)
                .option("subscribe", topic).option("startingOffsets", start)
                .option("kafka.group.id", cfg.group).load()
                .select(*schemas.LOG.fieldNames()))
    r = spark.readStream.schema(schemas.LOG)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rows = r.parquet(cfg.path(topic))
    if start == "latest":
        if position is None:
            raise ValueError("a folder log read from its latest position needs a place to keep it")
        since = _first_start(spark, cfg.path(topic), position)
        rows = rows.where(F.unix_micros(F.col("_metadata.file_modification_time")) > F.lit(since))
    return rows


def _first_start(spark: SparkSession, path: str, position: str) -> int:
    """Microseconds of the newest file at the first start; -1 for an empty folder."""
    fs, at = file_system(spark, position)
    if not fs.exists(at):
        logs, folder = file_system(spark, path)
        times = [f.getModificationTime() for f in logs.listStatus(folder)] if logs.exists(folder) else []
        spark.createDataFrame([(max(times, default=-1) * 1000,)], "since long").coalesce(1).write.parquet(position)
    return spark.read.schema("since long").parquet(position).first().since


def read_log_batch(spark: SparkSession, cfg: LogConfig, topic: str) -> DataFrame:
    """The whole topic as a batch DataFrame (replay)."""
    if cfg.bootstrap:
        return (spark.read.format("kafka").option("kafka.bootstrap.servers", cfg.bootstrap)
                .option("subscribe", topic).option("startingOffsets", "earliest").load()
                .select(*schemas.LOG.fieldNames()))
    return spark.read.schema(schemas.LOG).parquet(cfg.path(topic))


def as_log(df: DataFrame, topic: str, value: str = "value", key: str | None = None,
           offset: str | None = None, timestamp: str | None = None) -> DataFrame:
    """Shape any DataFrame with a payload column into log rows."""
    return df.select(
        (F.col(key).cast("binary") if key else F.lit(None).cast("binary")).alias("key"),
        F.col(value).cast("binary").alias("value"),
        F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
        (F.col(offset).cast("long") if offset else F.monotonically_increasing_id()).alias("offset"),
        (F.col(timestamp).cast("timestamp") if timestamp else F.current_timestamp()).alias("timestamp"),
    )


def write_log(df: DataFrame, cfg: LogConfig, topic: str) -> None:
    """Publish a batch of log rows (S6): Kafka with acks=all etc., or Parquet append."""
    if cfg.bootstrap:
        w = df.select("key", "value").write.format("kafka") \
            .option("kafka.bootstrap.servers", cfg.bootstrap).option("topic", topic)
        for k, v in cfg.producer.items():
            w = w.option(k, v)
        w.save()
        return
    df.select(*schemas.LOG.fieldNames()).write.mode("append").parquet(cfg.path(topic))


def tail_log(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
             trigger: dict | None = None):
    """Hand every micro-batch of a topic to ``handler(df, batch_id)``."""
    w = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "5 seconds"}))
    return w.start()


def write_results(results: DataFrame, path: str | None = None, checkpoint: str | None = None,
                  trigger: dict | None = None):
    """Serving output (S9): console lines, or a Parquet sink when ``path`` is given."""
    from quorum.functions.columns import serving_line
    if results.isStreaming:
        if path:
            w = results.writeStream.format("parquet").option("path", path)
        else:
            w = results.select(serving_line().alias("line")).filter("line IS NOT NULL") \
                .writeStream.format("console").option("truncate", "false")
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    if path:
        results.write.mode("append").parquet(path)
    else:
        results.select(serving_line().alias("line")).filter("line IS NOT NULL").show(truncate=False)
