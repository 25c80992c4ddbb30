"""Model and config streams -> registry and config tables.

Both topics are read from the earliest offset; every decoded version is
appended (re-registration is a new version), bad records go to quarantine.
The serving stream re-reads these tables in each of its micro-batches, so a
new model or timeout is seen from the next micro-batch on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum import schemas
from quorum.functions.columns import source_id
from quorum.functions.decode import decode_config, decode_models, split_bad
from quorum.operators.score import load_failures, with_load_probe
from quorum.sources.logs import CONFIG_TOPIC, MODELS_TOPIC, LogConfig, read_log
from quorum.streaming.tables import read_table, write_batch


@dataclass
class Tables:
    """Folder tables shared by the streaming queries."""
    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name}"


def registry_table(spark: SparkSession, tables: Tables) -> DataFrame:
    return read_table(spark, tables.registry, schemas.REGISTRY_LOG)


def config_table(spark: SparkSession, tables: Tables) -> DataFrame:
    return read_table(spark, tables.config, schemas.CONFIG)


def _models_batch(tables: Tables, fmt: str = "json", scorer_map=None):
    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_bad(decode_models(batch, fmt))
        good = good.withColumn("log_pos", source_id())
        if scorer_map is not None:
            # tried once, when registered; written before it is read by anything else
            good = with_load_probe(good, scorer_map)
            good.persist()
            write_batch(load_failures(good), tables.load_quarantine, batch_id)
        else:
            good = good.withColumn("loads", F.lit(None).cast("boolean"))
        write_batch(good.select(*schemas.REGISTRY_LOG.fieldNames()), tables.registry, batch_id)
        good.unpersist()
        write_batch(bad.withColumn("value", F.col("value").cast("string")),
                    tables.models_quarantine, batch_id)
    return handle


def _config_batch(tables: Tables, fmt: str = "json"):
    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_bad(decode_config(batch, fmt))
        write_batch(good.select(*schemas.CONFIG.fieldNames()), tables.config, batch_id)
        write_batch(bad.withColumn("value", F.col("value").cast("string")),
                    tables.config_quarantine, batch_id)
    return handle


def registry_job(spark: SparkSession, logs: LogConfig, tables: Tables, checkpoint: str,
                 trigger: dict | None = None, fmt: str = "json", scorer_map=None):
    """Start the two registry queries; returns their handles.  ``fmt`` as in
    ``quorum.functions.decode`` (proto3 descriptors carry no ``thr``: 0).  With
    ``scorer_map`` the payload of every new version is tried by its scorer; one that
    does not load never becomes active and is listed in ``load_quarantine``."""
    trig = trigger or {"processingTime": "5 seconds"}
    qm = (read_log(spark, logs, MODELS_TOPIC, start="earliest").writeStream
          .foreachBatch(_models_batch(tables, fmt, scorer_map))
          .option("checkpointLocation", f"{checkpoint}/models").trigger(**trig).start())
    qc = (read_log(spark, logs, CONFIG_TOPIC, start="earliest").writeStream
          .foreachBatch(_config_batch(tables, fmt))
          .option("checkpointLocation", f"{checkpoint}/config").trigger(**trig).start())
    return [qm, qc]


def model_payloads(registry: DataFrame) -> DataFrame:
    """Registry rows -> JSON model descriptors (the publisher side, S6/S7)."""
    data = F.base64("payload") if "payload" in registry.columns else F.lit("")
    return registry.select(F.to_json(F.struct(
        F.col("name"), F.col("description"), F.col("data_type").alias("dataType"),
        F.col("model_type").alias("modeltype"), data.alias("data"),
        F.struct(F.col("width"), F.col("mean"), F.col("std")).alias("preprocessing"),
        F.col("thr"), F.date_format("registered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("registeredAt"),
        F.col("ord"))).alias("value"), F.col("registered_at"))


def config_payloads(config: DataFrame) -> DataFrame:
    return config.select(F.to_json(F.struct(
        F.col("data_type").alias("datatype"), F.col("tmout_ms").alias("tmout"),
        F.date_format("effective_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("effectiveAt"))).alias("value"),
        F.col("effective_at"))
