"""Live state, read as ordinary DataFrames (T8, E3) - no state server.

* Statistics are kept as they happen: every micro-batch adds its *partials* (usage,
  sum, least, greatest, since) per model version and per data type, at most as many
  rows as there are versions and types, under its batch id (a replayed
  batch replaces its own).  ``compact`` merges the partials of finished batches into one
  table per generation.  A report merges partials and never reads responses or results.
* ``stream_state_report`` - the three views of the reference's state client
  (known models per data type, current stats per model, stats per data type);
* ``open_requests`` - requests in the stateful collector, read from its
  checkpoint with the ``statestore`` data source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.operators.route import known_models, prepare_registry
from quorum.operators.stats import (COLLECTOR_KEYS, MODEL_KEYS, collector_partials, merge_partials, merged_collector_stats,
                                    merged_model_stats, latest_versions, model_partials)
from quorum.session import file_system, ship_package
from quorum.streaming import collector
from quorum.streaming.registry_job import Tables, config_table, registry_table
from quorum.streaming.tables import ensure_dir, write_batch

_STATS = [T.StructField("usage", T.LongType()), T.StructField("duration_ms", T.LongType()),
          T.StructField("min_ms", T.LongType()), T.StructField("max_ms", T.LongType())]
MODEL_PARTIALS = T.StructType([
    T.StructField("data_model", T.StringType()), T.StructField("version", T.TimestampNTZType()),
    T.StructField("description", T.StringType()), T.StructField("model_type", T.IntegerType()), *_STATS])
COLLECTOR_PARTIALS = T.StructType([
    T.StructField("data_type", T.StringType()), *_STATS, T.StructField("since", T.TimestampNTZType())])

COMPACT_EVERY = 50


def write_partials(rows: DataFrame, results: DataFrame, tables: Tables, batch_id: int,
                   compact_every: int = COMPACT_EVERY) -> None:
    """Add a micro-batch's partials; now and then merge those of the batches before it."""
    spark = rows.sparkSession
    write_batch(model_partials(rows).select(*MODEL_PARTIALS.fieldNames()).coalesce(1), tables.model_partials, batch_id)
    write_batch(collector_partials(results).select(*COLLECTOR_PARTIALS.fieldNames()).coalesce(1),
                tables.collector_partials, batch_id)
    if batch_id and batch_id % compact_every == 0:
        # batches before this one are committed: nothing writes them again
        compact(spark, tables.model_partials, MODEL_PARTIALS, MODEL_KEYS, batch_id - 1)
        compact(spark, tables.collector_partials, COLLECTOR_PARTIALS, COLLECTOR_KEYS, batch_id - 1)


def _generations(spark: SparkSession, table: str) -> list[int]:
    """Batches up to which merged partials are complete."""
    fs, p = file_system(spark, f"{table}_merged")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    done = [int(n.split("=")[1]) for n in names if n.startswith("upto=")]
    return sorted(n for n in done if fs.exists(file_system(spark, f"{table}_merged/upto={n}/_SUCCESS")[1]))


def read_partials(spark: SparkSession, table: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The newest merged partials and those of the batches after it."""
    ensure_dir(spark, table)
    full = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).option("basePath", table).parquet(table)
    if upto is not None:
        rows = rows.where(F.col("batch_id") <= upto)
    merged = [n for n in _generations(spark, table) if upto is None or n <= upto]
    if not merged:
        return rows.drop("batch_id")
    older = spark.read.schema(schema).parquet(f"{table}_merged/upto={merged[-1]}")
    return rows.where(F.col("batch_id") > merged[-1]).drop("batch_id").unionByName(older)


def compact(spark: SparkSession, table: str, schema: T.StructType, keys: list[str], upto: int) -> None:
    """Merge the partials of all batches up to ``upto`` into one generation (written once)."""
    if upto not in _generations(spark, table):
        merged = merge_partials(read_partials(spark, table, schema, upto), keys)
        merged.select(*schema.fieldNames()).coalesce(1).write.mode("overwrite").parquet(f"{table}_merged/upto={upto}")


def stream_state_report(spark: SparkSession, tables: Tables) -> dict[str, DataFrame]:
    versions = merged_model_stats(read_partials(spark, tables.model_partials, MODEL_PARTIALS))
    collected = read_partials(spark, tables.collector_partials, COLLECTOR_PARTIALS)
    return {
        "known_models": known_models(prepare_registry(registry_table(spark, tables))),
        "model_report": latest_versions(versions),
        "model_versions": versions,
        "collector_report": merged_collector_stats(collected, config_table(spark, tables)),
    }


def open_requests(spark: SparkSession, collector_checkpoint: str) -> DataFrame:
    """Start state of every request the collector still holds (decided ones
    stay until their grace is over)."""
    ship_package(spark)
    requests = F.udf(collector.held_requests, T.ArrayType(collector._REQUEST), useArrow=False)
    held = (spark.read.format("statestore").option("path", collector_checkpoint).option("stateVarName", "requests").load()
            .select(F.explode(requests("value.requests")).alias("value"), "partition_id"))
    return held.where("value.opened").select(F.struct("value.guid").alias("key"), "value", "partition_id")
