"""Batch sources: the given Parquet tables and the measurement view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def measurements_from_events(events: DataFrame, threshold: int = 80, keep=()) -> DataFrame:
    """``events`` -> ``measurements(event_id, ts, data_type, utilization, label)``.

    The label (the reference's ``class`` field) is 1 iff ``props.k >= threshold``.
    ``get_json_object`` stays JVM-side and only touches ``props``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", "ts",
        F.col("event_type").alias("data_type"),
        F.col("value").alias("utilization"),
        F.when(k >= threshold, 1).otherwise(0).alias("label"),
        *keep,
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements_from_events(read_table(spark, sf_dir, "events"))
