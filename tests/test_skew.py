"""A hot model (all rows on one model version) is split over many tasks."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, T, registry_df
from quorum.operators.window import last_n_window
from quorum.plans.serve import scored_requests
from quorum.sources.tables import measurements


def test_hot_model_window_spreads_over_partitions(spark, monkeypatch):
    from quorum.operators import window
    monkeypatch.setattr(window, "CONTEXT_SHARE", 5)
    monkeypatch.setattr(window, "SLOT_ROWS", 8)
    # every event is the same data type with one model: one hot key
    m = measurements(spark, SF_SMALL).withColumn("data_type", F.lit("cpu"))
    reg = registry_df(spark, [("cpu", "m", "m", 0, T(1), 4, 50.0, 50.0, 0.0, 1)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = scored_requests(m, reg, bucket_rows=50)
        # keep the window referenced, else the optimizer prunes it away
        used = F.coalesce(F.size("window"), F.lit(0)) >= 0
        parts = rows.filter(used).select(F.spark_partition_id().alias("p")).distinct().count()
        plain = last_n_window(rows.select("event_id", "ts", "data_model", "version", "z"),
                              "z", 4, 4, bucket_seconds=None)
        plain_parts = plain.filter(used).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plain_parts == 1          # the naive plan: one task for the hot model
    assert parts >= 3                # bucketed: the hot model is spread out
    # and both give the same windows
    a = rows.select("event_id", "window")
    b = plain.select("event_id", F.col("window"))
    assert a.exceptAll(b).count() == 0


def test_asof_scan_splits_hot_key(spark):
    from quorum.operators.asof import asof_join
    m = measurements(spark, SF_SMALL).withColumn("data_type", F.lit("cpu"))
    right = spark.createDataFrame([("cpu", T(1), 1), ("cpu", T(10), 2), ("cpu", T(20), 3)],
                                  "data_type string, at timestamp_ntz, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = asof_join(m, right, ["data_type"], "ts", "at", strategy="scan", bucket_seconds=86400)
        parts = out.filter(F.col("v").isNotNull() | F.col("v").isNull()).select(
            F.spark_partition_id(), "v").select(F.spark_partition_id().alias("p")).distinct().count()
        exp = asof_join(m, right, ["data_type"], "ts", "at", strategy="broadcast")
        same = out.select("event_id", "v").exceptAll(exp.select("event_id", "v")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts >= 3 and same
