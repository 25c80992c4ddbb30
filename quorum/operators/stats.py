"""Usage statistics (A2, A3, A6) and the state reports built on them.

Statistics are merges of *partials* (usage, sum, least, greatest, since): the batch
functions merge the partials of all rows, the streaming reports those of the
micro-batches, so both give the same figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.functions.columns import VOTER_MODEL
from quorum.operators.route import DEFAULT_TIMEOUT_MS, known_models, prepare_registry

MODEL_KEYS = ["data_model", "version"]
COLLECTOR_KEYS = ["data_type"]


def _partials(df: DataFrame, keys, dur: str, *extra) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("usage"),
        F.sum(dur).cast("long").alias("duration_ms"),
        F.min(dur).cast("long").alias("min_ms"),
        F.max(dur).cast("long").alias("max_ms"),
        *extra,
    )


def merge_partials(partials: DataFrame, keys) -> DataFrame:
    """Partials of the union: sums of usage and duration, extremes, the first ``since``."""
    extra = [F.min(c).alias(c) for c in ("since", "description", "model_type") if c in partials.columns]
    return partials.groupBy(*keys).agg(
        F.sum("usage").alias("usage"), F.sum("duration_ms").cast("long").alias("duration_ms"),
        F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), *extra)


def _with_average(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_ms", F.try_divide(F.col("duration_ms").cast("double"), F.col("usage")))


def model_partials(rows: DataFrame) -> DataFrame:
    """Per model version: every answer counts - warm-up answers and late ones included."""
    return _partials(rows.filter("answered"), MODEL_KEYS, "latency_ms",
                     F.min("description").alias("description"), F.min("model_type").alias("model_type"))


def collector_partials(results: DataFrame) -> DataFrame:
    """Per data type over decided, processed results."""
    return _partials(results.filter("processed"), COLLECTOR_KEYS, "duration_ms", F.min("ts").alias("since"))


def merged_model_stats(partials: DataFrame) -> DataFrame:
    return _with_average(merge_partials(partials, MODEL_KEYS)).withColumn("since", F.col("version"))


def model_stats(rows: DataFrame) -> DataFrame:
    """Per model version (A2); a new version starts again from zero.  ``since`` is the
    version's registration time; ``avg_ms = duration / usage`` (A6)."""
    return _with_average(model_partials(rows)).withColumn("since", F.col("version"))


def latest_versions(stats: DataFrame) -> DataFrame:
    """Stats of the latest *activated* version per model (a registered but
    never used version does not replace the reported one)."""
    return (stats.groupBy("data_model")
            .agg(F.max_by(F.struct(*[c for c in stats.columns if c != "data_model"]), "version").alias("s"))
            .select("data_model", "s.*"))


def current_model_stats(rows: DataFrame) -> DataFrame:
    return latest_versions(model_stats(rows))


def merged_collector_stats(partials: DataFrame, config: DataFrame | None = None,
                           default_ms: int = DEFAULT_TIMEOUT_MS) -> DataFrame:
    return _with_timeout(_with_average(merge_partials(partials, COLLECTOR_KEYS)), config, default_ms)


def collector_stats(results: DataFrame, config: DataFrame | None = None,
                    default_ms: int = DEFAULT_TIMEOUT_MS) -> DataFrame:
    """Per data type over decided, processed results (A3, A6).  ``tmout_ms``
    is the currently effective timeout (latest config, of two with one time the longer;
    0 or none -> default)."""
    return _with_timeout(_with_average(collector_partials(results)), config, default_ms)


def _with_timeout(st: DataFrame, config: DataFrame | None, default_ms: int) -> DataFrame:
    st = st.withColumn("decider", F.lit(VOTER_MODEL))
    if config is None:
        return st.withColumn("tmout_ms", F.lit(default_ms).cast("long"))
    cur = (config.groupBy("data_type")
           .agg(F.max_by("tmout_ms", F.struct("effective_at", "tmout_ms")).alias("__t")))
    return (st.join(cur, "data_type", "left")
              .withColumn("tmout_ms", F.coalesce(F.nullif("__t", F.lit(0)),
                                                 F.lit(default_ms)).cast("long"))
              .drop("__t"))


def state_report(rows: DataFrame, results: DataFrame, registry: DataFrame,
                 config: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three views of the live-state client (E3): known models per data
    type, current stats per model, stats per data type."""
    return {
        "known_models": known_models(prepare_registry(registry)),
        "model_report": current_model_stats(rows),
        "collector_report": collector_stats(results, config),
    }
