"""Routing: measurements meet the models registered for their data type.

* ``known_model_epochs`` (A1, A7): per data type, the ordered list of known
  models changes only when a new model name is first registered, so the
  list is a handful of intervals ("epochs") per type.
* ``route_requests`` (J1, J2, J3, J6): one pass over the measurements with two
  temporal joins against registry-sized tables: the epoch gives ``n_models``
  and the known list, the version intervals give one row per
  (measurement, model) with the version active at the measurement time.
  Measurements without any model keep one row with NULL model.  No shuffle of
  the measurements when the registry is proven small (broadcast); a
  sharded scan otherwise.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions.columns import data_model_key, request_guid
from quorum.operators.asof import (DEFAULT_MAX_BROADCAST_ROWS, asof_join, fits_broadcast,
                                   interval_join, micros, time_grid, validity_intervals)

DEFAULT_TIMEOUT_MS = 150
SUPPORTED_MODEL_TYPES = (0,)

# tells versions of one model and time apart when the log order is unknown
VERSION_ORDER = ["description", "model_type", "width", "mean", "std", "thr", "ord"]

Routed = namedtuple("Routed", "starts requests no_model")


def prepare_registry(registry: DataFrame) -> DataFrame:
    """Add ``data_model`` (P5) and ``version`` (= registration time), one row per
    (model, registration time): of messages with the same time the last in
    the log stays (``log_pos``, if the registry has it, then the row's own
    values, so the choice never depends on the plan)."""
    if "data_model" in registry.columns:
        return registry
    reg = registry.withColumns({"data_model": data_model_key("data_type", "name"),
                                "version": F.col("registered_at")})
    keys = ["data_type", "data_model", "registered_at"]
    rest = [c for c in reg.columns if c not in keys]
    order = [c for c in ["log_pos", *VERSION_ORDER] if c in rest]
    return (reg.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
            .select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c)
                      for c in reg.columns if c != "log_pos"]))


def activated(registry: DataFrame, model_types=SUPPORTED_MODEL_TYPES) -> DataFrame:
    """Versions that become active (J3, P7): one whose type has no scorer, or whose
    payload does not load (``score.with_load_probe``), never displaces a version that serves.  Before any servable version it stays, as
    the known model that does not answer."""
    w = (Window.partitionBy("data_type", "data_model").orderBy("registered_at")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reg = prepare_registry(registry)
    return (reg.withColumn("__serves", serves(reg, model_types))
            .withColumn("__served", F.max("__serves").over(w))
            .filter(F.col("__serves") | ~F.col("__served")).drop("__serves", "__served"))


def serves(rows: DataFrame, model_types=SUPPORTED_MODEL_TYPES):
    """Whether a version can answer: its type has a scorer, and it loads where that was tried."""
    able = F.col("model_type").isin(list(model_types))
    return F.coalesce(able & F.coalesce("loads", F.lit(True)) if "loads" in rows.columns else able, F.lit(False))


def servable(registry: DataFrame, model_types=SUPPORTED_MODEL_TYPES) -> DataFrame:
    """Versions that have a scorer and load."""
    return registry.filter(serves(registry, model_types))


def first_registrations(registry: DataFrame) -> DataFrame:
    reg = prepare_registry(registry)
    return reg.groupBy("data_type", "data_model").agg(F.min("registered_at").alias("first_at"))


def known_model_epochs(registry: DataFrame) -> DataFrame:
    """``(data_type, epoch_at, n_models, models)``: from ``epoch_at`` on, the type
    knows ``models`` (ordered by first registration, then name).

    A type's models are listed once; an epoch's list is the start of that list."""
    all_models = (first_registrations(registry).groupBy("data_type")
                  .agg(F.array_sort(F.collect_list(F.struct("first_at", "data_model"))).alias("__all")))
    return (model_count_epochs(registry).join(all_models, "data_type")
            .select("data_type", "epoch_at", "n_models",
                    F.slice(F.col("__all.data_model"), F.lit(1), F.col("n_models")).alias("models")))


def known_models(registry: DataFrame) -> DataFrame:
    """Current known-model list per data type (A1 / T8 ``currentModels``)."""
    return (first_registrations(registry).groupBy("data_type")
            .agg(F.array_sort(F.collect_list(F.struct("first_at", "data_model"))).alias("__all"))
            .select("data_type", F.col("__all.data_model").alias("models"), F.size("__all").alias("n_models")))


def model_count_epochs(registry: DataFrame) -> DataFrame:
    """``(data_type, epoch_at, n_models)``: the number of known models from
    ``epoch_at`` on - fixed-size rows, at most one per registry row, so that a
    registry that fits a broadcast bounds them too."""
    per = first_registrations(registry).groupBy("data_type", F.col("first_at").alias("epoch_at")) \
        .agg(F.count(F.lit(1)).alias("__new"))
    w = (Window.partitionBy("data_type").orderBy("epoch_at")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select("data_type", "epoch_at", F.sum("__new").over(w).cast("int").alias("n_models"))


def version_intervals(registry: DataFrame, model_types=SUPPORTED_MODEL_TYPES) -> DataFrame:
    """Each activated version of a model is active from its registration until
    the next activated version of the same model (W2)."""
    return validity_intervals(activated(registry, model_types), ["data_type", "data_model"],
                              "registered_at", "valid_from", "valid_to")


def with_guid(measurements: DataFrame, cols=("event_id",)) -> DataFrame:
    """Deterministic request id per measurement."""
    return measurements.withColumn("guid", request_guid(*cols))


def with_epoch(measurements: DataFrame, registry: DataFrame, strategy: str = "auto",
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Attach ``n_models`` (0 for none) and ``models`` at each measurement."""
    ep = known_model_epochs(registry).select("data_type", "epoch_at", "n_models", "models")
    out = asof_join(measurements, ep, ["data_type"], "ts", "epoch_at", how="left",
                    strategy=strategy, max_broadcast_rows=max_broadcast_rows)
    return (out.withColumn("n_models", F.coalesce("n_models", F.lit(0)))
               .drop("epoch_at"))


def with_model_count(measurements: DataFrame, registry: DataFrame, grid=None) -> DataFrame:
    """Attach ``n_models`` (0 for none) by a broadcast of the count epochs."""
    out = asof_join(measurements, model_count_epochs(registry), ["data_type"], "ts", "epoch_at",
                    how="left", strategy="broadcast", grid=grid)
    return out.withColumn("n_models", F.coalesce("n_models", F.lit(0))).drop("epoch_at")


def version_counts(registry: DataFrame) -> DataFrame:
    """Per type: versions ``n``, models ``at_once``, first and last registration (microseconds)."""
    at = micros("registered_at")
    return (prepare_registry(registry).groupBy("data_type", "data_model").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
            .groupBy("data_type").agg(F.sum("n").alias("n"), F.count("*").alias("at_once"), F.min("a").alias("a"), F.max("b").alias("b")))


def registry_grid(registry: DataFrame):
    """Time cells for a registry with a type of many versions, else ``None``."""
    r = version_counts(registry).agg(F.max_by(F.struct("n", "at_once"), "n").alias("m"), F.min("a").alias("a"), F.max("b").alias("b")).first()
    return time_grid(r.a, r.b, r.m.n, r.m.at_once) if r.m else None


def with_timeout(df: DataFrame, config: DataFrame | None, ts: str = "ts",
                 default_ms: int = DEFAULT_TIMEOUT_MS, strategy: str = "auto",
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, grid=None) -> DataFrame:
    """Effective answer deadline at ``ts`` (J4): latest config of the data type;
    none or 0 -> ``default_ms``."""
    if config is None:
        return df.withColumn("timeout_ms", F.lit(default_ms).cast("long"))
    cfg = config.select("data_type", F.col("tmout_ms").alias("__tmout"),
                        F.col("effective_at").alias("__eff"))
    # of two configs with one time the longer deadline holds
    out = asof_join(df, cfg, ["data_type"], ts, "__eff", how="left", strategy=strategy,
                    max_broadcast_rows=max_broadcast_rows, tie=["__tmout"], grid=grid)
    return (out.withColumn("timeout_ms", F.coalesce(F.nullif(F.col("__tmout"), F.lit(0)),
                                                    F.lit(default_ms)).cast("long"))
               .drop("__tmout", "__eff"))


REQUEST_MODEL_COLS = ["data_model", "version", "name", "description", "model_type",
                      "width", "mean", "std", "thr"]


def _version_cols(registry: DataFrame) -> list[str]:
    base = set(REQUEST_MODEL_COLS) | {"data_type", "registered_at", "log_pos", "payload", "load_error"}
    extra = [c for c in registry.columns if c not in base]
    return REQUEST_MODEL_COLS + extra


def route_requests(measurements: DataFrame, registry: DataFrame, strategy: str = "auto",
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                   with_models_list: bool = False,
                   model_types=SUPPORTED_MODEL_TYPES, grid=None) -> DataFrame:
    """One row per (measurement, known model) with the active version (J1-J3),
    or one row with NULL ``data_model`` for a measurement without models (J6).

    Every row carries ``n_models``; measurement columns are kept.  ``grid``: time
    cells for a type with many versions (:func:`registry_grid`, found here with
    ``strategy="auto"``)."""
    reg = prepare_registry(registry)
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(reg, max_broadcast_rows) else "scan"
        grid = registry_grid(reg) if strategy == "broadcast" else None
    cols = _version_cols(reg)
    if strategy == "broadcast":
        if with_models_list:     # lists of names can outgrow the registry: sized on their own
            ep = known_model_epochs(reg).select("data_type", "epoch_at", "n_models", "models")
            out = asof_join(measurements, ep, ["data_type"], "ts", "epoch_at", how="left",
                            max_broadcast_rows=max_broadcast_rows)
        else:
            out = with_model_count(measurements, reg, grid)
        iv = version_intervals(reg, model_types).select("data_type", "valid_from", "valid_to", *cols)
        out = interval_join(out, iv, ["data_type"], "ts", how="left", grid=grid)
        out = out.drop("valid_from", "valid_to", "epoch_at")
    else:
        out = with_epoch(measurements, reg, strategy="scan")
        out = out.withColumn("data_model", F.explode_outer("models"))
        vers = activated(reg, model_types).select(
            "data_type", "data_model", F.col("registered_at").alias("__at"),
            *[c for c in cols if c != "data_model"])
        out = asof_join(out, vers, ["data_type", "data_model"], "ts", "__at", how="left",
                        strategy="scan").drop("__at")
    out = out.withColumn("n_models", F.coalesce("n_models", F.lit(0)))
    if not with_models_list and strategy != "broadcast":
        out = out.drop("models")
    return out


def route(measurements: DataFrame, registry: DataFrame, strategy: str = "auto") -> Routed:
    """The router's three outputs (P12): ``starts`` (one per measurement with
    models, ``n_models`` expected answers), ``requests`` (fan-out, one per
    model, active version attached) and ``no_model`` pass-through rows.
    The three are projections of two scans of the same input; ``serve`` uses
    the single stream of ``route_requests`` instead."""
    meas = measurements if "guid" in measurements.columns else with_guid(measurements)
    ep = with_epoch(meas, registry, strategy=strategy)
    starts = ep.filter(F.col("n_models") > 0)
    no_model_rows = ep.filter(F.col("n_models") == 0).drop("n_models", "models")
    requests = (route_requests(meas, registry, strategy=strategy)
                .filter(F.col("data_model").isNotNull()))
    return Routed(starts, requests, no_model_rows)


def no_model(measurements: DataFrame, registry: DataFrame, strategy: str = "auto") -> DataFrame:
    """Measurements for which no model was registered yet."""
    return (with_epoch(measurements, registry, strategy=strategy)
            .filter(F.col("n_models") == 0).drop("n_models", "models"))
