"""The whole serving graph as one batch plan.

    measurements --deadline, number of models (as-of, broadcast)
      --last W values per (data type, bucket of measurements)   [the exchange]
      --route: versions active at the measurement (broadcast)
      --window of each version (a cut of the row's values) --score --answer time
      --collect + vote, in the exchange's partitioning          --> results

One exchange carries the measurements, before they fan out to models.  The window is
computed once per measurement and not per request: a version's window is a cut of the
last values of its data type.  Rows of one measurement stay in one partition, so the
vote (and ranks, and deciders) need no exchange of their own.  Everything joined to
the measurements is registry- or config-sized and broadcast after a row count
proves it small; where it is not, the sharded forms take over.

With ``responses`` the answers come from outside: requests and answers are
partitioned by the request's guid and collected there.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.columns import request_guid, standardize
from quorum.operators.asof import (DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS,
                                   interval_join, micros, row_bytes, time_grid)
from quorum.operators.collect import KEY, PLACE, collect_vote, with_answers
from quorum.operators.responses import collect_responses
from quorum.operators.route import (DEFAULT_TIMEOUT_MS, SUPPORTED_MODEL_TYPES, _version_cols,
                                    prepare_registry, route_requests, version_intervals,
                                    with_epoch, with_model_count, with_timeout)
from quorum.operators.score import score_linear, score_with, scorers, with_load_probe
from quorum.operators.window import (BUCKET_ROWS, LAST, cut_window, density_slots, last_n_window, last_values,
                                     with_last_values)
from quorum.session import checkpoint_root

Served = namedtuple("Served", "results rows")

# columns that cross the exchange
SLIM_COLS = ["event_id", "ts", "data_type", "label", "timeout_ms", "n_models", "utilization"]

Profile = namedtuple("Profile", "registry_fits config_fits width registry_grid config_grid")


def registry_profile(registry: DataFrame, config: DataFrame | None = None,
                     max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                     max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> Profile:
    """Whether registry and config fit a broadcast, the largest window width, and
    the time cells of both - one early-stopping job over the two small inputs.  A side
    fits when it has at most ``max_rows`` rows and about ``max_bytes`` bytes (model
    payloads can make a few rows large)."""
    reg = prepare_registry(registry)
    kinds = "side int, data_type string, k string, us long, width int, b long"
    names = [c.split()[0] for c in kinds.split(", ")]
    sides = reg.limit(max_rows + 1).select(F.lit(0), "data_type", "data_model", micros("registered_at"), "width",
                                           row_bytes(reg)).toDF(*names)
    if config is not None:
        sides = sides.union(config.limit(max_rows + 1).select(
            F.lit(1), "data_type", F.lit(""), micros("effective_at"), F.lit(None).cast("int"), row_bytes(config)).toDF(*names))
    # at most 2 * max_rows short rows: one task, no exchange
    per = (sides.coalesce(1).groupBy("side", "data_type", "k").agg(F.count("*").alias("n"), F.max("width").alias("w"), F.sum("b").alias("b"),
                                                       F.min("us").alias("lo"), F.max("us").alias("hi"))
           .groupBy("side", "data_type").agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.max("w").alias("w"),
                                             F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
           .groupBy("side").agg(F.sum("n").alias("n"), F.max("w").alias("w"), F.sum("b").alias("b"), F.min("lo").alias("lo"),
                                F.max("hi").alias("hi"), F.max_by(F.struct("n", "m"), "n").alias("most")))
    got = {r.side: r for r in per.collect()}

    def fits(side):
        return side not in got or (got[side].n <= max_rows and (got[side].b or 0) <= max_bytes)

    def grid(side):
        return time_grid(got[side].lo, got[side].hi, got[side].most.n, got[side].most.m) if side in got else None

    w = got[0].w if 0 in got else 1
    if 0 in got and got[0].n > max_rows:
        w = registry.agg(F.max("width")).first()[0]
    return Profile(fits(0), fits(1), int(w or 1), grid(0), grid(1))


def max_width(registry: DataFrame) -> int:
    """Largest window width in the registry (a registry-sized aggregate)."""
    w = registry.agg(F.max("width")).first()[0]
    return int(w or 1)


def routed_rows(measurements: DataFrame, registry: DataFrame,
                config: DataFrame | None = None,
                default_timeout_ms: int = DEFAULT_TIMEOUT_MS, strategy: str = "auto",
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                config_strategy: str | None = None,
                model_types=SUPPORTED_MODEL_TYPES) -> DataFrame:
    """Deadline + fan-out with active version + standardised value ``z``."""
    reg = prepare_registry(registry)
    meas = with_timeout(measurements, config, default_ms=default_timeout_ms,
                        strategy=config_strategy or strategy,
                        max_broadcast_rows=max_broadcast_rows)
    rows = route_requests(meas, reg, strategy=strategy, max_broadcast_rows=max_broadcast_rows,
                          model_types=model_types)
    return rows.withColumn("z", standardize("utilization", "mean", "std"))


MEASURED = "measured"


def score_rows(rows: DataFrame, scorer: str = "linear", scorer_map=None,
               latency: Column | str | None = None, payloads: DataFrame | None = None) -> DataFrame:
    """Result and answer time of windowed rows.  ``latency=MEASURED`` (M3): the time
    the Python scorer took, in started milliseconds."""
    types = answering_types(scorer, scorer_map)
    rows = score_with(rows, scorer_map or scorers(), payloads) if scorer == "python" else score_linear(rows)
    if isinstance(latency, str):
        if latency != MEASURED or scorer != "python":
            raise ValueError("latency is a column, or 'measured' with scorer='python'")
        latency = F.ceil("score_ms")
    return with_answers(rows, latency, types)


def answering_types(scorer: str = "linear", scorer_map=None) -> list[int]:
    """Model types that have a scorer, so that their versions become active."""
    return sorted(scorer_map or scorers()) if scorer == "python" else list(SUPPORTED_MODEL_TYPES)


def request_starts(measurements: DataFrame, registry: DataFrame, config: DataFrame | None = None,
                   default_timeout_ms: int = DEFAULT_TIMEOUT_MS,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per measurement: guid, deadline and expected answers."""
    reg = prepare_registry(registry)
    p = registry_profile(reg, config, max_broadcast_rows)
    if p.registry_fits:
        reg = prepare_registry(registry.coalesce(1))
    meas = with_timeout(measurements, config, default_ms=default_timeout_ms,
                        strategy="broadcast" if p.config_fits else "scan", grid=p.config_grid)
    meas = (with_model_count(meas, reg, p.registry_grid) if p.registry_fits
            else with_epoch(meas, reg, strategy="scan").drop("models"))
    return meas.select(request_guid(KEY).alias("guid"), "event_id", "ts", "data_type", "label", "timeout_ms", "n_models")


def scored_requests(measurements: DataFrame, registry: DataFrame,
                    config: DataFrame | None = None, latency: Column | str | None = None,
                    scorer: str = "linear", default_timeout_ms: int = DEFAULT_TIMEOUT_MS,
                    strategy: str = "auto",
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                    bucket_rows: int = BUCKET_ROWS, scorer_map=None) -> DataFrame:
    """Every (measurement, model) row with window, result and answer time.

    Measurements without a model are one row with NULL ``data_model``.  The rows
    carry ``collect.PLACE``, by which they are partitioned; a bucket of the
    window has about ``bucket_rows`` measurements.

    A registry with a ``payload`` column (binary) is served by Python scorers: every
    version is tried once, those that do not load never become active, and the
    others' payloads reach the scorer."""
    reg, payloads = prepare_registry(registry), None
    if scorer == "python" and "payload" in registry.columns:
        payloads = reg.select("data_model", "version", "payload")
        if "loads" not in reg.columns:
            checkpoint_root(registry.sparkSession)
            reg = registry = with_load_probe(reg, scorer_map).drop("payload", "load_error").checkpoint()
    reg, registry = reg.drop("payload", "load_error"), registry.drop("payload", "load_error")
    p = registry_profile(reg, config, max_broadcast_rows)
    cfg_strategy = strategy
    if strategy == "auto":
        strategy = "broadcast" if p.registry_fits else "scan"
        cfg_strategy = "broadcast" if p.config_fits else "scan"
    types = answering_types(scorer, scorer_map)
    if strategy == "broadcast":
        # proven small: in one partition its windows and groupings need no exchange
        reg = prepare_registry(registry.coalesce(1))
        config = config.coalesce(1) if config is not None and cfg_strategy == "broadcast" else config
        meas = with_timeout(measurements, config, default_ms=default_timeout_ms, strategy=cfg_strategy,
                            max_broadcast_rows=max_broadcast_rows, grid=p.config_grid)
        meas = with_model_count(meas, reg, p.registry_grid).select(*SLIM_COLS)
        slots = density_slots(measurements, reg.select("data_type").distinct(), p.width, bucket_rows)
        meas = with_last_values(meas, "utilization", p.width, slots, PLACE)
        iv = version_intervals(reg, types).select("data_type", "valid_from", "valid_to", *_version_cols(reg))
        rows = interval_join(meas, iv, ["data_type"], "ts", how="left", grid=p.registry_grid)
        raw = cut_window(F.col(LAST), F.col("valid_from"), F.col("width"))
        rows = rows.withColumns({"z": standardize("utilization", "mean", "std"),
                                 "window": F.transform(raw, lambda v: standardize(v, F.col("mean"), F.col("std")))})
        rows = rows.drop(LAST, "valid_from", "valid_to")
    else:
        rows = routed_rows(measurements, reg, config, default_timeout_ms, strategy,
                           max_broadcast_rows, cfg_strategy, types)
        rows = last_n_window(rows, "z", None, p.width, out="__vals")
        rows = rows.withColumn("window", last_values(F.col("__vals"), F.col("width"))).drop("__vals")
    return score_rows(rows, scorer, scorer_map, latency, payloads)


def serve(measurements: DataFrame, registry: DataFrame, config: DataFrame | None = None,
          latency: Column | str | None = None, quorum="all", threshold: float = 0.5,
          responses: DataFrame | None = None, decider=None, **kw):
    """One result per measurement.

    ``latency`` is the answer time of a request row in ms (a column over the
    row's measurement and model columns); default 0, all answers in time; with
    ``scorer="python"`` it may be ``MEASURED``, the time the scorer took.
    ``quorum``: ``"all"`` waits for every model, an int ``k`` finishes at the
    k-th answer in time.  ``decider``: see ``quorum.operators.deciders``.

    ``responses``: answers from outside (guid, data_model, result, arrived_at)
    instead of this library's scorers; gives ``Collected`` with the late and unknown
    answers as well."""
    if responses is not None:
        starts = request_starts(measurements, registry, config, **kw)
        return collect_responses(starts, responses, quorum, threshold, decider)
    rows = scored_requests(measurements, registry, config, latency, **kw)
    return Served(collect_vote(rows, quorum, threshold, decider), rows)
