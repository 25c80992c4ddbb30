"""Scoring a window with the active model version (M1-M4, F1, F2).

* ``score_linear`` - the built-in two-class scorer as one column expression
  (no Python): logits ``[0, weights . window + bias]`` (mean and ``-thr`` where a
  version has no weights) -> arg-max.
* ``score_with`` - any Python model.  Only what a model needs crosses Arrow (its
  version, parameters and the window), each batch is split by version and every
  version is called once per batch with a matrix of windows.  Model payloads (P2) are
  a table of their own: while it is proven small it is broadcast and a task keeps loaded
  models in a cache bounded by payload bytes; a larger one meets the rows of its
  version in shards of bounded size.
* ``with_load_probe`` - versions whose payload does not load are marked when they
  are registered, so that they never become active (J3, P7).
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.columns import argmax2
from quorum.operators.asof import DEFAULT_MAX_BROADCAST_BYTES, micros
from quorum.session import ship_package


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def linear_logit(window="window", width="width", thr="thr") -> Column:
    """Class-1 logit: mean of the window minus ``thr`` (NULL if any value is NULL)."""
    s = F.aggregate(_c(window), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    return s / _c(width).cast("double") - _c(thr)


def weighted_logit(window="window", weights="weights", bias="bias") -> Column:
    """Class-1 logit of a version's own weights (NULL if any value is NULL or the lengths differ)."""
    products = F.zip_with(_c(window), _c(weights), lambda x, w: x.cast("double") * w)
    total = F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(F.size(_c(window)) == F.size(_c(weights)), total + F.coalesce(_c(bias), F.lit(0.0)))


def score_linear(df: DataFrame, window: str = "window", width: str = "width",
                 thr: str = "thr", out: str = "result", weights: str = "weights", bias: str = "bias") -> DataFrame:
    """Built-in scorer (M1 + P9): result 0 iff ``0 >= logit``.  Where ``df`` has a
    column of ``weights`` (array<double>, NULL for versions without) the logit is
    their product with the window plus ``bias``, else the window's mean less ``thr``."""
    logit = linear_logit(window, width, thr)
    if weights in df.columns:
        logit = F.when(F.col(weights).isNotNull(),
                       weighted_logit(window, weights, bias if bias in df.columns else F.lit(0.0))).otherwise(logit)
    return df.withColumn(out, argmax2(F.lit(0.0), logit))


# Pluggable scorers -----------------------------------------------------------

class Scorer(Protocol):
    """A model family.  ``load`` builds a model from one version's parameters
    (a dict of the registry row; ``params["payload"]`` is its payload in bytes, or
    None); ``predict`` maps an (n, width) float matrix of windows to n class labels (ints)."""

    def load(self, params: dict) -> Any: ...

    def predict(self, model: Any, windows: np.ndarray) -> np.ndarray: ...

    def close(self, model: Any) -> None:
        """Release a loaded model (optional; called when it leaves the cache or the task is done)."""


class LinearScorer:
    """Python twin of ``score_linear`` (used to check the plug-in path)."""

    def load(self, params: dict) -> Any:
        return float(params["thr"])

    def predict(self, model, windows: np.ndarray) -> np.ndarray:
        p1 = windows.astype(np.float64).sum(axis=1) / windows.shape[1] - model
        p0 = np.zeros_like(p1)
        return np.where(np.isnan(p1), 1, np.where(p0 >= p1, 0, 1))


class PayloadScorer:
    """Linear models whose payload is the model: little-endian doubles, the bias and
    one weight for each value of the window.  Any other payload does not load."""

    def load(self, params: dict) -> Any:
        raw = bytes(params["payload"] or b"")
        numbers = np.frombuffer(raw, dtype="<f8") if raw and len(raw) % 8 == 0 else np.empty(0)
        if len(numbers) != 1 + int(params["width"]) or not np.isfinite(numbers).all():
            raise ValueError("the payload is not a bias and a weight for each value of the window")
        return numbers

    def predict(self, model, windows: np.ndarray) -> np.ndarray:
        p1 = np.zeros(len(windows))
        for i in range(windows.shape[1]):            # in order, as the column expression sums
            p1 += windows[:, i].astype(np.float64) * model[1 + i]
        p1 += model[0]
        return np.where(np.isnan(p1), 1, np.where(p1 <= 0, 0, 1))


_SCORERS: dict[int, Scorer] = {0: LinearScorer()}


def register_scorer(model_type: int, scorer: Scorer) -> None:
    """Make ``model_type`` servable by ``scorer`` (F2)."""
    _SCORERS[int(model_type)] = scorer


def scorers() -> dict[int, Scorer]:
    return dict(_SCORERS)


PARAMS = ("width", "mean", "std", "thr")
CACHE_BYTES = 256 << 20
SHARD_ROWS = 20_000


class ModelCache:
    """Loaded models by version, the least recently used leave beyond ``max_bytes`` of payloads."""

    def __init__(self, scorer_map: dict, max_bytes: int):
        self.scorers, self.max_bytes, self.bytes, self.loads = scorer_map, max_bytes, 0, 0
        self.models: OrderedDict = OrderedDict()

    def get(self, key: tuple, params) -> Any:
        """The model of ``key`` = (..., model type); ``params()`` gives its parameters on a miss."""
        if key in self.models:
            self.models.move_to_end(key)
            return self.models[key][0]
        p = params()
        size = len(p.get("payload") or b"")
        while self.models and self.bytes + size > self.max_bytes:
            self._close(*self.models.popitem(last=False))
        model = self.scorers[int(key[-1])].load(p)
        self.loads += 1
        self.models[key] = (model, size)
        self.bytes += size
        return model

    def _close(self, key, entry) -> None:
        self.bytes -= entry[1]
        closer = getattr(self.scorers[int(key[-1])], "close", None)
        if closer is not None:
            closer(entry[0])

    def close(self) -> None:
        while self.models:
            self._close(*self.models.popitem())


def _score_frame(pdf: pd.DataFrame, cache: ModelCache, payload) -> tuple:
    """(results, ms per row) of rows with model_type, data_model, version, window and the parameters."""
    res = pd.array([None] * len(pdf), dtype="Int32")
    dur = np.zeros(len(pdf))
    known = (pdf["model_type"].isin(list(cache.scorers)) & pdf["window"].notna()).to_numpy()
    places = np.flatnonzero(known)
    for gk, g in pdf[known].groupby(["data_model", "version", "model_type"], sort=False, dropna=False).indices.items():
        at = places[g]
        first = pdf.iloc[at[0]]
        # one version -> one width; a NULL inside a window gives no result
        mat = np.vstack([np.asarray(a, dtype=np.float64) for a in pdf["window"].iloc[at]])
        ok = ~np.isnan(mat).any(axis=1)
        if not ok.any():
            continue
        model = cache.get(tuple(gk), lambda: {c: first[c] for c in PARAMS} | {"payload": payload(gk[0], gk[1])})
        t0 = time.perf_counter()
        pred = cache.scorers[int(gk[-1])].predict(model, mat[ok].astype(np.float32))
        ms = (time.perf_counter() - t0) * 1000.0
        res[at[ok]] = np.asarray(pred).astype("int32")
        dur[at] = ms / len(at)
    return res, dur


SCORED = "result int, ms double"
LOADS, LOAD_ERROR = "loads", "load_error"


def score_with(df: DataFrame, scorer_map: dict[int, Scorer] | None = None, payloads: DataFrame | None = None,
               out: str = "result", duration: str = "score_ms", cache_bytes: int = CACHE_BYTES,
               max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Score with Python models (M2, M3): adds ``out`` (int) and ``duration``
    (ms per row, measured around each model call, spread over its rows).

    ``payloads``: (data_model, version, payload), one row a version."""
    ship_package(df.sparkSession)
    smap = dict(scorer_map or _SCORERS)
    versions = None if payloads is None else payloads.select("data_model", micros("version").alias("version"), "payload")
    if versions is not None:
        # payloads are summed where they lie; only a proven small table comes to the driver
        size = versions.agg(F.sum(F.octet_length("payload") + F.octet_length("data_model") + 8)).first()[0] or 0
        if size > max_broadcast_bytes:
            return _score_sharded(df, smap, versions, out, duration, cache_bytes)
        table = {(r.data_model, r.version): bytes(r.payload) for r in versions.where("payload is not null").collect()}
    else:
        table = {}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        cache = ModelCache(smap, cache_bytes)
        try:
            for columns in batches:
                pdf = pd.concat(columns, axis=1, keys=["model_type", "data_model", "version", "window", *PARAMS])
                res, dur = _score_frame(pdf, cache, lambda m, v: shared.value.get((m, int(v))))
                yield pd.DataFrame({"result": res, "ms": dur})
        finally:
            cache.close()

    # a version that does not load has no scorer
    kind = F.when(F.coalesce(LOADS, F.lit(True)), F.col("model_type")) if LOADS in df.columns else F.col("model_type")
    scored = score(kind, "data_model", micros("version"), "window", *PARAMS)
    return (df.withColumn("__scored", scored)
            .withColumns({out: F.col("__scored.result"), duration: F.coalesce(F.col("__scored.ms"), F.lit(0.0))}).drop("__scored"))


def _score_sharded(df: DataFrame, smap: dict, versions: DataFrame, out: str, duration: str, cache_bytes: int) -> DataFrame:
    """Rows of a version, in shards of about ``SHARD_ROWS``, each with the version's payload."""
    asks = F.col("model_type").isin(list(smap)) & F.col("window").isNotNull()
    asks = F.coalesce(asks & F.coalesce(LOADS, F.lit(True)) if LOADS in df.columns else asks, F.lit(False))
    rows = df.where(asks).withColumn("__v", micros("version"))
    counts = rows.groupBy("data_model", "__v").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("__n"))
    rows = rows.join(counts, ["data_model", "__v"])
    # the shard of a row hangs on its own values, so that a task done again deals alike
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64("event_id", "ts"), F.col("__n")).cast("int")).drop("__n")
    sent = (counts.join(versions.withColumnRenamed("version", "__v"), ["data_model", "__v"])
            .select(F.col("data_model").alias("m"), F.col("__v").alias("v"),
                    F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("s"), F.col("payload").alias("p")))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType()), T.StructField(duration, T.DoubleType())])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame, payload: pd.DataFrame) -> pd.DataFrame:
        cache = ModelCache(smap, cache_bytes)
        raw = bytes(payload["p"].iloc[0]) if len(payload) and payload["p"].iloc[0] is not None else None
        res, dur = _score_frame(pdf.reset_index(drop=True), cache, lambda m, v: raw)
        cache.close()
        return pdf.assign(**{out: res, duration: dur})[names]

    done = rows.groupBy("data_model", "__v", "__shard").cogroup(sent.groupBy("m", "v", "s")).applyInPandas(run, schema)
    rest = df.where(~asks).withColumns({out: F.lit(None).cast("int"), duration: F.lit(0.0)})
    return done.unionByName(rest)


# Load probe -------------------------------------------------------------------


def with_load_probe(registry: DataFrame, scorer_map: dict[int, Scorer] | None = None) -> DataFrame:
    """``registry`` with ``loads`` and ``load_error``: each version is loaded once, where
    it lies; a version whose load fails never becomes active (``route.activated``).
    Versions of a type without a scorer are not tried."""
    ship_package(registry.sparkSession)
    smap = dict(scorer_map or _SCORERS)
    has = "payload" in registry.columns

    @F.pandas_udf("string")
    def probe(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            pdf = pd.concat(columns, axis=1, keys=["model_type", "payload", *PARAMS])
            errors = []
            for row in pdf.to_dict("records"):
                scorer, error = smap.get(row["model_type"]), None
                if scorer is not None:
                    try:
                        model = scorer.load(row)
                        getattr(scorer, "close", lambda m: None)(model)
                    except Exception as e:  # noqa: BLE001 - any failure to load keeps the version out
                        error = f"{type(e).__name__}: {e}"
                errors.append(error)
            yield pd.Series(errors, dtype=object)

    payload = F.col("payload") if has else F.lit(None).cast("binary")
    d = registry.withColumn(LOAD_ERROR, probe("model_type", payload, *PARAMS))
    return d.withColumn(LOADS, F.col(LOAD_ERROR).isNull())


def load_failures(probed: DataFrame) -> DataFrame:
    """The quarantine of ``with_load_probe``: versions that do not load, and why."""
    return probed.where(~F.col(LOADS)).select("data_type", "name", "description", "model_type", "registered_at", LOAD_ERROR)
