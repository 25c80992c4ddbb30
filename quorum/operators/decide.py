"""Python deciders (F3): the vote replaced by a Python function, in batch plans.

Deciders that column functions can express belong in ``quorum.operators.deciders``:
they need no Python worker and hold in the streaming paths as well.

The answers that count for a request are gathered per guid - at most
``n_models`` of them, so the list is bounded by the registry, never by the
data - and the decider is called on Arrow batches of many requests at once
(``mapInPandas``), not once per request.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum import schemas
from quorum.functions.columns import VOTER_MODEL
from quorum.functions.columns import request_guid
from quorum.operators.collect import KEY, START_COLS, _quorum_k, counted_answers, mark_counted, request_keys
from quorum.session import ship_package

Decider = Callable[[pd.DataFrame], pd.Series]


def majority_decider(batch: pd.DataFrame, threshold: float = 0.5) -> pd.Series:
    """Python twin of the built-in vote: mean of answers (missing -> 0)."""
    flat = batch["results"].explode()
    mean = pd.to_numeric(flat, errors="coerce").fillna(0).groupby(level=0).mean()
    return pd.Series(np.where(mean < threshold, 0, 1), index=mean.index)


def collect_answers(rows: DataFrame, quorum="all") -> DataFrame:
    """One row per guid: start columns, ``results`` / ``latencies`` of the
    counted answers in arrival order, and the completion flag."""
    d = mark_counted(rows, quorum)
    g = d.groupBy(*dict.fromkeys([*request_keys(d), *START_COLS])).agg(counted_answers().alias("__a"))
    return (g.withColumn("guid", request_guid(KEY))
             .withColumn("results", F.col("__a.result"))
             .withColumn("latencies", F.col("__a.latency_ms"))
             .withColumn("complete", (F.size("__a") > 0) & (F.size("__a") >= _quorum_k(quorum)))
             .select("guid", KEY, *START_COLS, "results", "latencies", "complete"))


def decide_with(rows: DataFrame, decider: Decider = majority_decider, quorum="all") -> DataFrame:
    """Results (same schema as ``collect_vote``) with ``decider`` choosing the
    result of every request that has at least one counted answer."""
    ship_package(rows.sparkSession)
    coll = collect_answers(rows, quorum)

    def run(batches):
        for pdf in batches:
            n = pdf["results"].map(len)
            processed = (pdf["n_models"] > 0) & (n > 0)
            res = pd.array([None] * len(pdf), dtype="Int32")
            if processed.any():
                res[processed.to_numpy()] = decider(pdf[processed]).astype("int32").to_numpy()
            last = pdf["latencies"].map(lambda a: max(a) if len(a) else 0)
            dur = np.where(pdf["complete"] & processed, last,
                           np.where(processed, pdf["timeout_ms"], 0)).astype("int64")
            outcome = np.where(pdf["n_models"] == 0, "no_model",
                               np.where(pdf["complete"] & processed, "complete",
                                        np.where(processed, "deadline", "timeout")))
            yield pd.DataFrame({
                "guid": pdf["guid"], "event_id": pdf["event_id"],
                "data_type": pdf["data_type"], "ts": pdf["ts"],
                "n_models": pdf["n_models"].astype("int32"),
                "processed": processed,
                "model": np.where(processed, VOTER_MODEL, ""),
                "source": np.where(processed, pdf["label"], 0).astype("int32"),
                "result": res, "duration_ms": dur, "outcome": outcome,
            })

    return coll.mapInPandas(run, schemas.RESULTS)
