"""Answers that arrive from outside, as an input of their own.

``starts`` are requests (one row per measurement: guid, measurement, expected
answers, deadline), ``responses`` rows of any origin that name a guid.  They
are correlated by guid:

* an answer whose guid is a request's counts up to the deadline and the k-th
  answer.  It knows the guid, so it cannot come before the request: where the
  clocks say so, its latency is 0;
* of several answers of one model to one request the earliest holds (then the
  smaller result, a missing result last); the others are duplicates;
* answers whose guid no request has, or without a guid, a model or a time, are
  *unknown*: nobody waits for them;
* the others that do not count came when the request was finished (*late*).

Plan: answers of one (guid, model) are merged before they move, so that a
storm of repeated answers to one request is small when it meets it; the merged
rows and the starts are then partitioned by guid, and rank, vote and decider
run in that partitioning (``collect.PLACE``).
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.columns import request_guid
from quorum.operators.asof import micros
from quorum.operators.collect import KEY, PLACE, START_COLS, collect_vote, late_responses, mark_counted

Collected = namedtuple("Collected", "results rows late unknown")

RESPONSE_INPUT = "guid string, data_model string, result int, arrived_at timestamp_ntz"


def usable() -> Column:
    """An answer that names a request, a model and a time."""
    return F.col("guid").isNotNull() & F.col("data_model").isNotNull() & F.col("arrived_at").isNotNull()


def _earliest(responses: DataFrame) -> DataFrame:
    """One row per (guid, model): its earliest answer, and how many there were."""
    missing_last = F.coalesce(F.col("result").cast("long"), F.lit(1 << 40))
    first = F.min(F.struct("arrived_at", missing_last.alias("r")))
    return (responses.where(usable()).groupBy("guid", "data_model")
            .agg(first.alias("first"), F.count("*").alias("n_answers"))
            .select("guid", "data_model", F.col("first.arrived_at").alias("arrived_at"),
                    F.when(F.col("first.r") < (1 << 40), F.col("first.r").cast("int")).alias("result"), "n_answers"))


def correlated(starts: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per (request, answering model), or one without a model for a
    request that nobody answers: the rows that ranks and votes work on."""
    s = starts if "guid" in starts.columns else starts.withColumn("guid", request_guid(KEY))
    s = s.select("guid", KEY, *START_COLS)
    a = _earliest(responses).withColumnRenamed("guid", "__g")
    rows = s.join(a, F.col("guid") == F.col("__g"), "left").drop("__g")
    late_by = micros("arrived_at") - micros("ts")
    # whole milliseconds, upwards: an answer one microsecond past the deadline is late
    return rows.withColumns({"answered": F.col("data_model").isNotNull(),
                             "latency_ms": F.greatest(F.ceil(late_by / 1000).cast("long"), F.when(late_by.isNotNull(), 0)),
                             PLACE: F.col("guid")})


def unknown_responses(starts: DataFrame, responses: DataFrame) -> DataFrame:
    """The response rows that nobody waits for, each of them, with ``reason``:
    ``incomplete`` or ``no_request``.  A guid that many of them share is split by
    the join (they are its streamed side)."""
    s = starts if "guid" in starts.columns else starts.withColumn("guid", request_guid(KEY))
    lost = responses.where(usable()).join(s.select("guid"), "guid", "left_anti").select(*responses.columns)
    return (lost.withColumn("reason", F.lit("no_request"))
            .union(responses.where(~usable()).withColumn("reason", F.lit("incomplete"))))


def collect_responses(starts: DataFrame, responses: DataFrame, quorum="all", threshold: float = 0.5,
                      decider=None) -> Collected:
    """Results of ``starts`` by the answers in ``responses``: one per request,
    those without any answer included (``timeout``; ``no_model`` where none is expected).

    ``responses``: guid, data_model, result, arrived_at (other columns are
    ignored, but kept in ``unknown``).  ``late`` has the answers that came when their request was finished."""
    rows = correlated(starts, responses)
    results = collect_vote(rows, quorum, threshold, decider)
    return Collected(results, mark_counted(rows, quorum).drop(PLACE), late_responses(rows, quorum).drop(PLACE),
                     unknown_responses(starts, responses))
