"""Deadline-bounded collection of answers and the vote.

Input: one row per (measurement, model) as produced by ``route_requests`` and
scoring - the start information (``guid``, ``n_models``, ``timeout_ms``,
``label``, ``ts``) rides on every row, so a request with no answer at all is
still present, and measurements without models are one row with
``n_models = 0``.  Collecting is therefore a single ``groupBy`` on the
measurement id: one shuffle, no join back to the starts.

Rules (reference behaviour, SC variant):
* an answer counts iff ``latency_ms <= timeout_ms`` (and it is among the
  first ``quorum`` answers by arrival, ties by model key);
* complete when ``quorum`` answers arrived in time (default all ``n_models``);
  duration = latency of the completing answer, otherwise the timeout;
* vote over counted answers: ``mean(coalesce(result, 0)) < threshold -> 0``
  else 1 (a tie votes 1; a warming-up model votes 0);
* nothing counted -> ``processed = false``, no result, duration 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions.columns import VOTER_MODEL, request_guid
from quorum.operators.route import SUPPORTED_MODEL_TYPES, serves

# the measurement id keys a request; the guid string (a hash of it) is only
# formed on the one-row-per-request output, never carried through a shuffle
KEY = "event_id"
START_COLS = ["data_type", "ts", "label", "n_models", "timeout_ms"]

#: where rows lie: rows of one request share it, and rows that carry it are
#: partitioned by it (with the data type or alone).  As a grouping key it lets
#: ranks and votes run where the rows are, without an exchange
PLACE = "__place"

#: one counted answer, in order of arrival, as a decider sees it
ANSWER = "struct<latency_ms:bigint,data_model:string,result:int>"


def request_keys(rows: DataFrame) -> list[str]:
    """Columns that tell requests apart, with the place of the rows if they have one."""
    return [KEY, *(["data_type", PLACE] if PLACE in rows.columns else [])]


def counted_answers() -> Column:
    """Aggregate: the counted answers of a request, in order of arrival.  They
    are at most as many as the type has models."""
    return F.array_sort(F.collect_list(F.when(F.col("counted"), F.struct("latency_ms", "data_model", "result"))
                                       .cast(ANSWER)))


def with_answers(rows: DataFrame, latency: Column | None = None,
                 model_types=SUPPORTED_MODEL_TYPES) -> DataFrame:
    """Mark which request rows get an answer and when (``latency_ms``,
    ``arrived_at``).  Only versions of a servable model type answer."""
    lat = latency if latency is not None else F.lit(0)
    answered = F.col("data_model").isNotNull() & serves(rows, model_types)
    return (rows.withColumn("answered", F.coalesce(answered, F.lit(False)))
                .withColumn("latency_ms", F.when(F.col("answered"), lat.cast("long")))
                .withColumn("arrived_at", F.timestamp_add("MILLISECOND", F.col("latency_ms"),
                                                          F.col("ts"))))


def _quorum_k(quorum) -> Column:
    if quorum in (None, "all"):
        return F.col("n_models")
    return F.lit(int(quorum))


def with_arrival_rank(rows: DataFrame) -> DataFrame:
    """``arrival_rank`` of each in-time answer within its request (W3): 1 for the
    first, by (latency, model key); NULL for late or missing answers."""
    on_time = F.col("answered") & (F.col("latency_ms") <= F.col("timeout_ms"))
    d = rows.withColumn("on_time", F.coalesce(on_time, F.lit(False)))
    w = Window.partitionBy(*request_keys(rows)).orderBy(F.col("on_time").desc(), "latency_ms", "data_model")
    return d.withColumn("arrival_rank", F.when(F.col("on_time"), F.row_number().over(w)))


def mark_counted(rows: DataFrame, quorum="all") -> DataFrame:
    """Add ``counted``: the answer takes part in the vote (J5 with A5)."""
    if quorum in (None, "all"):
        on_time = F.col("answered") & (F.col("latency_ms") <= F.col("timeout_ms"))
        return rows.withColumn("counted", F.coalesce(on_time, F.lit(False)))
    d = with_arrival_rank(rows)
    return d.withColumn("counted", F.coalesce(F.col("arrival_rank") <= _quorum_k(quorum),
                                              F.lit(False)))


def responses_in_time(rows: DataFrame, quorum="all") -> DataFrame:
    """Answers that reach the vote."""
    return mark_counted(rows, quorum).filter("counted")


def late_responses(rows: DataFrame, quorum="all") -> DataFrame:
    """Answers that arrive after their request was finished (J7): past the
    deadline, or after the quorum was reached.  Dropped by the vote, kept
    here for audit."""
    return mark_counted(rows, quorum).filter(F.col("answered") & ~F.col("counted"))


def collect_vote(rows: DataFrame, quorum="all", threshold: float = 0.5, decider=None) -> DataFrame:
    """One result per measurement.

    ``decider`` (F3): a function of the counted answers' column (an array of
    ``ANSWER``, in order of arrival) that gives the result's column, such as
    those of ``quorum.operators.deciders``; without one the answers vote
    against ``threshold``.  Either is part of the one collecting ``groupBy``."""
    d = mark_counted(rows, quorum)
    cnt = F.count_if("counted")
    chosen = (F.sum(F.when(F.col("counted"), F.coalesce("result", F.lit(0)))) if decider is None
              else counted_answers())
    # start columns depend on the measurement only; as grouping keys they keep the
    # aggregate hash-based (no sort) with fixed-width buffers
    agg = d.groupBy(*dict.fromkeys([*request_keys(d), *START_COLS])).agg(
        cnt.alias("__n"), chosen.alias("__chosen"),
        F.max(F.when(F.col("counted"), F.col("latency_ms"))).alias("__last"),
    )
    k = _quorum_k(quorum)
    has_models = F.col("n_models") > 0
    processed = has_models & (F.col("__n") > 0)
    complete = processed & (F.col("__n") >= k)
    vote = (F.when(F.col("__chosen") / F.col("__n") < F.lit(threshold), 0).otherwise(1) if decider is None
            else decider(F.col("__chosen")))
    return agg.select(
        request_guid(KEY).alias("guid"), "event_id", "data_type", "ts",
        F.col("n_models").cast("int").alias("n_models"),
        processed.alias("processed"),
        F.when(processed, F.lit(VOTER_MODEL)).otherwise(F.lit("")).alias("model"),
        F.when(processed, F.col("label")).otherwise(F.lit(0)).cast("int").alias("source"),
        F.when(processed, vote).cast("int").alias("result"),
        F.when(complete, F.col("__last"))
         .when(processed, F.col("timeout_ms"))
         .otherwise(F.lit(0)).cast("long").alias("duration_ms"),
        F.when(~has_models, F.lit("no_model"))
         .when(complete, F.lit("complete"))
         .when(processed, F.lit("deadline"))
         .otherwise(F.lit("timeout")).alias("outcome"),
    )
