"""Named queries over the given tables (the driver's ``queries()``).

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
``events`` (or ``embeddings``) table; the model registry, timeout config
and answer-latency rule are the inline ones of ``quorum.demo``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum import demo
from quorum.functions import decode as dec
from quorum.functions.columns import encode_result, request_guid, serving_line
from quorum.operators import deciders
from quorum.operators.collect import (collect_vote, late_responses, responses_in_time,
                                      with_arrival_rank)
from quorum.operators.decide import decide_with
from quorum.operators.ensemble import SliceModel, ensemble_score
from quorum.operators.route import (SUPPORTED_MODEL_TYPES, route,
                                    version_intervals, with_epoch, with_guid, with_timeout)
from quorum.operators.score import PayloadScorer, score_linear
from quorum.operators.stats import collector_stats, current_model_stats, model_stats, state_report
from quorum.plans.oracle import (AGAIN_EVERY, AGAIN_MS, ASTRAY_BY, ASTRAY_EVERY, BAD_EMPTY_K, BAD_TRUNCATE_K, BAD_TYPE_K,
                                 DECIDER_WEIGHTS, ENSEMBLE_SLICES, LOG_PARTITIONS, NAMELESS_EVERY, OTHER_WEIGHT,
                                 SOONER_EVERY, SOONER_MS, TRUNCATE_AT)
from quorum.plans.serve import MEASURED, scored_requests
from quorum.sources.tables import measurements, measurements_from_events, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _rows(spark, d, scorer="linear") -> DataFrame:
    return scored_requests(measurements(spark, d), demo.registry(spark), demo.config(spark),
                           latency=demo.latency(), scorer=scorer)


def _results(spark, d, quorum="all") -> DataFrame:
    return collect_vote(_rows(spark, d), quorum)


def _routed(spark, d):
    return route(with_guid(measurements(spark, d)), demo.registry(spark))


ANS = ["event_id", "data_model"]


def q_request_ids(spark, d):
    return with_guid(measurements(spark, d)).select("event_id", "guid")


def q_known_models(spark, d):
    ep = with_epoch(measurements(spark, d), demo.registry(spark))
    return ep.select("event_id", "data_type", "n_models",
                     F.array_join("models", ",").alias("models"))


def q_route_fanout(spark, d):
    return _routed(spark, d).requests.select(*ANS)


def q_route_starts(spark, d):
    return _routed(spark, d).starts.select("guid", "event_id", "data_type", "ts", "n_models")


def q_no_model_rows(spark, d):
    return _routed(spark, d).no_model.select("event_id", "data_type", "ts")


def q_active_version(spark, d):
    return _routed(spark, d).requests.select(*ANS, "version", "description")


def q_version_intervals(spark, d):
    """W2 per request: the validity interval of the version that served it."""
    req = _routed(spark, d).requests.select(*ANS, "version")
    iv = version_intervals(demo.registry(spark)).select(
        "data_model", F.col("valid_from").alias("version"), "valid_from", "valid_to")
    return req.join(iv, ["data_model", "version"]).select(*ANS, "valid_from", "valid_to")


def q_effective_timeout(spark, d):
    return with_timeout(measurements(spark, d), demo.config(spark)).select(
        "event_id", "data_type", "timeout_ms")


def q_servable_requests(spark, d):
    req = _routed(spark, d).requests
    return req.filter(F.col("model_type").isin(list(SUPPORTED_MODEL_TYPES))).select(*ANS, "model_type")


def _micro(col):
    return F.array_join(F.transform(col, lambda x: F.coalesce(
        F.round(x.cast("double") * 1_000_000).cast("long").cast("string"), F.lit("null"))), ",")


def q_last_n_window(spark, d):
    return _rows(spark, d).filter("answered").select(*ANS, "width",
                                                    _micro(F.col("window")).alias("window_micro"))


def _scored(rows):
    return rows.filter("answered").select(*ANS, F.lit(True).alias("processed"),
                                          F.col("description").alias("model"),
                                          F.col("label").alias("source"), "result")


def q_score_linear(spark, d):
    return _scored(_rows(spark, d))


def q_score_python_model(spark, d):
    return _scored(_rows(spark, d, scorer="python"))


def q_score_weighted(spark, d):
    """M1: the native scorer with a weight for each value of the window."""
    rows = _rows(spark, d).filter("answered").drop("result")
    w = F.col("width")
    rows = rows.withColumns({"weights": F.transform(F.sequence(F.lit(1), w), lambda i: F.lit(2.0) * i / (w * (w + 1))),
                             "bias": -F.col("thr")})
    return _scored(score_linear(rows))


def _payload_rows(spark, d, **kw):
    return scored_requests(measurements(spark, d), demo.payload_registry(spark), demo.config(spark), scorer="python",
                           scorer_map={0: PayloadScorer()}, **kw)


def q_score_payload_model(spark, d):
    """The weights come from the payload; versions whose payload does not load are never active."""
    return _scored(_payload_rows(spark, d, latency=demo.latency()))


def q_failing_payload_results(spark, d):
    """A payload that does not load, registered over one that serves."""
    return collect_vote(_payload_rows(spark, d, latency=demo.latency()))


def q_measured_usage(spark, d):
    """M3, A2: usage and durations as the scorer took them."""
    st = model_stats(_payload_rows(spark, d, latency=MEASURED))
    return st.select("data_model", "version", "usage", (F.col("duration_ms") > 0).alias("measured"))


def q_responses_in_time(spark, d):
    return responses_in_time(_rows(spark, d)).select(*ANS, "latency_ms", "result")


def q_late_responses(spark, d):
    return late_responses(_rows(spark, d)).select(*ANS, "latency_ms")


def q_arrival_rank(spark, d):
    return with_arrival_rank(_rows(spark, d)).filter("on_time").select(*ANS, "arrival_rank")


def q_vote_all(spark, d):
    return _results(spark, d)


def q_vote_quorum_1(spark, d):
    return _results(spark, d, 1)


def q_vote_quorum_2(spark, d):
    return _results(spark, d, 2)


def q_serve(spark, d):
    from quorum.plans.serve import serve
    return serve(measurements(spark, d), demo.registry(spark), demo.config(spark),
                 latency=demo.latency()).results


def q_replayed_registry(spark, d):
    """Messages delivered twice, ties, and versions that cannot serve
    registered over versions that do."""
    from quorum.plans.serve import serve
    return serve(measurements(spark, d), demo.registry(spark, demo.REPLAYED_ROWS),
                 demo.config(spark), latency=demo.latency()).results


def q_multi_partition_results(spark, d):
    """The events as a log of several partitions whose offsets collide; every
    measurement has its own result."""
    from quorum.plans.serve import serve
    from quorum.streaming.serve_stream import measurements_from_log
    m = dec.encode_measurements(measurements(spark, d))
    part = F.col("event_id") % LOG_PARTITIONS
    log = m.select(F.lit(None).cast("binary").alias("key"), "value", F.lit("mdata").alias("topic"),
                   part.cast("int").alias("partition"),
                   ((F.col("event_id") - part) / LOG_PARTITIONS).cast("long").alias("offset"),
                   F.col("ts").cast("timestamp").alias("timestamp"))
    meas, _ = measurements_from_log(log)
    return serve(meas, demo.registry(spark), demo.config(spark), latency=demo.latency()).results


def q_serve_stream(spark, d):
    """The events published as a log in 3 files, served by the streaming
    jobs (availableNow), results read back from the sink table."""
    from quorum.streaming.demo_run import run
    return run(spark, d, n_files=3)


def q_serve_stateful(spark, d):
    """The serving stream followed by the stateful collector
    (transformWithState keyed by guid, event-time deadline timers)."""
    from quorum.streaming.demo_run import run_with_collector
    res, _ = run_with_collector(spark, d, n_files=2)
    return res


def q_custom_decider(spark, d):
    """the earliest answer with a result decides, as an aggregate of the collecting ``groupBy``."""
    return collect_vote(_rows(spark, d), decider=deciders.first_answer())


def q_weighted_decider(spark, d):
    """F3 with k-of-n: votes weighted by model, of the first two answers."""
    return collect_vote(_rows(spark, d), 2, decider=deciders.weighted_vote(DECIDER_WEIGHTS, other=OTHER_WEIGHT))


def q_python_decider(spark, d):
    return decide_with(_rows(spark, d))


def outside_answers(spark, d) -> DataFrame:
    """Answers as an outside scorer would send them: those of the demo's models, some
    twice (later with another result, or earlier), some to requests that nobody made, some
    without a guid."""
    rows = _rows(spark, d).filter("answered").select("event_id", "data_model", "result", "arrived_at")
    moved = lambda ms: F.timestamp_add("MILLISECOND", F.lit(ms), F.col("arrived_at"))
    copies = F.array(
        F.struct(F.col("event_id").alias("to"), F.col("result").alias("result"), F.col("arrived_at").alias("arrived_at")),
        F.when(F.col("event_id") % AGAIN_EVERY == 0, F.struct(F.col("event_id").alias("to"), (1 - F.col("result")).alias("result"),
                                                             moved(AGAIN_MS).alias("arrived_at"))),
        F.when(F.col("event_id") % SOONER_EVERY == 0, F.struct(F.col("event_id").alias("to"), F.col("result").alias("result"),
                                                              moved(-SOONER_MS).alias("arrived_at"))),
        F.when(F.col("event_id") % ASTRAY_EVERY == 0, F.struct((F.col("event_id") + ASTRAY_BY).alias("to"), F.col("result").alias("result"),
                                                              F.col("arrived_at").alias("arrived_at"))),
        F.when(F.col("event_id") % NAMELESS_EVERY == 0, F.struct(F.lit(None).cast("long").alias("to"), F.col("result").alias("result"),
                                                                F.col("arrived_at").alias("arrived_at"))))
    sent = rows.select("data_model", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"))
    return sent.select(request_guid("c.to").alias("guid"), "data_model", "c.result", "c.arrived_at")


def _outside(spark, d, quorum="all"):
    from quorum.plans.serve import serve
    return serve(measurements(spark, d), demo.registry(spark), demo.config(spark), quorum=quorum,
                 responses=outside_answers(spark, d))


def q_collected_responses(spark, d):
    """Answers as an input of their own."""
    return _outside(spark, d).results


def q_collected_quorum_1(spark, d):
    return _outside(spark, d, 1).results


def q_unknown_responses(spark, d):
    """Answers that nobody waits for."""
    return _outside(spark, d).unknown.select("guid", "data_model", "result", "reason")


def q_late_outside_responses(spark, d):
    """Answers that came when their request was finished."""
    return _outside(spark, d, 1).late.select("event_id", "data_model", "latency_ms")


def _stat_cols(df, keys):
    return df.select(*keys, "usage", "duration_ms", "min_ms", "max_ms",
                     F.round("avg_ms", 6).alias("avg_ms"))


def q_model_stats(spark, d):
    return _stat_cols(model_stats(_rows(spark, d)), ["data_model", "version"])


def q_model_report(spark, d):
    return _stat_cols(current_model_stats(_rows(spark, d)), ["data_model", "version"])


def q_collector_stats(spark, d):
    st = collector_stats(_results(spark, d), demo.config(spark))
    return st.select("data_type", "usage", "duration_ms", "min_ms", "max_ms",
                     F.round("avg_ms", 6).alias("avg_ms"), "tmout_ms")


def q_state_report(spark, d):
    """Per data type the known models and the collector statistics."""
    rows = _rows(spark, d)
    views = state_report(rows, collect_vote(rows), demo.registry(spark), demo.config(spark))
    km = views["known_models"].select("data_type", F.array_join("models", ",").alias("models"), "n_models")
    return views["collector_report"].join(km, "data_type", "left").select(
        "data_type", "models", "n_models", "usage", "duration_ms", "min_ms", "max_ms",
        F.round("avg_ms", 6).alias("avg_ms"), "tmout_ms")


def q_stream_reports(spark, d):
    """Statistics kept as partials by the serving stream, micro-batch by micro-batch."""
    from quorum.streaming.demo_run import served, utc
    from quorum.streaming.reports import stream_state_report
    with utc(spark):
        tables, _ = served(spark, d, "serve-reports", 3, "all")
        return _stat_cols(stream_state_report(spark, tables)["model_versions"], ["data_model", "version"])


def q_stream_payload_results(spark, d):
    """Payloads through the model topic, tried when registered, served by the stream."""
    from quorum import schemas
    from quorum.streaming.demo_run import served, utc
    from quorum.streaming.tables import read_table as read_batches
    with utc(spark):
        tables, _ = served(spark, d, "serve-payload", 2, "all", registry=demo.payload_registry(spark),
                           scorer_map={0: PayloadScorer()}, scorer="python")
        return read_batches(spark, tables.results, schemas.RESULTS)


def q_serving_lines(spark, d):
    return _results(spark, d).select("event_id", serving_line().alias("line"))


def q_result_vs_expected(spark, d):
    return (_results(spark, d).filter("processed")
            .select("event_id", "result", "source", (F.col("result") == F.col("source")).alias("correct")))


def q_encoded_results(spark, d):
    return _results(spark, d).select("event_id", encode_result().alias("payload"))


def q_ensemble_embeddings(spark, d):
    models = [SliceModel(n, s, ln) for n, s, ln in ENSEMBLE_SLICES]
    emb = read_table(spark, d, "embeddings")
    out = ensemble_score(emb, "embedding", models, source=F.col("label") % 2)
    return out.select("vec_id", *[m.name for m in models], "result", "model", "source")


def measurement_log(spark, d) -> DataFrame:
    """The ``events`` table as a measurement log with corrupted payloads mixed
    in (chosen by ``props.k``): truncated JSON, a wrong-typed field, empty."""
    ev = read_table(spark, d, "events")
    m = measurements_from_events(ev, keep=[F.get_json_object("props", "$.k").cast("int").alias("k")])
    good = F.to_json(F.struct(F.col("utilization"), F.col("label").alias("class"),
                              F.col("data_type").alias("dataType")))
    wrong = F.concat(F.lit('{"utilization":"n/a","class":'), F.col("label").cast("string"),
                     F.lit(',"dataType":"'), F.col("data_type"), F.lit('"}'))
    payload = (F.when(F.col("k") >= BAD_TRUNCATE_K, F.substring(good, 1, TRUNCATE_AT))
               .when(F.col("k") >= BAD_TYPE_K, wrong)
               .when(F.col("k") >= BAD_EMPTY_K, F.lit(""))
               .otherwise(good))
    return m.select(F.lit(None).cast("binary").alias("key"), payload.cast("binary").alias("value"),
                    F.lit("mdata").alias("topic"), F.lit(0).alias("partition"),
                    F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


def q_decode_good_rows(spark, d):
    good, _ = dec.split_bad(dec.decode_measurements(measurement_log(spark, d)))
    return good.select(F.col("offset").alias("event_id"), "utilization", "label", "data_type")


def q_decode_quarantine(spark, d):
    _, bad = dec.split_bad(dec.decode_measurements(measurement_log(spark, d)))
    return bad.select(F.col("offset").alias("event_id"), F.length("value").alias("n_bytes"))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
