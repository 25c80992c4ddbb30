"""DuckDB SQL that states the same queries set-wise, as an independent check.

Every query reads the pre-registered ``events`` / ``embeddings`` views; the
inline registry and config are VALUES lists rendered from ``quorum.demo``.
"""

from __future__ import annotations

from quorum import demo

MAX_WIDTH = max(r[5] for r in demo.REGISTRY_ROWS)
DEFAULT_TIMEOUT_MS = 150


# The log of ``multi_partition_results`` and its position number
LOG_PARTITIONS, PARTITION_STEP = 8, 1 << 44


# What outside answers do, by event_id, and the weights of a decider
AGAIN_EVERY, AGAIN_MS, SOONER_EVERY, SOONER_MS = 3, 5, 5, 10
ASTRAY_EVERY, ASTRAY_BY, NAMELESS_EVERY = 7, 1_000_000_000_000, 11
DECIDER_WEIGHTS, OTHER_WEIGHT = {"click-m1": 0.5, "click-m2": 2.5, "error-m1": 0.0}, 1.0


def _base(quorum="all", rows=demo.REGISTRY_ROWS, event_id="event_id", outside=False, broken=(), weighted=False) -> str:
    ans, came = "ans", ""
    if outside:
        ans, came = "came", f"""
sent AS (SELECT event_id, data_model, result, latency_ms FROM ans WHERE answered
         UNION ALL SELECT event_id, data_model, 1 - result, latency_ms + {AGAIN_MS} FROM ans WHERE answered AND event_id % {AGAIN_EVERY} = 0
         UNION ALL SELECT event_id, data_model, result, latency_ms - {SOONER_MS} FROM ans WHERE answered AND event_id % {SOONER_EVERY} = 0),
came AS (SELECT s.event_id, s.data_model, s.result, greatest(s.latency_ms, 0) AS latency_ms, true AS answered, t.timeout_ms
         FROM sent s JOIN tmo t USING (event_id)
         QUALIFY row_number() OVER (PARTITION BY event_id, data_model ORDER BY s.latency_ms, s.result NULLS LAST) = 1),"""
    if quorum == "all":
        counted = f"""
cnt AS (SELECT a.*, coalesce(answered AND latency_ms <= timeout_ms, false) AS counted FROM {ans} a),"""
        k = "n.n_models"
    else:
        counted = f"""
ranked AS (SELECT event_id, data_model,
                  CAST(row_number() OVER (PARTITION BY event_id ORDER BY latency_ms, data_model) AS INTEGER) AS arrival_rank
           FROM {ans} WHERE answered AND latency_ms <= timeout_ms),
cnt AS (SELECT a.*, r.arrival_rank, coalesce(r.arrival_rank <= {int(quorum)}, false) AS counted
        FROM {ans} a LEFT JOIN ranked r ON a.event_id = r.event_id AND a.data_model = r.data_model),"""
        k = str(int(quorum))
    loads = "description NOT IN (" + ", ".join(f"'{x}'" for x in broken) + ")" if broken else "true"
    logit = "list_sum(list_transform(wvals, lambda x: CAST(x AS DOUBLE))) / width - thr"
    if weighted:
        logit = ("list_sum(list_transform(range(1, CAST(width AS BIGINT) + 1), lambda i: CAST(wvals[i] AS DOUBLE) * "
                 "(2.0::DOUBLE * i / (width * (width + 1))))) + (-thr)")
    return f"""WITH
reg0 AS ({demo.registry_sql(rows)}),
known AS (SELECT *, {loads} AND model_type = 0 AS serves, data_type || '-' || replace(name, ' ', '_') AS data_model, registered_at AS version FROM reg0
          QUALIFY row_number() OVER (PARTITION BY data_type, name, registered_at ORDER BY description DESC) = 1),
reg AS (SELECT * FROM known k
        WHERE serves OR NOT EXISTS (
            SELECT 1 FROM known s WHERE s.data_model = k.data_model AND s.serves
                                    AND s.registered_at < k.registered_at)),
cfg AS ({demo.config_sql()}),
meas AS (SELECT {event_id} AS event_id, ts, event_type AS data_type, value AS utilization,
                CAST(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80 THEN 1 ELSE 0 END AS INTEGER) AS label
         FROM events),
firsts AS (SELECT data_type, data_model, min(registered_at) AS first_at FROM known GROUP BY data_type, data_model),
nm AS (SELECT m.event_id, CAST(count(f.data_model) AS INTEGER) AS n_models,
              string_agg(f.data_model, ',' ORDER BY f.first_at, f.data_model) AS models
       FROM meas m LEFT JOIN firsts f ON f.data_type = m.data_type AND f.first_at <= m.ts
       GROUP BY m.event_id),
tmo AS (SELECT m.event_id, CAST(coalesce(nullif(c.tmout_ms, 0), {DEFAULT_TIMEOUT_MS}) AS BIGINT) AS timeout_ms
        FROM meas m ASOF LEFT JOIN cfg c ON m.data_type = c.data_type AND m.ts >= c.effective_at),
fan AS (SELECT m.*, f.data_model FROM meas m JOIN firsts f ON f.data_type = m.data_type AND f.first_at <= m.ts),
req AS (SELECT q.*, v.version, v.description, v.model_type, v.width, v.mean, v.std, v.thr, v.ord, v.serves
        FROM fan q ASOF JOIN reg v ON q.data_model = v.data_model AND q.ts >= v.registered_at),
win AS (SELECT r.*, list(CAST((utilization - mean) / nullif(std, 0) AS FLOAT)) OVER (
            PARTITION BY data_model, version ORDER BY ts, event_id
            ROWS BETWEEN {MAX_WIDTH - 1} PRECEDING AND CURRENT ROW) AS lst
        FROM req r),
w2 AS (SELECT *, CASE WHEN len(lst) >= width THEN lst[len(lst) - width + 1:] END AS wvals FROM win),
w3 AS (SELECT *, CASE WHEN wvals IS NULL OR list_count(wvals) < len(wvals) THEN NULL
                      ELSE {logit} END AS p1
       FROM w2),
ans AS (SELECT s.*,
               CAST(CASE WHEN p1 IS NULL THEN NULL WHEN isnan(p1) THEN 1 WHEN 0 >= p1 THEN 0 ELSE 1 END AS INTEGER) AS result,
               s.serves AS answered,
               CASE WHEN s.serves THEN CAST({demo.LATENCY_SQL} AS BIGINT) END AS latency_ms,
               t.timeout_ms, n.n_models
        FROM w3 s JOIN tmo t USING (event_id) JOIN nm n USING (event_id)),{came}{counted}
agg AS (SELECT event_id, count(*) FILTER (WHERE counted) AS n_cnt,
               sum(coalesce(result, 0)) FILTER (WHERE counted) AS ones,
               max(latency_ms) FILTER (WHERE counted) AS last_ms
        FROM cnt GROUP BY event_id),
results AS (
  SELECT sha256(CAST(m.event_id AS VARCHAR)) AS guid, m.event_id, m.data_type, m.ts, n.n_models,
         (n.n_models > 0 AND coalesce(a.n_cnt, 0) > 0) AS processed,
         CASE WHEN processed THEN 'voter model' ELSE '' END AS model,
         CAST(CASE WHEN processed THEN m.label ELSE 0 END AS INTEGER) AS source,
         CAST(CASE WHEN processed THEN (CASE WHEN ones / n_cnt < 0.5 THEN 0 ELSE 1 END) END AS INTEGER) AS result,
         CAST(CASE WHEN processed AND n_cnt >= {k} THEN last_ms WHEN processed THEN t.timeout_ms ELSE 0 END AS BIGINT) AS duration_ms,
         CASE WHEN n.n_models = 0 THEN 'no_model' WHEN processed AND n_cnt >= {k} THEN 'complete'
              WHEN processed THEN 'deadline' ELSE 'timeout' END AS outcome
  FROM meas m JOIN nm n ON m.event_id = n.event_id JOIN tmo t ON m.event_id = t.event_id
  LEFT JOIN agg a ON m.event_id = a.event_id)
"""


RESULT_COLS = "guid, event_id, data_type, ts, n_models, processed, model, source, result, duration_ms, outcome"

_MICRO = "array_to_string(list_transform(wvals, lambda x: coalesce(CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR), 'null')), ',')"

# How the decode test corrupts payloads, by props.k
BAD_TRUNCATE_K, BAD_TYPE_K, BAD_EMPTY_K, TRUNCATE_AT = 95, 90, 89, 12

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_LABEL = f"CAST(CASE WHEN {_K} >= 80 THEN 1 ELSE 0 END AS INTEGER)"

ENSEMBLE_SLICES = (("a", 1, 8), ("b", 9, 8), ("c", 17, 8))


def _ensemble_sql() -> str:
    sums = ", ".join(
        f"list_sum(list_transform(list_slice(embedding, {s}, {s + n - 1}), lambda x: CAST(x AS DOUBLE))) AS s_{name}, "
        f"list_count(list_slice(embedding, {s}, {s + n - 1})) = {n} AS ok_{name}"
        for name, s, n in ENSEMBLE_SLICES)
    cls = ", ".join(
        f"CAST(CASE WHEN NOT ok_{name} OR s_{name} IS NULL THEN NULL WHEN isnan(s_{name}) THEN 1 "
        f"WHEN 0 >= s_{name} THEN 0 ELSE 1 END AS INTEGER) AS {name}"
        for name, _, _ in ENSEMBLE_SLICES)
    mean = " + ".join(f"coalesce({name}, 0)" for name, _, _ in ENSEMBLE_SLICES)
    names = ", ".join(n for n, _, _ in ENSEMBLE_SLICES)
    return f"""SELECT vec_id, {names},
       CAST(CASE WHEN ({mean}) / {len(ENSEMBLE_SLICES)}.0 < 0.5 THEN 0 ELSE 1 END AS INTEGER) AS result,
       'voter model' AS model, CAST(label % 2 AS INTEGER) AS source
FROM (SELECT vec_id, label, {cls} FROM (SELECT vec_id, label, {sums} FROM embeddings))"""


def _decode_sql(which: str) -> str:
    if which == "good":
        return f"""SELECT event_id, value AS utilization, {_LABEL} AS label, event_type AS data_type
FROM events WHERE {_K} < {BAD_EMPTY_K}"""
    bad_len = (f"CASE WHEN {_K} >= {BAD_TRUNCATE_K} THEN {TRUNCATE_AT} "
               f"WHEN {_K} >= {BAD_TYPE_K} THEN length('{{\"utilization\":\"n/a\",\"class\":' || {_LABEL} || "
               f"',\"dataType\":\"' || event_type || '\"}}') ELSE 0 END")
    return f"""SELECT event_id, CAST({bad_len} AS INTEGER) AS n_bytes
FROM events WHERE {_K} >= {BAD_EMPTY_K}"""


def queries() -> dict[str, str]:
    b = _base()
    ans_cols = "event_id, data_model"
    q = {
        "request_ids": "SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS guid FROM events",
        "known_models": b + "SELECT m.event_id, m.data_type, n.n_models, n.models FROM meas m JOIN nm n ON m.event_id = n.event_id",
        "route_fanout": b + f"SELECT {ans_cols} FROM fan",
        "route_starts": b + "SELECT sha256(CAST(m.event_id AS VARCHAR)) AS guid, m.event_id, m.data_type, m.ts, n.n_models FROM meas m JOIN nm n ON m.event_id = n.event_id WHERE n.n_models > 0",
        "no_model_rows": b + "SELECT m.event_id, m.data_type, m.ts FROM meas m JOIN nm n ON m.event_id = n.event_id WHERE n.n_models = 0",
        "active_version": b + f"SELECT {ans_cols}, version, description FROM req",
        "effective_timeout": b + "SELECT m.event_id, m.data_type, t.timeout_ms FROM meas m JOIN tmo t ON m.event_id = t.event_id",
        "servable_requests": b + f"SELECT {ans_cols}, model_type FROM req WHERE model_type IN (0)",
        "last_n_window": b + f"SELECT {ans_cols}, width, {_MICRO} AS window_micro FROM ans WHERE answered",
        "score_linear": b + f"SELECT {ans_cols}, true AS processed, description AS model, label AS source, result FROM ans WHERE answered",
        "responses_in_time": b + f"SELECT {ans_cols}, latency_ms, result FROM cnt WHERE counted",
        "late_responses": b + f"SELECT {ans_cols}, latency_ms FROM cnt WHERE answered AND NOT counted",
        "vote_all": b + f"SELECT {RESULT_COLS} FROM results",
        "serve": b + f"SELECT {RESULT_COLS} FROM results",
        "python_decider": b + f"SELECT {RESULT_COLS} FROM results",
        "model_stats": b + """SELECT data_model, version, count(*) AS usage, CAST(sum(latency_ms) AS BIGINT) AS duration_ms,
       min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(sum(latency_ms) / count(*), 6) AS avg_ms
FROM ans WHERE answered GROUP BY data_model, version""",
        "model_report": b + """, st AS (SELECT data_model, version, count(*) AS usage, CAST(sum(latency_ms) AS BIGINT) AS duration_ms,
       min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(sum(latency_ms) / count(*), 6) AS avg_ms
FROM ans WHERE answered GROUP BY data_model, version)
SELECT * FROM st WHERE (data_model, version) IN (SELECT data_model, max(version) FROM st GROUP BY data_model)""",
        "collector_stats": b + f""", cur AS (SELECT data_type, arg_max(tmout_ms, effective_at) AS t FROM cfg GROUP BY data_type)
SELECT r.data_type, count(*) AS usage, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, min(duration_ms) AS min_ms,
       max(duration_ms) AS max_ms, round(sum(duration_ms) / count(*), 6) AS avg_ms,
       CAST(coalesce(nullif(any_value(cur.t), 0), {DEFAULT_TIMEOUT_MS}) AS BIGINT) AS tmout_ms
FROM results r LEFT JOIN cur ON r.data_type = cur.data_type WHERE processed GROUP BY r.data_type""",
        "serving_lines": b + """SELECT event_id, CASE WHEN NOT processed THEN 'No model available - skipping'
    WHEN result IS NOT NULL THEN 'Using model ' || model || '. Calculated result ' || result || ', expected ' || source || ' calculated in ' || duration_ms || ' ms' END AS line
FROM results""",
        "result_vs_expected": b + "SELECT event_id, result, source, (result = source) AS correct FROM results WHERE processed",
        "encoded_results": b + """SELECT event_id, CASE WHEN result IS NULL THEN '{}' ELSE json_object('served', result)::VARCHAR END AS payload FROM results""",
        "ensemble_embeddings": _ensemble_sql(),
        "decode_good_rows": _decode_sql("good"),
        "decode_quarantine": _decode_sql("bad"),
    }
    q["version_intervals"] = b + """, iv AS (SELECT data_model, registered_at AS vf,
       lead(registered_at) OVER (PARTITION BY data_model ORDER BY registered_at, description) AS vt FROM reg)
SELECT r.event_id, r.data_model, iv.vf AS valid_from, iv.vt AS valid_to
FROM req r JOIN iv ON r.data_model = iv.data_model AND r.version = iv.vf"""
    q["state_report"] = b + f""", cur AS (SELECT data_type, arg_max(tmout_ms, effective_at) AS t FROM cfg GROUP BY data_type),
km AS (SELECT data_type, string_agg(data_model, ',' ORDER BY first_at, data_model) AS models,
              CAST(count(*) AS INTEGER) AS n_models FROM firsts GROUP BY data_type),
st AS (SELECT r.data_type, count(*) AS usage, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, min(duration_ms) AS min_ms,
       max(duration_ms) AS max_ms, round(sum(duration_ms) / count(*), 6) AS avg_ms,
       CAST(coalesce(nullif(any_value(cur.t), 0), {DEFAULT_TIMEOUT_MS}) AS BIGINT) AS tmout_ms
       FROM results r LEFT JOIN cur ON r.data_type = cur.data_type WHERE processed GROUP BY r.data_type)
SELECT st.data_type, km.models, km.n_models, usage, duration_ms, min_ms, max_ms, avg_ms, tmout_ms
FROM st LEFT JOIN km ON st.data_type = km.data_type"""
    q["replayed_registry"] = (_base(rows=demo.REPLAYED_ROWS) +
                              f"SELECT {RESULT_COLS} FROM results")
    q["multi_partition_results"] = _base(event_id=(
        f"(event_id % {LOG_PARTITIONS}) * {PARTITION_STEP} + event_id // {LOG_PARTITIONS}")) + \
        f"SELECT {RESULT_COLS} FROM results"
    others = RESULT_COLS.replace(", result,", f", CAST(CASE WHEN processed THEN coalesce(f.chosen, 0) END AS INTEGER) AS result,").replace("event_id,", "r.event_id,")
    q["custom_decider"] = b + f""", f AS (SELECT event_id, arg_min(result, (latency_ms, data_model)) AS chosen FROM cnt
    WHERE counted AND result IS NOT NULL GROUP BY event_id)
SELECT {others} FROM results r LEFT JOIN f ON f.event_id = r.event_id"""
    weight = "CASE data_model " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in DECIDER_WEIGHTS.items()) + f" ELSE {OTHER_WEIGHT} END"
    q["weighted_decider"] = _base(2) + f""", f AS (SELECT event_id,
    CASE WHEN coalesce(sum(CAST({weight} AS DOUBLE) * coalesce(result, 0)) / nullif(sum(CAST({weight} AS DOUBLE)), 0), 0) < 0.5 THEN 0 ELSE 1 END AS chosen
    FROM cnt WHERE counted GROUP BY event_id)
SELECT {others} FROM results r LEFT JOIN f ON f.event_id = r.event_id"""
    q["collected_responses"] = _base(outside=True) + f"SELECT {RESULT_COLS} FROM results"
    q["collected_quorum_1"] = _base(1, outside=True) + f"SELECT {RESULT_COLS} FROM results"
    q["late_outside_responses"] = _base(1, outside=True) + "SELECT event_id, data_model, latency_ms FROM cnt WHERE NOT counted"
    q["unknown_responses"] = b + f"""SELECT sha256(CAST(event_id + {ASTRAY_BY} AS VARCHAR)) AS guid, data_model, result, 'no_request' AS reason
FROM ans WHERE answered AND event_id % {ASTRAY_EVERY} = 0
UNION ALL SELECT CAST(NULL AS VARCHAR), data_model, result, 'incomplete' FROM ans WHERE answered AND event_id % {NAMELESS_EVERY} = 0"""
    scored = f"SELECT {ans_cols}, true AS processed, description AS model, label AS source, result FROM ans WHERE answered"
    broken = _base(rows=demo.BROKEN_ROWS, broken=demo.BROKEN, weighted=True)
    q["score_weighted"] = _base(weighted=True) + scored
    q["score_payload_model"] = broken + scored
    q["failing_payload_results"] = broken + f"SELECT {RESULT_COLS} FROM results"
    q["measured_usage"] = broken + """SELECT data_model, version, count(*) AS usage, count(result) > 0 AS measured
FROM ans WHERE answered GROUP BY data_model, version"""
    q["score_python_model"] = q["score_linear"]
    q["stream_reports"] = q["model_stats"]
    q["stream_payload_results"] = q["failing_payload_results"]
    q["serve_stream"] = q["serve"]
    q["serve_stateful"] = q["serve"]
    for k in (1, 2):
        bk = _base(k)
        q[f"vote_quorum_{k}"] = bk + f"SELECT {RESULT_COLS} FROM results"
    q["arrival_rank"] = _base(1) + "SELECT event_id, data_model, arrival_rank FROM ranked"
    return q
