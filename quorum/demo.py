"""The inline model registry, timeout config and answer-latency rule used by
the test queries (FIXTURES.md sections 3 and 4).

The measurements themselves always come from the given ``events`` table;
these rows only play the part of the model and config topics.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum import schemas

# Fixed values (FIXTURES.md section 3): model versions
# (data_type, name, description, model_type, registered_at, width, mean, std, thr, ord)
REGISTRY_ROWS = [
    ("click", "m1", "click short", 0, "2024-01-01", 1, 50.0, 50.0, 0.0, 1),
    ("click", "m1", "click short v2", 0, "2024-01-15", 2, 50.0, 50.0, 0.1, 1),
    ("click", "m2", "click mid", 0, "2024-01-10", 4, 50.0, 25.0, 0.2, 2),
    ("click", "m 3", "click long", 0, "2024-01-01", 8, 49.0, 48.0, 0.0, 3),
    ("error", "m1", "error only", 0, "2024-01-01", 3, 50.0, 50.0, 0.0, 1),
    ("error", "m2", "error flat", 0, "2024-01-01", 1, 50.0, 0.0, 0.0, 2),
    ("purchase", "m1", "purchase a", 0, "2024-01-01", 1, 50.0, 50.0, 0.0, 1),
    ("purchase", "p2", "purchase pmml", 1, "2024-01-01", 1, 50.0, 50.0, 0.0, 2),
    ("view", "m1", "view late", 0, "2024-01-16", 2, 50.0, 50.0, 0.0, 1),
    ("view", "m1", "view late", 0, "2024-01-20", 2, 50.0, 50.0, 0.0, 1),
]

# The same registry as a publisher with retries leaves it: a message delivered
# twice, two versions at one time (the later line holds), and versions of a
# type without a scorer registered over versions that serve
REPLAYED_ROWS = REGISTRY_ROWS + [
    ("click", "m1", "click short v2", 0, "2024-01-15", 2, 50.0, 50.0, 0.1, 1),
    ("click", "m2", "click mid", 0, "2024-01-10", 4, 50.0, 25.0, 0.2, 2),
    ("click", "m2", "click mid, tie", 0, "2024-01-10", 4, 50.0, 25.0, -0.4, 2),
    ("error", "m1", "error pmml", 1, "2024-01-10", 3, 50.0, 50.0, 0.0, 1),
    ("view", "m1", "view pmml", 1, "2024-01-18", 2, 50.0, 50.0, 0.0, 1),
    ("purchase", "p2", "purchase p2 served", 0, "2024-01-12", 2, 50.0, 50.0, 0.0, 2),
]

# Versions whose payload does not load, registered over (or before) ones that serve
BROKEN_ROWS = REGISTRY_ROWS + [
    ("click", "m1", "click broken", 0, "2024-01-18", 2, 50.0, 50.0, 0.1, 1),
    ("click", "m2", "click mended", 0, "2024-01-19", 3, 50.0, 25.0, 0.1, 2),
    ("error", "m3", "error never loads", 0, "2024-01-05", 3, 50.0, 50.0, 0.0, 3),
]
BROKEN = ("click broken", "error never loads")


def weights_of(width: int) -> list[float]:
    """Rising weights that sum to one: the model in the payload."""
    return [2.0 * i / (width * (width + 1)) for i in range(1, width + 1)]


def payload_of(row) -> bytes:
    """Little-endian doubles: bias and weights; cut short for the broken versions."""
    raw = struct.pack(f"<{1 + row[5]}d", -row[8], *weights_of(row[5]))
    return raw[:-3] if row[2] in BROKEN else raw


# Fixed values (FIXTURES.md section 4): timeout config
# (data_type, tmout_ms, effective_at)
CONFIG_ROWS = [
    ("click", 100, "2024-01-01"),
    ("click", 200, "2024-01-20"),
    ("error", 0, "2024-01-01"),
    ("ghost", 50, "2024-01-01"),
]

# Fixed values (FIXTURES.md section 4): simulated answer latency in ms,
# (event_id * 31 + ord * 77) % 300
LATENCY_A, LATENCY_B, LATENCY_MOD = 31, 77, 300


def _values(spark: SparkSession, rows_sql: str, schema) -> DataFrame:
    """A VALUES list as a JVM-side local relation (no Python rows), cast to
    ``schema``; Spark knows its exact size."""
    df = spark.sql(rows_sql)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def registry(spark: SparkSession, rows=REGISTRY_ROWS) -> DataFrame:
    vals = ", ".join(
        f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}, TIMESTAMP_NTZ '{r[4]} 00:00:00', "
        f"{r[5]}, {r[6]}D, {r[7]}D, {r[8]}D, {r[9]})" for r in rows)
    names = ", ".join(f.name for f in schemas.REGISTRY.fields)
    return _values(spark, f"SELECT * FROM VALUES {vals} AS t({names})", schemas.REGISTRY)


def payload_registry(spark: SparkSession, rows=BROKEN_ROWS) -> DataFrame:
    """The registry with a payload a version."""
    raw = ", ".join(f"('{r[0]}', '{r[1]}', TIMESTAMP_NTZ '{r[4]} 00:00:00', X'{payload_of(r).hex()}')" for r in rows)
    sent = spark.sql(f"SELECT * FROM VALUES {raw} AS t(data_type, name, registered_at, payload)")
    return registry(spark, rows).join(F.broadcast(sent), ["data_type", "name", "registered_at"])


def config(spark: SparkSession) -> DataFrame:
    vals = ", ".join(f"('{a}', {b}L, TIMESTAMP_NTZ '{c} 00:00:00')" for a, b, c in CONFIG_ROWS)
    names = ", ".join(f.name for f in schemas.CONFIG.fields)
    return _values(spark, f"SELECT * FROM VALUES {vals} AS t({names})", schemas.CONFIG)


def latency() -> Column:
    """Answer latency of a request row (needs ``event_id`` and ``ord``)."""
    return ((F.col("event_id") * LATENCY_A + F.col("ord") * LATENCY_B)
            % LATENCY_MOD).cast("long")


# SQL renderings of the same rows, for the DuckDB oracle ---------------------

def registry_sql(rows=REGISTRY_ROWS) -> str:
    vals = ",\n    ".join(
        f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}, TIMESTAMP '{r[4]} 00:00:00', "
        f"{r[5]}, {r[6]}, {r[7]}, {r[8]}, {r[9]})" for r in rows)
    return (f"SELECT * FROM (VALUES\n    {vals}) AS t(data_type, name, description, "
            "model_type, registered_at, width, mean, std, thr, ord)")


def config_sql() -> str:
    vals = ", ".join(f"('{a}', {b}, TIMESTAMP '{c} 00:00:00')" for a, b, c in CONFIG_ROWS)
    return f"SELECT * FROM (VALUES {vals}) AS t(data_type, tmout_ms, effective_at)"


LATENCY_SQL = f"((event_id * {LATENCY_A} + ord * {LATENCY_B}) % {LATENCY_MOD})"
