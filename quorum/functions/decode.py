"""Decoding wire records and quarantining bad ones.

Payloads arrive as ``value`` bytes in log-shaped rows.  ``fmt="json"`` (the
default here) decodes with ``from_json`` in PERMISSIVE mode with a corrupt-
record column: a malformed or wrong-typed payload gives a non-NULL
``_corrupt_record``; empty or NULL input gives a NULL struct.  Both are bad.
``fmt="protobuf"`` uses ``from_protobuf`` (needs the spark-protobuf package
on the cluster and a descriptor file).  Proto3 defaults apply to fields that
are missing: 0, 0.0 or "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum import schemas
from quorum.functions.columns import model_name

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def _parse(value: Column, schema: T.StructType, fmt: str, message: str | None,
           desc_file: str | None) -> tuple[Column, Column]:
    """Return (parsed struct, is_bad)."""
    if fmt == "json":
        text = value.cast("string")
        parsed = F.from_json(text, _with_corrupt(schema),
                             {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        bad = parsed.isNull() | parsed[CORRUPT].isNotNull()
        return parsed, bad
    if fmt == "protobuf":  # pragma: no cover - jar not in the test image
        from pyspark.sql.protobuf.functions import from_protobuf
        parsed = from_protobuf(value, message, descFilePath=desc_file,
                               options={"mode": "PERMISSIVE"})
        return parsed, parsed.isNull()
    raise ValueError(f"unknown format {fmt!r}")


def _source_cols(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "value"]


def decode_measurements(raw: DataFrame, fmt: str = "json", desc_file: str | None = None) -> DataFrame:
    """Log rows -> measurement columns + ``_bad`` flag (P1).  Missing fields
    take proto3 defaults.  ``fmt``: ``json`` or ``protobuf`` (spark-protobuf package)."""
    p, bad = _parse(F.col("value"), schemas.MEASUREMENT_WIRE, fmt, "CPUData", desc_file)
    return raw.select(
        *_source_cols(raw), "value",
        F.coalesce(p["utilization"], F.lit(0.0)).alias("utilization"),
        F.coalesce(p["class"], F.lit(0)).alias("label"),
        F.coalesce(p["dataType"], F.lit("")).alias("data_type"),
        bad.alias("_bad"),
    )


def decode_models(raw: DataFrame, fmt: str = "json", desc_file: str | None = None) -> DataFrame:
    """Log rows -> registry rows (P2): blanks in names become ``_``, the
    preprocessing block is flattened; a descriptor without model data is bad
    (by location only, or neither)."""
    p, bad = _parse(F.col("value"), schemas.MODEL_WIRE, fmt, "ModelDescriptor", desc_file)
    pre = p["preprocessing"]
    reg_at = F.coalesce(F.to_timestamp_ntz(p["registeredAt"]),
                        F.col("timestamp").cast("timestamp_ntz")) \
        if "timestamp" in raw.columns else F.to_timestamp_ntz(p["registeredAt"])
    return raw.select(
        *_source_cols(raw), "value",
        F.coalesce(p["dataType"], F.lit("")).alias("data_type"),
        model_name(F.coalesce(p["name"], F.lit(""))).alias("name"),
        F.coalesce(p["description"], F.lit("")).alias("description"),
        F.coalesce(p["modeltype"], F.lit(0)).alias("model_type"),
        reg_at.alias("registered_at"),
        F.coalesce(pre["width"], F.lit(0)).alias("width"),
        F.coalesce(pre["mean"], F.lit(0.0)).alias("mean"),
        F.coalesce(pre["std"], F.lit(0.0)).alias("std"),
        F.coalesce(p["thr"], F.lit(0.0)).alias("thr"),
        F.coalesce(p["ord"], F.lit(0)).alias("ord"),
        F.coalesce(pre["input"], F.lit("")).alias("input"),
        F.coalesce(pre["output"], F.lit("")).alias("output"),
        # base64 text in JSON, bytes in protobuf
        (F.try_to_binary(p["data"], F.lit("base64")) if fmt == "json" else p["data"]).alias("payload"),
        (bad | p["data"].isNull() | (F.try_to_binary(p["data"], F.lit("base64")).isNull() if fmt == "json" else F.lit(False)))
        .alias("_bad"),
    )


def decode_config(raw: DataFrame, fmt: str = "json", desc_file: str | None = None) -> DataFrame:
    """Log rows -> ``config(data_type, tmout_ms, effective_at)``."""
    p, bad = _parse(F.col("value"), schemas.CONFIG_WIRE, fmt, "SpeculativeDescriptor", desc_file)
    eff = F.to_timestamp_ntz(p["effectiveAt"])
    if "timestamp" in raw.columns:
        eff = F.coalesce(eff, F.col("timestamp").cast("timestamp_ntz"))
    return raw.select(
        *_source_cols(raw), "value",
        F.coalesce(p["datatype"], F.lit("")).alias("data_type"),
        F.coalesce(p["tmout"], F.lit(0)).cast("long").alias("tmout_ms"),
        eff.alias("effective_at"),
        bad.alias("_bad"),
    )


def split_bad(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) (P4).  Good rows lose the raw payload; quarantine
    rows keep source position and payload for inspection."""
    good = decoded.filter(~F.col("_bad")).drop("_bad", "value")
    keep = [c for c in ("key", "topic", "partition", "offset", "timestamp") if c in decoded.columns]
    extra = [c for c in decoded.columns if c not in keep and c not in ("value", "_bad")]
    bad = decoded.filter(F.col("_bad")).select(*keep, *[c for c in extra if c == "event_id"],
                                                 "value",
                                                 F.lit("undecodable payload").alias("error"))
    return good, bad


def encode_measurements(df: DataFrame) -> DataFrame:
    """Measurement rows -> log rows (``value`` = JSON wire record)."""
    return df.select("*", F.to_json(F.struct(
        F.col("utilization"), F.col("label").alias("class"),
        F.col("data_type").alias("dataType"))).cast("binary").alias("value"))
