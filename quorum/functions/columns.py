"""Scalar column builders (all built-in, JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text of the serving lines and the voter's model name
VOTER_MODEL = "voter model"
LINE_RESULT = "Using model %s. Calculated result %s, expected %s calculated in %s ms"
LINE_NO_MODEL = "No model available - skipping"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def model_name(name) -> Column:
    """Blanks in a model name become underscores."""
    return F.replace(_c(name), F.lit(" "), F.lit("_"))


def data_model_key(data_type, name) -> Column:
    """Composite model key ``<data_type>-<name>`` (P5)."""
    return F.concat_ws("-", _c(data_type), model_name(name))


def request_guid(*cols) -> Column:
    """Deterministic request id (P6): SHA-256 of the source position.

    A random uuid would change when a task is retried, so the id is a hash."""
    parts = [_c(c).cast("string") for c in cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.sha2(key, 256)


def source_id(partition="partition", offset="offset") -> Column:
    """Position in a topic as one number: ``partition * 2**44 + offset``, so that
    offsets of different partitions never meet.  A partition above 2**19 or
    an offset above 2**44 has no number and stops the job."""
    p, o = F.coalesce(_c(partition), F.lit(0)).cast("long"), _c(offset).cast("long")
    fits = (p >= 0) & (p < F.lit(1 << 19)) & (o >= 0) & (o < F.lit(1 << 44))
    return (F.when(o.isNull() | fits, p * F.lit(1 << 44) + o)
            .otherwise(F.raise_error(F.lit("log position out of range")).cast("long")))


def standardize(value, mean, std) -> Column:
    """``((v - mean) / std)`` as float; NULL when std is 0."""
    return F.try_divide(_c(value) - _c(mean), _c(std)).cast("float")


def argmax2(p0, p1) -> Column:
    """Two-class arg-max (P9): NaN in either logit -> 1, tie -> 0, NULL -> NULL."""
    p0, p1 = _c(p0), _c(p1)
    return (F.when(p0.isNull() | p1.isNull(), F.lit(None).cast("int"))
            .when(F.isnan(p0) | F.isnan(p1), F.lit(1))
            .when(p0 >= p1, F.lit(0))
            .otherwise(F.lit(1)))


def serving_line(processed="processed", model="model", result="result",
                 source="source", duration="duration_ms") -> Column:
    """Text line per result (P10); NULL for processed-without-result."""
    return (F.when(~_c(processed), F.lit(LINE_NO_MODEL))
            .when(_c(result).isNotNull(),
                  F.format_string(LINE_RESULT, _c(model), _c(result).cast("string"),
                                  _c(source).cast("string"), _c(duration).cast("string"))))


def encode_result(result="result") -> Column:
    """Wire form of a result (P11): JSON ``{"served": r}``."""
    return F.to_json(F.struct(_c(result).alias("served")))


def decode_result(payload) -> Column:
    return F.from_json(_c(payload).cast("string"), "served int").getField("served")

