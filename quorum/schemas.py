"""Record schemas, declared up front (nothing is inferred)."""

from pyspark.sql import types as T

# Wire records -------------------------------------------------------------

# measurement payload (fields as on the wire)
MEASUREMENT_WIRE = T.StructType([
    T.StructField("utilization", T.DoubleType()),
    T.StructField("class", T.IntegerType()),
    T.StructField("dataType", T.StringType()),
])

PREPROCESSING_WIRE = T.StructType([
    T.StructField("width", T.IntegerType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

MODEL_WIRE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("dataType", T.StringType()),
    T.StructField("modeltype", T.IntegerType()),
    T.StructField("data", T.StringType()),       # base64 payload (oneof data)
    T.StructField("location", T.StringType()),   # oneof location
    T.StructField("preprocessing", PREPROCESSING_WIRE),
    # scoring parameters of the built-in linear scorer travel with the model
    T.StructField("thr", T.DoubleType()),
    T.StructField("registeredAt", T.StringType()),
    # optional position of the model among those of its type (demo latency)
    T.StructField("ord", T.IntegerType()),
])

CONFIG_WIRE = T.StructType([
    T.StructField("datatype", T.StringType()),
    T.StructField("tmout", T.LongType()),
    T.StructField("effectiveAt", T.StringType()),
])

# Log source columns (same as a Kafka source row) ---------------------------
LOG = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Internal records ----------------------------------------------------------
MEASUREMENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("utilization", T.DoubleType()),
    T.StructField("label", T.IntegerType()),
])

REGISTRY = T.StructType([
    T.StructField("data_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("model_type", T.IntegerType()),
    T.StructField("registered_at", T.TimestampNTZType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("thr", T.DoubleType()),
    T.StructField("ord", T.IntegerType()),
])

# the registry as the stream keeps it: with the payload and the message's place in the log
REGISTRY_LOG = T.StructType(REGISTRY.fields + [T.StructField("log_pos", T.LongType()),
                                               T.StructField("payload", T.BinaryType()),
                                               T.StructField("loads", T.BooleanType())])

CONFIG = T.StructType([
    T.StructField("data_type", T.StringType()),
    T.StructField("tmout_ms", T.LongType()),
    T.StructField("effective_at", T.TimestampNTZType()),
])

RESULTS = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("n_models", T.IntegerType()),
    T.StructField("processed", T.BooleanType()),
    T.StructField("model", T.StringType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("result", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("outcome", T.StringType()),
])
