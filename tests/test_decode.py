"""Decode / quarantine (P1-P4), result encoding."""

import json

from pyspark.sql import functions as F

from quorum.functions.columns import decode_result, encode_result
from quorum.functions.decode import decode_config, decode_measurements, decode_models, split_bad


def _log(spark, payloads):
    rows = [(None, p.encode() if p is not None else None, "t", 0, i, None)
            for i, p in enumerate(payloads)]
    from quorum import schemas
    return spark.createDataFrame(rows, schemas.LOG)


def test_measurements_good_bad_empty(spark):
    raw = _log(spark, ['{"utilization": 0.5, "class": 1, "dataType": "cpu"}',
                       '{"utilization": "oops", "class": 1, "dataType": "cpu"}',
                       '{"utiliz', "", "{}"])
    good, bad = split_bad(decode_measurements(raw))
    g = good.orderBy("offset").collect()
    assert [(r["offset"], r["utilization"], r["label"], r["data_type"]) for r in g] == \
        [(0, 0.5, 1, "cpu"), (4, 0.0, 0, "")]           # {} = all proto3 defaults
    assert sorted(r["offset"] for r in bad.collect()) == [1, 2, 3]
    assert good.count() + bad.count() == raw.count()


def test_models_flatten_rename_and_location(spark):
    m1 = {"name": "m 3", "description": "d", "dataType": "cpu", "modeltype": 0, "data": "AAE=",
          "preprocessing": {"width": 4, "mean": 1.5, "std": 2.0, "input": "x", "output": "y"},
          "registeredAt": "2024-01-02 00:00:00"}
    m2 = {"name": "loc", "dataType": "cpu", "location": "s3://somewhere"}
    good, bad = split_bad(decode_models(_log(spark, [json.dumps(m1), json.dumps(m2), "nope"])))
    r = good.collect()
    assert len(r) == 1 and r[0]["name"] == "m_3" and r[0]["width"] == 4 and r[0]["std"] == 2.0
    assert str(r[0]["registered_at"]) == "2024-01-02 00:00:00"
    assert bad.count() == 2


def test_config_decode(spark):
    good, bad = split_bad(decode_config(_log(spark, [
        '{"datatype": "cpu", "tmout": 90, "effectiveAt": "2024-01-01 00:00:00"}', "[1"])))
    r = good.collect()
    assert (r[0]["data_type"], r[0]["tmout_ms"]) == ("cpu", 90) and bad.count() == 1


def test_result_round_trip(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "result int")
    enc = df.select(encode_result().alias("p"))
    assert [r[0] for r in enc.collect()] == ['{"served":0}', '{"served":1}', "{}"]
    back = enc.select(decode_result(F.col("p")).alias("r"))
    assert [r[0] for r in back.collect()] == [0, 1, None]



def test_model_payload_and_names_are_decoded(spark):
    import base64
    import json
    from quorum import schemas
    from quorum.functions.decode import decode_models, split_bad
    raw = b"\x00\x01graph"
    rows = [{"name": "m 1", "dataType": "cpu", "data": base64.b64encode(raw).decode(),
             "preprocessing": {"width": 2, "mean": 1.0, "std": 2.0, "input": "x", "output": "y"}},
            {"name": "m2", "dataType": "cpu", "data": "not base64!"}, {"name": "m3", "dataType": "cpu", "location": "there"}]
    log = spark.createDataFrame([(None, json.dumps(r).encode(), "models", 0, i, None) for i, r in enumerate(rows)], schemas.LOG)
    good, bad = split_bad(decode_models(log))
    r, = good.collect()
    assert (r.name, bytes(r.payload), r.input, r.output) == ("m_1", raw, "x", "y") and bad.count() == 2
