"""Model files (S7) and log round trip."""

import os

from quorum import schemas
from quorum.session import work_dir
from quorum.sources.logs import LogConfig, as_log, read_log_batch, write_log
from quorum.sources.model_files import (decode_preprocessing, encode_container, encode_preprocessing,
                                       read_model_dir)


def test_model_dir_decode_and_quarantine(spark):
    root = work_dir(spark, "models").replace("file:", "")
    with open(os.path.join(root, "a.model"), "wb") as f:
        f.write(encode_container("m 3", "long", "cpu", {"width": 8, "mean": 49.0, "std": 48.0},
                                 b"\x00\x01graph"))
    with open(os.path.join(root, "b.model"), "wb") as f:
        f.write(b"\x00\x00\x00\x00\x00\x00\xff\xffbroken")
    good, bad = read_model_dir(spark, root)
    g = good.collect()
    assert len(g) == 1 and g[0]["name"] == "m_3" and g[0]["width"] == 8 and g[0]["std"] == 48.0
    assert g[0]["graph"] == b"\x00\x01graph"
    assert bad.count() == 1


def test_log_round_trip(spark):
    cfg = LogConfig(root=work_dir(spark, "logs"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "v string, o long")
    write_log(as_log(df, "t", value="v", offset="o"), cfg, "t")
    back = read_log_batch(spark, cfg, "t")
    assert back.schema == schemas.LOG
    assert sorted((bytes(r["value"]).decode(), r["offset"]) for r in back.collect()) == [("a", 1), ("b", 2)]


def test_tail_log_hands_every_batch_to_handler(spark):
    from quorum.sources.logs import read_log, tail_log
    cfg = LogConfig(root=work_dir(spark, "tail"))
    for i in range(2):
        df = spark.createDataFrame([(f"x{i}{j}", i * 10 + j) for j in range(3)], "v string, o long")
        write_log(as_log(df.coalesce(1), "t", value="v", offset="o"), cfg, "t")
    seen = []
    q = tail_log(read_log(spark, cfg, "t", start="earliest", max_files_per_trigger=1),
                 lambda df, bid: seen.append((bid, df.count())),
                 checkpoint=work_dir(spark, "tail-ckpt"), trigger={"availableNow": True})
    q.awaitTermination()
    assert sum(n for _, n in seen) == 6 and len(seen) == 2


def test_write_results_parquet(spark):
    from quorum.sources.logs import write_results
    from quorum import schemas
    path = work_dir(spark, "results")
    df = spark.createDataFrame([("g", 1, "cpu", None, 1, True, "voter model", 0, 1, 5, "complete")],
                               schemas.RESULTS)
    write_results(df, path)
    assert spark.read.parquet(path).count() == 1


def test_model_files_with_proto_records(spark):
    """A container as the publisher writes it: the record is a proto3 message."""
    root = work_dir(spark, "proto-models").replace("file:", "")
    record = b"\x08\x08" + b"\x11" + b"\x00" * 6 + b"\x48\x40" + b"\x19" + b"\x00" * 6 + b"\x28\x40" + b"\x22\x05dense" + b"\x2a\x07softmax"
    assert record == encode_preprocessing(8, 48.0, 12.0, "dense", "softmax")
    for name, raw in (("a", record), ("b", b""), ("c", record[:-3]), ("d", b"\x09" + b"\x00" * 8)):
        with open(os.path.join(root, f"{name}.model"), "wb") as f:
            f.write(encode_container(f"m {name}", "d", "cpu", raw, b"graph"))
    good, bad = read_model_dir(spark, root)
    got = {r.name: r for r in good.collect()}
    assert set(got) == {"m_a", "m_b"} and bad.count() == 2        # cut short; width of a wrong wire type
    r = got["m_a"]
    assert (r.width, r.mean, r.std, r.input, r.output, bytes(r.payload)) == (8, 48.0, 12.0, "dense", "softmax", b"graph")
    assert (got["m_b"].width, got["m_b"].mean) == (0, 0.0)        # defaults


def test_preprocessing_records():
    assert decode_preprocessing(encode_preprocessing(-1, -2.5, 1e300, "ü", "")) == {
        "width": -1, "mean": -2.5, "std": 1e300, "input": "ü", "output": ""}
    # unknown fields are passed over; of a repeated field the last holds
    assert decode_preprocessing(b"\x08\x01\x30\x96\x01\x3a\x01x\x45\x00\x00\x00\x00\x08\x02")["width"] == 2


def test_folder_log_from_its_latest_position(spark):
    """Files present at the first start are not read, nor after a restart; later ones are."""
    import time
    from quorum.sources.logs import read_log
    cfg, ckpt, out = LogConfig(root=work_dir(spark, "latest")), work_dir(spark, "latest-ckpt"), work_dir(spark, "latest-out")

    def publish(i):
        df = spark.createDataFrame([(f"x{i}", i)], "v string, o long")
        write_log(as_log(df.coalesce(1), "mdata", value="v", offset="o"), cfg, "mdata")

    def run():
        q = (read_log(spark, cfg, "mdata", start="latest", position=f"{ckpt}/start").writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", f"{ckpt}/q").trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(r.offset for r in spark.read.schema(schemas.LOG).parquet(out).collect())

    publish(1)
    publish(2)
    time.sleep(1.1)
    assert run() == []
    time.sleep(1.1)
    publish(3)
    assert run() == [3]
    time.sleep(1.1)
    publish(4)
    assert run() == [3, 4]
