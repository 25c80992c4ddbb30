"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each set where over half of a text's shingle hashes
have it.  Texts with one fingerprint collapse first.  Among the distinct
fingerprints, a family of structured bit masks guarantees that two
fingerprints within the radius agree on all bits of at least one mask: each
bit position is given a non-zero vector of ``radius + 1`` bits, and mask
``v`` holds the positions whose vector has odd overlap with ``v``; the
vectors of ``radius`` differing positions leave a ``v`` orthogonal to all of
them, so none of these positions is in mask ``v``.

Buckets of up to ``BUCKET`` fingerprints are compared inside; fuller ones are
split again by a covering family over the bits that their mask left free -
pairs within the radius stay together in one of the finer buckets - until the
free bits bound the bucket.  No pair is lost and no group is compared whole.

Defined results: null and empty texts have fingerprint zero, which links like
any other; texts shorter than a shingle are one shingle; repeated rows and
repeated ids share a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import fresh_name, map_batches, numbered, saved
from quorum.llm.components import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text (UTF-8), signed."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], seed) for a, b in
                  zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[k:k + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp",
                      shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and its texts' fingerprints (signed 64-bit)."""
    df = docs.withColumn(out, F.lit(0).cast("long"))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_col)).cast(pa.large_binary())
            fps = pa.array([fingerprint(t.as_py() or b"", shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [fps if c == out else batch.column(i) for i, c in enumerate(names)], names=names)

    return map_batches(df, run, df.schema)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions (signed 64-bit): any ``radius`` of
    the positions are all outside at least one mask."""
    vectors = (1 << (radius + 1)) - 1
    of = {p: 1 + k % vectors for k, p in enumerate(positions)}
    masks = []
    for v in range(1, vectors + 1):
        m = sum(1 << p for p in positions if (of[p] & v).bit_count() % 2)
        masks.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return masks


def _linked(radius: int):
    """Bucket -> links that connect what is within the radius inside it."""
    def run(frames):
        for pdf in frames:
            left, right = [], []
            for members in pdf["members"]:
                x = np.unique(np.asarray(members, dtype=np.int64)).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                todo = np.ones(len(x), dtype=bool)
                for root in range(len(x)):        # a spanning tree per group
                    if not todo[root]:
                        continue
                    todo[root], queue = False, [root]
                    while queue:
                        at = queue.pop()
                        new = np.flatnonzero(near[at] & todo)
                        todo[new] = False
                        left += [x[at]] * len(new)
                        right += x[new].tolist()
                        queue += new.tolist()
            yield pd.DataFrame({"a": np.array(left, dtype=np.uint64).view(np.int64),
                                "b": np.array(right, dtype=np.uint64).view(np.int64)})
    return run


def links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` that connect all
    pairs within ``radius`` bits: pairs in one bucket are joined by a tree of
    true links instead of being listed."""
    if radius == 0:
        return fps.select(F.col(fp).alias("a"), F.col(fp).alias("b")).limit(0)
    members = fps.select(F.col(fp).alias("fp"), F.lit("").alias("path"),
                         F.lit(0).cast("long").alias("mask"))
    found = None
    families = {"": covering_masks(list(range(BITS)), radius)}
    fixed = {"": 0}
    free = BITS
    while families:
        rows = [(p, i, m, fixed[p] | m) for p, masks in families.items()
                for i, m in enumerate(masks)]
        finer = {f"{p}{i:x}.": m for p, i, _, m in rows}
        table = F.create_map(*[x for p, masks in families.items() for x in (
            F.lit(p), F.array(*[F.struct(F.lit(f"{p}{i:x}.").alias("path"),
                                         F.lit(fixed[p] | m).alias("mask"))
                                for i, m in enumerate(masks)]))])
        keyed = (members.select("fp", F.explode(table[F.col("path")]).alias("k"))
                 .select("fp", F.col("k.path").alias("path"), F.col("k.mask").alias("mask"))
                 .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
        free = max(BITS - (m & ((1 << BITS) - 1)).bit_count() for m in finer.values())
        last = 1 << free <= 2 * bucket
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        small = sizes if last else sizes.where(F.col("n") <= bucket)
        groups = (keyed.join(small, ["path", "key"]).groupBy("path", "key")
                  .agg(F.collect_list("fp").alias("members")).select("members"))
        here = groups.mapInPandas(_linked(radius), "a long, b long")
        found = here if found is None else found.union(here)
        if last:
            break
        big = sizes.where(F.col("n") > bucket)
        keys = saved(big, "buckets")
        paths = [r[0] for r in keys.select("path").distinct().collect()]  # names of masks
        if not paths:
            break
        members = keyed.join(keys, ["path", "key"]).select("fp", "path", "mask")
        fixed = {p: finer[p] for p in paths}
        families = {p: covering_masks([i for i in range(BITS) if not finer[p] >> i & 1], radius)
                    for p in paths}
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed) and ``component``, the
    smallest id reachable over links of at most ``radius`` differing bits."""
    rows = saved(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                   "text", "fp", shingle).select("id", "fp"), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    linked = components(links(classes.select("fp"), "fp", radius))
    labelled = classes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component"))
    named = labelled.join(smallest, "label").select("fp", "component")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the
    smallest id (of repeated rows, one).  A null id sorts last."""
    rid = fresh_name(docs, "row_number_")
    rows = numbered(docs, rid)
    ids = rows.select(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"),
                               F.col(rid).alias("r")).alias("id"), F.col(text_col).alias("text"))
    groups = near_duplicates(ids, "id", "text", shingle, radius)
    keep = groups.where(F.col("id") == F.col("component")).select(F.col("id.r").alias(fresh_name(rows, "keep_")))
    return (rows.join(keep, F.col(rid) == F.col(keep.columns[0]), "left_semi")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    d = near_duplicates(docs)
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("component").alias("component_id"))
