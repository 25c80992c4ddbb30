"""Substring dedup by content-defined chunking.

A gear rolling hash runs over each whole text's bytes; where it falls below a
threshold a chunk ends, so boundaries depend on the last ``REACH`` bytes only
and come back in step right after an insertion.  Deduplicated, by digest, are
units as long as the claim: shortest series of chunks of one document that
hold ``min_words`` words, from each chunk on and up to each chunk; the copy in
the document with the smallest id stays.  Neighbouring units whose first copy
is in one other document are a repeated passage.  A stretch whose units have
different first documents is reported once for each of them, and such
passages may overlap.

Work moves in packed blocks.  A block of documents sends each distinct digest
once to the shard of that digest, with the block's smallest document that
has it - so a passage that all documents share costs a row per block, not
per document.  Shards answer with the smallest document of all blocks, and
the block marks its runs.  Blocks are written once and read for both steps.

Defined results: null and empty texts have no chunks; rows with one id are
one document; a null id sorts first; a passage repeated only inside one
document is left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm import text as T
from quorum.llm.common import fresh_name, map_batches, saved, ship_package

REACH = 16
MEAN_CHUNK = 24
MIN_CHUNK = 8
MAX_CHUNK = 256
MIN_WORDS = 20
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
NULL_ID = -(1 << 63)

_GEAR = np.random.default_rng(7).integers(0, 1 << 16, size=256, dtype=np.uint16)


def boundaries(buf: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Chunk ends (exclusive) over the rows' bytes; every row's end is one."""
    n = len(buf)
    if not n:
        return np.empty(0, dtype=np.int64)
    gear = _GEAR[buf]
    h = gear.copy()
    for k in range(1, REACH):                       # h = sum of gear[i - k] << k
        h[k:] += gear[:-k] << np.uint16(k)
    ends = np.flatnonzero(h < (1 << 16) // mean) + 1
    starts, stops = offsets[:-1], offsets[1:]
    row = np.searchsorted(stops, ends, side="left")
    ends = ends[ends - starts[np.minimum(row, len(starts) - 1)] > REACH]
    # no end closer than MIN_CHUNK after another candidate, none inside a character
    if len(ends):
        ends = ends[np.concatenate(([True], np.diff(ends) >= MIN_CHUNK))]
        ends = ends[(ends == n) | (buf[np.minimum(ends, n - 1)] & 0xC0 != 0x80)]
    ends = np.union1d(ends, stops[stops > starts])
    begins = np.concatenate((offsets[:1], ends[:-1]))
    long = ends - begins > MAX_CHUNK
    if long.any():
        extra = np.concatenate([np.arange(a + MAX_CHUNK, b, MAX_CHUNK)
                                for a, b in zip(begins[long], ends[long])])
        for _ in range(3):
            inside = buf[np.minimum(extra, n - 1)] & 0xC0 == 0x80
            extra = extra + inside
        ends = np.union1d(ends, extra[extra < n])
    return ends


def chunked(buf: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK):
    """(row, digest, bytes, words) of the chunks, in order."""
    ends = boundaries(buf, offsets, mean)
    begins = np.concatenate((offsets[:1], ends[:-1])) if len(ends) else ends
    row = np.searchsorted(offsets[1:], ends, side="left")
    starts, _, _ = T.word_spans(buf, offsets, T.NOT_WHITE)
    words = np.diff(np.searchsorted(starts, np.concatenate((offsets[:1], ends))))
    return row, T.word_hashes(buf, begins, ends), ends - begins, words


_INVERSE = np.uint64(pow(int(T.powers(2)[1]), -1, 1 << 64))


def units(row: np.ndarray, digest: np.ndarray, words: np.ndarray, min_words: int):
    """(first chunk, last chunk, digest) of the shortest series of chunks of a
    row with ``min_words`` words, from each chunk and to each chunk, in order."""
    n = len(row)
    if not n:
        z = np.empty(0, dtype=np.int64)
        return z, z, np.empty(0, dtype=np.uint64)
    total = np.concatenate(([0], np.cumsum(words.astype(np.int64))))
    at = np.arange(n)
    last = np.searchsorted(total, total[:-1] + min_words, side="left") - 1
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    a, b = np.concatenate((at, first)), np.concatenate((np.maximum(last, at), at))
    ok = (a >= 0) & (b < n)
    a, b = a[ok], b[ok]
    a, b = a[row[a] == row[b]], b[row[a] == row[b]]
    key = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    a, b = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digest * T.powers(n), dtype=np.uint64)))
    back = np.full(n, _INVERSE)
    back[0] = 1
    return a, b, T.mix((sums[b + 1] - sums[a]) * np.multiply.accumulate(back)[a])


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], dtype="<i8").tobytes()
    return _PACK.compress(head + b"".join(parts))


def unpack(raw: bytes, *types) -> list[np.ndarray]:
    data = _UNPACK.decompress(raw)
    sizes = np.frombuffer(data, dtype="<i8", count=len(types))
    at, out = 8 * len(types), []
    for size, t in zip(sizes.tolist(), types):
        out.append(np.frombuffer(data, dtype=t, count=size // np.dtype(t).itemsize, offset=at))
        at += size
    return out


_BLOCK = ("<i8", "<u4", "<u8", "<u4", "<u4")     # ids of rows, chunks' row, digest, bytes, words


def blocks(docs: DataFrame, id_col: str, text_col: str, mean: int = MEAN_CHUNK) -> DataFrame:
    """(block, data): the chunks of runs of documents, written."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(text_col).alias("t"))

    def run(batches):
        from pyspark import TaskContext
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = T.utf8(batch.column(1))
            names, data = [], []
            for a, b in T.row_blocks(off, BLOCK_BYTES):
                parts = []
                for c, d in T.row_blocks(off[a:b + 1], T.BLOCK_BYTES):
                    c, d = a + c, a + d
                    r, g, n, w = chunked(buf[off[c]:off[d]], off[c:d + 1] - off[c], mean)
                    parts.append((r + (c - a), g, n, w))
                cols = [np.concatenate(x) for x in zip(*parts)]
                names.append((part << 32) + k)
                k += 1
                data.append(pack(*(np.ascontiguousarray(x).astype(t) for x, t in
                                   zip((ids[a:b], *cols), _BLOCK))))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())],
                                             names=["block", "data"])

    return saved(map_batches(rows, run, "block long, data binary"), "chunks")


def _ask(shards: int, min_words: int):
    """Block -> its units' distinct digests with their smallest document, by shard."""
    def run(frames):
        for pdf in frames:
            out = []
            for block, data in zip(pdf["block"], pdf["data"]):
                ids, row, digest, _, words = unpack(data, *_BLOCK)
                a, _, digest = units(row, digest, words, min_words)
                own = ids[row[a]]
                order = np.lexsort((own, digest))
                d, i = digest[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else order
                d, i = d[first], i[first]
                shard = (d >> np.uint64(40)) % np.uint64(shards)
                by = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[by], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    own = by[cuts[s]:cuts[s + 1]]
                    out.append((s, block, pack(d[own], i[own])))
            yield pd.DataFrame(out, columns=["shard", "block", "data"])
    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Shard -> for each block, the digests that another block has too, with
    the smallest document of all."""
    got = [unpack(x, "<u8", "<i8") for x in pdf["data"]]
    d, i = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    order = np.lexsort((i, d))
    new = np.concatenate(([True], d[order][1:] != d[order][:-1]))
    group = np.cumsum(new) - 1
    first = np.empty(len(d), dtype=np.int64)
    first[order] = i[order][new][group]
    shared = np.empty(len(d), dtype=bool)
    shared[order] = np.bincount(group)[group] > 1
    out, at = [], 0
    for block, g in zip(pdf["block"], got):
        s = slice(at, at + len(g[0]))
        at += len(g[0])
        if shared[s].any():
            out.append((block, pack(g[0][shared[s]], first[s][shared[s]]), False))
    return pd.DataFrame(out, columns=["block", "data", "own"])


def _spans(min_words: int):
    """Block and answers -> repeated passages."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row, digest, size, words = unpack(pdf.loc[pdf["own"], "data"].iloc[0], *_BLOCK)
        a, b, unit = units(row, digest, words, min_words)
        own = ids[row[a]]
        order = np.lexsort((own, unit))
        d = unit[order]
        new = np.concatenate(([True], d[1:] != d[:-1])) if len(d) else np.empty(0, bool)
        keys, firsts = d[new], own[order][new]
        for raw in pdf.loc[~pdf["own"], "data"]:
            k, f = unpack(raw, "<u8", "<i8")
            firsts[np.searchsorted(keys, k)] = f
        first = firsts[np.searchsorted(keys, unit)]
        end = np.cumsum(size.astype(np.int64))
        begin = end - size
        start_of_row = np.full(len(ids), 0, dtype=np.int64)
        if len(row):
            heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            start_of_row[row[heads]] = begin[heads]
        dup = first != own
        a, b, first, own = a[dup], b[dup], first[dup], own[dup]
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(a) > 1) | (np.diff(first) != 0)
                                              | (np.diff(row[a].astype(np.int64)) != 0)))) if len(a) else a
        a, b, first, own = a[edge], b[np.append(edge[1:], len(b)) - 1] if len(b) else b, first[edge], own[edge]
        total = np.concatenate(([0], np.cumsum(words.astype(np.int64))))
        at_row = start_of_row[row[a]]
        return pd.DataFrame({
            "doc_id": own, "first_doc_id": first,
            "begin": begin[a] - at_row, "end": end[b] - at_row,
            "n_words": total[b + 1] - total[a], "n_chunks": b + 1 - a})
    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, mean: int = MEAN_CHUNK) -> DataFrame:
    """One row per passage of ``min_words`` or more that a document shares
    with one of smaller id: doc_id, first_doc_id, begin and end (bytes of the
    UTF-8 text), n_words, n_chunks."""
    ship_package(docs.sparkSession)
    table = blocks(docs, id_col, text_col, mean)
    size = table.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(512, size // SHARD_BYTES)
    answers = (table.mapInPandas(_ask(shards, min_words), "shard long, block long, data binary")
               .groupBy("shard").applyInPandas(_answer, "block long, data binary, own boolean"))
    both = answers.union(table.select("block", "data", F.lit(True)))
    return both.groupBy("block").applyInPandas(
        _spans(min_words), "doc_id long, first_doc_id long, begin long, end long, n_words long, n_chunks long")


def report(docs: DataFrame) -> DataFrame:
    """The repeated passages of all documents."""
    return repeated_passages(docs)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     **parameters) -> DataFrame:
    """``docs`` without the repeated passages (their first copies stay)."""
    cut, of = (fresh_name(docs, c) for c in ("spans_", "span_id_"))
    so_far = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = repeated_passages(docs, id_col, text_col, **parameters).withColumn(
        "end", F.max("end").over(so_far)).groupBy("doc_id").agg(      # passages may overlap
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias(cut)).withColumnRenamed(
        "doc_id", of)
    joined = docs.join(spans, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col(of),
                       "left")
    raw = F.encode(F.col(text_col), "utf-8")
    cuts = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"))),
                    F.col(cut))
    piece = F.transform(cuts, lambda c, i: F.decode(F.substring(
        raw, c["end"].cast("int") + 1,
        F.greatest(F.lit(0), (F.coalesce(F.get(cuts, i + 1)["begin"], F.octet_length(text_col).cast("long"))
                              - c["end"]).cast("int"))),
        "utf-8"))
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(
        F.array_join(piece, ""))).select(*[F.col(f"`{c}`") for c in docs.columns])
