"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Benchmark items are cut into windows of ``n`` words; the hashes of all windows
go to the executors, each document's word windows are hashed with array
arithmetic and looked up, and every hit is verified against the words
themselves.  Documents are not shuffled.

The set is built by tasks, from pieces of items of at most ``PIECE`` windows,
and is a few flat arrays over one buffer of words, so that its size is known
from its windows before it is built.  Sets of more than ``block_bytes`` are
cut into blocks of about that size; the documents pass over one block after
the other, each pass but the last is written, and its block's broadcast is
given up before the next one's.

Defined results: null or empty texts have no words and no hits; an item with
no words has no windows; items of fewer than ``n`` words are one window;
repeated items count once by their id, null ids as the empty one; repeated
document rows each count for themselves; an empty benchmark hits nothing, an
empty table of documents gives an empty result; texts of any length are
scanned whole; columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm import text as T
from quorum.llm.common import fresh_name, map_batches, saved
from quorum.session import ship_package

NGRAM = 10
BLOCK_BYTES = 32 << 20          # of a built set
PIECE = 1 << 14                 # windows of one piece of an item
WINDOW_BYTES = 28               # key, group, begin, end and item of a window
ITEM_BYTES = 100                # an id beside its characters
_RING = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(hashes: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``n`` consecutive word hashes from each place of ``at`` (None: from each)."""
    if at is None:
        m = max(0, len(hashes) - n + 1)
        runs = (hashes[k:k + m] for k in range(n))
    else:
        m = len(at)
        runs = (hashes[at + k] for k in range(n))
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for run in runs:
            out = out * _RING + run
    return out


class WindowSet:
    """Windows of the pieces of a block: for each length the sorted hashes of
    the different windows, where in ``raw`` their words stand, and the items
    that hold them."""

    def __init__(self, pieces=(), n: int = NGRAM):
        pieces = list(pieces)
        self.ids = sorted({i for i, _ in pieces})
        number = {i: k for k, i in enumerate(self.ids)}
        self.raw = b"".join(words for _, words in pieces)
        offsets = np.concatenate(([0], np.cumsum([len(words) for _, words in pieces]))).astype(np.int64)
        starts, ends, per_row = T.word_spans(np.frombuffer(self.raw, np.uint8), offsets, T.WORD_CHARS)
        hashes = T.word_hashes(np.frombuffer(self.raw, np.uint8), starts, ends)
        first = np.concatenate(([0], np.cumsum(per_row)))
        item = np.repeat(np.array([number[i] for i, _ in pieces], dtype=np.int32), per_row)
        last = np.repeat(first[1:], per_row)
        self.tables = {}
        for size in np.unique(np.minimum(per_row[per_row > 0], n)).tolist():
            if size == n:
                at = np.flatnonzero(np.arange(len(starts)) + n <= last)
            else:
                at = first[:-1][per_row == size]
            self.tables[size] = self._table(window_hashes(hashes, size, at), starts[at], ends[at + size - 1], item[at])

    def _table(self, keys, begin, end, item):
        """(hash, begin and end of each different window; where its items begin; items)."""
        raw = self.raw
        order = np.lexsort((item, keys))

        def differs(order):
            k, b, e = keys[order], begin[order], end[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = k[1:] != k[:-1]
            mixed = False
            for i in np.flatnonzero(~new).tolist():
                if raw[b[i]:e[i]] != raw[b[i - 1]:e[i - 1]]:
                    new[i] = mixed = True
            return new, mixed
        new, mixed = differs(order)
        if mixed:                                # windows that share a hash: order them by their words
            order = np.array(sorted(order.tolist(), key=lambda i: (keys[i], raw[begin[i]:end[i]], item[i])))
            new, _ = differs(order)
        at = np.flatnonzero(new)
        one = order[at]
        return (keys[one], begin[one].astype(np.uint32), end[one].astype(np.uint32),
                np.append(at, len(order)), item[order])

    def scan(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             hashes: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(positions of the words hit, items found) of one document."""
        hit = np.zeros(len(hashes) + 1, dtype=np.int64)
        found = []
        for size, (known, begin, end, first, item) in self.tables.items():
            w = window_hashes(hashes, size)
            at = np.searchsorted(known, w)
            at[at == len(known)] = 0
            groups = set()
            for i in np.flatnonzero(known[at] == w).tolist():
                joined = b" ".join(low[a:b].tobytes() for a, b in
                                   zip(starts[i:i + size].tolist(), ends[i:i + size].tolist()))
                k = int(at[i])
                while k < len(known) and known[k] == w[i]:
                    if self.raw[begin[k]:end[k]] == joined:
                        hit[i] += 1
                        hit[i + size] -= 1
                        groups.add(k)
                        break
                    k += 1
            found += [item[first[k]:first[k + 1]] for k in groups]
        ids = np.unique(np.concatenate(found)).tolist() if found else []
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), [self.ids[i] for i in ids]


def documents_words(column: pa.Array):
    """(lower-cased bytes of the row's block, starts, ends, hashes) of each row."""
    buf, off = T.utf8(column)
    for a, b in T.row_blocks(off):
        low = T.LOWER[buf[off[a]:off[b]]]
        starts, ends, per_row = T.word_spans(low, off[a:b + 1] - off[a], T.WORD_CHARS)
        hashes = T.word_hashes(low, starts, ends)
        at = np.concatenate(([0], np.cumsum(per_row)))
        for i in range(b - a):
            s = slice(at[i], at[i + 1])
            yield low, starts[s], ends[s], hashes[s]


def item_pieces(benchmark: DataFrame, n: int = NGRAM, id_col: str = "item_id",
                text_col: str = "text") -> DataFrame:
    """The different (i, words, size): normalised words, joined by spaces, of at
    most ``PIECE`` windows of an item, and the bytes they take in a set."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                             F.col(text_col).alias("t"))

    def cut(batches):
        for batch in batches:
            out = []
            for i, (low, s, e, _) in zip(batch.column(0).to_pylist(), documents_words(batch.column(1))):
                for a in range(0, max(1, len(s) - n + 1) if len(s) else 0, PIECE):
                    spans = zip(s[a:a + PIECE + n - 1].tolist(), e[a:a + PIECE + n - 1].tolist())
                    words = b" ".join(low[x:y].tobytes() for x, y in spans)
                    windows = min(PIECE, max(1, len(s) - n + 1) - a)
                    out.append((i, words, len(words) + WINDOW_BYTES * windows + len(i) + ITEM_BYTES))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))],
                names=["i", "words", "size"])

    return map_batches(items, cut, "i string, words binary, size long").distinct()


def window_sets(benchmark: DataFrame, n: int = NGRAM, block_bytes: int = BLOCK_BYTES):
    """The benchmark's window sets, each built by a task and of about ``block_bytes``."""
    pieces = saved(item_pieces(benchmark, n), "benchmark_pieces")
    size = pieces.agg(F.sum("size")).first()[0] or 0
    # pieces are dealt by hash: room for blocks that get more than their share
    blocks = 1 if size <= block_bytes else math.ceil(1.5 * size / block_bytes)

    def build(table: pa.Table) -> pa.Table:
        built = WindowSet(zip(table.column("i").to_pylist(), table.column("words").to_pylist()), n)
        return pa.table({"block": table.column("block").slice(0, 1),
                         "data": pa.array([pickle.dumps(built)], pa.binary())})

    ship_package(benchmark.sparkSession)
    built = saved(pieces.withColumn("block", F.pmod(F.xxhash64("i", "words"), F.lit(blocks)))
                  .groupBy("block").applyInArrow(build, "block long, data binary"), "benchmark_windows")
    for r in built.select("block").orderBy("block").collect() or [None]:
        # one block at a time is on the driver, to be broadcast
        yield WindowSet() if r is None else pickle.loads(built.where(F.col("block") == r.block).first().data)


def mark_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text",
              block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns: number of words, positions of hit
    words, items found.  Returns the frame and the three names."""
    words_c, hits_c, items_c = (fresh_name(docs, c) for c in ("n_words", "hit_words", "hit_items"))
    out = docs.withColumns({words_c: F.lit(0).cast("long"), hits_c: F.array().cast("array<int>"),
                            items_c: F.array().cast("array<string>")})
    sc = docs.sparkSession.sparkContext
    shared = None
    for windows in window_sets(benchmark, n, block_bytes):
        if shared is not None:
            out = saved(out, "benchmark_hits")
            shared.destroy()
        shared = sc.broadcast(windows)

        def scan(batches, shared=shared):
            windows = shared.value
            for batch in batches:
                names = batch.schema.names
                n_words, hits, found = [], [], []
                for low, s, e, h in documents_words(batch.column(names.index(text_col))):
                    p, ids = windows.scan(low, s, e, h)
                    n_words.append(len(h))
                    hits.append(p.astype(np.int32))
                    found.append(ids)
                old_h = batch.column(names.index(hits_c)).to_pylist()
                old_i = batch.column(names.index(items_c)).to_pylist()
                new = {words_c: pa.array(n_words, pa.int64()),
                       hits_c: pa.array([a + b.tolist() for a, b in zip(old_h, hits)],
                                        pa.list_(pa.int32())),
                       items_c: pa.array([a + b for a, b in zip(old_i, found)],
                                         pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(
                    [new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

        out = map_batches(out, scan, out.schema)
    return out, words_c, hits_c, items_c


def report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items, contaminated."""
    marked, words_c, hits_c, items_c = mark_hits(docs.select("doc_id", "text"), benchmark, n)
    return marked.select(
        "doc_id", F.col(words_c).alias("n_words"),
        F.size(F.array_distinct(hits_c)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(items_c)).alias("items"),
    ).withColumns({"n_items": F.size("items").cast("long"),
                   "contaminated": F.col("n_hit") > 0})


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text",
                  max_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the benchmark's passages.

    The words that are hit go (with what stands between them); a document of
    whose words more than ``max_share`` are hit goes whole.  Other documents
    are left byte for byte."""
    marked, words_c, hits_c, items_c = mark_hits(docs, benchmark, n, text_col, block_bytes)
    share = F.size(F.array_distinct(hits_c)) / F.greatest(F.col(words_c), F.lit(1))
    kept = marked.where(share <= max_share)

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            i = names.index(text_col)
            hits = batch.column(names.index(hits_c)).to_pylist()
            texts = batch.column(i).to_pylist()
            for k, h in enumerate(hits):
                if h:
                    texts[k] = without(texts[k], sorted(set(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, batch.column(i).type) if j == i else batch.column(j)
                 for j in range(len(names))], names=names)

    return map_batches(kept, cut, kept.schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def without(text: str, hit: list[int]) -> str:
    """``text`` without the runs of hit words (``hit``: sorted positions)."""
    raw = text.encode()
    buf, off = T.utf8(pa.array([text], type=pa.string()))
    starts, ends, _ = T.word_spans(T.LOWER[buf], off, T.WORD_CHARS)
    out, at, k = [], 0, 0
    while k < len(hit):
        last = k
        while last + 1 < len(hit) and hit[last + 1] == hit[last] + 1:
            last += 1
        out.append(raw[at:starts[hit[k]]])
        at = int(ends[hit[last]])
        k = last + 1
    out.append(raw[at:])
    return b"".join(out).decode()


def digest(report: DataFrame) -> DataFrame:
    """``report`` with the list of items as the hash of its comma-joined ids."""
    return report.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
                         "contaminated")
