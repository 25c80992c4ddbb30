"""Importance resampling towards a target distribution.

Hashed word runs are counted over all documents and over all target texts, as
one array of buckets each; a bucket's *gain* is the scaled log ratio of the two
smoothed shares.  A document's weight is the floored mean of the gains of its
features, its score the weight plus scaled Gumbel noise of its id, so that the
highest scores are a draw without replacement in proportion to the weights.

The scores are ordered by a distributed LSD radix sort.  The composite key
(score descending, id ascending) is cut into digits; each pass, from the least
digit on, is a stable counting sort: rows lie in blocks of ``BLOCK_ROWS``
consecutive places, a histogram (block, digit) is summed to global prefix
offsets, and each block writes its rows' next places (offset plus the row's
stable rank in the block).  Blocks are runs of places, not of keys, so ties
and hot keys never make one large.  After the last pass the place is the rank.

Defined results: a null text has no words (weight 0); an empty table gives an
empty table, an empty target counts nothing (all gains follow the documents
alone); a null id is hashed as no characters and comes last among ties;
repeated rows are rows of their own, with ranks in order of their place in the
table; long texts are read whole, in slices; columns other than the two named
are not looked at and, in :func:`draw`, come back as they are.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import fresh_name, map_batches, numbered, saved
from quorum.llm.text import LOWER, WORD_CHARS, row_blocks, utf8, word_spans
from quorum.session import ship_package

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: digits of a pass, and rows of a block of places
DIGIT_BITS = 12
BLOCK_ROWS = 1 << 15

_SLICE_WORDS = 1 << 18
_LONG_WORD = 48


def _crc_table() -> np.ndarray:
    """Bytewise table of the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _crc_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each word's bytes, after the bytes whose CRC is ``before``."""
    out = np.zeros(len(starts), dtype=np.uint32) if before is None else before.astype(np.uint32)
    for a in range(0, len(starts), _SLICE_WORDS):
        s, e = starts[a:a + _SLICE_WORDS], ends[a:a + _SLICE_WORDS]
        n = e - s
        part = out[a:a + _SLICE_WORDS]
        for i in np.flatnonzero(n > _LONG_WORD):
            part[i] = zlib.crc32(buf[s[i]:e[i]], int(part[i]))
        order = np.flatnonzero(n <= _LONG_WORD)
        order = order[np.argsort(-n[order], kind="stable")]
        lens, at = n[order], s[order]
        c = ~part[order]
        for j in range(int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -j, side="left"))
            x = c[:live]
            c[:live] = _CRC[(x ^ buf[at[:live] + j]) & np.uint32(255)] ^ (x >> np.uint32(8))
        part[order] = ~c
    return out


def run_buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_row: np.ndarray,
                buckets: int = BUCKETS, max_run: int = MAX_RUN):
    """(row, bucket) arrays of each run length from 1 to ``max_run``."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    crc = _crc_words(buf, starts, ends)
    yield row, (crc % np.uint32(buckets)).astype(np.int64)
    space = np.frombuffer(b" ", dtype=np.uint8)
    for r in range(2, max_run + 1):
        n = max(len(row) - r + 1, 0)
        whole = row[:n] == row[r - 1:]                   # the run ends in the row where it begins
        zero = np.zeros(n, dtype=np.int64)
        crc = _crc_words(space, zero, zero + 1, crc[:n])
        crc = _crc_words(buf, starts[r - 1:], ends[r - 1:], crc)
        yield row[:n][whole], (crc[whole] % np.uint32(buckets)).astype(np.int64)


def _blocks(column):
    """(first row, bytes, starts, ends, words per row) of runs of whole rows."""
    buf, offsets = utf8(column)
    for a, b in row_blocks(offsets):
        part = LOWER[buf[offsets[a]:offsets[b]]]
        starts, ends, per_row = word_spans(part, offsets[a:b + 1] - offsets[a], WORD_CHARS)
        yield a, part, starts, ends, per_row


def bucket_counts(table: DataFrame, text: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task sends one array's non-zero entries."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part, starts, ends, per_row in _blocks(batch.column(0)):
                for _, b in run_buckets(part, starts, ends, per_row, buckets, max_run):
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return (map_batches(table.select(F.col(text).alias("text")), count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS,
          max_run: int = MAX_RUN) -> np.ndarray:
    """Scaled log ratio of the shares of each bucket: an array of ``buckets`` numbers, whatever the input's size."""
    def counts(table):
        out = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(table, text, buckets, max_run).collect():
            out[r.bucket] = r.n
        return out

    s, t = counts(docs), counts(target)
    up, down = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * up / (float(a + 1) * down)))
                     for a, b in zip(s.tolist(), t.tolist())], dtype=np.int64)


def noise(doc_id, seed=SEED) -> int:
    """Scaled Gumbel noise of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, row: str | None = None, doc_id: str = "doc_id", text: str = "text",
           max_run: int = MAX_RUN, seed=SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document; ``row`` names its row number."""
    buckets = len(gain)

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            words, features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for a, part, starts, ends, per_row in _blocks(batch.column(2)):
                m = len(per_row)
                words[a:a + m] = per_row
                for r, b in run_buckets(part, starts, ends, per_row, buckets, max_run):
                    features[a:a + m] += np.bincount(r, minlength=m)
                    # sums of one row's integer gains are exact in doubles
                    total[a:a + m] += np.bincount(r, weights=gain[b], minlength=m).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            extra = np.array([noise(i, seed) for i in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words), pa.array(features), pa.array(weight),
                 pa.array(weight + extra)], ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, score, f"row long, doc_id {kind}, n_words long, n_features long, weight long, score long")


def _passes(tops: list[int]) -> list[tuple[int, int, int]]:
    """(key, shift, bits) of the passes, least digit first, for keys (most significant first) up to ``tops``."""
    out = []
    for key in reversed(range(len(tops))):
        bits = int(tops[key]).bit_length()
        width = -(-bits // max(1, -(-bits // DIGIT_BITS)))
        out += [(key, shift, min(width, bits - shift)) for shift in range(0, bits, max(width, 1))]
    return out


def radix_places(rows: DataFrame, keys: list[str], place: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``place`` 0, 1, ... in order of ``keys``, rows of equal keys in order of their old place.

    ``keys`` are columns of non-negative longs, the most significant first;
    ``place`` holds distinct non-negative longs.  A key that never varies takes no pass."""
    ship_package(rows.sparkSession)
    tops = rows.agg(*[F.max(k) for k in keys]).first()
    if tops[0] is None:
        return rows
    # a last pass of one digit makes sparse places dense where no key varies
    for key, shift, bits in _passes([t or 0 for t in tops]) or [(0, 0, 0)]:
        rows = saved(_counting_pass(rows, keys[key], shift, bits, place, block_rows), "radix")
    return rows


def _counting_pass(rows: DataFrame, key: str, shift: int, bits: int, place: str, block_rows: int) -> DataFrame:
    block, digit, start, mask = "__block", "__digit", "__start", (1 << bits) - 1
    t = rows.withColumns({block: F.floor(F.col(place) / block_rows).cast("long") if block_rows & (block_rows - 1)
                          else F.shiftright(place, block_rows.bit_length() - 1),
                          digit: F.shiftright(key, shift).bitwiseAND(mask).cast("int")})
    counts = t.groupBy(block, digit).agg(F.count("*").alias("__n"))
    # rows with smaller digits: as many sums as a digit has values
    upto = Window.orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    lower = (counts.groupBy(digit).agg(F.sum("__n").alias("__all"))
             .select(digit, F.coalesce(F.sum("__all").over(upto), F.lit(0)).alias("__lower")))
    earlier = Window.partitionBy(digit).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
               .join(F.broadcast(lower), digit)
               .select(F.col(block).alias("b"), F.col(digit).alias("d"),
                       (F.col("__lower") + F.col("__before")).alias(start)))
    columns = rows.columns

    def scatter(pdf: pd.DataFrame, off: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf[place].to_numpy(), kind="stable")]
        d = pdf[digit].to_numpy()
        order = np.argsort(d.astype(np.uint16), kind="stable")     # 16-bit keys: a counting sort
        seen, first, n = np.unique(d[order], return_index=True, return_counts=True)
        begins = off.set_index("d")[start].reindex(seen).to_numpy(dtype=np.int64)
        out = pdf.iloc[order]
        return out.assign(**{place: np.repeat(begins - first, n) + np.arange(len(out))})[columns]

    return t.groupBy(block).cogroup(offsets.groupBy("b")).applyInPandas(scatter, rows.schema)


def ranked(rows: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """:func:`scored` rows with ``rank``: 1, 2, ... of the drawn documents, null for all others."""
    fits = rows.where(F.col("n_words") >= min_words)
    n, top, low, high = fits.agg(F.count("*"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    plain = rows.withColumn("rank", F.lit(None).cast("long"))
    if not n:
        return plain
    low, high = low or 0, high or 0
    key = fits.withColumns({"__k0": F.lit(top) - F.col("score"),
                            "__k1": F.coalesce(F.col("doc_id") - F.lit(low), F.lit(high - low + 1)).cast("long"),
                            "__place": F.col("row")})
    drawn = percent * n // 100
    done = (radix_places(key, ["__k0", "__k1"], "__place")
            .withColumn("rank", F.when(F.col("__place") < drawn, F.col("__place") + 1)))
    rest = plain.where((F.col("n_words") < min_words) | F.col("n_words").isNull())
    return done.select(*plain.columns).union(rest)


def resample(docs: DataFrame, target: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text",
             buckets: int = BUCKETS, max_run: int = MAX_RUN, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed=SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of numbered ``docs``; ``doc_id`` is a whole number."""
    gain = gains(docs, target, text, buckets, max_run)
    return ranked(saved(scored(docs, gain, row, doc_id, text, max_run, seed), "scored"), min_words, percent)


def draw(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``docs``, all columns."""
    row, kept = fresh_name(docs, "row_"), fresh_name(docs, "drawn_")
    rows = numbered(docs, row)
    got = resample(rows, target, row, **parameters).where("rank is not null").select(F.col("row").alias(kept))
    return rows.join(got, rows[row] == got[kept], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    slim = docs.select("doc_id", "text")
    row = fresh_name(slim, "row_")
    return resample(numbered(slim, row), target.select("text"), row).select(
        "doc_id", "n_features", "weight", "score", "rank")
