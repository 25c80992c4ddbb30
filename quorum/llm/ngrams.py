"""Language-model scoring with Elias-Fano n-gram tries.

The model is a trigram model with interpolated absolute discounting,

    p(w | u v) = max(c(uvw) - D3, 0) / c(uv) + D3 N(uv) / c(uv) * p(w | v)
    p(w | v)   = max(c(vw) - D2, 0) / c(v) + D2 N(v) / c(v) * p(w)

(c: training counts, N: distinct successors, D from the counts of counts).
p(w) is the add-half unigram probability.  All counts, and D2 and D3, are of
the whole training corpus.

Work moves as packed events.  Every token of every text - training or not -
goes once with its two predecessors to the shard of the word before it; a
frequent word's events are spread over several shards by u (those of texts'
first tokens by w), so c(uvw), c(uv) and N(uv) are whole in one shard or known
to all.  Frequent words travel as codes by rank, bytes of one place together,
so an event takes about eight bytes.  The shards read this one exchange twice.
First they count: they give the counts of counts, and ask for what they see a
part of only - c(vw) of spread words, c(w) of words not among the ``HEADS``
that all tasks know - from the totals of all shards, summed by (v, w).  Then
events and answers meet in the shard, which builds its part of the model as a
trie: level one holds the words v, level two their successors w, level three,
for each context uv, the successors by their position among those of v.
Levels and the monotone pointers between them are Elias-Fano sequences,
probabilities and back-off weights are 8-bit codes; the trie is
memory-mapped (a nameless temporary file of the task), and the shard's queries
are found by successor search, context-relative on the last level.  Shards
answer with sums per document, which meet again per block of documents.
Neither the number of shards nor ``HEADS`` changes a score, but for the codes'
rounding.

Words are known by 64-bit hashes (u within the contexts of v by 32 bits of
them), so exact counts hold up to collisions.

Defined results: a null or empty text is its end token alone; a null id is
in the training part; repeated rows are texts of their own; with no training
text all probabilities are the uniform ones of the base.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm import text as T
from quorum.llm.common import map_batches, saved, ship_package
from quorum.llm.eliasfano import EliasFano, Quantised
from quorum.llm.substrings import pack, unpack

HEADS = 1 << 19
SHARD_EVENTS = 1_200_000
MIN_SHARDS = 96
BLOCK_BYTES = 6 << 20
START, END, WORD = np.uint64(0), np.uint64(1), np.uint64(2)   # WORD: in place of v, asks for c(w)
PART, D2, D3, KINDS = 0, -1, -2, -3     # kinds of rows: parts and answers, counts of counts, N(v) of spread words
ESCAPE, FIRST = 0, 1                    # codes of a word known by its hash, and of START
_G = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 5 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def token_blocks(batch: pa.RecordBatch, text_at: int):
    """(first row, last row, tokens, tokens per row): word hashes, and the
    end token after each text."""
    buf, off = T.utf8(batch.column(text_at))
    for a, b in T.row_blocks(off, BLOCK_BYTES):
        hashes, sizes = [], []
        for c, d in T.row_blocks(off[a:b + 1], T.BLOCK_BYTES):
            c, d = a + c, a + d
            low = T.LOWER[buf[off[c]:off[d]]]
            s, e, n = T.word_spans(low, off[c:d + 1] - off[c], T.NOT_WHITE)
            hashes.append(T.word_hashes(low, s, e))
            sizes.append(n)
        words, n = np.concatenate(hashes), np.concatenate(sizes)
        yield a, b, np.insert(words, np.cumsum(n), END), n + 1


def vocabulary(docs: DataFrame, held: str, text_col: str) -> DataFrame:
    """(h, c): the training tokens' hashes and counts."""
    def run(batches):
        for batch in batches:
            for a, b, tokens, sizes in token_blocks(batch, 1):
                train = ~batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                h, c = np.unique(tokens[np.repeat(train, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    counts = map_batches(docs.select(held, text_col), run, "h long, c long")
    return saved(counts.groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")


class Unigrams:
    """What all tasks know: totals, and counts of the frequent words."""

    def __init__(self, total: int, types: int, h: np.ndarray, c: np.ndarray, shards: int):
        self.total, self.types, self.shards = total, types, shards
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.norm = total + 0.5 * (types + 1)
        self.ends = int(self.c[self.h == END].sum())
        self.pieces_of_start = max(1, -(-self.ends * shards // max(total, 1)))
        self.pieces = np.maximum(1, -(-self.c * shards // max(total, 1))).astype(np.uint64)
        by_rank = np.lexsort((self.h, -self.c))
        self.code = np.empty(len(by_rank), dtype=np.uint32)
        self.code[by_rank] = np.arange(len(by_rank)) + FIRST + 1
        self.words = np.concatenate((np.array([0, START], dtype=np.uint64), self.h[by_rank]))

    def shard_of(self, v: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Shard of a piece of a word's events."""
        return T.mix(np.where(piece > 0, T.mix(v + piece * _G), v) ^ np.uint64(0x5BD1E995)) \
            % np.uint64(self.shards)

    def pieces_of(self, v: np.ndarray) -> np.ndarray:
        at = self.head(v)
        out = np.ones(len(v), dtype=np.uint64)
        out[at >= 0] = self.pieces[at[at >= 0]]
        out[v == START] = self.pieces_of_start
        return out

    def is_spread(self, v: np.ndarray) -> np.ndarray:
        """Whether a word's events are in several shards."""
        return self.pieces_of(v) > 1

    def history(self, v: np.ndarray) -> np.ndarray:
        """c(v) of spread words."""
        return np.where(v == START, self.ends, self.c[self.head(v)])

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / self.norm)

    def head(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the frequent words, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


# runs of v: codes, hashes of the uncoded, lengths; u: codes, hashes; w: codes, hashes; rows
_EVENTS = ("u1", "<u8", "u1", "u1", "<u4", "u1", "<u8", "u1")
_HEADER = ("<i8", "u1", "<i8")                  # ids, held out, n_tokens
_ASKED = ("<u8", "<u8", "<i8")                  # v, w, training count
_SUMS = ("<u4", "<f8", "<f8", "<u4")            # row, score, base, known
_COUNTS = "shard long, kind long, key long, n long, data binary"


def _planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers as bytes, those of one place together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _previous(x: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
    """Each token's predecessor; ``fill`` for the first of a text."""
    out = np.concatenate((x[:1], x[:-1]))
    out[first] = fill
    return out


def _events(shared):
    """Documents -> the events of each shard, in packed blocks, after a header
    row of each block; a row's number goes with its held-out flag as low bit."""
    def run(batches):
        uni = shared.value
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            held_all = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, w, sizes in token_blocks(batch, 2):
                block, k = (part << 32) + k, k + 1
                held = held_all[a:b]
                yield _rows([(-1 - block, block, pack(*(np.ascontiguousarray(x).astype(t) for x, t in zip(
                    (ids[a:b], held | (nulls[a:b] << 1), sizes), _HEADER))))])
                row = np.repeat(np.arange(b - a, dtype=np.uint32), sizes)
                tag = row << np.uint32(1) | held[row]
                first = np.cumsum(sizes) - sizes
                at = uni.head(w)
                code = np.full(len(w), ESCAPE, dtype=np.uint32)
                code[at >= 0] = uni.code[at[at >= 0]]
                v, code_v, at_v = (_previous(x, first, f) for x, f in ((w, START), (code, FIRST), (at, -1)))
                u, code_u = (_previous(x, first, f) for x, f in ((v, START), (code_v, FIRST)))
                # the shard of an event, by v, and where v is frequent by u too; first tokens by w
                pieces = np.ones(len(w), dtype=np.uint64)
                pieces[at_v >= 0] = uni.pieces[at_v[at_v >= 0]]
                pieces[first] = uni.pieces_of_start
                by = u.copy()
                by[first] = w[first]
                shard = uni.shard_of(v, T.mix(by ^ _G) % pieces)
                order = np.argsort(shard << np.uint64(44) | v >> np.uint64(20), kind="stable")
                shard, v, u, w, tag = (x[order] for x in (shard, v, u, w, tag))
                code_v, code_u, code = (x[order] for x in (code_v, code_u, code))
                cuts = np.searchsorted(shard, np.arange(uni.shards + 1, dtype=np.uint64))
                out = []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    x = slice(cuts[s], cuts[s + 1])
                    runs = np.flatnonzero(np.concatenate(([True], v[x][1:] != v[x][:-1])))
                    out.append((s, block, pack(
                        _planes(code_v[x][runs]), v[x][runs][code_v[x][runs] == ESCAPE],
                        _planes(np.diff(np.append(runs, cuts[s + 1] - cuts[s]))),
                        _planes(code_u[x]), (u[x][code_u[x] == ESCAPE] & _LOW).astype(np.uint32),
                        _planes(code[x]), w[x][code[x] == ESCAPE],
                        _planes(np.diff(tag[x], prepend=np.uint32(0))))))
                yield _rows(out)
    return run


def _rows(rows) -> pa.RecordBatch:
    shard, block, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary())],
        names=["shard", "block", "data"])


def discount(n1: int, n2: int) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts, within (0, 1)."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Grams:
    """The distinct n-grams of one shard's events with the events' training
    counts: trigrams (v, u, w, c), pairs (pair, c2), words (words, cw); w is
    known by its place among the words, v in pairs by that among the names."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray):
        self.words, at = np.unique(w, return_inverse=True)
        order = np.lexsort((at, u, v))
        v, u, at = v[order], u[order], at[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (at[1:] != at[:-1])))
        self.group = np.empty(len(v), dtype=np.int64)          # of each event, its trigram
        self.group[order] = np.cumsum(new) - 1
        self.c = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        self.v, self.u, self.w = v[new], u[new], at[new].astype(np.uint64)
        first = np.concatenate(([True], self.v[1:] != self.v[:-1]))
        self.names, self.vid = self.v[first], (np.cumsum(first) - 1).astype(np.uint64)
        self.pair, of = np.unique(self.vid << np.uint64(32) | self.w, return_inverse=True)
        self.pair_v = (self.pair >> np.uint64(32)).astype(np.int64)
        self.pair_w = (self.pair & _LOW).astype(np.int64)
        self.c2 = np.bincount(of, weights=self.c, minlength=len(self.pair)).astype(np.int64)
        self.cw = np.bincount(self.w.astype(np.int64), weights=self.c,
                              minlength=len(self.words)).astype(np.int64)


def _decoded(planes: np.ndarray, others: np.ndarray, words: np.ndarray) -> np.ndarray:
    code = _numbers(planes)
    out = words[code]
    out[code == ESCAPE] = others
    return out


def _unpacked(data, uni: Unigrams) -> tuple[list[np.ndarray], list[int]]:
    """v, u, w, row and its flag of packed events; the events of each."""
    low = (uni.words & _LOW).astype(np.uint32)
    cols, sizes = ([], [], [], []), []
    for raw in data:
        v, v_hash, length, u, u_hash, w, w_hash, tag = unpack(raw, *_EVENTS)
        got = (np.repeat(_decoded(v, v_hash, uni.words), _numbers(length)), _decoded(u, u_hash, low),
               _decoded(w, w_hash, uni.words), np.cumsum(_numbers(tag), dtype=np.uint32))
        for col, x in zip(cols, got):
            col.append(x)
        sizes.append(len(got[3]))
    return [np.concatenate(c) for c in cols], sizes


def _stats(kind: int, counts: np.ndarray) -> list[tuple]:
    return [(kind, n, int(np.sum(counts == n)), None) for n in (1, 2)]


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["shard", "kind", "key", "n", "data"])


def _count(shared):
    """Shard -> counts of counts of what is whole in it, and by (v, w) its part
    of the others."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return _frame([])
        uni = shared.value
        (v, u, w, tag), _ = _unpacked(pdf["data"], uni)
        g = Grams(v, u, w, tag % 2 == 0)
        del v, u, w, tag
        spread, rare = uni.is_spread(g.names)[g.pair_v], uni.head(g.words) < 0
        out = [(key[0], *x) for x in _stats(D3, g.c) + _stats(D2, g.c2[~spread])]
        v = np.concatenate((g.names[g.pair_v[spread]], np.full(int(rare.sum()), WORD)))
        w = np.concatenate((g.words[g.pair_w[spread]], g.words[rare]))
        c = np.concatenate((g.c2[spread], g.cw[rare]))
        to = T.mix(v ^ T.mix(w)) % np.uint64(uni.shards)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(uni.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            x = order[cuts[s]:cuts[s + 1]]
            out.append((s, PART, key[0], 0, pack(v[x], w[x], c[x])))
        return _frame(out)
    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Parts by (v, w) -> to each sender the totals of what it asked; counts of
    counts and N(v) of spread words."""
    known = pdf[pdf["kind"] < 0]
    out = [(-1, kind, n, sum_, None) for kind, n, sum_ in zip(
        known["kind"].tolist(), known["key"].tolist(), known["n"].tolist())]
    pdf = pdf[pdf["kind"] == PART]
    if not len(pdf):
        return _frame(out)
    got = [unpack(x, *_ASKED) for x in pdf["data"]]
    v, w, c = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.lexsort((w, v))
    new = np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])))
    sums = np.add.reduceat(c[order], np.flatnonzero(new))
    total = np.empty(len(v), dtype=np.int64)
    total[order] = sums[np.cumsum(new) - 1]
    names = v[order][new]
    real = (names != WORD) & (sums > 0)
    out += [(-1, *x) for x in _stats(D2, sums[real])]
    out += [(-1, KINDS, k, n, None) for k, n in zip(*(x.astype(np.int64).tolist() for x in np.unique(
        names[real], return_counts=True)))]
    at = 0
    for sender, g in zip(pdf["key"], got):
        out.append((sender, PART, -1, 0, pack(g[0], g[1], total[at:at + len(g[0])])))
        at += len(g[0])
    return _frame(out)


def _to_shards(shared):
    """Summed counts of counts -> a row for each shard; N(v) -> one for each
    shard of the word's pieces."""
    def run(batches):
        uni = shared.value
        for batch in batches:
            for kind, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                to = np.arange(uni.shards)
                if kind == KINDS:
                    v = np.array([key], dtype=np.int64).view(np.uint64)
                    piece = np.arange(int(uni.pieces_of(v)[0]), dtype=np.uint64)
                    to = np.unique(uni.shard_of(np.repeat(v, len(piece)), piece)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), *(pa.array(np.full(len(to), x), pa.int64()) for x in (kind, key, n)),
                     pa.nulls(len(to), pa.binary())], names=["shard", "kind", "key", "n", "data"])
    return run


class Trie:
    """The n-grams of one shard: u, v, w with training counts."""

    def __init__(self, g: Grams, cv: np.ndarray, kinds: np.ndarray, p: np.ndarray, d2: float, d3: float):
        """``g`` with its whole c2; c(v) and N(v) of its names, p(w) of its words.
        A v without training text leaves all to p(w)."""
        low = np.where(cv > 0, d2 * kinds / np.maximum(cv, 1), 1.0)
        some = g.c2 > 0
        pair, pair_v, c2 = g.pair[some], g.pair_v[some], g.c2[some]
        p2 = np.maximum(c2 - d2, 0) / cv[pair_v] + low[pair_v] * p[g.pair_w[some]]
        successors = np.bincount(pair_v, minlength=len(g.names))
        at2 = np.concatenate(([0], np.cumsum(successors)))
        # contexts (v, u), and their successors by position among those of v
        some = g.c > 0
        vid, c3 = g.vid[some], g.c[some]
        n = len(vid)
        ctx_key = vid << np.uint64(32) | g.u[some]
        new_ctx = np.concatenate(([True], ctx_key[1:] != ctx_key[:-1])) if n else np.empty(0, bool)
        ctx = np.cumsum(new_ctx) - 1
        cc, kinds3 = np.bincount(ctx, weights=c3), np.bincount(ctx)
        of_start = g.names[vid[new_ctx].astype(np.int64)] == START     # its one context is spread like it
        if of_start.any():
            cc[of_start], kinds3[of_start] = cv[g.names == START], kinds[g.names == START]
        back3 = d3 * kinds3 / np.maximum(cc, 1)
        lower = np.searchsorted(pair, vid << np.uint64(32) | g.w[some])
        p3 = np.maximum(c3 - d3, 0) / cc[ctx] + back3[ctx] * p2[lower]
        position = lower - at2[vid.astype(np.int64)]
        self.width = int(successors.max()).bit_length()
        third = ctx.astype(np.uint64) << np.uint64(self.width) | position.astype(np.uint64)
        levels = {"v": g.names, "vw": pair, "to_w": at2, "vu": ctx_key[new_ctx], "uvw": third}
        codes = {"vw": np.log10(p2), "v": np.log10(np.minimum(low, 1)), "vu": np.log10(np.minimum(back3, 1)),
                 "uvw": np.log10(p3)}
        self._map({k: EliasFano.encode(x) for k, x in levels.items()},
                  {k: Quantised.fit(x) for k, x in codes.items()})

    def _map(self, levels: dict, codes: dict) -> None:
        """Write the levels to a nameless temporary file and map it."""
        self.file = tempfile.TemporaryFile()
        parts = [(o, i, a) for o in (*levels.values(), *codes.values())
                 for i, a in enumerate(o.parts() if isinstance(o, EliasFano) else [o.codes])]
        places, at = [], 0
        for _, _, a in parts:
            at += -at % 8
            places.append(at)
            self.file.seek(at)
            self.file.write(a.tobytes())
            at += a.nbytes
        self.file.truncate(at)
        self.file.flush()
        raw = np.memmap(self.file, dtype=np.uint8, mode="r", shape=(at,)) if at else np.empty(0, np.uint8)
        for (o, i, a), place in zip(parts, places):
            view = raw[place:place + a.nbytes].view(a.dtype)
            if isinstance(o, EliasFano):
                setattr(o, ("low", "high", "directory")[i], view)
            else:
                o.codes = view
        self.bytes = at
        self.level, self.code = levels, codes

    def close(self) -> None:
        self.level = self.code = None
        self.file.close()

    @staticmethod
    def _find(level: EliasFano, keys: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Places of ``keys`` where ``ok``; -1 for the others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        some, back = np.unique(keys[ok], return_inverse=True)
        out[ok] = level.find(some)[back]
        return out

    def log10(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 p(w | u v) of each query; w by places in ``p``, their p(w)."""
        vid = self._find(self.level["v"], v, np.ones(len(v), dtype=bool))
        seen = vid >= 0
        shifted = np.where(seen, vid, 0).astype(np.uint64) << np.uint64(32)
        pair = self._find(self.level["vw"], shifted | w, seen)
        ctx = self._find(self.level["vu"], shifted | u, seen)
        both = (pair >= 0) & (ctx >= 0)
        to_w = self.level["to_w"].values().astype(np.int64)
        relative = np.where(both, pair - to_w[np.maximum(vid, 0)], 0).astype(np.uint64)
        key = np.where(both, ctx, 0).astype(np.uint64) << np.uint64(self.width) | relative
        third = self._find(self.level["uvw"], key, both)
        out = np.log10(p[w.astype(np.int64)])
        back = seen & (pair < 0)
        out[back] += self.code["v"][vid[back]]
        out[pair >= 0] = self.code["vw"][pair[pair >= 0]]
        out[ctx >= 0] += self.code["vu"][ctx[ctx >= 0]]
        out[third >= 0] = self.code["uvw"][third[third >= 0]]
        return out


def _score(shared):
    """Shard -> sums per block and row; header rows pass through."""
    def run(key, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0 or not len(pdf):
            return pdf[["block", "data"]].assign(header=True)
        uni = shared.value
        answers = [unpack(x, *_ASKED) for x in told.loc[told["kind"] == PART, "data"]]
        found = {(kind, k): n for kind, k, n in zip(*(told.loc[told["kind"] < 0, c].tolist()
                                                     for c in ("kind", "key", "n")))}
        d2, d3 = (discount(found.get((k, 1), 0), found.get((k, 2), 0)) for k in (D2, D3))
        (v, u, w, tag), sizes = _unpacked(pdf["data"], uni)
        g = Grams(v, u, w, tag % 2 == 0)
        del v, u, w
        # whole counts in place of the shard's own; answers are in the order of (v, w)
        at = uni.head(g.words)
        spread, rare = uni.is_spread(g.names), at < 0
        if answers:
            av, aw, ac = (np.concatenate([x[k] for x in answers]) for k in range(3))
            order = np.lexsort((aw, av))
            of_word = av[order] == WORD
            g.c2[spread[g.pair_v]], g.cw[rare] = ac[order][~of_word], ac[order][of_word]
        g.cw[~rare] = uni.c[at[~rare]]
        cv = np.bincount(g.vid.astype(np.int64), weights=g.c).astype(np.int64)
        kinds = np.bincount(g.pair_v[g.c2 > 0], minlength=len(g.names))
        if spread.any():
            cv[spread] = uni.history(g.names[spread])
            kinds[spread] = [found.get((KINDS, k), 0) for k in g.names[spread].view(np.int64).tolist()]
        p = (g.cw + 0.5) / uni.norm
        trie = Trie(g, cv, kinds, p, d2, d3)
        score = trie.log10(g.v, g.u, g.w, p)[g.group]
        trie.close()
        of = g.w.astype(np.int64)[g.group]
        base, known = uni.base(g.cw)[of], (g.cw > 0)[of]
        out, at = [], 0
        for block, n in zip(pdf["block"], sizes):
            x = slice(at, at + n)
            at += n
            rows, inv = np.unique(tag[x] >> np.uint32(1), return_inverse=True)
            sums = (np.bincount(inv, weights=y[x], minlength=len(rows)) for y in (score, base, known))
            out.append((block, pack(*(y.astype(t) for y, t in zip((rows, *sums), _SUMS))), False))
        return pd.DataFrame(out, columns=["block", "data", "header"])
    return run


def _gather(total: int):
    """Block -> one row per document."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, flags, n = unpack(pdf.loc[pdf["header"], "data"].iloc[0], *_HEADER)
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for raw in pdf.loc[~pdf["header"], "data"]:
            rows, s, b, k = unpack(raw, *_SUMS)
            score[rows] += s
            base[rows] += b
            known[rows] += k
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64").copy() if not (flags > 1).any() else pd.array(
                [None if f > 1 else int(i) for i, f in zip(ids, flags)], dtype="Int64"),
            "held_out": flags % 2 == 1, "n_tokens": n, "n_known": known,
            "train_tokens": np.full(len(ids), total, dtype=np.int64), "base_score": base, "score": score})
    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           shard_events: int = SHARD_EVENTS, min_shards: int = MIN_SHARDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"),
                       F.col(text_col).alias("t"))
    words = vocabulary(rows, "held", "t")
    n = words.agg(F.sum("c"), F.count("*")).first()
    total, types = n[0] or 0, n[1]
    heads = words.where(F.col("c") * HEADS > total).toArrow()      # fewer than HEADS, by their sum
    shards = max(min_shards, total // shard_events)
    uni = Unigrams(total, types, heads["h"].to_numpy().view(np.uint64), heads["c"].to_numpy(), shards)
    shared = spark.sparkContext.broadcast(uni)
    # one plan: the exchange of the events by shard is written once and read by the two groupings
    events = map_batches(rows, _events(shared), "shard long, block long, data binary")
    parts = events.groupBy("shard").applyInPandas(_count(shared), _COUNTS)
    totals = parts.groupBy("shard").applyInPandas(_total, _COUNTS)
    stats = totals.where("kind < 0").groupBy("kind", "key").agg(F.sum("n").alias("n"))   # fewer than 2 * shards
    told = totals.where(F.col("kind") == PART).union(map_batches(stats, _to_shards(shared), _COUNTS))
    sums = events.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(
        _score(shared), "block long, data binary, header boolean")
    return sums.groupBy("block").applyInPandas(
        _gather(total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                        "base_score double, score double")


def report(docs: DataFrame) -> DataFrame:
    return scores(docs)
