"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

Merging by rank has two local properties: the tokenisation of a text's prefix
has one last token, and a sequence of tokens is the tokenisation of its bytes
iff every two neighbours are (``pair_ok`` tests a pair with the merge rule
itself).  The transducer reads a piece byte by byte.  Its state is the last
token emitted and the bytes read since; for each prefix of these bytes it
knows the last token.  A later token can only begin where the bytes up to now
are a proper prefix of some vocabulary entry; the tokens that the paths to
all such places share are certain and leave the state, so lookahead is
bounded by the longest entry.  States and transitions are made when first
met and kept, up to ``MAX_STATES``.

Decoding maps ids to bytes; :class:`Utf8Stream` is an incremental UTF-8
machine over chunks that may end inside a character.

Defined results: a null or empty text has no ids; invalid UTF-8 that ids can
spell decodes with U+FFFD in text form, and exactly in byte form.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import threading
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import fresh_name, map_batches

MAX_STATES = 150_000
MAX_PIECES = 400_000
SLICE_ROWS = 250
IDLE_SECONDS = 3.0
_idle: threading.Timer | None = None
MAX_PIECE = 40


class Merges:
    """Ranks of a vocabulary file, and the merge rule on one byte string."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b)
                         for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.size_of = {i: len(t) for t, i in self.rank.items()}
        # trie of the vocabulary: byte << 32 | node -> node; rank and "has children" by node
        self.child: dict[int, int] = {}
        self.rank_at, self.inner = [-1], [False]
        for token, r in self.rank.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = byte << 32 | node
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.inner)
                    self.rank_at.append(-1)
                    self.inner.append(False)
            self.rank_at[node] = r
        self._halves: dict[int, tuple[int, int]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives ``token``; (-1, -1) for one byte, (-2, -2)
        where merging its bytes up to its rank leaves no two."""
        got = self._halves.get(token)
        if got is None:
            raw = self.bytes_of[token]
            parts = [self.rank.get(p) for p in self.merge(raw, token)] if len(raw) > 1 else []
            got = (-1, -1) if len(raw) == 1 else tuple(parts) if len(parts) == 2 and None not in parts else (-2, -2)
            self._halves[token] = got
        return got

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the tokenisation of their bytes: no pair that meets at their
        border, while they are put together, merges before the parts it is of do.  The
        parts are taken apart again, the one merged last first (equal ranks: the left first)."""
        halves, known, bytes_of, rank = self.halves, self._halves, self.bytes_of, self.rank
        x, y, limit, left = a, b, None, False
        while True:
            r = rank.get(bytes_of[x] + bytes_of[y])
            if r is not None and (limit is None or r < limit or (r == limit and left)):
                return False
            x_to = (known.get(x) or halves(x))[1]
            y_to = (known.get(y) or halves(y))[0]
            if x_to == -2 or y_to == -2:
                return self.merge(bytes_of[a] + bytes_of[b]) == [bytes_of[a], bytes_of[b]]
            if x_to == y_to == -1:
                return True
            # undo the later merge; of equal ranks the right one came later
            if y_to < 0 or (x_to >= 0 and x > y):
                limit, left, x = x, False, x_to
            else:
                limit, left, y = y, True, y_to

    def merge(self, raw: bytes, below: int | None = None) -> list[bytes]:
        """Parts of ``raw`` after merging the pair of lowest rank (``below`` a rank only), again and again."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    """Reads bytes, emits token ids."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.m, self.max_states = merges, max_states
        self._pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.start = self._keep((-1, b"", (), ()))
        self.passing = 0

    def _keep(self, state: tuple) -> int:
        """The number of a state.  A state is: the last token emitted, the
        bytes since, the last token of each prefix of them, and the places
        with their trie nodes where a vocabulary entry may be under way."""
        at = self.index.get(state[:2])
        if at is None:
            at = self.index[state[:2]] = len(self.states)
            self.states.append(state)
        return at

    def pair_ok(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the tokenisation of their bytes."""
        key = (a, b)
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > self.max_states:
                self._pairs.clear()
            ok = self._pairs[key] = self.m.stays_apart(a, b)
        return ok

    def path(self, lasts: tuple, n: int) -> list[int]:
        """Ends of the tokens of the prefix of length ``n``, last first."""
        size, out = self.m.size_of, []
        while n > 0:
            out.append(n)
            n -= size[lasts[n - 1]]
        return out

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The transition of ``state`` on ``byte``: next state, ids emitted."""
        prev, pending, lasts, live = state
        m = self.m
        child, rank_at, inner = m.child, m.rank_at, m.inner
        last, going, high = -1, [], byte << 32
        for s, node in (*live, (len(pending), 0)):
            node = child.get(high | node)
            if node is None:
                continue
            if inner[node]:
                going.append((s, node))
            token = rank_at[node]
            if last < 0 <= token:            # the last token begins at one of these places
                before = lasts[s - 1] if s else prev
                if before < 0 or self.pair_ok(before, token):
                    last = token
        if last < 0:
            raise ValueError("bytes without a tokenisation")
        pending += bytes((byte,))
        lasts += (last,)
        if going and not going[0][0]:        # an entry may still begin where the state does
            return (prev, pending, lasts, tuple(going)), ()
        # the paths to all later boundaries are one up to the last end they share
        size, cut = m.size_of, len(pending)
        for s, _ in going:
            while cut != s:
                if cut > s:
                    cut -= size[lasts[cut - 1]]
                else:
                    s -= size[lasts[s - 1]]
            if not cut:
                return (prev, pending, lasts, tuple(going)), ()
        return ((lasts[cut - 1], pending[cut:], lasts[cut:], tuple([(s - cut, node) for s, node in going])),
                self._tail(lasts[:cut]))

    def encode(self, raw: bytes) -> list[int]:
        """Ids of one piece.  With the tables full, steps from states not in
        them are made in passing; after many such steps they start anew."""
        if self.passing > 4 * self.max_states:
            self.reset()
        at, out, steps = self.start, [], self.steps
        state = None                         # the state, where it has no number
        for byte in raw:
            if state is None:
                key = byte << 32 | at
                move = steps.get(key)
                if move is not None:
                    at, ids = move
                    if ids:
                        out += ids
                    continue
                state, ids = self.step(self.states[at], byte)
                if len(self.states) < self.max_states:
                    at, state = self._keep(state), None
                    steps[key] = at, ids
                    out += ids
                    continue
            else:
                state, ids = self.step(state, byte)
            self.passing += 1
            out += ids
            known = self.index.get(state[:2])
            if known is not None:
                at, state = known, None
        if state is None:
            tail = self.ends.get(at)
            if tail is None:
                tail = self.ends[at] = self._tail(self.states[at][2])
        else:
            tail = self._tail(state[2])
        out += tail
        return out

    def _tail(self, lasts: tuple) -> tuple[int, ...]:
        return tuple([lasts[n - 1] for n in reversed(self.path(lasts, len(lasts)))])


class Utf8Stream:
    """Incremental UTF-8: feed chunks, get text; a character may span chunks.
    Ill-formed bytes become U+FFFD, one for each maximal ill-formed part."""

    # state -> [(low byte, high byte, next state)]; 0 is between characters
    TABLE = {
        0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5),
            (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
        1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
        4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)],
    }
    NEXT = [[next((to for lo, hi, to in rows if lo <= b <= hi), -1) for b in range(256)]
            for _, rows in sorted(TABLE.items())]

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, chunk: bytes) -> str:
        out, i, n = [], 0, len(chunk)
        while i < n:
            if not self.state:               # between characters: take what is well formed
                try:
                    out.append(chunk[i:].decode() if i else chunk.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(chunk[i:i + e.start].decode())
                    i += e.start
            to = self.NEXT[self.state][chunk[i]]
            if to < 0:
                out.append("\N{REPLACEMENT CHARACTER}")
                i += not self.state          # a byte that ends a part may begin the next
                self.state, self.held = 0, b""
                continue
            self.held += chunk[i:i + 1]
            self.state = to
            i += 1
            if not to:
                out.append(self.held.decode())
                self.held = b""
        return "".join(out)

    def finish(self) -> str:
        rest = "\N{REPLACEMENT CHARACTER}" if self.state else ""
        self.state, self.held = 0, b""
        return rest


class Tokenizer:
    """Texts to ids and back."""

    def __init__(self, path: str, pattern: str, max_pieces: int = MAX_PIECES,
                 max_states: int = MAX_STATES):
        self.merges, self.max_pieces = Merges(path), max_pieces
        self.fst = Transducer(self.merges, max_states)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}     # pieces met, while there is room
        self.passing = 0
        size = max(self.merges.bytes_of) + 1
        self.table = [self.merges.bytes_of.get(i, b"") for i in range(size)]

    def encode(self, text: str) -> np.ndarray:
        if self.passing > 4 * self.max_pieces:    # pieces have changed: learn them anew
            self.known, self.passing = {}, 0
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.fst.encode(piece.encode()))
                if len(known) < self.max_pieces and len(piece) <= MAX_PIECE:
                    known[piece] = ids
                else:
                    self.passing += 1
            out += ids
        return np.array(out, dtype="<u4")

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, np.asarray(ids).tolist()))

    def decode(self, ids, chunk: int = 4096) -> str:
        """Text of ``ids``, decoded in chunks by the streaming machine."""
        ids = np.asarray(ids)
        stream = Utf8Stream()
        parts = [stream.feed(self.decode_bytes(ids[i:i + chunk])) for i in range(0, len(ids), chunk)]
        return "".join(parts) + stream.finish()


@lru_cache(maxsize=1)
def _tables(path: str, pattern: str, max_pieces: int, max_states: int) -> Tokenizer:
    return Tokenizer(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)),
                     pattern, max_pieces, max_states)


def _release() -> None:
    _tables.cache_clear()
    gc.enable()
    gc.collect()


@contextmanager
def _tokenizer(*key):
    """The worker process's tokenizer, kept from task to task; a worker that
    Spark keeps for other stages drops it after ``IDLE_SECONDS``."""
    global _idle
    if _idle is not None:
        _idle.cancel()
    gc.disable()                # the tables hold no cycles, and scanning them costs half the time
    try:
        yield _tables(*key)
    finally:
        _idle = threading.Timer(IDLE_SECONDS, _release)
        _idle.daemon = True
        _idle.start()


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text",
           ids: bool = True, digests: bool = False, max_pieces: int = MAX_PIECES,
           max_states: int = MAX_STATES) -> DataFrame:
    """``docs`` with ``n_tokens``, with ``ids`` (array of ints) and with
    ``digests``: the hashes of the ids and of the bytes decoded from them.
    The file ``vocabulary`` (about 1 MB) is sent along for nodes that lack it.
    ``max_pieces`` and ``max_states`` bound a worker's tables (about 230 and
    700 bytes each); they change its speed, not its results."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    ids_c, n_c, sha_c, back_c = (fresh_name(docs, c) for c in (
        "ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    new = {n_c: F.lit(0).cast("long")}
    new |= {ids_c: F.array().cast("array<int>")} if ids else {}
    new |= {sha_c: F.lit(""), back_c: F.lit("")} if digests else {}
    df, added = docs.withColumns(new), list(new)

    def run(batches):
        with _tokenizer(vocabulary, pattern, max_pieces, max_states) as tok:
            for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
                names = batch.schema.names
                out = {c: [] for c in added}
                for value in batch.column(names.index(text_col)):
                    got = tok.encode(value.as_py() or "")
                    out[n_c].append(len(got))
                    if digests:
                        out[sha_c].append(hashlib.sha256(got.tobytes()).hexdigest())
                        out[back_c].append(hashlib.sha256(tok.decode(got).encode()).hexdigest())
                    if ids:
                        out[ids_c].append(got.astype(np.int32))
                cols = {c: pa.array(v, df_types[c]) for c, v in out.items()}
                yield pa.RecordBatch.from_arrays(
                    [cols[c] if c in cols else batch.column(i) for i, c in enumerate(names)], names=names)

    df_types = {n_c: pa.int64(), sha_c: pa.string(), back_c: pa.string(), ids_c: pa.list_(pa.int32())}
    return map_batches(df, run, df.schema)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids",
           out: str = "text") -> DataFrame:
    """``tokens`` with the text of ``ids_col`` in ``out``."""
    tokens.sparkSession.sparkContext.addFile(vocabulary)
    df = tokens.withColumn(out, F.lit(""))

    def run(batches):
        with _tokenizer(vocabulary, pattern, MAX_PIECES, MAX_STATES) as tok:
            for batch in batches:
                names = batch.schema.names
                texts = pa.array([tok.decode(v.as_py() or []) for v in
                                  batch.column(names.index(ids_col))], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [texts if c == out else batch.column(i) for i, c in enumerate(names)], names=names)

    return map_batches(df, run, df.schema)


def report(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs.select("doc_id", "text"), vocabulary, pattern, ids=False, digests=True).drop("text")
