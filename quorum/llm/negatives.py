"""Hard negatives by exact inner-product search over anchor-clustered shared lists.

Anchors are clustered by direction.  For a cluster, every candidate has one
angular upper bound on its inner product with any member u:
``|u| |i| cos(max(0, angle(i, centroid) - widest angle of the cluster))``, whose
order does not depend on u.  So the candidates are sorted by it once per cluster,
and every member walks that shared list, scoring a chunk at a time, until its
k-th best score is above the bound of all that is left: the result is exact.

The same walk serves both searches: the positives (the best rows of the anchor's
label) and, per positive, the best rows of other labels inside a band of scores.

On Spark: candidates are dealt by a hash of their id into blocks of about
``BLOCK_ROWS``, anchors into packs of at most ``PACK_ROWS`` of whole clusters
(a larger cluster is split), and each pair (pack, block) is one group of a cogroup,
bounded on both sides whatever is common in the data.  Blocks are taken in
rounds, each ``GROWTH`` times the blocks before it; the k-th best of the rounds
before is the floor of the next, so that a round hands on about ``GROWTH`` times
k rows for an anchor, however many blocks there are.  Centroids are fitted on at most
``SAMPLE`` anchors (they only shape the bounds, never the result).

Defined results: rows with a null id, label or vector, or a null or
non-finite component take no part; repeated rows and rows that share an id are one row (that of the
smallest label, then vector); vectors of unequal length are compared as if the shorter
ended in zeros; ties go to the smaller id; an empty table, or one without anchors,
gives an empty result; other columns are not looked at.  Components are whole
numbers of 64 bits after scaling; their inner products must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import map_batches, saved
from quorum.session import ship_package

SCALE = 256
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90

BLOCK_ROWS = 8192
PACK_ROWS = 2048
GROWTH = 8
SAMPLE = 4096
CLUSTER_ROWS = 32
MAX_CLUSTERS = 128
CHUNK = 512
#: more than what rounding can take from a cosine bound
MARGIN = 1e-6

_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max
FOUND = "vec_id long, band int, score long, other long"


def valid_rows(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, whole components, one row an id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vec = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = (table.select("vec_id", "label", "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), vec.alias("vec")).alias("r")))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.vec")


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, zeros after the shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    width = max(width, int(lens.max()) if len(lens) else 0)
    out = np.zeros((len(lens), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _exact_type(a: np.ndarray, b: np.ndarray, room: int):
    """The fastest number type in which all inner products, with ``room`` bits below them, are exact."""
    most = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most >= min(2.0 ** 53, 2.0 ** (62 - room)):
        return object
    return np.float32 if most < 2 ** 24 else np.float64


def fit_centroids(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Unit centroids of the sample's directions (spherical k-means, seeds evenly spaced in the sample)."""
    x = sample.astype(np.float64)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    k = min(MAX_CLUSTERS, max(1, len(x) // CLUSTER_ROWS))
    c = x[np.arange(k) * len(x) // k]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            mean = x[near == j].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                c[j] = mean / np.linalg.norm(mean)
    return c


def packed(anchors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vec, cluster, pack) of the anchors, and the number of packs."""
    some = anchors.select("vec", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()
    width = max(len(r.vec) for r in some)
    centroids = fit_centroids(np.array([list(r.vec) + [0] * (width - len(r.vec)) for r in some], dtype=np.int64))

    def nearest(batches):
        for batch in batches:
            x = _matrix(batch.column(2), width)[:, :width].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.argmax(x @ centroids.T, axis=1).astype(np.int32))] if len(x) else
                [*batch.columns, pa.array([], pa.int32())], ["vec_id", "label", "vec", "cluster"])

    rows = saved(map_batches(anchors, nearest, "vec_id long, label long, vec array<long>, cluster int"), "anchors")
    # one row a cluster: small clusters share a pack, a large one is split over several
    table, pack, room = [], -1, 0
    for r in rows.groupBy("cluster").count().orderBy("cluster").collect():
        parts = -(-r["count"] // PACK_ROWS)
        if parts > 1 or r["count"] > room:
            pack += 1
            room = PACK_ROWS if parts == 1 else 0
        room -= r["count"] if parts == 1 else 0
        table.append((r.cluster, pack, parts))
        pack += parts - 1
    places = rows.sparkSession.createDataFrame(table, "cluster int, first int, parts int")
    part = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int")
    return rows.join(F.broadcast(places), "cluster").select(
        "vec_id", "label", "vec", "cluster", (F.col("first") + part).alias("pack")), pack + 1


def _angles(x: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((x @ centre) / np.maximum(norms, 1e-300), -1, 1))


def walk(ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, own: np.ndarray, own_labels: np.ndarray, members: np.ndarray,
         low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[tuple[np.ndarray, ...]]:
    """Best ``k`` candidates of each member and band: arrays (member, band, score, id).

    ``low`` and ``high`` (members x bands) bound the scores that count; ``same`` asks
    for rows of the member's label, else for rows of other labels."""
    n, (m, bands) = len(ids), low.shape
    room = max(1, n.bit_length())
    kind = _exact_type(members, vecs, room)
    exact = object if kind is object else np.int64
    # bounds: one list for all members
    x, u = vecs.astype(np.float64), members.astype(np.float64)
    norms, lengths = np.linalg.norm(x, axis=1), np.linalg.norm(u, axis=1)
    centre = (u / np.maximum(lengths, 1e-300)[:, None]).sum(axis=0)
    size = np.linalg.norm(centre)
    if size > 0:
        centre = centre / size
        widest = _angles(u[lengths > 0], lengths[lengths > 0], centre).max(initial=0)
        bound = norms * (np.cos(np.maximum(0, _angles(x, norms, centre) - widest)) + MARGIN)
    else:
        bound = norms * (1 + MARGIN)
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    # unique keys: score, then the smaller id
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(n)
    low_digits = (n - 1 - rank)[order]
    by_rank = np.sort(ids)
    c, q = vecs[order].astype(kind), members.astype(kind)
    c_ids, c_labels = ids[order], labels[order]
    best = np.full((m, bands, k), -1 << 70 if exact is object else _NONE, dtype=exact)
    none = best[0, 0, 0] if m else 0
    need = low.copy()
    for a in range(0, n, CHUNK):
        open_ = (need <= (lengths * bound[a])[:, None]) & (need <= high)
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            break                                        # certified: nothing left can count for any member
        s = q[live] @ c[a:a + CHUNK].T
        s = s if exact is object else s.astype(np.int64)
        fits = (own_labels[live][:, None] == c_labels[a:a + CHUNK]) == same
        fits &= own[live][:, None] != c_ids[a:a + CHUNK]
        for b in range(bands):
            ok = fits & (s >= need[live, b][:, None]) & (s <= high[live, b][:, None]) & open_[live, b][:, None]
            hit = np.flatnonzero(ok.any(axis=1))
            if not len(hit):
                continue
            keys = np.where(ok[hit], s[hit] * (1 << room) + low_digits[a:a + CHUNK], none)
            rows = live[hit]
            both = np.concatenate([best[rows, b], keys], axis=1)
            both = np.sort(both, axis=1) if exact is object else np.partition(both, both.shape[1] - k, axis=1)
            best[rows, b] = both[:, both.shape[1] - k:]
            worst = best[rows, b].min(axis=1)
            full = worst != none
            need[rows[full], b] = np.maximum(need[rows[full], b], (worst[full] >> room).astype(np.int64))
    i, b, j = np.nonzero(best != none)
    keys = best[i, b, j]
    place = n - 1 - (keys & ((1 << room) - 1)).astype(np.int64)
    return [(i, b, (keys >> room).astype(np.int64), by_rank[place])]


def _walk_group(k: int, same: bool):
    """One pack of anchors against one block of candidates."""
    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if anchors.num_rows and block.num_rows:
            vecs = _matrix(block["vec"])
            members = _matrix(anchors["vec"], vecs.shape[1])
            vecs = np.pad(vecs, ((0, 0), (0, members.shape[1] - vecs.shape[1])))
            ids, labels = np.asarray(block["vec_id"]), np.asarray(block["label"])
            own, own_labels, cluster = (np.asarray(anchors[c]) for c in ("vec_id", "label", "cluster"))
            low, high = (np.array(anchors[c].to_pylist(), dtype=np.int64) for c in ("low", "high"))
            for one in np.unique(cluster):
                at = np.flatnonzero(cluster == one)
                for i, b, score, other in walk(ids, labels, vecs, own[at], own_labels[at], members[at], low[at], high[at], k, same):
                    for column, values in zip(out, (own[at][i], b, score, other)):
                        column.append(values)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)],
                        names=["vec_id", "band", "score", "other"])
    return run


def search(candidates: DataFrame, blocks: int, anchors: DataFrame, packs: int, bands: int, k: int, same: bool) -> DataFrame:
    """(vec_id, band, score, other, rank): the best ``k`` candidates of each anchor and band.

    ``anchors``: as of :func:`packed`, with ``low`` and ``high``, arrays of ``bands`` bounds."""
    ship_package(candidates.sparkSession)
    best, a, b = None, 0, min(1, blocks)
    w = Window.partitionBy("vec_id", "band").orderBy(F.desc("score"), "other")
    while a < blocks:
        asked = anchors
        if best is not None:
            # an anchor's k-th best so far: nothing below it counts any more
            floors = (best.groupBy("vec_id", "band").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
                      .groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "s"))).alias("floors")))
            low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("floors", i.cast("int")), x)))
            asked = anchors.join(floors, "vec_id", "left").withColumn("low", low).drop("floors")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(a), F.lit(b - 1))))
        dealt = (candidates.where(F.col("block").between(a, b - 1))
                 .withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))))
        found = (asked.groupBy("pack", "block").cogroup(dealt.groupBy("pack", "block"))
                 .applyInArrow(_walk_group(k, same), FOUND))
        found = found if best is None else found.union(best.drop("rank"))
        best = saved(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
        a, b = b, min(blocks, b * GROWTH)
    return best


def mine(table: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = saved(valid_rows(table), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % anchor_step == 0)).first()
    if not asked:
        return table.sparkSession.createDataFrame([], out)
    blocks = max(1, round(n / BLOCK_ROWS))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    anchors, packs = packed(rows.where(F.col("vec_id") % anchor_step == 0))
    whole = anchors.withColumns({"low": F.array(F.lit(_NONE + 1)), "high": F.array(F.lit(_MOST))})
    near = search(candidates, blocks, whole, packs, 1, positives, True)
    # a negative score bounds an empty band
    near = near.where("score >= 0").select("vec_id", "other", "score", (F.col("rank") - 1).alias("band"),
                                           F.expr(f"({low_percent} * score + 99) div 100").alias("l"),
                                           F.expr(f"{high_percent} * score div 100").alias("h"))
    bands = near.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("band", "l", "h"))).alias("b"))

    def side(name, missing):
        """One bound a positive; an anchor with fewer positives has empty bands."""
        return F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col("b")[name], i - 1), F.lit(missing)))

    banded = anchors.join(bands, "vec_id").withColumns({"low": side("l", _MOST), "high": side("h", _NONE + 1)}).drop("b")
    far = search(candidates, blocks, banded, packs, positives, negatives, False)
    far = far.select("vec_id", "band", F.col("rank").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.select("vec_id", "band", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).join(
        far, ["vec_id", "band"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(table: DataFrame) -> DataFrame:
    """The hard negatives of the anchors of ``embeddings``."""
    return mine(table)
