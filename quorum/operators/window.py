"""Last-N count window per model version.

Semantics: for each row, the values of the last ``width`` rows of its
partition (oldest first, the row itself last) in ``order``; NULL while fewer
than ``width`` rows have been seen.  A new model version is a new partition,
so the window restarts empty on every hot swap.

Physical form.  A plain ``Window.partitionBy(data_model, version)`` puts all
rows of one model version in one task; a hot model (a third of all rows)
would then be a single task.  Instead each version is split into time
buckets (``bucket_seconds``):

1. inside ``(version, bucket)`` the previous ``W-1`` values come from
   ``lag`` (offset frames: one sort, one pass, no per-row re-aggregation);
2. the last ``W-1`` rows of every bucket (its "tail", a ``row_number``
   filter that Spark turns into a map-side group limit) form a table of at
   most ``buckets x (W-1)`` rows - bounded by the time span, not by the data
   volume; over it, the same ``lag`` trick gives, at the last row of each
   bucket, the ``W-1`` values that precede the *next* non-empty bucket (the
   "carry"), and ``lead`` names that bucket;
3. rows near the start of a bucket prepend the carry (a join on
   ``(version, bucket)`` whose build side is the small carry table).

Bucket size (default 60 s): a task holds one version's rows of one bucket,
so a model taking a third of a large stream stays at about its rows per
minute; AQE packs the many small buckets of quiet models into few tasks, and
the tail table grows with the time span (buckets x (W-1) rows per version),
not with the data.

Frame offsets must be literals, so ``W`` is the largest width; each row then
``slice``s its own width.  Values travel inside a struct so that a NULL
value (still a row) differs from a missing row; a NULL inside a full window
makes the score NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.operators.asof import micros, time_bucket

DEFAULT_WINDOW_BUCKET_SECONDS = 60


def _prev_values(v: str, w: Window, n: int) -> Column:
    """``[v(-n), ..., v(-1)]`` over ``w``, missing rows dropped (oldest first)."""
    lags = [F.lag(v, k).over(w) for k in range(n, 0, -1)]
    return F.filter(F.array(*lags), lambda x: x.isNotNull())


def _upto(v: str, w: Window, n: int) -> Column:
    """The previous ``n`` values and the current one."""
    if n == 0:
        return F.array(v)
    return F.concat(_prev_values(v, w, n), F.array(v))


def last_n_window(df: DataFrame, value: Column | str, width: Column | str | int,
                  max_width: int, partition: Sequence[str] = ("data_model", "version"),
                  order: Sequence[str] = ("ts", "event_id"), ts: str = "ts",
                  out: str = "window",
                  bucket_seconds: int | None = DEFAULT_WINDOW_BUCKET_SECONDS,
                  bucket: Column | None = None,
                  tail_source: DataFrame | None = None) -> DataFrame:
    """Add ``out`` (``array<value type>`` or NULL) to ``df``.  With
    ``width=None`` ``out`` holds up to the last ``max_width`` values, to be cut
    later with ``last_values`` (the width can then join in after the shuffle).

    ``bucket_seconds=None`` keeps one partition per version (no split).
    ``bucket`` overrides the time bucket; it must not decrease along ``order``.
    ``tail_source``: the same rows (partition, order, ``ts`` and ``value``
    columns) from a cheaper plan, used for the tail branch instead of ``df``."""
    W = int(max_width)
    if W < 1:
        raise ValueError("max_width must be >= 1")
    val = F.col(value) if isinstance(value, str) else value
    wid = None if width is None else (
        F.lit(width) if isinstance(width, int) else (F.col(width) if isinstance(width, str) else width))
    part = list(partition)
    d = df.withColumn("__v", F.struct(val.alias("v")))
    if W == 1:
        d = d.withColumn("__full", F.array("__v"))
    elif not bucket_seconds and bucket is None:
        w = Window.partitionBy(*part).orderBy(*order)
        d = d.withColumn("__full", _upto("__v", w, W - 1))
    else:
        d = d.withColumn("__b", bucket if bucket is not None else time_bucket(ts, bucket_seconds))
        local = Window.partitionBy(*part, "__b").orderBy(*order)
        # tails: last W-1 rows per (version, bucket).  A row_number filter
        # lets Spark limit each group map-side (WindowGroupLimit) before the
        # exchange, so this branch shuffles at most W-1 rows per group and task.
        rev = Window.partitionBy(*part, "__b").orderBy(*[F.col(o).desc() for o in order])
        if tail_source is not None:
            if bucket is not None or not isinstance(value, str):
                raise ValueError("tail_source needs a column name value and time buckets")
            cols = list(dict.fromkeys([*part, *order, ts, value]))
            src = tail_source.select(*cols).withColumns({
                "__b": time_bucket(ts, bucket_seconds),
                "__v": F.struct(F.col(value).alias("v"))})
        else:
            src = d
        tails = (src.select(*part, "__b", *order, "__v")
                 .withColumn("__rd", F.row_number().over(rev))
                 .filter(F.col("__rd") <= W - 1))
        seq = Window.partitionBy(*part).orderBy(*order)
        carry = (tails
                 .withColumns({"__cw": _upto("__v", seq, W - 2),
                               "__nb": F.lead("__b", 1).over(seq)})
                 .filter((F.col("__rd") == 1) & F.col("__nb").isNotNull())
                 .select(*part, F.col("__nb").alias("__b"), F.col("__cw").alias("__carry")))
        d = d.withColumn("__prev", _prev_values("__v", local, W - 1))
        d = d.join(carry, [*part, "__b"], "left")
        local_n = F.size("__prev") + 1
        head = F.when(local_n >= W, F.col("__prev")) \
                .otherwise(F.concat(F.coalesce("__carry", F.array()), F.col("__prev")))
        d = d.withColumn("__full", F.concat(head, F.array("__v"))) \
             .drop("__b", "__prev", "__carry")
    vals = F.transform("__full", lambda x: x["v"])
    d = d.withColumn(out, vals if wid is None else last_values(vals, wid))
    return d.drop("__v", "__full")


def last_values(values: Column, width: Column) -> Column:
    """The last ``width`` entries of ``values``; NULL when there are fewer."""
    n = F.size(values)
    return F.when((width >= 1) & (n >= width), F.slice(values, n - width + 1, width))


# One window per measurement ----------------------------------------------------
#
# All models of a data type see the same measurements, so their windows are cuts of
# one array per measurement: its type's last W raw values, from the version's
# start on, as many as the version is wide.  The array is computed once per
# measurement, in buckets of consecutive measurements of a type whose borders
# follow the density of the data; what a bucket needs from before its border is
# dealt to it as context rows, so a single exchange carries the measurements.

#: a bucket has about this many measurements, or CONTEXT_SHARE windows if that is more
BUCKET_ROWS = 50_000
CONTEXT_SHARE = 100
#: time slots of the density histogram, over all types together, each for SLOT_ROWS measurements or more
SLOTS = 1 << 17
SLOT_ROWS = 64

LAST = "__last"


def density_slots(rows: DataFrame, types: DataFrame, width: int, bucket_rows: int = BUCKET_ROWS,
                  slots: int = SLOTS) -> DataFrame | None:
    """Where the measurements of each slot of time go: ``(data_type, __start, __span,
    __slot, __bucket, __context)``; ``None`` if every type fits one bucket.

    Two column-pruned passes: rows and time span per type, then rows per slot,
    at most ``slots`` of them and one a type.  A type gets slots in proportion to its rows,
    a bucket ends at the first slot at which it has enough rows, and the slots before a
    border that hold the ``width - 1`` rows a window can reach back to are context
    of the bucket after it (of several, if buckets there are smaller than a window).
    ``types`` (one column, proven small) are the types that have models."""
    slim = rows.select("data_type", micros("ts").alias("__us")).join(F.broadcast(types), "data_type")
    per = slim.groupBy("data_type").agg(F.count("*").alias("n"), F.min("__us").alias("a"), F.max("__us").alias("b")).collect()
    total = sum(r.n for r in per)
    slots = min(slots, total // SLOT_ROWS)
    enough = max(bucket_rows, CONTEXT_SHARE * width)
    if all(r.n <= enough for r in per):
        return None
    spans = [(r.data_type, r.a, max(1, -(-(r.b - r.a + 1) // max(1, slots * r.n // total)))) for r in per if r.a is not None]
    grid = rows.sparkSession.createDataFrame(spans, "data_type string, __start long, __span long")
    counts = (slim.join(F.broadcast(grid), "data_type")
              .groupBy("data_type", _slot(F.col("__us")).alias("__slot")).count().collect())
    by_type: dict = {}
    for r in counts:
        by_type.setdefault(r.data_type, []).append((r["__slot"], r["count"]))
    out = []
    for data_type, start, span in spans:
        out += [(data_type, start, span, *x) for x in _assign(sorted(by_type.get(data_type, [])), enough, width - 1)]
    return rows.sparkSession.createDataFrame(
        out, "data_type string, __start long, __span long, __slot long, __bucket int, __context array<int>")


def _slot(us: Column) -> Column:
    return F.floor((us - F.col("__start")) / F.col("__span"))


def _assign(slots: list[tuple[int, int]], enough: int, back: int) -> list[tuple[int, int, list[int]]]:
    """(slot, bucket, buckets it is context of) for the (slot, rows) of a type, in order of time."""
    out, borders, bucket, have = [], [], 0, 0
    for i, (slot, n) in enumerate(slots):
        if have >= enough:
            bucket, have = bucket + 1, 0
            borders.append(i)
        have += n
        out.append((slot, bucket, []))
    for j, i in enumerate(borders):
        need = back
        while need > 0 and i > 0:
            i -= 1
            out[i][2].append(j + 1)
            need -= slots[i][1]
    return out


def with_last_values(rows: DataFrame, value: str, width: int, slots: DataFrame | None, place: str,
                     order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Add ``LAST``: the type's last ``width`` (ts, value) pairs up to the row, oldest
    first, and ``place``: rows are partitioned by it and the data type.

    ``slots``: of :func:`density_slots`; measurements of types that are not in it
    have no models and need no neighbours."""
    if slots is None:
        d = rows.withColumns({place: F.lit(0), "__ctx": F.lit(False)})
    else:
        spans = F.broadcast(slots.coalesce(1).select("data_type", "__start", "__span").distinct())
        dealt = slots.select("data_type", "__slot", "__bucket", "__context")
        d = (rows.join(spans, "data_type", "left").withColumn("__slot", _slot(micros("ts")))
             .join(F.broadcast(dealt), ["data_type", "__slot"], "left"))
        spread = -1 - F.pmod(F.xxhash64(*order), F.lit(1024)).cast("int")
        own = F.array(F.struct(F.coalesce("__bucket", spread).alias("p"), F.lit(False).alias("c")))
        others = F.transform(F.coalesce("__context", F.array().cast("array<int>")), lambda b: F.struct(b.alias("p"), F.lit(True).alias("c")))
        d = (d.withColumn("__to", F.explode(F.concat(own, others)))
             .select(*rows.columns, F.col("__to.p").alias(place), F.col("__to.c").alias("__ctx")))
    w = Window.partitionBy("data_type", place).orderBy(*order)
    pair = F.struct(F.col("ts").alias("ts"), F.col(value).alias("v"))
    return (d.withColumn(LAST, F.collect_list(pair).over(w.rowsBetween(1 - width, Window.currentRow)))
            .filter(~F.col("__ctx")).drop("__ctx"))


def cut_window(last: Column, since: Column, width: Column) -> Column:
    """The last ``width`` values at or after ``since``; NULL when there are fewer."""
    own = F.filter(last, lambda x: x["ts"] >= since)
    return last_values(F.transform(own, lambda x: x["v"]), width)
