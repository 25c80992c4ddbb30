"""Temporal (as-of) joins.

``asof_join(left, right, on, left_ts, right_ts)`` gives every left row the
latest right row with the same key and ``right_ts <= left_ts``.  Spark has no
public as-of join for DataFrames, so it is built from ordinary operators, in
two physical forms:

* **broadcast** - the right side is turned into validity intervals
  ``[valid_from, valid_to)`` (``lead`` over the key) and joined with a
  broadcast hash join on the key plus a range condition.  The left side is
  streamed, never shuffled.  Used when the right side is proven small: its
  rows are counted (``limit(n+1).count()`` stops early) before the hint is
  given.  Where a key has many intervals, they are laid on a grid of time cells
  (``TimeGrid``) and the join is on the key and the cell, so that a left row
  meets the few intervals of its cell and not all of its key.
* **scan** - for a right side of any size: left and right rows are unioned
  and sharded by ``(key, time bucket)``; inside a shard
  ``last(ignorenulls)`` over the time order finds the version, and the
  version that was current when a shard starts comes from a small per-bucket
  summary (one row per key and bucket).  A hot key is split over its time
  buckets, so no task holds a whole key.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST_ROWS = 200_000
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_BUCKET_SECONDS = 3600


def row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row: bytes of strings and binaries, the bytes of
    their text form for arrays, maps and structs, 8 per other field."""
    def size(f):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f.name)))), F.lit(0))
        return F.lit(8)
    parts = [size(f).cast("long") for f in df.schema.fields]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes``
    bytes (one early-stopping job)."""
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return r[0] <= max_rows and (r[1] or 0) <= max_bytes


def time_bucket(ts: str | Column, seconds: int) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def validity_intervals(df: DataFrame, keys: Sequence[str], ts: str,
                       valid_from: str = "valid_from", valid_to: str = "valid_to",
                       tie: Sequence[str] = ()) -> DataFrame:
    """Add ``[valid_from, valid_to)`` per key (W2): a row is valid from its own
    time until the next row of the same key; the last one never expires."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts), *[F.col(t) for t in tie])
    return df.withColumns({valid_from: F.col(ts), valid_to: F.lead(F.col(ts)).over(w)})


#: ``n`` cells of ``width`` microseconds from ``start`` on; the first and the last are open to their side
TimeGrid = namedtuple("TimeGrid", "start width n")

#: a key with no more intervals than this is searched without a grid
GRIDLESS_INTERVALS = 32
MAX_GRID_CELLS = 100_000


def micros(ts: str | Column) -> Column:
    """Microseconds of a time, as one whole number."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_grid(start: int | None, end: int | None, intervals: int, at_once: int = 1) -> TimeGrid | None:
    """A grid between the first and the last start (microseconds) of a key's
    ``intervals``, of which up to ``at_once`` hold at a time: with ``intervals /
    at_once`` cells, laying them on it makes about two rows of each.  ``None``
    where a key has at most ``GRIDLESS_INTERVALS`` or they all hold at once."""
    n = min(intervals // max(at_once, 1), MAX_GRID_CELLS)
    if start is None or intervals <= GRIDLESS_INTERVALS or n <= 1:
        return None
    return TimeGrid(int(start), max(1, -(-(int(end) - int(start) + 1) // n)), n)


def grid_cell(ts: str | Column, grid: TimeGrid) -> Column:
    cell = F.floor((micros(ts) - F.lit(grid.start)) / F.lit(grid.width))
    # (least and greatest skip nulls)
    return F.when(cell.isNotNull(), F.least(F.greatest(cell, F.lit(0)), F.lit(grid.n - 1))).cast("int")


def interval_join(left: DataFrame, intervals: DataFrame, on: Sequence[str], ts: str,
                  valid_from: str = "valid_from", valid_to: str = "valid_to",
                  how: str = "inner", broadcast: bool = True, grid: TimeGrid | None = None) -> DataFrame:
    """Join each left row with every interval of its key that contains ``ts``.

    ``intervals`` key columns are matched by name and dropped from the output.
    With ``grid`` each interval is repeated for the cells it touches and a left row
    meets those of its cell only."""
    r = intervals.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c)
                           for c in intervals.columns])
    lay = []
    if grid is not None:
        last = F.coalesce(grid_cell(valid_to, grid), F.lit(grid.n - 1))
        r = r.withColumn("__cell", F.explode(F.sequence(grid_cell(valid_from, grid), last)))
        lay = [grid_cell(left[ts], grid) == r["__cell"]]
    if broadcast:
        r = F.broadcast(r)
    cond = [left[k] == r[f"__r_{k}"] for k in on] + lay
    cond += [r[valid_from] <= left[ts], r[valid_to].isNull() | (left[ts] < r[valid_to])]
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in on], *(["__cell"] if lay else []))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str,
              right_ts: str, how: str = "left", strategy: str = "auto",
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
              bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
              tie: Sequence[str] = (), grid: TimeGrid | None = None) -> DataFrame:
    """Latest right row per key with ``right_ts <= left_ts``.

    Right columns other than the keys are appended (``right_ts`` included);
    ``how`` is ``left`` (unmatched rows get NULLs) or ``inner``.  ``tie``
    orders right rows that share a key and a time (later one wins); ``grid``
    is for the broadcast form (:func:`interval_join`)."""
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(right, max_broadcast_rows) else "scan"
    if strategy == "broadcast":
        iv = validity_intervals(right, on, right_ts, "__vf", "__vt", tie)
        out = interval_join(left, iv, on, left_ts, "__vf", "__vt", how=how, grid=grid)
        return out.drop("__vf", "__vt")
    if strategy == "scan":
        return _asof_scan(left, right, on, left_ts, right_ts, how, bucket_seconds, tie)
    raise ValueError(f"unknown strategy {strategy!r}")


def _asof_scan(left, right, on, left_ts, right_ts, how, bucket_seconds, tie):
    rcols = [c for c in right.columns if c not in on]
    clash = set(rcols) & set(left.columns)
    if clash:
        raise ValueError(f"right columns clash with left: {sorted(clash)}")
    order_r = F.struct(F.col(right_ts), *[F.col(t) for t in tie])
    lrows = left.select(*[F.col(k) for k in on],
                        F.col(left_ts).alias("__t"),
                        time_bucket(left_ts, bucket_seconds).alias("__b"),
                        F.lit(1).alias("__side"),
                        F.struct(*[F.col(c) for c in left.columns]).alias("__l"),
                        F.lit(None).cast(right.select(F.struct(*rcols)).schema[0].dataType).alias("__r"),
                        F.lit(None).cast(right.select(order_r).schema[0].dataType).alias("__o"))
    rrows = right.select(*[F.col(k) for k in on],
                         F.col(right_ts).alias("__t"),
                         time_bucket(right_ts, bucket_seconds).alias("__b"),
                         F.lit(0).alias("__side"),
                         F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"),
                         F.struct(*[F.col(c) for c in rcols]).alias("__r"),
                         order_r.alias("__o"))
    u = lrows.unionByName(rrows)
    # right rows sort before left rows of the same time: a version is visible at its own time
    w = (Window.partitionBy(*on, "__b").orderBy("__t", "__side", "__o")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("__in", F.last("__r", ignorenulls=True).over(w))
    # per (key, bucket): the version current at the end of each right bucket
    rb = (rrows.groupBy(*on, "__b").agg(F.max_by("__r", "__o").alias("__lastr"))
          .withColumn("__k", F.lit(1)))
    lb = lrows.select(*on, "__b").distinct().withColumn("__lastr", F.lit(None).cast(rb.schema["__lastr"].dataType)) \
        .withColumn("__k", F.lit(0))
    wc = (Window.partitionBy(*on).orderBy("__b", "__k")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = (lb.unionByName(rb)
             .withColumn("__carry", F.last("__lastr", ignorenulls=True).over(wc))
             .filter("__k = 0").select(*on, "__b", "__carry"))
    lres = u.filter("__side = 1").join(carry, [*on, "__b"], "left")
    lres = lres.withColumn("__v", F.coalesce("__in", "__carry"))
    if how == "inner":
        lres = lres.filter(F.col("__v").isNotNull())
    return lres.select("__l.*", *[F.col("__v")[c].alias(c) for c in rcols])
