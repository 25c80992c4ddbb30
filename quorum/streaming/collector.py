"""Stateful, deadline-bounded collection of answers.

``transformWithState`` keyed by a remainder of the guid's hash, one of ``STATE_KEYS``
(guids are unique per measurement, so no hot key).  A key's requests are one value of
the state, ``requests``, durable in the state store (RocksDB): a call of the processor, a
read and a write of the state and a timer cost far more than the work on a request, and
the requests of a micro-batch that share a key share them.  Held of a request:

* the start information, from its start row, once it is ``opened``;
* its answers, one per model key (a replayed answer is not counted twice);
* ``due_ms``, when its time is over.  The key's one timer is at the first of these;
* once it is decided, its mark.  Marks lie apart (``_Held``): of those that no row of a
  micro-batch asks for, only the guids are looked at.

Rows reach the processor and leave it in pieces, the rows of a key as one value
(``packed``, ``unpacked``): a row by itself costs a conversion of each of its columns on
both sides of the Python worker.

Only a start row opens a request.  An answer without one waits (its start may be
read after it) and is given out as ``kind = 'unknown'`` when the grace is over.  So
a decided request needs its mark for a bounded grace only: an answer that comes
still later finds no request, and cannot open one.  State is bounded by
the requests of one grace.

Which answers count depends on the rows alone: ``latency_ms <= timeout_ms``.  A
request is decided when ``quorum`` answers in time are there, or by its timer:
the deadline and ``settle_ms`` after its start was read, on the clock of the job.  No
watermark takes part: no row is dropped for being old or out of order, and at the
end of the input the timers of open requests still fire.  Answers that come
after the decision, or past the deadline, are ``kind = 'late'`` rows (the audit of J7).

The decision is the column expression of a decider (``operators.deciders``) over the
counted answers, the same object as in batch, evaluated after the state operator.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections import namedtuple
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quorum import schemas
from quorum.functions.columns import VOTER_MODEL
from quorum.operators import deciders
from quorum.session import ship_package

OUTPUT = T.StructType(schemas.RESULTS.fields + [
    T.StructField("kind", T.StringType()),
    T.StructField("late_model", T.StringType()),
    T.StructField("late_ms", T.LongType()),
])
# what the state operator gives out: the counted answers instead of the result
_DECIDED = T.StructType([f for f in OUTPUT.fields if f.name != "result"]
                        + [T.StructField("answers", T.ArrayType(T.StructType([
                            T.StructField("latency_ms", T.LongType()), T.StructField("data_model", T.StringType()),
                            T.StructField("result", T.IntegerType())])))])

#: what a start row says of its request
START = ["event_id", "data_type", "ts", "label", "n_models", "timeout_ms"]
_REQUEST = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("data_type", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("label", T.IntegerType()),
    T.StructField("n_models", T.IntegerType()), T.StructField("timeout_ms", T.LongType()),
    T.StructField("opened", T.BooleanType()), T.StructField("start_ms", T.LongType()),
    T.StructField("due_ms", T.LongType()), T.StructField("done", T.BooleanType()),
    T.StructField("answers", _DECIDED["answers"].dataType)])
# one value per key, so that a key costs one read and one write of the state; ``requests``: see _Held
_GROUP = T.StructType([T.StructField("due_ms", T.LongType()), T.StructField("requests", T.BinaryType())])

#: keys of the state: a key holds the requests whose guids have its remainder.  Fixed for the life of a checkpoint
STATE_KEYS = 1 << 11
#: rows of the input that are dealt into pieces at once
PACK_ROWS = 1 << 18
#: pieces of marks in a key, above which neighbours of about one size are merged
MARK_PIECES = 8

_CAME = ["guid", *START, "is_start", "answered", "data_model", "latency_ms", "result"]
_Out = namedtuple("_Out", _DECIDED.fieldNames())
_PACKED = T.StructType([T.StructField("state_key", T.LongType()), T.StructField("rows", T.BinaryType())])

GRACE_MS = 3_600_000
SETTLE_MS = 2_000


def _new(guid) -> dict:
    return dict.fromkeys(_REQUEST.fieldNames()) | {"guid": guid, "opened": False, "done": False, "answers": []}


_Marks = namedtuple("_Marks", "first last n guids requests")


class _Held:
    """The requests of a key: ``open``, those not decided, by guid, and pieces of marks of
    decided ones.  A piece has its guids and its requests as two values, so that the
    requests are unpacked only for a guid that is asked for, and not packed again."""

    def __init__(self, value: bytes | None = None):
        names = _REQUEST.fieldNames()
        requests, pieces = pickle.loads(value) if value else ([], [])
        self.open = {r[0]: dict(zip(names, r)) for r in requests}
        self.pieces = [_Marks(*p) for p in pieces]
        self.fresh: dict = {}           # decided in this call
        self._places = self._requests = None

    def get(self, guid) -> dict | None:
        st = self.open.get(guid) or self.fresh.get(guid)
        if st is not None or not self.pieces:
            return st
        if self._places is None:
            self._places = [dict(zip(g, range(len(g)))) for g in (pickle.loads(p.guids) for p in self.pieces)]
            self._requests = [None] * len(self.pieces)
        for k, places in enumerate(self._places):
            at = places.get(guid)
            if at is not None:
                if self._requests[k] is None:
                    self._requests[k] = pickle.loads(self.pieces[k].requests)
                return dict(zip(_REQUEST.fieldNames(), self._requests[k][at]))
        return None

    def put(self, guid, st: dict) -> None:
        if st["done"]:
            self.open.pop(guid, None)
            self.fresh[guid] = st
        else:
            self.open[guid] = st

    def forget(self, now: int) -> None:
        """Drop the marks whose grace is over."""
        kept = []
        for p in self.pieces:
            if p.first <= now < p.last:
                kept.append(_marks([r for r in pickle.loads(p.requests) if r[_DUE] > now]))
            elif p.first > now:
                kept.append(p)
        self.pieces = kept

    def due(self) -> int | None:
        return min([st["due_ms"] for st in self.open.values()] + [p.first for p in self.pieces], default=None)

    def settle(self) -> None:
        """The fresh marks as a piece; pieces of about one size become one."""
        if self.fresh:
            names = _REQUEST.fieldNames()
            self.pieces.append(_marks([tuple([st[c] for c in names]) for st in self.fresh.values()]))
            self.fresh = {}
        while len(self.pieces) > MARK_PIECES:
            k = min(range(len(self.pieces) - 1), key=lambda i: self.pieces[i].n + self.pieces[i + 1].n)
            both = pickle.loads(self.pieces[k].requests) + pickle.loads(self.pieces[k + 1].requests)
            self.pieces[k:k + 2] = [_marks(both)]

    def value(self) -> bytes | None:
        names = _REQUEST.fieldNames()
        if not (self.open or self.pieces):
            return None
        return pickle.dumps(([tuple([st[c] for c in names]) for st in self.open.values()], [tuple(p) for p in self.pieces]))

    def requests(self) -> list[tuple]:
        """Every request held, decided or not."""
        names = _REQUEST.fieldNames()
        return [tuple([st[c] for c in names]) for st in self.open.values()] + [r for p in self.pieces for r in pickle.loads(p.requests)]


_DUE = _REQUEST.fieldNames().index("due_ms")


def _marks(requests: list[tuple]) -> _Marks:
    dues = [r[_DUE] for r in requests]
    return _Marks(min(dues), max(dues), len(requests), pickle.dumps([r[0] for r in requests]), pickle.dumps(requests))


def held_requests(value: bytes | None) -> list[tuple]:
    """The requests in a value of the state, in the fields of ``_REQUEST``."""
    at = _REQUEST.fieldNames().index("ts")
    epoch = dt.datetime(1970, 1, 1)
    return [r[:at] + (epoch + dt.timedelta(microseconds=r[at]) if isinstance(r[at], int) else r[at],) + r[at + 1:]
            for r in _Held(value).requests()]


class CollectorProcessor(StatefulProcessor):

    def __init__(self, quorum="all", time_mode: str = "event", settle_ms: int = SETTLE_MS, grace_ms: int = GRACE_MS):
        """``time_mode="event"``: an answer's latency is its ``latency_ms``
        (arrival minus measurement time).  ``"processing"``: it is measured on the
        wall clock from when the request was first seen.  ``settle_ms``: how long after the
        deadline an answer that was in time may still be on its way to the job;
        ``grace_ms``: how long a decided request, or an answer without one, is remembered."""
        self.quorum, self.time_mode, self.settle_ms, self.grace_ms = quorum, time_mode, settle_ms, grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.group = handle.getValueState("requests", _GROUP)

    # -- helpers ---------------------------------------------------------
    def _held(self) -> tuple[_Held, int | None]:
        """Requests of the key, and the time of the key's timer."""
        group = self.group.get()
        return (_Held(), None) if group is None else (_Held(bytes(group[1])), group[0])

    def _keep(self, held: _Held, timer: int | None) -> None:
        """Write the requests back, with one timer at the first time that one of them is due."""
        held.settle()
        due = held.due()
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        value = held.value()
        if value is not None:
            self.group.update((due, value))
        else:
            self.group.clear()

    def _row(self, guid, st, kind="result", counted=(), duration=0, outcome="timeout", late=(None, None)) -> _Out:
        processed = bool(counted)
        return _Out(guid=guid, event_id=st["event_id"], data_type=st["data_type"], ts=st["ts"], n_models=st["n_models"],
                    processed=processed, model=VOTER_MODEL if processed else "",
                    source=st["label"] if processed else 0,
                    duration_ms=duration, outcome=outcome, kind=kind,
                    late_model=late[0], late_ms=late[1], answers=counted)

    def _late(self, guid, st, answers, kind="late") -> list[_Out]:
        return [self._row(guid, st, kind, outcome=kind, late=(dm, lat)) for lat, dm, _ in answers]

    def _decide(self, guid, st: dict, now: int, final: bool) -> list[_Out]:
        timeout, held = st["timeout_ms"], st["answers"]
        on_time = [a for a in held if a[0] <= timeout]
        k = st["n_models"] if self.quorum in (None, "all") else int(self.quorum)
        complete = len(on_time) >= k
        if not complete and not final:
            return []
        counted = on_time[:k] if complete else on_time
        rows = [self._row(guid, st, counted=counted, duration=counted[-1][0] if complete else timeout,
                          outcome="complete" if complete else "deadline") if counted else self._row(guid, st)]
        rows += self._late(guid, st, [a for a in held if a not in counted])
        self._finish(st, now)
        return rows

    def _finish(self, st: dict, now: int) -> None:
        st["done"], st["answers"], st["due_ms"] = True, [], now + max(self.grace_ms, 1)

    # -- callbacks -------------------------------------------------------
    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        starts, answers = {}, {}
        for r in rows:
            if r.is_start:
                starts.setdefault(r.guid, tuple([getattr(r, c) for c in START]))
            if r.answered:
                answers.setdefault(r.guid, []).append((r.latency_ms, r.data_model, r.result))
        return map(_as_row, self.collect(starts, answers, int(timerValues.getCurrentProcessingTimeInMs())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return map(_as_row, self.expire(int(timerValues.getCurrentProcessingTimeInMs())))

    def collect(self, starts: dict, answers: dict, now: int) -> list[_Out]:
        """What came for a key: by guid the start information (``START``) and the answers
        (latency, model key, result)."""
        held, timer = self._held()
        out = []
        for guid in starts | answers:
            st = held.get(guid)
            decided = st is not None and st["done"]
            st = st or _new(guid)
            out += self._take(guid, st, starts.get(guid), answers.get(guid, ()), now)
            if st["due_ms"] is not None and not decided:
                held.put(guid, st)
        self._keep(held, timer)
        return out

    def _take(self, guid, st: dict, start: tuple | None, came: Iterable[tuple], now: int) -> list[_Out]:
        out = []
        if start is not None and not st["opened"]:
            st.update(zip(START, start), opened=True, start_ms=now)
            if st["n_models"] == 0:
                self._finish(st, now)
                out.append(self._row(guid, st, outcome="no_model"))
            else:
                st["due_ms"] = now + st["timeout_ms"] + self.settle_ms
        if self.time_mode == "processing":
            lat = now - st["start_ms"] if st["opened"] else 0
            came = [(lat, dm, result) for _, dm, result in came]
        if st["done"]:
            return out + self._late(guid, st, came)
        if came:
            answers = {a[1]: a for a in st["answers"]}
            for a in sorted(came, key=lambda a: (a[0], a[2] is None, a[2] or 0)) if len(came) > 1 else came:
                if a[1] not in answers or answers[a[1]][0] > a[0]:
                    answers[a[1]] = a
            st["answers"] = sorted(answers.values(), key=lambda a: a[:2]) if len(answers) > 1 else list(answers.values())
        if not st["opened"]:
            if came:
                st["due_ms"] = now + self.grace_ms
            return out
        return self._decide(guid, st, now, final=False)

    def expire(self, now: int) -> list[_Out]:
        """The key's timer came."""
        held, _ = self._held()
        held.forget(now)
        out = []
        for guid, st in list(held.open.items()):
            if st["due_ms"] > now:
                continue
            if st["opened"]:
                out += self._decide(guid, st, now, final=True)
                held.put(guid, st)
                continue
            out += self._late(guid, st, st["answers"], "unknown")      # answers that nobody waited for
            del held.open[guid]
        self._keep(held, None)           # (the timer that came: Spark removes it)
        return out

    def close(self) -> None:
        pass


def _as_row(out: _Out) -> Row:
    return Row(**out._asdict() | {"answers": [dict(zip(_ANSWER, a)) for a in out.answers]})


_ANSWER = _DECIDED["answers"].dataType.elementType.fieldNames()


class PackedCollector(CollectorProcessor):
    """The same on pieces: a row that comes in is rows of a key (``packed``), one that goes
    out is what they gave (``unpacked``)."""

    def init(self, handle) -> None:
        super().init(handle)
        self.schema = _arrow(_came_type())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        import pyarrow as pa
        starts, answers, same = {}, {}, {}
        batches = [pa.ipc.read_record_batch(pa.py_buffer(r.rows), self.schema) for r in rows]
        batch = batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        opening = batch.filter(batch.column("is_start"))
        for guid, *start in zip(*[_values(opening, c, same) for c in ["guid", *START]]):
            starts.setdefault(guid, start)
        answering = batch.filter(batch.column("answered"))
        for guid, *answer in zip(*[_values(answering, c, same) for c in ["guid", "latency_ms", "data_model", "result"]]):
            answers.setdefault(guid, []).append(tuple(answer))
        return _piece(self.collect(starts, answers, int(timerValues.getCurrentProcessingTimeInMs())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return _piece(self.expire(int(timerValues.getCurrentProcessingTimeInMs())))


def _values(batch, name: str, same: dict) -> list:
    """A column's values; of a type or model, which are few, one object for each."""
    column = batch.column(name)
    values = column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()
    return [same.setdefault(v, v) for v in values] if name in ("data_type", "data_model") else values


def _came_type() -> T.StructType:
    from quorum.streaming.serve_stream import RESPONSES
    return T.StructType([RESPONSES[c] for c in _CAME])


def _arrow(fields: T.StructType):
    """The Arrow schema of a piece: times are whole microseconds."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.TimestampNTZType) else to_arrow_type(f.dataType))
                      for f in fields])


def _piece(out: list[_Out]) -> Iterator[Row]:
    import pyarrow as pa
    if not out:
        return iter(())
    schema, columns = _arrow(_DECIDED), list(zip(*out))
    answers, ends = [], [0]
    for a in columns[-1]:
        answers += a
        ends.append(len(answers))
    of = schema.field("answers").type
    parts = [pa.array(c, f.type) for c, f in zip(zip(*answers) if answers else [()] * len(_ANSWER), of.value_type)]
    answers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(of.value_type)))
    arrays = [pa.array(c, f.type) for c, f in zip(columns[:-1], schema)] + [answers.cast(of)]
    return iter([Row(rows=pa.RecordBatch.from_arrays(arrays, schema=schema).serialize().to_pybytes())])


def packed(batches: Iterator) -> Iterator:
    """Rows with their ``state_key`` -> for each key of ``PACK_ROWS`` rows or so, these as one value."""
    import numpy as np
    import pyarrow as pa
    schema, out = _arrow(_came_type()), pa.schema([("state_key", pa.int64()), ("rows", pa.binary())])

    def piece(held):
        table = pa.Table.from_batches(held)
        keys = table.column("state_key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        table = pa.table([table.column(f.name).cast(f.type) for f in schema], schema=schema)
        rows = table.take(pa.array(order)).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        values = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.array(values, pa.binary())], schema=out)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK_ROWS:
            yield piece(held)
            held, n = [], 0
    if held:
        yield piece(held)


def unpacked(batches: Iterator) -> Iterator:
    """What ``PackedCollector`` gives out, as rows of ``_DECIDED``."""
    import pyarrow as pa
    schema = _arrow(_DECIDED)
    at = schema.get_field_index("ts")
    for batch in batches:
        for value in batch.column(0):
            rows = pa.ipc.read_record_batch(value.as_buffer(), schema)
            yield rows.set_column(at, "ts", rows.column(at).cast(pa.timestamp("us")))


def collect_stream(responses: DataFrame, quorum="all", time_mode: str = "event", threshold: float = 0.5,
                   decider=None, settle_ms: int = SETTLE_MS, grace_ms: int = GRACE_MS) -> DataFrame:
    """Streaming results from a stream of start and answer rows
    (``serve_stream.RESPONSES``).  Start the sink inside
    ``quorum.session.rocksdb_state(spark)`` (the state store must be RocksDB for
    transformWithState) with a ``processingTime`` trigger: deadlines need a clock."""
    ship_package(responses.sparkSession)
    rows = responses.select(*_CAME, F.pmod(F.xxhash64("guid"), F.lit(STATE_KEYS)).alias("state_key"))
    out = rows.mapInArrow(packed, _PACKED).groupBy("state_key").transformWithState(
        statefulProcessor=PackedCollector(quorum, time_mode, settle_ms, grace_ms),
        outputStructType=T.StructType([_PACKED["rows"]]), outputMode="Append", timeMode="ProcessingTime").mapInArrow(unpacked, _DECIDED)
    decided = (decider or deciders.vote(threshold))(F.col("answers"))
    result = F.when((F.col("kind") == "result") & F.col("processed"), decided).cast("int")
    return out.withColumn("result", result).select(*OUTPUT.fieldNames())
