"""Keyed state machines on streams: snapshots, idempotency, chat limits, active runs.

Decisions that depend on the ones before must see events in time order, while files arrive in any
order. ``InOrder`` holds the marks of a bucket of keys until the watermark has passed them and then
folds each key's in order, so a stream decides exactly as its batch twin does on the same events;
what is later than the watermark is dropped by Spark. Timers run in event time: they fold what is due, and free what a
key's state no longer needs. State lives in Spark's RocksDB store, so it may outgrow memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as fv
from .limits import MICROS, chat_reason, with_micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer, spark: SparkSession):
    """Start a query whose operators keep keyed state: all that is there now, then stop.

    The state store is a setting that a query reads once, at its start.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def watched(events: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Events with ``us``, under a watermark; events without a time are left out, as they have no place in the order."""
    timed = with_micros(events.withColumn(ts, F.col(ts).cast("timestamp")), ts)
    return timed.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark)


class Fold:
    """What ``InOrder`` needs of a state machine; ``state`` is a tuple of plain values or None."""

    #: Columns of a row that ``marks`` reads.
    columns: list[str]
    #: A mark is a tuple: ``us`` first, then what orders marks of the same instant. So many give the order.
    ordered: int

    def marks(self, row: Row) -> Iterable[tuple]:
        raise NotImplementedError

    def step(self, key: tuple, state: tuple | None, mark: tuple) -> tuple[tuple | None, Row | None]:
        """State after the mark, and the row that it gives."""
        raise NotImplementedError

    def tidy(self, state: tuple, us: int) -> tuple[tuple | None, int | None]:
        """What is left of the state when time has passed ``us``, and when to look again."""
        raise NotImplementedError


def _place(mark: tuple, n: int) -> tuple:
    return tuple((x is not None, x) if x is not None else (False, 0) for x in mark[:n])


class InOrder(StatefulProcessor):
    """Runs a ``Fold`` over each key's marks in order, as the watermark passes them.

    Spark's group is a bucket of keys: every call to the state store, and every value in it, is costly
    to hand to the JVM, so the marks of all its keys are stored pickled, as one value a batch, and so
    are the states by key. The first ``width`` columns of a row are its key, and a mark's too.
    """

    def __init__(self, fold: Fold, width: int):
        self.fold, self.width = fold, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "marks binary")
        self.state = handle.getValueState("state", "states binary")

    def wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.width
        marks = [(*row[:n], *m) for row in rows for m in self.fold.marks(row)]
        if marks:
            self.waiting.appendValue((pickle.dumps(marks),))
            self.wake(min(m[n] for m in marks))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, now = self.width, timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[tuple, list[tuple]] = {}
        later = []
        for mark in (m for part in self.waiting.get() for m in pickle.loads(part[0])):
            if mark[n] <= now:
                due.setdefault(mark[:n], []).append(mark[n:])
            else:
                later.append(mark)
        held = self.state.get()
        states = pickle.loads(held[0]) if held is not None else {}
        out = []
        for own, marks in due.items():
            state = states.get(own)
            for mark in sorted(marks, key=lambda m: _place(m, self.fold.ordered)):
                state, row = self.fold.step(own, state, mark)
                if row is not None:
                    out.append(row)
            states[own] = state
        if due:
            if later:
                self.waiting.put([(pickle.dumps(later),)])
                self.wake(min(m[n] for m in later))
            else:
                self.waiting.clear()
        kept, again = {}, None
        for own, state in states.items():
            state, end = self.fold.tidy(state, now) if state is not None else (None, None)
            if state is not None:
                kept[own] = state
                if end is not None:
                    again = end if again is None else min(again, end)
        if kept:
            self.state.update((pickle.dumps(kept),))
            if again is not None:
                self.wake(max(again, now + 1000))
        elif states:
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


#: Buckets of keys in a stream; a query that goes on from a checkpoint keeps its number.
BUCKETS = 2048


def in_order(events: DataFrame, key: list[str], fold: Fold, schema: str | T.StructType, buckets: int = BUCKETS) -> DataFrame:
    """``fold`` over the marks of each ``key`` in order; ``events`` come from ``watched``."""
    own = [F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]
    # the watermark's column has to stay; every other one costs time for each row
    keyed = events.select(*own, *fold.columns, "ts", F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket"))
    return keyed.groupBy("_bucket").transformWithState(InOrder(fold, len(key)), schema, "append", "EventTime")


class ChatLimits(Fold):
    """Three limits of a user at once; only accepted runs count. Leases end by themselves."""

    columns, ordered = ["us", "event_id", "ends"], 2

    def __init__(self, concurrent: int, minute: int, day: int):
        self.limits = concurrent, minute, day

    def marks(self, row):
        return [(row.us, row.event_id, row.ends)]

    def step(self, key, state, mark):
        us, event_id, ends = mark
        state, _ = self.tidy(state, us) if state else (None, None)
        leases, accepted = state or ([], [])
        reason = chat_reason(len(leases), accepted, us, *self.limits)
        if not reason:
            leases, accepted = [*leases, ends], [*accepted, us]
        return (leases, accepted), Row(event_id=event_id, us=us, allowed=not reason, reason=reason)

    def tidy(self, state, us):
        leases = [t for t in state[0] if t > us]
        accepted = [t for t in state[1] if t > us - 86_400 * MICROS]
        if not leases and not accepted:
            return None, None
        return (leases, accepted), min([*leases, *(t + 86_400 * MICROS for t in accepted[:1])])


def chat_limit_stream(
    runs: DataFrame, concurrent: int = fv.CHAT_CONCURRENT, minute: int = fv.CHAT_PER_MINUTE, day: int = fv.CHAT_PER_DAY,
    lease: int = fv.RUN_LEASE_SECONDS, watermark: str = "10 minutes",
) -> DataFrame:
    """``chat_limits`` on a stream: event_id, us, ``allowed`` and ``reason`` of each run.

    State per user is the leases that still run and the accepted runs of a day, never more numbers
    than the limits allow; timers free leases at their end and the rest a day later.
    """
    ends = F.col("us") + (F.least("duration_s", F.lit(float(lease))) * MICROS).cast("long")
    kind = runs.schema["event_id"].dataType.simpleString()
    timed = watched(runs, "ts", watermark).withColumn("ends", F.coalesce(ends, F.col("us") + lease * MICROS))
    fold = ChatLimits(concurrent, minute, day)
    return in_order(timed, ["user_id"], fold, f"event_id {kind}, us long, allowed boolean, reason string")


class Requests(Fold):
    """The first request of a client's key decides what the repeats get, until the key rests for a while."""

    columns, ordered = ["us", "request_id", "payload_hash", "status"], 2

    def __init__(self, ttl: int):
        self.ttl = ttl * MICROS

    def marks(self, row):
        return [(row.us, row.request_id, row.payload_hash, row.status)]

    def step(self, key, state, mark):
        us, request_id, payload, status = mark
        if state is None or us - state[2] >= self.ttl:
            state, decision = (payload, status, us), "new"
        else:
            first_payload, first_status, _ = state
            if payload is not None and first_payload is not None and payload != first_payload:
                decision = "conflict_payload"
            elif first_status == "completed":
                decision = "replay"
            else:
                decision = "conflict_running" if first_status in ("started", "streaming") else "conflict_used"
            state = (first_payload, first_status, us)
        return state, Row(request_id=request_id, us=us, decision=decision)

    def tidy(self, state, us):
        end = state[2] + self.ttl
        return (None, None) if end <= us else (state, end)


def idempotent_stream(requests: DataFrame, ttl: int = 86_400, watermark: str = "10 minutes") -> DataFrame:
    """``idempotent_in_time`` on a stream: request_id, us and ``decision`` of each request.

    State per (user, client_request_id) is what its first request was; a timer forgets it when the
    key has rested for ``ttl`` seconds. Requests without a client id are new at once.
    """
    kind = requests.schema["request_id"].dataType.simpleString()
    timed = watched(requests, "ts", watermark)
    keyed = timed.filter(F.col("client_request_id").isNotNull())
    judged = in_order(keyed, ["user_id", "client_request_id"], Requests(ttl), f"request_id {kind}, us long, decision string")
    free = timed.filter(F.col("client_request_id").isNull()).select("request_id", "us", F.lit("new").alias("decision"))
    return judged.unionByName(free)


class Active(Fold):
    """Runs of a user that hold a lease: one more at a start, one less at an end."""

    columns, ordered = ["us", "ends", "run_id"], 3

    def marks(self, row):
        return [(row.us, 1, row.run_id), (row.ends, -1, row.run_id)]

    def step(self, key, state, mark):
        us, step, run_id = mark
        active = (state[0] if state else 0) + step
        return (active,), Row(user_id=key[0], run_id=run_id, at_us=us, step=step, active=active)

    def tidy(self, state, us):
        return (state, None) if state[0] else (None, None)


def active_run_stream(runs: DataFrame, lease: int = fv.RUN_LEASE_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """``active_runs`` on a stream: the number of a user's active runs after every start and end.

    Both marks of a run wait in state; the timer of its end gives the -1, even if nothing else comes.
    """
    user, run = (runs.schema[c].dataType.simpleString() for c in ("user_id", "run_id"))
    ends = F.col("us") + (F.least("duration_s", F.lit(float(lease))) * MICROS).cast("long")
    timed = watched(runs, "ts", watermark).withColumn("ends", F.coalesce(ends, F.col("us") + lease * MICROS))
    schema = f"user_id {user}, run_id {run}, at_us long, step int, active long"
    return in_order(timed, ["user_id"], Active(), schema)


class Sustained(StatefulProcessor):
    """Length of the unbroken run of breaching windows that a label is in."""

    def __init__(self, by: list[str], sustain: int):
        self.by, self.sustain = by, sustain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "minute long, over long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.run.get()
        minute, over = held if held is not None else (None, 0)
        for row in sorted(rows, key=lambda r: r["_minute"]):
            over = over + 1 if minute is not None and row["_minute"] == minute + 1 else 0
            minute = row["_minute"]
            if over >= self.sustain:
                named = dict(zip(self.by, key))
                yield Row(window_start=row["window_start"], window_end=row["window_end"], **named, rate=row["rate"], minutes_over=over)
        self.run.update((minute, over))

    def close(self) -> None:
        pass


def alert_stream(rated: DataFrame, by: list[str], threshold: float, sustain_minutes: int) -> DataFrame:
    """``alerts`` on a stream of ``rates``: window_start, window_end, the labels, rate and minutes_over.

    Two stateful operators in a row: windows come in order of their end once the watermark closes
    them, and a label's state is the last breaching minute and how long its run is.
    """
    minute = F.floor(F.unix_micros("window_end") / 60_000_000)
    over = rated.filter(F.col("rate") > threshold).withColumn("_minute", minute)
    fields = [rated.schema[c] for c in ("window_start", "window_end", *by, "rate")]
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("minutes_over", T.LongType())])
    return over.groupBy(*by).transformWithState(Sustained(by, sustain_minutes), out, "append", "None")


class Snapshot(StatefulProcessor):
    """The newest event of a key, whole, until its time to live has passed."""

    def __init__(self, schema: T.StructType, seq: str, ttl: int):
        self.schema, self.names, self.seq, self.ttl = schema, schema.fieldNames(), seq, ttl * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def _order(self, row) -> tuple:
        return row["us"], row[self.seq] is not None, row[self.seq] or 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.newest.get()
        best = Row(**dict(zip(self.names, held))) if held is not None else None
        top = max(rows, key=self._order)
        if best is None or self._order(top) > self._order(best):
            self.newest.update(tuple(top[n] for n in self.names))
            self.handle.registerTimer(-(-(top["us"] + self.ttl) // 1000))
            yield Row(**{n: top[n] for n in self.names}, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.newest.get()
        if held is not None:
            row = dict(zip(self.names, held))
            if row["us"] + self.ttl <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.newest.clear()
                yield Row(**row, expired=True)

    def close(self) -> None:
        pass


def snapshot_stream(
    events: DataFrame, key: str, seq: str, ts: str = "ts", ttl: int = 3600, watermark: str = "10 minutes"
) -> DataFrame:
    """Changes of ``latest_state``: whole events as they become the newest of their key, and once more as they expire.

    The newest is the one of the greatest (``ts``, ``seq``), as in the batch form, so events that come
    out of order never move a snapshot back. ``expired`` rows carry the snapshot that ended.
    """
    timed = watched(events, ts, watermark)
    fields = [T.StructField(f.name, f.dataType) for f in timed.schema.fields]
    out = T.StructType([*fields, T.StructField("expired", T.BooleanType())])
    return timed.groupBy(key).transformWithState(Snapshot(T.StructType(fields), seq, ttl), out, "update", "EventTime")


def snapshot_table(changes: DataFrame, key: str) -> DataFrame:
    """Live snapshots from the changes of all batches (column ``batch``): the last change of each key, unless it expired."""
    rest = [c for c in changes.columns if c not in (key, "batch")]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_c")).select(key, "_c.*")
    return last.filter(~F.col("expired")).drop("expired")
