"""Sliding-window limits in which only accepted events count.

Whether an event is accepted depends on the ones accepted before it, so the
decision is a fold in time order. Windows over *all* events bound the accepted
ones from above; keys that stay under the limit even so are accepted without a
fold. Only the rest is folded, in sorted partitions, with a state no larger
than the limit itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..operators.graph import components
from ..session import run_dir, shared_dir
from ..sources.tables import remove

MICROS = 1_000_000
#: Uploads of one linked group that a task folds at a time.
SLICE_ROWS = 1 << 18


def with_micros(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as whole microseconds in ``us``."""
    return df.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))


def window_counts(df: DataFrame, key: str, seconds: int, out: str, ident: str = "event_id") -> DataFrame:
    """Events of the same key in the ``seconds`` up to each event, itself
    included. Time is cut into blocks of that length and every event also
    visits the next block, so one hot key spreads over its blocks.
    """
    span = seconds * MICROS
    blocks = df.select(key, ident, "us").withColumn("_home", F.floor(F.col("us") / span)).withColumn(
        "_block", F.explode(F.array("_home", F.col("_home") + 1))
    )
    w = Window.partitionBy(key, "_block").orderBy("us").rangeBetween(-(span - 1), 0)
    counted = blocks.withColumn(out, F.count(F.lit(1)).over(w)).filter("_home = _block")
    return counted.select(key, ident, out)


def _risky(df: DataFrame, key: str, seconds: int, limit: int, ident: str) -> DataFrame:
    """Keys that could exceed the limit if every event were accepted."""
    counts = window_counts(df, key, seconds, "_n", ident)
    return counts.filter(F.col("_n") > limit).select(key).distinct()


def _fold(
    df: DataFrame, group: str, ident: str, extra: list[str], new_state: Callable, decide: Callable, seconds: int
) -> DataFrame:
    """Run ``decide(state, row)`` over each group in (us, ident) order.

    A pause of at least the window empties every window, so a group is cut
    there and its parts are folded on their own. Pauses are found from the
    first and last event of each block of time.
    """
    span = seconds * MICROS
    blocked = df.select(group, ident, "us", *extra).withColumn("_block", F.floor(F.col("us") / span))
    blocks = blocked.groupBy(group, "_block").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    w = Window.partitionBy(group).orderBy("_block")
    pause = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) >= span, F.lit(True)).cast("int")
    parts = blocks.withColumn("_pause", pause).withColumn("_part", F.sum("_pause").over(w))
    rows = blocked.join(parts.select(group, "_block", "_part"), [group, "_block"])
    rows = rows.select(group, "_part", ident, "us", *extra).repartition(group, "_part")
    rows = rows.sortWithinPartitions(group, "_part", "us", ident)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            reasons = []
            for row in pdf.itertuples(index=False, name="Row"):
                if row[:2] != current:
                    current, state = row[:2], new_state()
                reasons.append(decide(state, row))
            yield pd.DataFrame({ident: pdf[ident], "reason": reasons})

    kind = df.schema[ident].dataType.simpleString()
    return rows.mapInPandas(run, f"{ident} {kind}, reason string")


def _trim(window: deque, oldest: int) -> None:
    while window and window[0] <= oldest:
        window.popleft()


def busy_parts(df: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, _block, part, most): the busy periods of each key, by blocks of ``seconds``.

    A pause of at least ``seconds`` ends a period, for it empties every window. ``most`` bounds the
    events that any window of the period holds: a window lies in two blocks. Only sums of blocks are
    ordered, so a hot key is spread over its blocks until then. Null keys have no period.
    """
    span = seconds * MICROS
    blocks = df.filter(F.col(key).isNotNull()).groupBy(key, F.floor(F.col("us") / span).alias("_block")).agg(
        F.min("us").alias("_lo"), F.max("us").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy(key).orderBy("_block")
    last = F.lag(F.struct("_block", "_hi", "_n")).over(w)
    pause = F.coalesce(F.col("_lo") - last["_hi"] >= span, F.lit(True))
    beside = F.when(last["_block"] == F.col("_block") - 1, last["_n"]).otherwise(0)
    marked = blocks.withColumns({"_pause": pause.cast("int"), "_near": F.col("_n") + beside})
    parts = marked.withColumn("part", F.sum("_pause").over(w))
    most = F.max("_near").over(Window.partitionBy(key, "part"))
    return parts.withColumn("most", most).select(key, "_block", "part", "most")


def upload_decide(state: dict, user, project, us: int, user_limit: int, project_limit: int, span: int, stands: bool = False) -> str:
    """Empty when the upload is accepted, else the limit that refuses it.

    An upload that already ``stands`` is only recorded. A null user or project has no limit.
    """
    if len(state) > 100_000:  # forget users and projects without a live entry
        for key in [k for k, w in state.items() if not w or w[-1] <= us - span]:
            del state[key]
    held = []
    for kind, key, limit in (("user", user, user_limit), ("project", project, project_limit)):
        if key is not None:
            window = state.setdefault((kind, key), deque())
            _trim(window, us - span)
            if not stands and len(window) >= limit:
                return kind
            held.append(window)
    for window in held:
        window.append(us)
    return ""


def upload_limits(
    events: DataFrame, user_limit: int = fv.UPLOADS_PER_MINUTE_USER,
    project_limit: int = fv.UPLOADS_PER_MINUTE_PROJECT, seconds: int = 60, accepted: DataFrame | None = None,
) -> DataFrame:
    """Adds ``allowed`` and ``reason`` (``user``/``project``/empty).

    ``events``: event_id, ts, user_id, project_id; uploads count in order of (ts, event_id), and one
    without a ts is allowed and counts for nothing. ``accepted``, of the same columns, are uploads of
    an earlier run that still count.

    Only busy periods that could exceed their limit if all uploads were accepted need a decision in
    order. Each is a node; an upload that falls into one of its user and one of its project links the
    two. A connected component of such periods is folded as one, by itself: what happens outside it
    cannot change its decisions, so hot groups that share nothing run in tasks of their own. A group
    of more than ``SLICE_ROWS`` uploads is folded slice by slice of its time (``_fold_slices``). All
    other uploads are allowed without a fold.
    """
    span = seconds * MICROS

    def packed(df: DataFrame, stands: bool) -> DataFrame:
        """The event as one column beside what the decision needs, so that names never clash."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return df.select(
            F.struct(*events.columns).alias("event"), "event_id", "user_id", "project_id", us.alias("us"), F.lit(stands).alias("stands")
        )

    rows = packed(events, False)
    if accepted is not None:
        rows = rows.unionByName(packed(accepted, True))
    rows = rows.withColumn("_block", F.floor(F.col("us") / span))
    for key, limit, node in (("user_id", user_limit, "_user"), ("project_id", project_limit, "_project")):
        risky = busy_parts(rows, key, seconds).filter(F.col("most") > limit)
        name = F.concat_ws("#", F.lit(key), F.col(key).cast("string"), "part")
        rows = rows.join(risky.select(key, "_block", name.alias(node)), [key, "_block"], "left")
    # read three times from here on: for the links, for the folds and for what is free
    shared_dir(events.sparkSession)
    rows = rows.checkpoint()
    links = rows.filter("_user IS NOT NULL AND _project IS NOT NULL").select(F.col("_user").alias("a"), F.col("_project").alias("b"))
    rows = rows.withColumn("_node", F.coalesce("_user", "_project"))
    groups = components(links).select(F.col("node").alias("_node"), F.col("component").alias("_group"))
    rows = rows.join(groups, "_node", "left").withColumn("_group", F.coalesce("_group", "_node")).drop("_block", "_user", "_project", "_node")
    # so few: each holds SLICE_ROWS rows
    large = rows.filter(F.col("_group").isNotNull()).groupBy("_group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE_ROWS)
    sizes = large.agg(F.count(F.lit(1)), F.max("n")).first()
    limits = (user_limit, project_limit, span)
    if not sizes[0]:
        judged = _fold_uploads(rows.filter(F.col("_group").isNotNull()), *limits)
    else:
        n = -(-sizes[1] // SLICE_ROWS)
        at = F.percentile_approx("us", [i / n for i in range(1, n)], 20 * n).alias("_cuts")
        cuts = F.broadcast(rows.join(F.broadcast(large), "_group", "left_semi").groupBy("_group").agg(at).checkpoint())
        sliced = rows.join(cuts, "_group").withColumn("_slice", F.size(F.filter("_cuts", lambda x: x < F.col("us")))).drop("_cuts")
        small = rows.filter(F.col("_group").isNotNull()).join(cuts, "_group", "left_anti")
        judged = _fold_uploads(small, *limits).unionByName(_fold_slices(sliced, cuts, n, *limits))
    judged = judged.select("event", "stands", "reason")
    free = rows.filter(F.col("_group").isNull()).select("event", "stands", F.lit("").alias("reason"))
    out = judged.unionByName(free).filter(~F.col("stands"))
    return out.select("event.*", (F.col("reason") == "").alias("allowed"), "reason")


def _fold_uploads(rows: DataFrame, user_limit: int, project_limit: int, span: int) -> DataFrame:
    """Adds ``reason``: each _group decided in order of (us, event_id), by one task."""
    ordered = rows.repartition("_group").sortWithinPartitions("_group", "us", "event_id")
    schema = T.StructType([*rows.schema.fields, T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, {}
        for batch in batches:
            reasons = []
            for group, *upload in zip(*(batch.column(c).to_pylist() for c in ("_group", "user_id", "project_id", "us", "stands"))):
                if group != current:
                    current, state = group, {}
                user, project, us, stands = upload
                reasons.append(upload_decide(state, user, project, us, user_limit, project_limit, span, stands))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reasons, pa.string())], names=schema.fieldNames())

    return ordered.mapInArrow(run, schema)


def _fold_slices(rows: DataFrame, cuts: DataFrame, n: int, user_limit: int, project_limit: int, span: int) -> DataFrame:
    """``_fold_uploads`` for large groups, one slice of time after the other.

    A slice starts from the accepted uploads before it that are still in a window, which is all that
    a fold remembers. A task holds one slice of a group, and every row is written and read once.
    Uploads of one microsecond are never parted. ``cuts``: _group and _cuts, the last microsecond of each slice but the last.
    """
    spark, base = rows.sparkSession, run_dir(rows.sparkSession)
    rows.repartition("_group", "_slice").write.partitionBy("_slice").parquet(f"{base}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    columns = [c for c in rows.columns if c != "_slice"]
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("reason", T.StringType())])
    live = None
    for k in range(n):
        part = kept.filter(F.col("_slice") == k).select(*columns)
        if live is not None:
            part = part.unionByName(live)
        _fold_uploads(part, user_limit, project_limit, span).write.parquet(f"{base}/judged/part={k}")
        done = spark.read.schema(schema).parquet(f"{base}/judged/part={k}").filter("reason = ''").join(cuts, "_group")
        # the event itself has been given out and is left behind
        live = done.filter(F.col("us") > F.try_element_at("_cuts", F.lit(k + 1)) - span).withColumns(
            {"event": F.lit(None).cast(rows.schema["event"].dataType), "stands": F.lit(True)}
        ).select(*columns)
    return spark.read.schema(schema).parquet(*[f"{base}/judged/part={k}" for k in range(n)])


def limit_uploads(
    stream: DataFrame, out: str, checkpoint: str, user_limit: int = fv.UPLOADS_PER_MINUTE_USER,
    project_limit: int = fv.UPLOADS_PER_MINUTE_PROJECT, seconds: int = 60, delay: int = 600,
):
    """Start the limit on a stream: decisions as Parquet under ``out``, one folder per batch.

    User and project windows feed back into each other, so no single key can hold the state. Each
    batch is decided by ``upload_limits``, seeded with the accepted uploads of the last window. An
    upload waits until event time has passed it by ``delay`` seconds, so files may come in any order
    within that; one that comes later still is refused as ``late``. What waits and what still counts
    is a table under ``out/_state``, one version per batch, so a repeated batch starts from the same
    state and rewrites the same folder. Versions before the last are dropped.
    """
    spark, columns = stream.sparkSession, [f for f in stream.schema.fields]
    names = [f.name for f in columns]
    decided = T.StructType([*columns, T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType())])
    carried = T.StructType([*columns, T.StructField("counts", T.BooleanType()), T.StructField("horizon", T.LongType())])
    span = seconds * MICROS

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = session.createDataFrame([], carried)
        if batch_id:
            state = session.read.schema(carried).parquet(f"{out}/_state/{batch_id - 1}")
        before = state.agg(F.max("horizon")).first()[0]
        newest = with_micros(batch).agg(F.max("us")).first()[0]
        horizon = max((x for x in (before, None if newest is None else newest - delay * MICROS) if x is not None), default=None)
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        late = F.coalesce(us <= F.lit(before).cast("long"), F.lit(False))
        due = us.isNull() | F.coalesce(us <= F.lit(horizon).cast("long"), F.lit(False))
        fresh = batch.select(*names)
        waiting = state.filter(~F.col("counts")).select(*names)
        ready = waiting.unionByName(fresh.filter(~late))
        judged = upload_limits(ready.filter(due), user_limit, project_limit, seconds, state.filter("counts").select(*names))
        refused = fresh.filter(late).select(*names, F.lit(False).alias("allowed"), F.lit("late").alias("reason"))
        judged.unionByName(refused).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        mine = session.read.schema(decided).parquet(f"{out}/batch={batch_id}").filter("allowed")
        live = state.filter("counts").select(*names).unionByName(mine.select(*names)).filter(us > F.lit(horizon).cast("long") - span)
        left = ready.filter(~due).withColumn("counts", F.lit(False))
        # the horizon rides on every row, and on one empty row where nothing else is left
        clock = session.createDataFrame([tuple([None] * len(names))], T.StructType(columns)).withColumn("counts", F.lit(None).cast("boolean"))
        rest = left.unionByName(live.withColumn("counts", F.lit(True))).unionByName(clock)
        rest.withColumn("horizon", F.lit(horizon).cast("long")).write.mode("overwrite").parquet(f"{out}/_state/{batch_id}")
        if batch_id > 1:
            remove(session, f"{out}/_state/{batch_id - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chat_reason(running: int, accepted: Sequence[int], us: int, concurrent: int, minute: int, day: int) -> str:
    """Empty when a run may start, else the limit that refuses it; ``accepted`` are the start times of a day."""
    if running >= concurrent:
        return "concurrent"
    if sum(t > us - 60 * MICROS for t in accepted) >= minute:
        return "minute"
    return "day" if len(accepted) >= day else ""


def chat_decide(state: dict, us: int, ends: int, concurrent: int, minute: int, day: int) -> str:
    """Empty when the run may start, else the limit that refuses it."""
    active = state.setdefault("active", [])
    active[:] = [t for t in active if t > us]
    accepted = state.setdefault("accepted", deque())
    _trim(accepted, us - 86_400 * MICROS)
    reason = chat_reason(len(active), accepted, us, concurrent, minute, day)
    if not reason:
        active.append(ends)
        accepted.append(us)
    return reason


def chat_limits(
    runs: DataFrame, concurrent: int = fv.CHAT_CONCURRENT, minute: int = fv.CHAT_PER_MINUTE,
    day: int = fv.CHAT_PER_DAY, lease: int = fv.RUN_LEASE_SECONDS,
) -> DataFrame:
    """Adds ``allowed`` and ``reason`` per run.

    ``runs``: event_id, ts, user_id, duration_s. A run is active until its end
    or the end of its lease, whichever is first.
    """
    e = with_micros(runs).withColumn(
        "ends", F.col("us") + (F.least(F.col("duration_s"), F.lit(float(lease))) * MICROS).cast("long")
    )
    risky = _risky(e, "user_id", lease, concurrent, "event_id")
    for seconds, limit in ((60, minute), (86_400, day)):
        risky = risky.union(_risky(e, "user_id", seconds, limit, "event_id"))
    todo = e.join(risky.distinct(), "user_id", "left_semi")

    def decide(state: dict, row) -> str:
        return chat_decide(state, row.us, row.ends, concurrent, minute, day)

    judged = _fold(todo, "user_id", "event_id", ["ends"], dict, decide, 86_400)
    reason = F.coalesce("reason", F.lit(""))
    return runs.join(judged, "event_id", "left").select(
        *runs.columns, (reason == "").alias("allowed"), reason.alias("reason")
    )


def window_flags(runs: DataFrame, minute: int = fv.CHAT_PER_MINUTE, day: int = fv.CHAT_PER_DAY) -> DataFrame:
    """The stateless form: counts of all runs, refused ones included."""
    e = with_micros(runs)
    a = window_counts(e, "user_id", 60, "last_minute")
    b = window_counts(e, "user_id", 86_400, "last_day")
    return a.join(b.drop("user_id"), "event_id").withColumn(
        "over_limit", (F.col("last_minute") > minute) | (F.col("last_day") > day)
    )


def limit_stream(events: DataFrame, key: str, limit: int, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """One key's limit on a stream: event_id, us, ``allowed`` per event.

    State per key is the accepted times of one window, never more than
    ``limit`` numbers; it is dropped when event time has passed the window.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = seconds * MICROS

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        allowed = []
        for us in pdf["us"]:
            _trim(window, us - span)
            ok = len(window) < limit
            if ok:
                window.append(us)
            allowed.append(ok)
        state.update(([int(t) for t in window],))
        expires = (int(pdf["us"].max()) + span) // 1000 + 1
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": pdf["event_id"], "us": pdf["us"], "allowed": allowed})

    kind = events.schema["event_id"].dataType.simpleString()
    timed = with_micros(events.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", watermark)
    return timed.select(key, "event_id", "us", "ts").groupBy(key).applyInPandasWithState(
        run, f"event_id {kind}, us long, allowed boolean", "accepted array<long>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
