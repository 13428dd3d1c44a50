"""Event flows: envelopes, snapshots, rates, alerts, idempotency, runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.joins import orphans
from ..operators.query import hard_delete
from ..operators.skew import running_sum
from ..sources.tables import EVENT_SCHEMA, read_latest, remove, version_path, versions, write_version
from .limits import MICROS, busy_parts, with_micros


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, max_files: int = 100) -> DataFrame:
    """JSON event files as a stream, bounded per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def valid_envelopes(events: DataFrame) -> DataFrame:
    """Events that name their task and project and carry a sane progress."""
    return events.filter(
        F.col("event_id").isNotNull() & F.col("task_id").isNotNull() & F.col("project_id").isNotNull()
        & F.col("seq_num").isNotNull() & F.col("actual_progress").between(0, 100)
    )


def write_events(events: DataFrame, path: str, checkpoint: str):
    """Start the validated stream into per-project folders."""
    return (
        valid_envelopes(events).writeStream.format("parquet").partitionBy("project_id")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_state(events: DataFrame, key: str, seq: str, ts: str, now: Column | None = None, ttl: int = 3600) -> DataFrame:
    """Newest event per key, without the ones older than the time to live."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("_e")).select(key, "_e.*")
    if now is None:
        return last
    return last.filter(F.col(ts) > now - F.make_dt_interval(secs=F.lit(ttl)))


def latest_stream(
    events: DataFrame, key: str, seq: str, ts: str = "ts", ttl: int = 3600, watermark: str = "10 minutes"
) -> DataFrame:
    """Snapshot updates on a stream: key, last sequence and status.

    Out-of-order events never move a snapshot back; idle keys are dropped
    after the time to live.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        newest = state.getCurrentWatermarkMs()
        for pdf in batches:
            newest = max(newest, int(pdf[ts].max().timestamp() * 1000))
            row = pdf.loc[pdf[seq].idxmax()]
            if best is None or row[seq] > best[0]:
                best = (int(row[seq]), row["status"])
        state.update(best)
        state.setTimeoutTimestamp(newest + ttl * 1000)
        yield pd.DataFrame({key: [k[0]], seq: [best[0]], "status": [best[1]]})

    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.select(key, seq, "status", ts).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, {seq} long, status string", "seq long, status string", "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def rates(
    events: DataFrame, by: list[str], ts: str = "ts", value: str | None = None, window: str = "5 minutes",
    slide: str = "1 minute", watermark: str = "10 minutes", seconds: int = 300,
) -> DataFrame:
    """Events per second and mean value per label in sliding windows.

    The same plan serves a table and a stream; on a table the watermark has
    no effect.
    """
    aggs = [F.count(F.lit(1)).alias("events"), (F.count(F.lit(1)) / seconds).alias("rate")]
    if value:
        aggs.append(F.avg(value).alias("mean_value"))
    timed = events.withWatermark(ts, watermark) if events.isStreaming else events
    out = timed.groupBy(F.window(ts, window, slide).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


DAY = 1440


def alerts(rated: DataFrame, by: list[str], threshold: float, sustain_minutes: int) -> DataFrame:
    """Windows at which a rate has been over the threshold long enough.

    Windows end every minute. Runs are found within a day of a label; what a day's last run carries
    over to the next is summed from one row per day, so a label that breaches for years is spread
    over its days.
    """
    minute = F.floor(F.unix_micros(F.col("window_end").cast("timestamp")) / 60_000_000)
    over = rated.filter(F.col("rate") > threshold).withColumn("_minute", minute).withColumn("_day", F.floor(F.col("_minute") / DAY))
    within = Window.partitionBy(*by, "_day").orderBy("_minute")
    runs = over.withColumn("_island", F.col("_minute") - F.row_number().over(within))
    spans = runs.groupBy(*by, "_day", "_island").agg(F.min("_minute").alias("_from"), F.max("_minute").alias("_to"))
    last = F.max(F.when(F.col("_to") == (F.col("_day") + 1) * DAY - 1, F.col("_to") - F.col("_from") + 1))
    days = spans.groupBy(*by, "_day").agg(F.coalesce(last, F.lit(0)).alias("_tail"))
    w = Window.partitionBy(*by).orderBy("_day")
    before = F.lag(F.struct("_day", "_tail")).over(w)
    tail = F.when(before["_day"] == F.col("_day") - 1, before["_tail"]).otherwise(0)
    # days in a row that breach throughout hand on all that came before them
    chained = days.withColumn("_in", F.coalesce(tail, F.lit(0))).withColumn("_chain", F.sum((F.col("_in") < DAY).cast("int")).over(w))
    in_chain = Window.partitionBy(*by, "_chain").orderBy("_day")
    carried = chained.withColumn("_carry", F.first("_in").over(in_chain) + DAY * (F.row_number().over(in_chain) - 1))
    facts = spans.alias("s").join(carried.select(*by, "_day", "_carry").alias("c"), [*by, "_day"])
    ahead = F.when(F.col("_from") == F.col("_day") * DAY, F.col("_carry")).otherwise(0)
    facts = facts.select(*by, "_day", "_island", "_from", ahead.alias("_ahead"))
    joined = runs.join(facts, [*by, "_day", "_island"])
    return (
        joined.withColumn("minutes_over", (F.col("_minute") - F.col("_from") + F.col("_ahead")).cast("int"))
        .filter(F.col("minutes_over") >= sustain_minutes).select(*rated.columns, "minutes_over")
    )


def idempotent(requests: DataFrame) -> DataFrame:
    """Decision per request: new, replay, or conflict.

    ``requests``: request_id (order), user_id, client_request_id,
    payload_hash, status (of the first run). Requests without a client id
    are always new. The first request of a key decides what the rest get.
    """
    keyed = requests.filter(F.col("client_request_id").isNotNull())
    free = requests.filter(F.col("client_request_id").isNull()).withColumn("decision", F.lit("new"))
    slot = F.to_json(F.struct("user_id", "client_request_id")).alias("slot")
    first = keyed.groupBy(slot).agg(F.min_by(F.struct("request_id", "payload_hash", "status"), "request_id").alias("_f"))
    f = F.col("_f")
    decision = (
        F.when(F.col("request_id") == f["request_id"], "new")
        .when(F.col("payload_hash") != f["payload_hash"], "conflict_payload")
        .when(f["status"] == "completed", "replay")
        .when(f["status"].isin("started", "streaming"), "conflict_running")
        .otherwise("conflict_used")
    )
    # a client that repeats one key without end makes a skewed partition, which AQE splits
    judged = keyed.withColumn("slot", slot).join(first, "slot")
    judged = judged.withColumn("decision", decision).select(*requests.columns, "decision")
    return judged.unionByName(free)


def idempotent_in_time(requests: DataFrame, ttl: int = 86_400) -> DataFrame:
    """``idempotent`` with a time to live: request_id, us and ``decision``, in order of (ts, request_id).

    A key that rests for ``ttl`` seconds is forgotten, so its next request is new again. Rests are
    found from blocks of time, so a key that is repeated without end is not sorted in one task.
    Requests without a client id are new; those without a time are left out.
    """
    timed = with_micros(requests).filter(F.col("us").isNotNull())
    slot = F.to_json(F.struct("user_id", "client_request_id"))
    keyed = timed.filter(F.col("client_request_id").isNotNull()).withColumns({"slot": slot, "_block": F.floor(F.col("us") / (ttl * MICROS))})
    parts = busy_parts(keyed, "slot", ttl).drop("most")
    keyed = keyed.join(parts, ["slot", "_block"])
    first = keyed.groupBy("slot", "part").agg(
        F.min_by(F.struct("request_id", "payload_hash", "status"), F.struct("us", "request_id")).alias("_f")
    )
    f = F.col("_f")
    decision = (
        F.when(F.col("request_id") == f["request_id"], "new")
        .when(F.col("payload_hash") != f["payload_hash"], "conflict_payload")
        .when(f["status"] == "completed", "replay")
        .when(f["status"].isin("started", "streaming"), "conflict_running")
        .otherwise("conflict_used")
    )
    judged = keyed.join(first, ["slot", "part"]).select("request_id", "us", decision.alias("decision"))
    free = timed.filter(F.col("client_request_id").isNull()).select("request_id", "us", F.lit("new").alias("decision"))
    return judged.unionByName(free)


def drop_repeats(requests: DataFrame, key: list[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """Stream form that only drops repeats."""
    return requests.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)


def run_metrics(runs: DataFrame, bounds: list[float], window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Run count, mean duration and cumulative bucket counts per status and
    tumbling window. ``runs``: ts, status, duration_s."""
    timed = runs.withWatermark("ts", watermark) if runs.isStreaming else runs
    names = [f"le_{b:g}".replace(".", "_") for b in bounds]
    out = timed.groupBy(F.window("ts", window).alias("w"), "status").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("duration_s").alias("mean_duration_s"),
        *[F.count_if(F.col("duration_s") <= b).alias(n) for b, n in zip(bounds, names)],
    )
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def clean_cache(points: DataFrame, entries: DataFrame, now: Column, ttl: int = fv.CACHE_TTL_SECONDS) -> DataFrame:
    """Cache points that stay after a scheduled clean-up.

    Entries older than the time to live go, then points whose entry is gone.
    """
    live = entries.filter(F.col("created_at") > now - F.make_dt_interval(secs=F.lit(ttl)))
    return hard_delete(points, orphans(points, live), "point_id")


def clean_up(
    spark: SparkSession, base: str, now: Column, entry_schema: str, point_schema: str, ttl: int = fv.CACHE_TTL_SECONDS, keep: int = 2
) -> tuple[int, int]:
    """The scheduled job: drop expired entries, then points whose entry is gone. Returns how many of each.

    ``<base>/entries`` and ``<base>/points`` are versioned tables. A version counts once its writer
    has committed, so readers see all of a clean-up or nothing, and a job that dies in between only
    leaves orphans for its next run to find. Where nothing is to go, no version is written. The last
    ``keep`` versions stay for readers that have begun.
    """
    entries = read_latest(spark, f"{base}/entries", entry_schema)
    live = entries.filter(F.col("created_at") > now - F.make_dt_interval(secs=F.lit(ttl)))
    expired = entries.count() - live.count()
    if expired:
        write_version(live, f"{base}/entries")
    points = read_latest(spark, f"{base}/points", point_schema)
    kept = clean_cache(points, read_latest(spark, f"{base}/entries", entry_schema), now, ttl)
    gone = points.count() - kept.count()
    if gone:
        write_version(kept, f"{base}/points")
    for table in ("entries", "points"):
        for number in versions(spark, f"{base}/{table}", complete=False)[:-keep]:
            remove(spark, version_path(f"{base}/{table}", number))
    return expired, gone


def active_runs(runs: DataFrame, lease: int = fv.RUN_LEASE_SECONDS) -> DataFrame:
    """Active runs per user after every start and end.

    ``runs``: run_id, user_id, ts, duration_s; a run holds its lease until its
    end or ``lease`` seconds, whichever is first. Hours are summed first, so a
    busy user is spread over tasks.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = us + (F.least("duration_s", F.lit(float(lease))) * 1_000_000).cast("long")
    marks = F.array(
        F.struct(us.alias("at_us"), F.lit(1).alias("step")), F.struct(ends.alias("at_us"), F.lit(-1).alias("step"))
    )
    moves = runs.select("user_id", "run_id", F.inline(marks))
    # ends come before starts at the same instant: an ended run frees its slot
    return running_sum(
        moves, ["user_id"], ["at_us", "step", "run_id"], "step", "active", F.floor(F.col("at_us") / 3_600_000_000)
    )


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a job that hands every micro-batch to ``apply`` and then ends.

    ``apply`` must be idempotent per batch id, as a batch may be repeated
    after a failure.
    """
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def ingest_batches(stream: DataFrame, out: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]):
    """Incremental ingestion: each micro-batch's chunks replace its own folder."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run_batches(stream, apply, checkpoint)
