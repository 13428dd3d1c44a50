"""Event flows: batch twins and streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..plans import composed as cp, ingest as ing
from ..session import run_dir
from ..sources.tables import SCHEMAS, append_log, read_latest, write_turn_hits, write_version
from ..streaming import events as ev, limits as lm, stateful as st
from .base import load, query
from .ingest import COMPOSED, intake_rows, refusing_embedder



def _utc(spark, d) -> DataFrame:
    """Events with instants instead of wall-clock times."""
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One table as a stream of files, be it one file or a folder of them: a stream takes a single file only as a pattern."""
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parque[t]")


_ENVELOPE = "value BETWEEN 0 AND 100 AND event_type <> 'signup'"


def _envelopes(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq_num"),
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("task_id"),
        F.col("event_type").alias("project_id"), F.col("value").alias("actual_progress"),
    )


@query("stm1_event_stream", f"""
    SELECT event_id::VARCHAR AS event_id, event_id AS seq_num, user_id::VARCHAR AS task_id, event_type AS project_id, value AS actual_progress FROM events WHERE {_ENVELOPE}""")
def _(spark, d):
    base = run_dir(spark)
    ev.write_events(_envelopes(_stream(spark, d, "events")), f"{base}/out", f"{base}/ckpt").awaitTermination()
    schema = "event_id string, seq_num long, task_id string, actual_progress double, project_id string"
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("stm2_latest_snapshot", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1 AND ts > TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR""")
def _(spark, d):
    t = ev.latest_state(_utc(spark, d), "user_id", "event_id", "ts", F.lit("2024-01-31").cast("timestamp"), ttl=43200)
    return t.select("user_id", "event_id", "event_type")


@query("stm2_latest_snapshot_stream", """
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1""")
def _(spark, d):
    base = run_dir(spark)
    src = _stream(spark, d, "events").withColumnRenamed("event_type", "status")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    job = ev.latest_stream(src, "user_id", "event_id").writeStream.outputMode("update").foreachBatch(keep)
    job.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("user_id long, event_id long, status string, batch int").parquet(f"{base}/out")
    return out.groupBy("user_id").agg(F.max_by(F.struct("event_id", "status"), "event_id").alias("s")).select("user_id", "s.*")


@query("stm2_whole_snapshot_stream", """
    SELECT user_id, event_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, max(ts) OVER () AS last FROM events)
    WHERE rn = 1 AND ts > last - INTERVAL 10 MINUTE - INTERVAL 6 HOUR""")
def _(spark, d):
    out = f"{run_dir(spark)}/out"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    changes = st.snapshot_stream(_stream(spark, d, "events"), "user_id", "event_id", ttl=6 * 3600)
    writer = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-ckpt")
    st.start(writer, spark).awaitTermination()
    rows = spark.read.schema(T.StructType([*changes.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    return st.snapshot_table(rows, "user_id").select("user_id", "event_id", "event_type", "value", "props")


#: All uploads in order, each decided by the accepted ones of the hour before: user_limit 2, project_limit 10.
_UPLOADS = """
    WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS us, '' AS reason, []::STRUCT(u BIGINT, p VARCHAR, t BIGINT)[] AS acc
      UNION ALL SELECT rn, event_id, us, reason, CASE WHEN reason = '' THEN list_append(live, {u: user_id, p: event_type, t: us}) ELSE live END FROM
        (SELECT *, CASE WHEN len(list_filter(live, lambda x: x.u = user_id)) >= 2 THEN 'user' WHEN len(list_filter(live, lambda x: x.p = event_type)) >= 10 THEN 'project' ELSE '' END AS reason FROM
          (SELECT e.*, list_filter(acc, lambda x: x.t > e.us - 3600000000) AS live FROM w JOIN e ON e.rn = w.rn + 1)))
    SELECT event_id, reason = '' AS allowed, reason FROM w WHERE event_id IS NOT NULL"""


def _uploads(t: DataFrame) -> DataFrame:
    return t.select("event_id", "ts", "user_id", F.col("event_type").alias("project_id"))


@query("stm3_upload_rate_limit", _UPLOADS)
def _(spark, d):
    t = _uploads(load(spark, d, "events"))
    return lm.upload_limits(t, user_limit=2, project_limit=10, seconds=3600).select("event_id", "allowed", "reason")


@query("stm3_upload_rate_limit_stream", f"{_UPLOADS} AND us <= (SELECT max(us) - 600000000 FROM e)")
def _(spark, d):
    out = f"{run_dir(spark)}/out"
    lm.limit_uploads(_uploads(_stream(spark, d, "events")), out, f"{out}-ckpt", 2, 10, 3600, 600).awaitTermination()
    return spark.read.schema("event_id long, allowed boolean, reason string").parquet(f"{out}/batch=*")


@query("stm3_key_limit_stream", """
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS at_us, false AS allowed, []::BIGINT[] AS acc FROM events
      UNION ALL SELECT user_id, rn, event_id, at_us, allowed, CASE WHEN allowed THEN list_append(live, at_us) ELSE live END FROM (SELECT *, len(live) < 2 AS allowed FROM
        (SELECT e.user_id, e.rn, e.event_id, e.us AS at_us, list_filter(acc, lambda x: x > e.us - 3600000000) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)))
    SELECT event_id, at_us AS us, allowed FROM w WHERE event_id IS NOT NULL""")
def _(spark, d):
    base = run_dir(spark)
    job = lm.limit_stream(_stream(spark, d, "events"), "user_id", 2, 3600).writeStream.format("parquet")
    job.option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, us long, allowed boolean").parquet(f"{base}/out")


_CHAT = """
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) + floor(least(value, 120) * 1000000)::BIGINT AS ends, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, '' AS reason, []::BIGINT[] AS act, []::BIGINT[] AS acc FROM events
      UNION ALL SELECT user_id, rn, event_id, reason, CASE WHEN reason = '' THEN list_append(act, ends) ELSE act END, CASE WHEN reason = '' THEN list_append(acc, us) ELSE acc END FROM
        (SELECT e.*, act, acc, CASE WHEN len(list_filter(act, lambda t: t > us)) >= 1 THEN 'concurrent' WHEN len(list_filter(acc, lambda t: t > us - 60000000)) >= 2 THEN 'minute'
           WHEN len(list_filter(acc, lambda t: t > us - 86400000000)) >= 2 THEN 'day' ELSE '' END AS reason FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1))
    SELECT event_id, reason = '' AS allowed, reason FROM w WHERE event_id IS NOT NULL"""


@query("stm4_chat_limits", _CHAT)
def _(spark, d):
    t = load(spark, d, "events").select("event_id", "ts", "user_id", F.col("value").alias("duration_s"))
    return lm.chat_limits(t, concurrent=1, minute=2, day=2).select("event_id", "allowed", "reason")


def _drain(spark: SparkSession, changes: DataFrame, schema: str) -> DataFrame:
    """All rows that a stateful stream gives for what is there now."""
    base = run_dir(spark)
    st.start(changes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt"), spark).awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("stm4_chat_limits_stream", f"""
    SELECT * FROM ({_CHAT}) SEMI JOIN (SELECT event_id FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)) USING (event_id)""")
def _(spark, d):
    t = _stream(spark, d, "events").select("event_id", "ts", "user_id", F.col("value").alias("duration_s"))
    out = _drain(spark, st.chat_limit_stream(t, concurrent=1, minute=2, day=2), "event_id long, allowed boolean, reason string")
    return out.select("event_id", "allowed", "reason")


@query("stm4_window_flags", """
    SELECT event_id, last_minute, last_day, last_minute > 1 OR last_day > 4 AS over_limit FROM (SELECT event_id, user_id,
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS last_minute,
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS last_day FROM events)""")
def _(spark, d):
    t = lm.window_flags(load(spark, d, "events").select("event_id", "ts", "user_id"), 1, 4)
    return t.select("event_id", "last_minute", "last_day", "over_limit")


_RATES = """
    SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, event_type, count(*) AS events, count(*) / 300.0::DOUBLE AS rate, avg(value) AS mean_value
    FROM (SELECT *, unnest(list_transform([0, 1, 2, 3, 4], lambda k: date_trunc('minute', ts) - to_minutes(k))) AS w FROM events) GROUP BY 1, 2, 3"""


@query("stm5_sliding_rates", f"""
    SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS started, event_type, events, round(rate, 9) AS rate, round(mean_value, 6) AS mean_value FROM ({_RATES})""")
def _(spark, d):
    t = ev.rates(_utc(spark, d), ["event_type"], value="value")
    return t.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "events",
        F.round("rate", 9).alias("rate"), F.round("mean_value", 6).alias("mean_value"),
    )


@query("stm5_sliding_rates_stream", f"""
    SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS started, event_type, events FROM ({_RATES})
    WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(spark, d):
    base = run_dir(spark)
    src = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    job = ev.rates(src, ["event_type"], value="value").writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
    job.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    schema = "window_start timestamp, window_end timestamp, event_type string, events long, rate double, mean_value double"
    out = spark.read.schema(schema).parquet(f"{base}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "events")


@query("stm6_sustained_alerts", f"""
    WITH o AS (SELECT *, epoch(window_end)::BIGINT // 60 AS m FROM ({_RATES}) WHERE rate > 0.003),
    i AS (SELECT *, m - row_number() OVER (PARTITION BY event_type ORDER BY m) AS isl FROM o)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS started, event_type, minutes_over FROM (SELECT *, row_number() OVER (PARTITION BY event_type, isl ORDER BY m) - 1 AS minutes_over FROM i) WHERE minutes_over >= 5""")
def _(spark, d):
    t = ev.alerts(ev.rates(_utc(spark, d), ["event_type"]), ["event_type"], 0.003, 5)
    return t.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "minutes_over")


@query("stm6_sustained_alerts_stream", f"""
    WITH o AS (SELECT *, epoch(window_end)::BIGINT // 60 AS m FROM ({_RATES}) WHERE rate > 0.003),
    i AS (SELECT *, m - row_number() OVER (PARTITION BY event_type ORDER BY m) AS isl FROM o)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS started, event_type, minutes_over FROM (SELECT *, row_number() OVER (PARTITION BY event_type, isl ORDER BY m) - 1 AS minutes_over FROM i)
    WHERE minutes_over >= 5 AND window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(spark, d):
    src = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    changes = st.alert_stream(ev.rates(src, ["event_type"]), ["event_type"], 0.003, 5)
    out = _drain(spark, changes, "window_start timestamp, event_type string, minutes_over long")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "minutes_over")


@query("stm7_idempotency", """
    WITH r AS (SELECT event_id AS request_id, user_id, CASE WHEN event_type <> 'signup' THEN 'c' || floor(value / 10)::BIGINT END AS cid, event_type IN ('click', 'view') AS payload,
        CASE WHEN value < 5 THEN 'completed' WHEN value < 15 THEN 'streaming' ELSE 'failed' END AS st FROM events),
    f AS (SELECT user_id, cid, arg_min(request_id, request_id) AS fid, arg_min(payload, request_id) AS fp, arg_min(st, request_id) AS fs FROM r WHERE cid IS NOT NULL GROUP BY 1, 2)
    SELECT request_id, CASE WHEN cid IS NULL OR request_id = fid THEN 'new' WHEN payload <> fp THEN 'conflict_payload' WHEN fs = 'completed' THEN 'replay' WHEN fs = 'streaming' THEN 'conflict_running' ELSE 'conflict_used' END AS decision
    FROM r LEFT JOIN f USING (user_id, cid)""")
def _(spark, d):
    v = F.col("value")
    t = load(spark, d, "events").select(
        F.col("event_id").alias("request_id"), "user_id",
        F.when(F.col("event_type") != "signup", F.concat(F.lit("c"), F.floor(v / 10))).alias("client_request_id"),
        F.col("event_type").isin("click", "view").cast("string").alias("payload_hash"),
        F.when(v < 5, "completed").when(v < 15, "streaming").otherwise("failed").alias("status"),
    )
    return ev.idempotent(t).select("request_id", "decision")


#: A key forgets its first request after a rest of two days.
_IN_TIME = """
    WITH r AS (SELECT event_id AS request_id, user_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'signup' THEN 'c' || floor(value / 10)::BIGINT END AS cid, event_type IN ('click', 'view') AS payload,
        CASE WHEN value < 5 THEN 'completed' WHEN value < 15 THEN 'streaming' ELSE 'failed' END AS st FROM events),
    g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id, cid ORDER BY us, request_id) >= 172800000000, true)::INT AS rested FROM r),
    p AS (SELECT *, sum(rested) OVER (PARTITION BY user_id, cid ORDER BY us, request_id) AS part FROM g),
    f AS (SELECT *, first_value(request_id) OVER w AS fid, first_value(payload) OVER w AS fp, first_value(st) OVER w AS fs FROM p WINDOW w AS (PARTITION BY user_id, cid, part ORDER BY us, request_id))
    SELECT request_id, CASE WHEN cid IS NULL OR request_id = fid THEN 'new' WHEN payload <> fp THEN 'conflict_payload' WHEN fs = 'completed' THEN 'replay' WHEN fs = 'streaming' THEN 'conflict_running' ELSE 'conflict_used' END AS decision FROM f"""


def _requests(t: DataFrame) -> DataFrame:
    v = F.col("value")
    return t.select(
        F.col("event_id").alias("request_id"), "ts", "user_id",
        F.when(F.col("event_type") != "signup", F.concat(F.lit("c"), F.floor(v / 10))).alias("client_request_id"),
        F.col("event_type").isin("click", "view").cast("string").alias("payload_hash"),
        F.when(v < 5, "completed").when(v < 15, "streaming").otherwise("failed").alias("status"),
    )


@query("stm7_idempotency_in_time", _IN_TIME)
def _(spark, d):
    return ev.idempotent_in_time(_requests(load(spark, d, "events")), 172_800).select("request_id", "decision")


@query("stm7_idempotency_stream", f"{_IN_TIME} WHERE cid IS NULL OR us <= (SELECT max(us) - 600000000 FROM r)")
def _(spark, d):
    changes = st.idempotent_stream(_requests(_stream(spark, d, "events")), 172_800)
    return _drain(spark, changes, "request_id long, decision string")


@query("stm7_drop_repeats_stream", """
    SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2""")
def _(spark, d):
    base = run_dir(spark)
    src = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    job = ev.drop_repeats(src, ["user_id", "event_type"], "ts", "60 days").writeStream.format("parquet").option("path", f"{base}/out")
    job.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(SCHEMAS["events"].replace("timestamp_ntz", "timestamp")).parquet(f"{base}/out")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stm8_run_metrics", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS started, event_type AS status, count(*) AS runs, round(avg(value), 6) AS mean_duration_s,
      count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 2.5) AS le_2_5, count(*) FILTER (value <= 60) AS le_60 FROM events GROUP BY 1, 2""")
def _(spark, d):
    t = _utc(spark, d).select("ts", F.col("event_type").alias("status"), F.col("value").alias("duration_s"))
    out = ev.run_metrics(t, [1.0, 2.5, 60.0])
    return out.withColumns({
        "started": F.date_format("window_start", "yyyy-MM-dd HH:mm"), "mean_duration_s": F.round("mean_duration_s", 6)
    }).drop("window_start")


@query("stm9_cache_cleanup", f"""
    SELECT event_id AS point_id FROM events WHERE event_type = 'view' OR ts > TIMESTAMP '2024-01-31' - INTERVAL {fv.CACHE_TTL_SECONDS} SECOND""")
def _(spark, d):
    e = _utc(spark, d)
    points = e.select(F.col("event_id").alias("point_id"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("redis_key"))
    entries = e.select(F.col("event_id").alias("redis_key"), F.col("ts").alias("created_at"))
    return ev.clean_cache(points, entries, F.lit("2024-01-31").cast("timestamp")).select("point_id")


@query("stm9_scheduled_cleanup", f"""
    WITH e AS (SELECT event_id, event_type, ts > TIMESTAMP '2024-01-31' - INTERVAL {fv.CACHE_TTL_SECONDS} SECOND AS live FROM events)
    SELECT event_id AS point_id, (SELECT count(*) FILTER (NOT live) FROM e) AS expired, (SELECT count(*) FILTER (NOT live AND event_type <> 'view') FROM e) AS orphans, 0::BIGINT AS again
    FROM e WHERE event_type = 'view' OR live""")
def _(spark, d):
    base, e = run_dir(spark), _utc(spark, d)
    points, entries = "point_id long, redis_key long", "redis_key long, created_at timestamp"
    write_version(e.select(F.col("event_id").alias("point_id"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("redis_key")), f"{base}/points")
    write_version(e.select(F.col("event_id").alias("redis_key"), F.col("ts").alias("created_at")), f"{base}/entries")
    now = F.lit("2024-01-31").cast("timestamp")
    expired, orphans = ev.clean_up(spark, base, now, entries, points)
    again = sum(ev.clean_up(spark, base, now, entries, points))
    found = [F.lit(n).cast("long").alias(c) for n, c in ((expired, "expired"), (orphans, "orphans"), (again, "again"))]
    return read_latest(spark, f"{base}/points", points).select("point_id", *found)


@query("stm10_incremental_ingest", """
    SELECT doc_id AS document_id, count(*) AS chunks FROM (SELECT doc_id, unnest(range(0, ceil(length(trim(text, chr(10) || ' ')) / 512)::BIGINT)) AS i FROM documents WHERE length(trim(text)) >= 40) GROUP BY 1""")
def _(spark, d):
    from ..functions import chunking as ck

    base = run_dir(spark)
    docs = _stream(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), "text", F.octet_length("text").alias("file_size")
    )

    def build(batch: DataFrame) -> DataFrame:
        gated = ing.gate(batch)
        return ing.chunk_records(gated, F.when(F.col("is_acceptable"), ck.fixed(F.col("text"), 512)))

    ev.ingest_batches(docs, f"{base}/out", f"{base}/ckpt", build).awaitTermination()
    out = spark.read.schema("document_id long, chunk_index int, chunk_hash string").parquet(f"{base}/out")
    return out.groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("stm10_incremental_ingest_files", f"""
    SELECT project_id, count(*) AS documents, count(*) FILTER (outcome <> 'CACHED') AS stored, count(*) FILTER (outcome = 'QUARANTINED') AS refused, sum(expected)::BIGINT AS chunks, sum(links)::BIGINT AS links
    FROM ({COMPOSED}) GROUP BY 1""")
def _(spark, d):
    # four batches, in no order of ids, so repeats of a text come in other batches than the text; all cores write and read
    base, files_each = run_dir(spark), max(1, spark.sparkContext.defaultParallelism // 4)
    cut = load(spark, d, "documents").repartition(4 * files_each, "doc_id")
    cut.write.option("parquet.block.size", cp.ROW_GROUP).parquet(f"{base}/in")
    files = spark.readStream.schema(SCHEMAS["documents"]).option("maxFilesPerTrigger", files_each).parquet(f"{base}/in")
    cp.ingest_stream(intake_rows(files), f"{base}/out", f"{base}/ckpt", fn=refusing_embedder).awaitTermination()
    return cp.verdicts(spark, f"{base}/out").groupBy("project_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("outcome") != "CACHED").alias("stored"),
        F.count_if(F.col("outcome") == "QUARANTINED").alias("refused"), F.sum("expected").alias("chunks"), F.sum("links").alias("links"),
    )


@query("stm11_active_runs", """
    WITH m AS (SELECT user_id, event_id AS run_id, unnest([epoch_us(ts), epoch_us(ts) + floor(least(value * 60, 120) * 1000000)::BIGINT]) AS at_us, unnest([1, -1]) AS step FROM events)
    SELECT user_id, run_id, at_us, step, sum(step) OVER (PARTITION BY user_id ORDER BY at_us, step, run_id)::BIGINT AS active FROM m""")
def _(spark, d):
    t = load(spark, d, "events").select(F.col("event_id").alias("run_id"), "user_id", "ts", (F.col("value") * 60).alias("duration_s"))
    return ev.active_runs(t).select("user_id", "run_id", "at_us", "step", "active")


@query("stm11_active_runs_stream", """
    WITH m AS (SELECT user_id, event_id AS run_id, unnest([epoch_us(ts), epoch_us(ts) + floor(least(value * 60, 120) * 1000000)::BIGINT]) AS at_us, unnest([1, -1]) AS step FROM events),
    s AS (SELECT user_id, run_id, at_us, step, sum(step) OVER (PARTITION BY user_id ORDER BY at_us, step, run_id)::BIGINT AS active FROM m)
    SELECT * FROM s WHERE at_us <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""")
def _(spark, d):
    t = _stream(spark, d, "events").select(F.col("event_id").alias("run_id"), "user_id", "ts", (F.col("value") * 60).alias("duration_s"))
    return _drain(spark, st.active_run_stream(t), "user_id long, run_id long, at_us long, step int, active long")


@query("snk3_turn_hits_json", """
    SELECT user_id % 8 AS turn, event_id AS id, value AS score FROM events""")
def _(spark, d):
    path = f"{run_dir(spark)}/hits"
    hits = load(spark, d, "events").select((F.col("user_id") % 8).alias("turn"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    write_turn_hits(hits, path)
    return spark.read.schema("id long, score double, turn long").json(path)


@query("snk4_append_log", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, d):
    path = f"{run_dir(spark)}/log"
    log = load(spark, d, "events").select("event_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    append_log(log.filter("action <> 'error'"), path)
    append_log(log.filter("action = 'error'"), path)
    back = spark.read.schema("event_id long, action string, created_at timestamp_ntz, day date").parquet(path)
    return back.groupBy(F.col("day").cast("string").alias("day"), "action").agg(F.count("*").alias("n"))
