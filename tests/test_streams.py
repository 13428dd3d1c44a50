"""Streams give what their batch twins give, in any arrival order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docloom.catalog import QUERIES
from docloom.plans.registry import Stages
from docloom.session import shared_dir
from docloom.sources.tables import load
from docloom.streaming import events as ev, limits as lm

SCHEMA = "event_id long, ts timestamp, user_id long, status string, value double"


def write_files(spark, path, rows, files):
    """Parquet files in time order of writing; each becomes one micro-batch."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f={i}")


def make(seed, n=300):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [(i, base + dt.timedelta(seconds=20 * i + rng.randint(0, 15)), rng.randint(0, 4), rng.choice(["a", "b"]), rng.random()) for i in range(n)]


def stream(spark, path):
    return spark.readStream.schema(SCHEMA + ", f int").option("maxFilesPerTrigger", 1).parquet(path).drop("f")


def drain(df, spark, out, ckpt, mode="append"):
    if mode == "append":
        df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt).trigger(
            availableNow=True).start().awaitTermination()
    else:
        def keep(batch, i):
            batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

        df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


def test_snapshots_ignore_late_sequence_numbers(spark, tmp_path):
    rows = make(1)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    write_files(spark, str(tmp_path / "in"), shuffled, 4)
    drain(ev.latest_stream(stream(spark, str(tmp_path / "in")), "user_id", "event_id", watermark="3 hours"), spark, str(tmp_path / "out"), str(tmp_path / "c"), "update")
    out = spark.read.schema("user_id long, event_id long, status string, batch int").parquet(str(tmp_path / "out"))
    got = {r["user_id"]: r["event_id"] for r in out.groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()}
    batch = ev.latest_state(spark.createDataFrame(rows, SCHEMA), "user_id", "event_id", "event_id")
    assert got == {r["user_id"]: r["event_id"] for r in batch.collect()}


def test_limit_stream_keeps_state_between_batches(spark, tmp_path):
    rows = make(3)
    write_files(spark, str(tmp_path / "in"), rows, 5)
    drain(lm.limit_stream(stream(spark, str(tmp_path / "in")), "user_id", 2, 300), spark, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r["event_id"]: r["allowed"] for r in spark.read.schema("event_id long, us long, allowed boolean").parquet(str(tmp_path / "out")).collect()}
    seen, want = {}, {}
    for i, ts, u, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        live = [t for t in seen.get(u, []) if t > ts - dt.timedelta(seconds=300)]
        want[i] = len(live) < 2
        seen[u] = live + [ts] if want[i] else live
    assert got == want


def test_rates_stream_matches_batch(spark, tmp_path):
    rows = make(4)
    write_files(spark, str(tmp_path / "in"), rows, 3)
    drain(ev.rates(stream(spark, str(tmp_path / "in")), ["status"]), spark, str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.schema("window_start timestamp, window_end timestamp, status string, events long, rate double").parquet(str(tmp_path / "out"))
    last = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    batch = ev.rates(spark.createDataFrame(rows, SCHEMA), ["status"])
    pick = lambda df: {(r["window_start"], r["status"], r["events"]) for r in df.collect()}
    assert pick(out) == pick(batch.filter(F.col("window_end") <= F.lit(last)))


def test_event_files_are_validated_and_partitioned(spark, tmp_path):
    good = '{"event_id": "e1", "seq_num": 1, "task_id": "t", "project_id": "p", "actual_progress": 40.0}'
    bad = '{"event_id": "e2", "seq_num": 2, "project_id": "p", "actual_progress": 40.0}\n{"event_id": "e3", "seq_num": 3, "task_id": "t", "project_id": "p", "actual_progress": 400}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(good + "\n" + bad)
    ev.write_events(ev.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).filter("project_id = 'p'").collect()] == ["e1"]


def test_alerts_need_an_unbroken_run(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), "x", 2.0 if m != 4 else 0.5) for m in range(12)]
    rated = spark.createDataFrame(rows, "window_end timestamp, label string, rate double")
    got = sorted(r["window_end"].minute for r in ev.alerts(rated, ["label"], 1.0, 5).collect())
    assert got == [10, 11]


def test_cache_cleanup_keeps_points_without_key(spark):
    points = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", None)], "point_id string, redis_key string")
    now = F.lit("2024-02-01").cast("timestamp")
    entries = spark.sql("SELECT 'k1' AS redis_key, timestamp'2024-01-31' AS created_at UNION ALL SELECT 'k2', timestamp'2024-01-01'")
    assert sorted(r["point_id"] for r in ev.clean_cache(points, entries, now).collect()) == ["a", "c"]


def test_stages_can_be_replaced(spark):
    stages = Stages(a=lambda d: d.filter("id > 5"), b=lambda d: d.withColumn("x", F.lit(1)))
    assert stages.run(spark.range(10), ["a", "b"]).count() == 4
    stages.register("a", lambda d: d.limit(0))
    assert stages.run(spark.range(10), ["a", "b"]).count() == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", ["stm10_incremental_ingest", "stm7_drop_repeats_stream"])
def test_streams_read_tables_in_folders(spark, sf, tmp_path, name):
    for table in ("documents", "events"):
        load(spark, sf, table).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = lambda d: sorted(tuple(r) for r in QUERIES[name](spark, d).collect())
    assert rows(str(tmp_path)) == rows(sf) != []
