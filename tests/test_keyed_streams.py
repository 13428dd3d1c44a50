"""Order-dependent decisions: batch forms against plain folds, streams against their batch twins."""

import datetime as dt
import random
from collections import Counter, deque

import pytest
from pyspark.sql import Row, functions as F

from docloom.operators import aggregates as ag
from docloom.operators.graph import components
from docloom.sources.tables import read_latest, versions, write_version
from docloom.streaming import events as ev, limits as lm, stateful as st

BASE = dt.datetime(2024, 1, 1)
UPLOADS = "event_id long, ts timestamp, user_id string, project_id string, event string"


def uploads(seed, n=400, step=7):
    """Two hot groups that share nothing, quiet users, nulls, ties and repeated times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = rng.choice("aab")
        user = rng.choice([f"{group}{k}" for k in range(3)] + [f"quiet{i}", None])
        project = rng.choice([f"{group}-p1", f"{group}-p2", None])
        rows.append((i, BASE + dt.timedelta(seconds=step * (i // 2) + rng.choice([0, 0, 1, 300 if i > n // 2 else 0])), user, project, "x"))
    return rows


def fold_uploads(rows, user_limit, project_limit, seconds):
    held, out = {}, {}
    for i, ts, user, project, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        reason = ""
        for kind, key, limit in (("user", user, user_limit), ("project", project, project_limit)):
            window = held.setdefault((kind, key), deque())
            while window and window[0] <= ts - dt.timedelta(seconds=seconds):
                window.popleft()
            if key is not None and not reason and len(window) >= limit:
                reason = kind
        if not reason:
            held["user", user].append(ts)
            held["project", project].append(ts)
        out[i] = reason
    return out


def files(spark, path, rows, schema, n):
    """Parquet files written one after the other; each becomes a micro-batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{path}/f={i}")
    return spark.readStream.schema(f"{schema}, f int").option("maxFilesPerTrigger", 1).parquet(path).drop("f")


def jumbled(rows, seed, reach, ts=1):
    """Rows out of order, each at most ``reach`` places from where it belongs."""
    rng = random.Random(seed)
    return [r for _, r in sorted(enumerate(sorted(rows, key=lambda r: r[ts])), key=lambda x: x[0] + rng.random() * reach)]


def drained(spark, changes, path, schema):
    writer = changes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt")
    st.start(writer, spark).awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def test_components_like_union_find(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(90)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)]
    links += [("z", "z"), (None, "q"), ("n1", None)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a string, b string")).collect()
    assert Counter(map(tuple, got)) == Counter((n, top(n)) for n in parent)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_upload_limits_like_a_fold(spark, seed):
    rows = uploads(seed)
    extra = ("us", "part", "most", "stands", "_user", "_block", "_group")
    df = spark.createDataFrame(rows, UPLOADS).withColumns({c: F.lit(c) for c in extra})
    found = lm.upload_limits(df, 3, 5, 60).collect()
    assert all(r[c] == c for r in found for c in extra)
    got = {r["event_id"]: r["reason"] for r in found}
    want = fold_uploads(rows, 3, 5, 60)
    assert got == want and {"user", "project", ""} == set(want.values())


def test_upload_limits_of_a_large_group_go_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_ROWS", 60)
    rows = sorted(uploads(5, 300, 2), key=lambda r: (r[1], r[0]))
    want = fold_uploads(rows, 3, 8, 60)
    df = spark.createDataFrame(rows, UPLOADS)
    parts = []
    fold = lm._fold_uploads
    monkeypatch.setattr(lm, "_fold_uploads", lambda part, *a: parts.append(part.filter("NOT stands").groupBy("_group").count()) or fold(part, *a))
    got = lm.upload_limits(df, 3, 8, 60).collect()
    assert len(got) == len(rows) and {r["event_id"]: r["reason"] for r in got} == want
    assert len(parts) > 3 and max(r["count"] for p in parts for r in p.collect()) < 100
    early, late = rows[:80], rows[80:]
    accepted = spark.createDataFrame([r for r in early if want[r[0]] == ""], UPLOADS)
    got = lm.upload_limits(spark.createDataFrame(late, UPLOADS), 3, 8, 60, accepted).collect()
    assert len(got) == len(late) and {r["event_id"]: r["reason"] for r in got} == {r[0]: want[r[0]] for r in late}


def test_upload_limits_go_on_from_accepted(spark):
    rows = sorted(uploads(3), key=lambda r: (r[1], r[0]))
    want = fold_uploads(rows, 3, 8, 60)
    first, rest = rows[:200], rows[200:]
    accepted = spark.createDataFrame([r for r in first if not want[r[0]]], UPLOADS)
    got = lm.upload_limits(spark.createDataFrame(rest, UPLOADS), 3, 8, 60, accepted).collect()
    assert {r["event_id"]: r["reason"] for r in got} == {r[0]: want[r[0]] for r in rest}


def test_hot_groups_fold_in_tasks_of_their_own(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, BASE + dt.timedelta(seconds=i // 8), f"g{i % 8}-u", f"g{i % 8}-p", "x") for i in range(800)]
        out = lm.upload_limits(spark.createDataFrame(rows, UPLOADS), 2, 3, 60)
        tasks = out.select(F.split("user_id", "-")[0].alias("g"), F.spark_partition_id().alias("t")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["g"] for r in tasks}) == 8 == len(tasks)  # no group in two tasks
    assert len({r["t"] for r in tasks}) > 2


def test_upload_stream_equals_batch_and_replays(spark, tmp_path):
    rows = jumbled(uploads(4), 5, 40)
    late = [(9000, BASE, "a0", "a-p1", "x"), (9001, None, "a0", "a-p1", "x")]
    src = files(spark, str(tmp_path / "in"), rows + late, UPLOADS, 5)
    out = str(tmp_path / "out")
    lm.limit_uploads(src, out, str(tmp_path / "ckpt"), 3, 8, 60, delay=400).awaitTermination()
    read = lambda: {r["event_id"]: r["reason"] for r in spark.read.schema("event_id long, reason string").parquet(f"{out}/batch=*").collect()}
    got, newest = read(), max(r[1] for r in rows)
    want = {i: x for i, x in fold_uploads(rows, 3, 8, 60).items() if rows_by_id(rows)[i][1] <= newest - dt.timedelta(seconds=400)}
    assert got.pop(9000) == "late" and got.pop(9001) == ""
    assert got == want
    # the last batch again, as after a failure: the same state, the same rows
    before = Counter(read().items())
    last = src_batch(spark, str(tmp_path / "in"), 4)
    replay(src, last, 4, out)
    assert Counter(read().items()) == before


def rows_by_id(rows):
    return {r[0]: r for r in rows}


def src_batch(spark, path, i):
    return spark.read.schema(UPLOADS).parquet(f"{path}/f={i}")


def replay(src, batch, batch_id, out):
    """Hand a batch to the step of the job once more."""
    steps = []

    class Writer:
        def foreachBatch(self, step):
            steps.append(step)
            return self

        def __getattr__(self, name):
            return lambda *a, **k: self

    class Stream:
        sparkSession, schema, writeStream = batch.sparkSession, src.schema, Writer()

    lm.limit_uploads(Stream, out, "", 3, 8, 60, delay=400)
    steps[0](batch, batch_id)


RUNS = "event_id long, ts timestamp, user_id long, duration_s double"


def runs(seed, n=240):
    rng = random.Random(seed)
    return [(i, BASE + dt.timedelta(seconds=25 * i + rng.choice([0, 0, 7])), rng.randint(0, 2), rng.choice([None, 5.0, 60.0, 500.0])) for i in range(n)]


def seen(rows, minutes=20):
    return max(r[1] for r in rows) - dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("limits", [(2, 100, 1000), (100, 2, 1000), (100, 100, 30), (2, 3, 40)])
def test_chat_limit_stream_equals_batch(spark, tmp_path, limits):
    rows = runs(1)
    src = files(spark, str(tmp_path / "in"), jumbled(rows, 2, 30), RUNS, 3)
    out = drained(spark, st.chat_limit_stream(src, *limits, watermark="20 minutes"), str(tmp_path), "event_id long, allowed boolean, reason string")
    whole = spark.createDataFrame(rows, RUNS).withColumn("duration_s", F.coalesce("duration_s", F.lit(1e9)))
    batch = lm.chat_limits(whole, *limits).filter(F.col("ts") <= F.lit(seen(rows)))
    want = Counter((r["event_id"], r["reason"]) for r in batch.collect())
    assert Counter((r["event_id"], r["reason"]) for r in out.collect()) == want
    assert len({reason for _, reason in want}) > 1


def test_active_run_stream_equals_batch(spark, tmp_path):
    rows = runs(3)
    src = files(spark, str(tmp_path / "in"), jumbled(rows, 4, 30), RUNS, 3).withColumnRenamed("event_id", "run_id")
    schema = "user_id long, run_id long, at_us long, step int, active long"
    out = drained(spark, st.active_run_stream(src, watermark="20 minutes"), str(tmp_path), schema)
    whole = spark.createDataFrame(rows, RUNS).withColumnRenamed("event_id", "run_id")
    batch = ev.active_runs(whole.withColumn("duration_s", F.coalesce("duration_s", F.lit(1e9))))
    limit = F.unix_micros(F.lit(seen(rows)).cast("timestamp"))
    cols = [c.split()[0] for c in schema.split(", ")]
    want = batch.filter(F.col("at_us") <= limit).select(*cols)
    got, want = (Counter(map(tuple, x.collect())) for x in (out.select(*cols), want))
    assert got == want, (got - want, want - got)


REQUESTS = "request_id long, ts timestamp, user_id long, client_request_id string, payload_hash string, status string"


def test_idempotent_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    status = ["completed", "started", "streaming", "failed", None]
    rows = [
        (i, BASE + dt.timedelta(seconds=40 * i + rng.choice([0, 0, 90])), rng.randint(0, 1), rng.choice(["a", "b", "c", None]), rng.choice(["x", "x", "y", None]), rng.choice(status))
        for i in range(150)
    ]
    src = files(spark, str(tmp_path / "in"), jumbled(rows, 6, 20), REQUESTS, 3)
    out = drained(spark, st.idempotent_stream(src, 300, "20 minutes"), str(tmp_path), "request_id long, us long, decision string")
    whole = spark.createDataFrame(rows, REQUESTS)
    last = F.unix_micros(F.lit(seen(rows)).cast("timestamp"))
    free = {r[0] for r in rows if r[3] is None}
    want = {(r["request_id"], r["decision"]) for r in ev.idempotent_in_time(whole, 300).collect()}
    due = {r["request_id"] for r in ev.idempotent_in_time(whole, 300).filter(F.col("us") <= last).collect()} | free
    assert {(r["request_id"], r["decision"]) for r in out.collect()} == {x for x in want if x[0] in due}
    held, plain = {}, {}
    for i, ts, user, client, payload, state in sorted(rows, key=lambda r: (r[1], r[0])):
        if client is None:
            plain[i] = "new"
            continue
        first = held.get((user, client))
        if first is None or ts - first[2] >= dt.timedelta(seconds=300):
            held[user, client] = [payload, state, ts]
            plain[i] = "new"
            continue
        first[2] = ts
        if payload and first[0] and payload != first[0]:
            plain[i] = "conflict_payload"
        else:
            plain[i] = {"completed": "replay", "started": "conflict_running", "streaming": "conflict_running"}.get(first[1], "conflict_used")
    assert dict(want) == plain


def test_whole_snapshots_expire(spark, tmp_path):
    schema = "task_id string, seq_num long, ts timestamp, status string, stage_label string, total_units int, note struct<a:int,b:string>"
    rng = random.Random(7)
    rows = [
        (f"t{rng.randint(0, 30)}", rng.randint(0, 5), BASE + dt.timedelta(seconds=60 * rng.randint(0, 200)), rng.choice("ab"), rng.choice(["parse", None]), rng.choice([1, None]), (i, "x"))
        for i in range(120)
    ]
    src = files(spark, str(tmp_path / "in"), jumbled(rows, 8, 10, 2), schema, 4)
    changes = st.snapshot_stream(src, "task_id", "seq_num", ttl=3600, watermark="30 minutes")
    out = str(tmp_path / "out")

    def keep(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    writer = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt"))
    st.start(writer, spark).awaitTermination()
    table = st.snapshot_table(spark.read.parquet(out), "task_id")
    now = F.lit(max(r[2] for r in rows) - dt.timedelta(minutes=30)).cast("timestamp")
    whole = spark.createDataFrame(rows, schema)
    order = {}
    for r in rows:  # several events may share task, time and number
        order.setdefault(r[0], []).append((r[2], r[1]))
    want = ev.latest_state(whole, "task_id", "seq_num", "ts", now, 3600).select("task_id", "ts", "seq_num")
    assert Counter(map(tuple, table.select("task_id", "ts", "seq_num").collect())) == Counter(map(tuple, want.collect()))
    assert {tuple(r) for r in table.select(*[f.name for f in whole.schema]).collect()} <= {tuple(r) for r in whole.collect()}
    assert 0 < table.count() < len(order)


RATED = "window_start timestamp, window_end timestamp, label string, rate double"


def rated(minutes, label="x"):
    """Breaching windows that end at these minutes, quiet ones between."""
    last = max(minutes) + 3
    return [(BASE + dt.timedelta(minutes=m - 5), BASE + dt.timedelta(minutes=m), label, 2.0 if m in minutes else 0.5) for m in range(1, last)]


def test_alerts_carry_over_days(spark):
    """Runs within a day, over midnight, over whole days, and two whole days that begin by themselves."""
    long = set(range(1430, 4 * 1440 + 20)) | set(range(5 * 1440, 7 * 1440)) | {7 * 1440 + 2, 7 * 1440 + 3} | set(range(20, 30))
    rows = rated(long) + rated({3, 4, 5, 1439, 1440, 1441, 1442}, "y")
    got = {(r["label"], r["window_end"]): r["minutes_over"] for r in ev.alerts(spark.createDataFrame(rows, RATED), ["label"], 1.0, 2).collect()}
    want, run = {}, {}
    for _, end, label, rate in rows:
        run[label] = run.get(label, -1) + 1 if rate > 1 else -1
        if run[label] >= 2:
            want[label, end] = run[label]
    assert got == want and max(want.values()) > 3 * 1440


def test_alert_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, BASE + dt.timedelta(seconds=rng.randint(0, 7200)), rng.choice("ab")) for i in range(500)]
    schema = "event_id long, ts timestamp, label string"
    src = files(spark, str(tmp_path / "in"), jumbled(rows, 1, 30), schema, 3)
    changes = st.alert_stream(ev.rates(src, ["label"], watermark="20 minutes"), ["label"], 0.03, 3)
    out = drained(spark, changes, str(tmp_path), "window_end timestamp, label string, minutes_over long")
    whole = ev.alerts(ev.rates(spark.createDataFrame(rows, schema), ["label"]), ["label"], 0.03, 3)
    want = whole.filter(F.col("window_end") <= F.lit(seen(rows))).select("window_end", "label", F.col("minutes_over").cast("long"))
    got, want = (Counter(map(tuple, x.select("window_end", "label", "minutes_over").collect())) for x in (out, want))
    assert got == want and want


def test_clean_up_twice(spark, tmp_path):
    base = str(tmp_path)
    entry, point = "redis_key string, created_at timestamp", "point_id string, redis_key string"
    now = F.lit("2024-02-01").cast("timestamp")
    assert ev.clean_up(spark, base, now, entry, point) == (0, 0)  # no tables yet
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    write_version(spark.createDataFrame([("k1", new), ("k2", old)], entry), f"{base}/entries")
    write_version(spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", None), ("d", "gone")], point), f"{base}/points")
    assert ev.clean_up(spark, base, now, entry, point) == (1, 2)
    assert sorted(r["point_id"] for r in read_latest(spark, f"{base}/points", point).collect()) == ["a", "c"]
    held = versions(spark, f"{base}/points"), versions(spark, f"{base}/entries")
    assert ev.clean_up(spark, base, now, entry, point) == (0, 0)
    assert (versions(spark, f"{base}/points"), versions(spark, f"{base}/entries")) == held == ([1, 2], [1, 2])
    # a version whose writer died is not read, and its number is not taken again
    broken = spark.createDataFrame([("z", None)], point)
    broken.write.parquet(f"{base}/points/v000003")
    (tmp_path / "points" / "v000003" / "_SUCCESS").unlink()
    assert "z" not in {r["point_id"] for r in read_latest(spark, f"{base}/points", point).collect()}
    assert write_version(broken, f"{base}/points").endswith("v000004")


def test_sketches_are_near_exact_quantiles(spark):
    rng = random.Random(2)
    values = [rng.lognormvariate(3, 2) for _ in range(20_000)]
    rows = [(BASE + dt.timedelta(minutes=i % 3000), "ab"[i % 3 == 0], v) for i, v in enumerate(values)] + [(BASE, "none", None)]
    df = spark.createDataFrame(rows, "ts timestamp, status string, ms double")
    found = ag.sketch_quantiles(ag.quantile_sketches(df, ["status"], "ms"), ["status"], (0.1, 0.5, 0.99)).collect()
    assert {r["status"] for r in found} == {"a", "b"}
    for r in found:
        own = [v for _, s, v in rows if s == r["status"]]
        assert r["n"] == len(own)
        for q, got in ((0.1, r["p10"]), (0.5, r["p50"]), (0.99, r["p99"])):
            assert abs(sum(v <= got for v in own) / len(own) - q) < 0.02


def test_first_deltas_and_feedback(spark):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    runs = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, at(9))], "run_id long, started_at timestamp")
    deltas = spark.createDataFrame([(1, at(3)), (1, at(2)), (2, at(1))], "run_id long, ts timestamp")
    assert {r["run_id"]: r["first_delta_ms"] for r in ag.first_deltas(runs, deltas).collect()} == {1: 2000, 2: 0, 3: 0}
    votes = [("m", True, "slow, wrong", "x"), ("m", False, "wrong,wrong", " "), ("m", None, None, None), (None, True, "", "y")]
    out = ag.feedback_rollup(spark.createDataFrame(votes, "model string, is_positive boolean, reason_tags string, comment string"), ["model"])
    got = {r["model"]: (r["votes"], r["positive_share"], r["comments"], r["tags"]) for r in out.collect()}
    assert got == {"m": (3, 0.5, 1, {"slow": 1, "wrong": 2}), None: (1, 1.0, 1, {})}


class Store:
    """A bucket's state, and how often it is called."""

    def __init__(self):
        self.calls, self.lists, self.values, self.timers = 0, [], None, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Value(self)

    def registerTimer(self, ms):
        self.timers.append(ms)

    def appendValue(self, value):
        self.calls += 1
        self.lists.append(value)

    def put(self, values):
        self.calls += 1
        self.lists = list(values)

    def get(self):
        self.calls += 1
        return iter(list(self.lists))

    def clear(self):
        self.calls += 1
        self.lists = []


class Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.values

    def update(self, value):
        self.store.calls += 1
        self.store.values = value

    def clear(self):
        self.store.calls += 1
        self.store.values = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("keys", [3, 3000])
def test_state_is_called_by_bucket_and_not_by_key(keys):
    """Each key has a run from 1 to 5 seconds and one that is still to come; a null key is a key too."""
    store, machine = Store(), st.InOrder(st.Active(), 1)
    machine.init(store)
    row = Row("_key0", "us", "ends", "run_id")
    names = [None, *range(keys - 1)]
    for us in (1_000_000, 60_000_000):
        list(machine.handleInputRows((0,), iter([row(k, us, us + 4_000_000, f"{k}-{us}") for k in names]), Clock(0)))
    out = list(machine.handleExpiredTimer((0,), Clock(3000), None))
    assert [(r.user_id, r.step, r.active) for r in out] == [(k, 1, 1) for k in names]
    out = list(machine.handleExpiredTimer((0,), Clock(6000), None))
    assert [(r.user_id, r.step, r.active) for r in out] == [(k, -1, 0) for k in names]
    assert store.values is None and min(store.timers[-1:]) == 60_000
    assert store.calls < 12
