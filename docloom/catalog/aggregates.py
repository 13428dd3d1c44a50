"""Statistics, facets, histograms, reports, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import chunking as ck
from ..functions import fixed_values as fv
from ..functions import checks, numbers as nm
from ..operators import aggregates as ag, windows as wn
from .base import load, query
from .joins import lines


@query("agg2_runs_per_user", """
    SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND event_type IN ('click', 'view')) AS runs FROM events GROUP BY 1""")
def _(spark, d):
    runs = load(spark, d, "events").select("user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    return ag.run_counts(runs, F.lit("2024-01-10").cast("timestamp_ntz"), ["click", "view"])


_STATUS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'ready' WHEN '2-HIGH' THEN 'embedding' WHEN '3-MEDIUM' THEN 'failed'
    WHEN '5-LOW' THEN 'completed' ELSE 'parsed' END"""


def _docs(spark, d):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "ready").when(p == "2-HIGH", "embedding").when(p == "3-MEDIUM", "failed").when(
        p == "5-LOW", "completed").otherwise("parsed")
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), (F.col("o_orderstatus") == "P").alias("is_deleted"), status.alias("status"),
        F.when(p != "2-HIGH", F.floor(F.col("o_totalprice") / 1000)).alias("chunk_count"),
        F.floor("o_totalprice").alias("file_size_bytes"), F.col("o_orderdate").alias("updated_at"),
    )


def _sql_stats(done: str) -> str:
    return f"""
    SELECT project_id, count(*) AS total_documents, sum(CASE WHEN s = 'embedding' THEN 0 ELSE floor(o_totalprice / 1000) END)::BIGINT AS total_chunks,
      sum(floor(o_totalprice))::BIGINT AS total_size_bytes, count(*) FILTER (s IN ({done})) AS completed,
      count(*) FILTER (s = 'embedding') AS processing, count(*) FILTER (s = 'failed') AS failed,
      count(*) FILTER (s NOT IN ({done}, 'embedding', 'failed')) AS pending, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_synced
    FROM (SELECT *, o_custkey AS project_id, {_STATUS} AS s FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1"""


@query("agg3_project_stats", _sql_stats("'completed', 'ready'"))
def _(spark, d):
    t = ag.project_stats(_docs(spark, d))
    return t.withColumn("last_synced", F.to_date("last_synced_at").cast("string")).drop("last_synced_at")


@query("agg3_project_stats_strict", _sql_stats("'completed'"))
def _(spark, d):
    t = ag.project_stats(_docs(spark, d), strict=True)
    return t.withColumn("last_synced", F.to_date("last_synced_at").cast("string")).drop("last_synced_at")


@query("agg4_dedup_ratio", """
    SELECT source, count(*) AS links, count(DISTINCT c) AS chunks, count(*) - count(DISTINCT c) AS saved_chunks, round(1 - count(DISTINCT c) / count(*)::DOUBLE, 6) AS dedup_ratio
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS c FROM documents) GROUP BY 1""")
def _(spark, d):
    links = lines(spark, d).select("source", F.sha2("content", 256).alias("chunk_hash"))
    return ag.dedup_ratio(links, "source").withColumn("dedup_ratio", F.round("dedup_ratio", 6))


@query("agg5_quota", """
    WITH u AS (SELECT o_custkey AS c, o_orderpriority AS p, sum(floor(o_totalprice))::BIGINT AS used FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT o_orderkey, coalesce(used, 0) AS used_bytes, coalesce(used, 0) > 600000 OR coalesce(used, 0) + floor(o_totalprice)::BIGINT > 600000 AS would_exceed
    FROM orders LEFT JOIN u ON c = o_custkey AND p = o_orderpriority WHERE o_orderstatus <> 'F'""")
def _(spark, d):
    t = load(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("project_id"),
        F.floor("o_totalprice").alias("file_size"), "o_orderstatus",
    )
    stored = t.filter("o_orderstatus = 'F'").withColumnRenamed("file_size", "storage_size_bytes")
    return ag.quota(stored, t.filter("o_orderstatus <> 'F'"), 600000).select("o_orderkey", "used_bytes", "would_exceed")


_FACET_DOCS = """SELECT lang, CASE WHEN usable AND len(ps) > 0 THEN len(ps) ELSE 2 END AS n FROM (SELECT lang, length(trim(text)) > 50 AS usable,
    list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: trim(s)), lambda s: length(s) > 20) AS ps FROM documents)"""


def _facet_docs(spark, d):
    t = load(spark, d, "documents")
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    name = F.concat(F.lit("doc_"), "doc_id", F.when(F.col("lang") == "en", ".MD").when(F.col("lang") == "fr", ".pdf").otherwise(""))
    return t.select(
        "doc_id", name.alias("file_name"),
        ck.search_paragraphs(text, name, checks.usable_content(text, name), name, F.lit(2)).alias("paragraphs"),
    )


@query("agg6_search_facets", f"""
    WITH r AS ({_FACET_DOCS}), n AS (SELECT sum(n)::BIGINT AS n FROM r)
    SELECT 'document_types' AS facet, CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'pdf' ELSE 'txt' END AS key, count(*) AS count FROM documents GROUP BY 2
    UNION ALL SELECT 'data_sources', 'local', n FROM n UNION ALL SELECT 'owners', 'me@x.org', n FROM n UNION ALL SELECT 'connector_types', 'local', n FROM n""")
def _(spark, d):
    return ag.facets(_facet_docs(spark, d), "me@x.org")


@query("chk8_search_paragraphs", f"""
    SELECT doc_id, page, sha256(p) AS h FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS page FROM (SELECT doc_id,
      CASE WHEN usable AND len(ps) > 0 THEN ps ELSE [nm, nm] END AS ps FROM (SELECT doc_id, 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.MD' WHEN 'fr' THEN '.pdf' ELSE '' END AS nm, length(trim(text)) > 50 AS usable,
      list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: trim(s)), lambda s: length(s) > 20) AS ps FROM documents)))""")
def _(spark, d):
    t = _facet_docs(spark, d).select("doc_id", F.posexplode("paragraphs").alias("i", "p"))
    return t.select("doc_id", (F.col("i") + 1).alias("page"), F.sha2("p", 256).alias("h"))


@query("agg7_turn_scores", """
    SELECT l_orderkey, l_linenumber, round(avg(l_discount), 6) AS retrieval_score, count(*) AS evidence_count FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("score", F.col("l_discount"))
    return ag.turn_scores(t, ["l_orderkey", "l_linenumber"]).withColumn("retrieval_score", F.round("retrieval_score", 6))


def _ops(spark, d):
    return load(spark, d, "events").select(
        "event_id", F.col("user_id").alias("task_id"), F.dayofmonth("ts").alias("turn_number"), F.col("ts").alias("created_at"),
        F.floor(F.col("value") * 10).alias("duration_ms"), F.col("event_type").alias("operation"),
    )


@query("agg8_calls_per_turn", """
    SELECT user_id AS task_id, day(ts) AS turn_number, count(*) AS sdk_calls FROM events GROUP BY 1, 2""")
def _(spark, d):
    return ag.calls_per_turn(_ops(spark, d))


@query("agg8_operation_times", """
    SELECT event_id, strftime(ts + to_milliseconds(floor(value * 10)::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS ended FROM events""")
def _(spark, d):
    t = ag.with_end_time(_ops(spark, d))
    return t.select("event_id", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ended"))


@query("agg9_cost_rollup", """
    SELECT lang, sum(n)::BIGINT AS tokens, round(sum(n) * CASE lang WHEN 'fr' THEN 0.13 ELSE 0.02 END, 4)::DOUBLE AS cost_micro_usd
    FROM (SELECT lang, CASE WHEN trim(text) = '' THEN 0 ELSE length(text) // 4 END AS n FROM documents) GROUP BY lang""")
def _(spark, d):
    ops = load(spark, d, "documents").select("lang", nm.token_estimate(F.col("text")).alias("tokens"))
    model = F.when(F.col("lang") == "fr", "text-embedding-3-large").otherwise("text-embedding-3-small")
    t = ag.cost_rollup(ops, nm.embedding_cost(F.col("tokens"), model) * 1e6, ["lang"])
    return t.select("lang", "tokens", F.round("cost_usd", 4).alias("cost_micro_usd"))


_BOUNDS = ", ".join(f"('{b:g}', {b}::DOUBLE)" for b in fv.STEP_SECONDS_BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)"


@query("agg10_histogram", f"""
    SELECT event_type, le, count(*) FILTER (value <= b) AS cumulative, round(sum(value), 2) AS total
    FROM events, (VALUES {_BOUNDS}) v(le, b) GROUP BY event_type, le""")
def _(spark, d):
    t = ag.histogram(load(spark, d, "events"), "value", fv.STEP_SECONDS_BOUNDS, ["event_type"])
    return t.withColumn("total", F.round("total", 2))


def _utc(e):
    """Events with instants instead of wall-clock times."""
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _sql_histogram(rows: str, by: str, bounds: list[float]) -> str:
    """Cumulative counts of ``v`` per ``by``; every bound is a row, +Inf too."""
    cells = ", ".join([f"('{b:g}', {float(b)}::DOUBLE)" for b in bounds] + ["('+Inf', 'inf'::DOUBLE)"])
    return f"SELECT {by}, le, count(*) FILTER (v <= b) AS cumulative, round(sum(v), 3)::DOUBLE AS total FROM ({rows}), (VALUES {cells}) x(le, b) GROUP BY {by}, le"


def _histogram(rows, by, bounds):
    return ag.histogram(rows, "v", bounds, [by]).withColumn("total", F.round("total", 3).cast("double"))


_LATENCY = "SELECT event_type, value / 10 AS v FROM events"
_SIZES = "SELECT source, octet_length(encode(text))::DOUBLE AS v FROM documents"


@query("agg10_latency", _sql_histogram(_LATENCY, "event_type", fv.LATENCY_BOUNDS))
def _(spark, d):
    return _histogram(load(spark, d, "events").select("event_type", (F.col("value") / 10).alias("v")), "event_type", fv.LATENCY_BOUNDS)


@query("agg10_upload_size", _sql_histogram("SELECT o_orderstatus, o_totalprice * 100 AS v FROM orders", "o_orderstatus", fv.FILE_SIZE_BOUNDS))
def _(spark, d):
    rows = load(spark, d, "orders").select("o_orderstatus", (F.col("o_totalprice") * 100).alias("v"))
    return _histogram(rows, "o_orderstatus", fv.FILE_SIZE_BOUNDS)


@query("agg10_document_size", _sql_histogram(_SIZES, "source", fv.DOCUMENT_SIZE_BOUNDS))
def _(spark, d):
    rows = load(spark, d, "documents").select("source", F.octet_length("text").cast("double").alias("v"))
    return _histogram(rows, "source", fv.DOCUMENT_SIZE_BOUNDS)


@query("agg10_embed_batch", _sql_histogram("SELECT l_shipdate::DATE::VARCHAR AS day, count(*)::DOUBLE AS v FROM lineitem GROUP BY l_shipdate::DATE, l_suppkey % 7", "day", fv.EMBED_BATCH_BOUNDS))
def _(spark, d):
    day = F.col("l_shipdate").cast("date").cast("string").alias("day")
    rows = load(spark, d, "lineitem").groupBy(day, F.col("l_suppkey") % 7).agg(F.count("*").cast("double").alias("v"))
    return _histogram(rows.select("day", "v"), "day", fv.EMBED_BATCH_BOUNDS)


@query("agg10_quality_score", _sql_histogram("SELECT event_type, (floor(value) % 101) / 100::DOUBLE AS v FROM events", "event_type", fv.QUALITY_BOUNDS))
def _(spark, d):
    rows = load(spark, d, "events").select("event_type", ((F.floor("value") % 101) / 100).alias("v"))
    return _histogram(rows, "event_type", fv.QUALITY_BOUNDS)


@query("agg10_chunks_per_document", _sql_histogram("SELECT source, ceil(length(text) / 512)::DOUBLE AS v FROM documents", "source", fv.CHUNKS_BOUNDS))
def _(spark, d):
    rows = load(spark, d, "documents").select("source", F.ceil(F.length("text") / 512).cast("double").alias("v"))
    return _histogram(rows, "source", fv.CHUNKS_BOUNDS)


@query("agg11_counters", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS value FROM orders GROUP BY 1, 2""")
def _(spark, d):
    return ag.counters(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg12_coverage", """
    SELECT vendor, year, count(*) AS pages, '{''vendor'': ''' || vendor || ''', ''year'': ''' || year || '''}: ' || count(*) || ' pages' AS line
    FROM (SELECT source AS vendor, coalesce(CASE WHEN lang <> 'es' THEN lang END, 'unknown') AS year FROM documents) GROUP BY 1, 2""")
def _(spark, d):
    t = load(spark, d, "documents").select(F.col("source").alias("vendor"), F.when(F.col("lang") != "es", F.col("lang")).alias("year"))
    return ag.coverage(t, ["vendor", "year"])


_STEP_LIST = "[" + ", ".join(f"'{s}'" for s in fv.STEPS) + "]"


@query("agg14_step_report", f"""
    WITH h AS (SELECT user_id AS document_id, {_STEP_LIST}[1 + hour(ts) % 9] AS step, 1 + hour(ts) % 9 AS o, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'completed' END AS action, ts, event_id FROM events),
    l AS (SELECT document_id, step, o, arg_max(action, (ts, event_id)) AS action, count(*) FILTER (action = 'failed') AS tries FROM h GROUP BY 1, 2, 3),
    g AS (SELECT document_id, count(*) FILTER (action = 'completed') AS steps_done, sum(tries)::BIGINT AS tries, max(o) FILTER (action = 'failed') AS fo,
            list(o) FILTER (action = 'completed') AS done, list(o) FILTER (action = 'started') AS busy FROM l GROUP BY 1)
    SELECT document_id, steps_done, tries, {_STEP_LIST}[fo] AS failed_step,
      {_STEP_LIST}[(SELECT min(i) FROM range(1, 10) t(i) WHERE NOT list_contains(coalesce(done, []), i) AND NOT list_contains(coalesce(busy, []), i))] AS next_step,
      {_STEP_LIST}[(SELECT min(i) FROM range(1, 10) t(i) WHERE NOT list_contains(coalesce(done, []), i))] AS resume_from FROM g""")
def _(spark, d):
    steps = F.array(*[F.lit(s) for s in fv.STEPS])
    action = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").otherwise("completed")
    t = load(spark, d, "events").select(
        F.col("user_id").alias("document_id"), F.element_at(steps, 1 + F.hour("ts") % 9).alias("step"),
        action.alias("action"), F.struct("ts", "event_id").alias("ts"),
    )
    return ag.step_report(t)


@query("agg15_pdf_profile", """
    WITH p AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
    s AS (SELECT * FROM p WHERE turn % greatest(1, total // 15) = 0 AND turn / greatest(1, total // 15) < 15),
    a AS (SELECT conv_id, sum(CASE role WHEN 'system' THEN 0 ELSE length(text) // 4 END)::BIGINT AS chars, avg(CASE role WHEN 'system' THEN 0 ELSE length(text) // 4 END) AS avg_chars, avg(CASE WHEN length(text) > 350 THEN 1.0 ELSE 0 END) AS landscape,
            avg(CASE role WHEN 'user' THEN 1.0 ELSE 0 END) AS images, max(total) AS total, bool_or(contains('deck ' || role, 'deck u')) AS kw FROM s GROUP BY 1)
    SELECT conv_id, CASE WHEN chars < 40 AND (images > 0.4 OR total <= 3) THEN 'SCANNED' WHEN landscape >= 0.5 THEN 'SLIDE_VISUAL'
      WHEN kw AND FALSE THEN 'SLIDE_VISUAL' WHEN images >= 0.4 AND avg_chars < 350 THEN 'SLIDE_VISUAL' ELSE 'DIGITAL_BOOK' END AS profile FROM a""")
def _(spark, d):
    pages = load(spark, d, "conversations").select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page_no"), F.lit("report.pdf").alias("file_name"),
        F.when(F.length("text") > 350, 1600.0).otherwise(600.0).alias("width"), F.lit(800.0).alias("height"),
        F.when(F.col("role") == "system", F.lit(0)).otherwise(F.floor(F.length("text") / 4)).alias("text_chars"),
        (F.col("role") == "user").alias("has_image"),
    )
    out = ag.profile_documents(ag.sample_pages(pages))
    return out.select(F.col("document_id").alias("conv_id"), "profile")


@query("win6_page_sample", """
    WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM p WHERE i % greatest(1, n // 15) = 0 AND i // greatest(1, n // 15) < 15""")
def _(spark, d):
    # ids order a source's documents, with gaps
    docs = load(spark, d, "documents")
    pages = docs.select("doc_id", F.col("source").alias("document_id"), F.col("doc_id").alias("page_no"))
    return ag.sample_pages(pages).select(F.col("document_id").alias("source"), "doc_id")


@query("agg16_outcome_rollup", """
    SELECT event_type, count(*) AS runs, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS completed_share, round(avg(floor(value * 10)), 4) AS avg_duration_ms, max(floor(value * 10))::BIGINT AS max_duration_ms FROM events GROUP BY 1""")
def _(spark, d):
    t = load(spark, d, "events").select(
        "event_type", F.when(F.col("value") > 50, "completed").otherwise("failed").alias("status"), F.floor(F.col("value") * 10).alias("duration_ms")
    )
    return ag.outcome_rollup(t, ["event_type"]).withColumns({
        "completed_share": F.round("completed_share", 6), "avg_duration_ms": F.round("avg_duration_ms", 4)
    })


@query("agg16_run_quantiles", """
    WITH r AS (SELECT user_id, min(ts) AS started FROM events GROUP BY 1),
    f AS (SELECT e.user_id, min(e.ts) AS first FROM events e WHERE event_type = 'view' GROUP BY 1),
    t AS (SELECT e.event_type, e.value, floor(e.value * 10) AS ms, greatest(0, coalesce(floor((epoch_us(f.first) - epoch_us(r.started)) / 1000), 0))::BIGINT AS fd FROM events e JOIN r USING (user_id) LEFT JOIN f USING (user_id))
    SELECT event_type, count(*) AS runs, count(*) FILTER (fd > 0) AS answered, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS completed_share,
      round(quantile_cont(ms, 0.5), 4) AS duration_p50, round(quantile_cont(ms, 0.95), 4) AS duration_p95, round(quantile_cont(ms, 0.99), 4) AS duration_p99,
      round(quantile_cont(CASE WHEN fd > 0 THEN fd END, 0.5), 4)::DOUBLE AS first_delta_p50, round(quantile_cont(CASE WHEN fd > 0 THEN fd END, 0.95), 4)::DOUBLE AS first_delta_p95, round(quantile_cont(CASE WHEN fd > 0 THEN fd END, 0.99), 4)::DOUBLE AS first_delta_p99
    FROM t GROUP BY 1""")
def _(spark, d):
    # a run is an event; it starts with its user's first event and its deltas are the user's views
    e = load(spark, d, "events")
    starts = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at"))
    deltas = e.filter("event_type = 'view'").select(F.col("user_id").alias("run_id"), "ts")
    timed = ag.first_deltas(starts, deltas).select(F.col("run_id").alias("user_id"), "first_delta_ms")
    runs = e.join(timed, "user_id").select(
        "event_type", F.when(F.col("value") > 50, "completed").otherwise("failed").alias("status"),
        F.floor(F.col("value") * 10).alias("duration_ms"), "first_delta_ms",
    )
    out = ag.run_quantiles(runs, ["event_type"])
    exact = [c for c in out.columns if "_p" in c]
    return out.withColumns({c: F.round(c, 4) for c in exact} | {"completed_share": F.round("completed_share", 6)})


@query("agg16_sketched_quantiles", """
    SELECT event_type, count(*) AS n, true AS near FROM events GROUP BY 1""")
def _(spark, d):
    # hourly sketches, merged: the share of runs at or under each quantile is within 2 % of what was asked
    runs = _utc(load(spark, d, "events"))
    found = ag.sketch_quantiles(ag.quantile_sketches(runs, ["event_type"], "value"), ["event_type"])
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    held = runs.join(found.select("event_type", *shares), "event_type").groupBy("event_type").agg(
        *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(p) for p in shares]
    )
    near = reduce(lambda a, b: a & b, [F.abs(F.col(p) - q) <= 0.02 for p, q in shares.items()])
    return found.select("event_type", "n").join(held.select("event_type", near.alias("near")), "event_type")


@query("agg16_feedback_tags", """
    WITH f AS (SELECT event_type, value > 20 AS ok, CASE WHEN value > 60 THEN NULL ELSE 'tag' || user_id % 3 || ', ' || CASE WHEN user_id % 2 = 0 THEN 'slow' ELSE 'tag' || user_id % 3 END END AS tags, CASE WHEN user_id % 5 = 0 THEN 'text' ELSE ' ' END AS c FROM events),
    t AS (SELECT event_type, tag, count(*) AS n FROM (SELECT event_type, unnest(list_distinct(list_transform(string_split(tags, ','), lambda x: trim(x)))) AS tag FROM f) GROUP BY 1, 2)
    SELECT event_type, (SELECT count(*) FROM f x WHERE x.event_type = t.event_type) AS votes, (SELECT round(avg(ok::INT), 6) FROM f x WHERE x.event_type = t.event_type) AS positive_share,
      (SELECT count(*) FILTER (trim(c) <> '') FROM f x WHERE x.event_type = t.event_type) AS comments, string_agg(tag || '=' || n, ',' ORDER BY tag) AS tags FROM t GROUP BY 1""")
def _(spark, d):
    u = F.col("user_id")
    tag = F.concat(F.lit("tag"), u % 3)
    t = load(spark, d, "events").select(
        "event_type", (F.col("value") > 20).alias("is_positive"),
        F.when(~(F.col("value") > 60), F.concat(tag, F.lit(", "), F.when(u % 2 == 0, "slow").otherwise(tag))).alias("reason_tags"),
        F.when(u % 5 == 0, "text").otherwise(" ").alias("comment"),
    )
    out = ag.feedback_rollup(t, ["event_type"])
    line = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("event_type", "votes", F.round("positive_share", 6).alias("positive_share"), "comments", line.alias("tags"))


@query("agg16_feedback", """
    SELECT source, count(*) AS votes, round(avg(quality), 6) AS positive_share FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def _(spark, d):
    t = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return t.groupBy("source").agg(F.count("*").alias("votes"), F.round(F.avg("quality"), 6).alias("positive_share"))


@query("win3_chat_context", """
    WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM
        (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 30),
    w AS (SELECT conv_id, 0::BIGINT AS i, 100::BIGINT AS used, NULL::BIGINT AS turn, FALSE AS kept FROM r WHERE i = 1
      UNION ALL SELECT r.conv_id, r.i, w.used + CASE WHEN w.used + r.n <= 1500 THEN r.n ELSE 0 END, r.turn, w.used + r.n <= 1500 FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1)
    SELECT conv_id, turn FROM w WHERE kept""")
def _(spark, d):
    m = load(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )
    return wn.context(m, F.lit(100), budget=1500).select(F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"))


@query("win4_stop_states", """
    WITH t AS (SELECT conv_id, turn + 1 AS tn, CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END AS rc, CASE role WHEN 'system' THEN 0 ELSE 2 END AS calls, length(text) % 11 AS ev,
        (length(text) % 50) / 100.0::DOUBLE AS rs, (length(text) % 100) / 100.0::DOUBLE AS cov, (length(text) % 7) / 7.0::DOUBLE AS conf FROM conversations),
    a AS (SELECT *, tn > 1 AND cov <= coalesce(lag(cov) OVER w, 0) AS stuck, count(*) FILTER (calls > 0 AND ev > 0 AND rs < 0.25) OVER w AS low,
        count(*) FILTER (rc <> 0) OVER (PARTITION BY conv_id ORDER BY tn ROWS 2 PRECEDING) AS f3 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY tn)),
    b AS (SELECT *, count(*) FILTER (tn > 1 AND NOT stuck) OVER (PARTITION BY conv_id ORDER BY tn) AS run FROM a),
    c AS (SELECT *, count(*) FILTER (stuck) OVER (PARTITION BY conv_id, run ORDER BY tn) AS stagnation FROM b)
    SELECT conv_id, tn AS turn_number, stagnation, low AS low_retrieval, CASE WHEN stagnation >= 3 THEN 'stagnated' WHEN f3 >= 3 THEN 'repeated_tool_failures'
      WHEN calls > 0 AND (ev = 0 OR (rs < 0.25 AND low >= 2)) THEN 'insufficient_evidence' WHEN cov >= 0.9 AND conf >= 0.8 THEN 'completed'
      WHEN tn >= 6 THEN 'insufficient_evidence' END AS stop_reason FROM c""")
def _(spark, d):
    n = F.length("text")
    t = load(spark, d, "conversations").select(
        F.col("conv_id").alias("task_id"), (F.col("turn") + 1).alias("turn_number"), F.when(n % 3 == 0, 1).otherwise(0).alias("returncode"),
        F.when(F.col("role") == "system", 0).otherwise(2).alias("sdk_calls"), (n % 11).alias("evidence_count"),
        ((n % 50) / 100).alias("retrieval_score"), ((n % 100) / 100).alias("coverage"), ((n % 7) / 7).alias("confidence"),
    )
    return wn.stop_states(t, 6).select(
        F.col("task_id").alias("conv_id"), "turn_number", "stagnation", "low_retrieval", "stop_reason"
    )


@query("win5_page_numbers", """
    SELECT conv_id, turn, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS page_number
    FROM (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN turn + 2 WHEN role = 'system' THEN 40 + turn END AS p FROM conversations)""")
def _(spark, d):
    marked = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat("text", F.lit(" <!-- page: "), F.col("turn") + 2, F.lit("-99 -->")))
    marked = marked.when(F.col("role") == "system", F.concat(F.lit("## PAGE "), 40 + F.col("turn"), F.lit(" "), "text")).otherwise(F.col("text"))
    t = load(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), marked.alias("content"))
    return wn.page_numbers(t).select(F.col("document_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "page_number")
