"""Joins and first-wins set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, joins
from ..streaming.events import latest_state
from .base import load, query, spread


@query("joi1_child_counts", """
    SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') AS document_count,
      (SELECT count(*) FROM events WHERE user_id = c_custkey) AS session_count FROM customer""")
def _(spark, d):
    docs = load(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "P").alias("is_deleted")
    )
    sessions = load(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    children = {"document_count": docs, "session_count": sessions}
    return joins.with_child_counts(load(spark, d, "customer").select("c_custkey"), "c_custkey", children)


@query("joi3_semi_join_ids", """
    SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(spark, d):
    ids = load(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    rows = load(spark, d, "orders").withColumn("is_deleted", F.col("o_orderstatus") == "P")
    return joins.by_ids(rows, ids, "o_custkey").select("o_orderkey")


@query("joi4_orphan_vectors", """
    SELECT doc_id FROM documents WHERE lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    points = load(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("doc_id")).alias("redis_key"))
    entries = load(spark, d, "labels").select(F.col("doc_id").alias("redis_key"))
    return joins.orphans(points, entries).select("doc_id")


@query("joi5_insert_if_absent", """
    WITH rows AS (SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) WHERE rn = 1),
    target AS (SELECT conv_id, role, turn FROM conversations WHERE turn = 0)
    SELECT * FROM target UNION ALL SELECT * FROM rows r WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.conv_id = r.conv_id AND t.role = r.role)""")
def _(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "role", "turn")
    return dedup.insert_if_absent(rows.filter("turn = 0"), rows, ["conv_id", "role"], ["turn"])


@query("joi7_preview", """
    SELECT document_id, length(p) AS n, sha256(p) AS h FROM (SELECT d.doc_id AS document_id, CASE WHEN lang <> 'de' THEN text ELSE
      coalesce((SELECT string_agg(c, chr(10) || chr(10) ORDER BY i) FROM (SELECT unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i) WHERE c <> ''), '') END AS p FROM documents d)""")
def _(spark, d):
    t = load(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    chunks = t.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    docs = t.select("document_id", F.when(F.col("lang") != "de", F.col("text")).alias("markdown_content"))
    out = joins.preview(docs, chunks)
    return out.select("document_id", F.length("preview").alias("n"), F.sha2("preview", 256).alias("h"))


_MESSAGES = """
    SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, CASE WHEN turn = 0 THEN NULL
      WHEN role = 'assistant' AND turn > 4 THEN (conv_id + 1) * 1000 + turn - 1 ELSE conv_id * 1000 + turn - 1 END AS parent_id FROM conversations"""


@query("joi8_parent_check", f"""
    WITH m AS ({_MESSAGES}) SELECT message_id, parent_id IS NULL OR EXISTS (SELECT 1 FROM m p WHERE p.message_id = m.parent_id AND p.session_id = m.session_id) AS parent_ok FROM m""")
def _(spark, d):
    own, other = F.col("conv_id") * 1000 + F.col("turn") - 1, (F.col("conv_id") + 1) * 1000 + F.col("turn") - 1
    t = load(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.when(F.col("turn") == 0, None).when((F.col("role") == "assistant") & (F.col("turn") > 4), other).otherwise(own).alias("parent_id"),
    )
    return joins.check_parents(t).select("message_id", "parent_ok")


@query("joi9_status_snapshot", """
    WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS stage, floor(value / 20)::BIGINT AS units FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
    SELECT c_custkey, coalesce(nullif(stage, ''), c_mktsegment) AS stage_label, coalesce(nullif(units, 0), c_nationkey) AS processed_units
    FROM customer LEFT JOIN s ON user_id = c_custkey""")
def _(spark, d):
    tasks = load(spark, d, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("stage_label"), F.col("c_nationkey").cast("long").alias("processed_units")
    )
    last = latest_state(load(spark, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey", "event_id", "ts")
    snaps = last.select(
        "c_custkey", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("stage_label"),
        F.floor(F.col("value") / 20).alias("processed_units"),
    )
    return joins.merge_snapshots(tasks, snaps, "c_custkey", ["stage_label", "processed_units"])


@query("set1_dedupe_first", """
    SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM
      (SELECT doc_id, source, CASE lang WHEN 'es' THEN NULL ELSE text END AS k FROM documents)) WHERE rn = 1""")
def _(spark, d):
    t = load(spark, d, "documents").select("doc_id", "source", F.when(F.col("lang") != "es", F.sha2("text", 256)).alias("k"))
    return dedup.dedupe(t, "k", ["doc_id"]).select("doc_id", "source")


@query("set2_unique_rows", """
    SELECT min(doc_id) AS pos, lang, source FROM documents GROUP BY lang, source""")
def _(spark, d):
    t = load(spark, d, "documents").select(F.col("doc_id").alias("pos"), "lang", "source")
    return dedup.unique(t, ["pos"])


@query("set5_classify_documents", """
    WITH i AS (SELECT doc_id, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS project_id, sha256(text) AS h FROM documents),
    e AS (SELECT h, project_id, min_by(k, doc_id) AS stored, min(doc_id) AS id FROM (SELECT i.*, CASE WHEN quality = 1 AND toxic = 0 THEN 'ready' WHEN toxic = 1 THEN 'deleted' ELSE 'failed' END AS k
          FROM i JOIN labels USING (doc_id)) GROUP BY 1, 2),
    f AS (SELECT h, project_id, min(doc_id) AS first_id FROM i GROUP BY 1, 2)
    SELECT doc_id, coalesce(e.id, first_id) AS stored_id, CASE WHEN stored = 'ready' THEN 'cached' WHEN doc_id <> first_id THEN 'reingest'
        WHEN stored IS NULL THEN 'create' WHEN stored = 'deleted' THEN 'reactivate' ELSE 'reingest' END AS action,
      stored IS DISTINCT FROM 'ready' AS is_new
    FROM i JOIN f USING (h, project_id) LEFT JOIN e USING (h, project_id)""")
def _(spark, d):
    t = load(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.length("text") > 500, "long").otherwise("short").alias("project_id"),
        F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("arrived"),
    )
    lab = load(spark, d, "labels").withColumnRenamed("doc_id", "document_id")
    stored = dedup.dedupe(t.join(lab, "document_id"), ["project_id", "content_hash"], ["document_id"]).select(
        "document_id", "project_id", "content_hash", (F.col("toxic") == 1).alias("is_deleted"),
        F.when((F.col("quality") == 1), "ready").otherwise("failed").alias("status"), F.lit(3).alias("chunk_count"),
    )
    out = dedup.classify_documents(t, stored)
    return out.select(F.col("document_id").alias("doc_id"), "stored_id", "action", "is_new")


_LINES = """SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents"""


def lines(spark, d):
    t = spread(load(spark, d, "documents"), "doc_id")
    return t.select(F.col("doc_id").alias("document_id"), "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


@query("set6_dedup_chunks", f"""
    WITH c AS ({_LINES}), o AS (SELECT c, arg_min(doc_id, (doc_id, i)) AS owner FROM c GROUP BY c)
    SELECT doc_id, i AS chunk_index, owner AS owner_document_id, owner = doc_id AS is_new FROM c JOIN o USING (c)""")
def _(spark, d):
    chunks = lines(spark, d).withColumn("chunk_hash", F.sha2("content", 256)).drop("content")
    return dedup.dedup_chunks(chunks).select(
        F.col("document_id").alias("doc_id"), "chunk_index", "owner_document_id", "is_new"
    )


@query("set6_dedup_chunks_existing", f"""
    WITH c AS ({_LINES}), s AS (SELECT c, min(doc_id) AS st FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY c),
    o AS (SELECT c, arg_min(doc_id, (doc_id, i)) AS owner FROM c GROUP BY c)
    SELECT doc_id, count(*) AS chunks, count(*) FILTER (coalesce(st, owner) = doc_id) AS new_chunks FROM c JOIN o USING (c) LEFT JOIN s USING (c) GROUP BY 1""")
def _(spark, d):
    chunks = lines(spark, d).withColumn("chunk_hash", F.sha2("content", 256)).drop("content")
    low = load(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("document_id"))
    stored = chunks.join(low, "document_id", "left_semi").groupBy("chunk_hash").agg(F.min("document_id").alias("document_id"))
    return dedup.dedup_chunks(chunks, stored).groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count("*").alias("chunks"), F.count_if("is_new").alias("new_chunks")
    )


@query("set7_multi_hop_union", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END, event_id) AS rn
      FROM events) WHERE rn = 1""")
def _(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", "event_type")
    hops = [e.filter(F.col("event_type") == t) for t in ("purchase", "click", "view", "signup")]
    hops.append(e.filter(~F.col("event_type").isin("purchase", "click", "view", "signup") | F.col("event_type").isNull()))
    return dedup.union_first_wins(hops, "user_id", ["event_id"])
