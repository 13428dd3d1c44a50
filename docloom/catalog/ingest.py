"""Quality gate, ingestion stages, upkeep and extraction."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.embedding import HashingEmbedder
from ..functions.text import infer_vendor, is_advisory
from ..operators import aggregates as ag, dedup
from ..operators.vectors import fan_queries
from ..plans import composed as cp, extract as ex, ingest as ing, quality as ql, registry, upkeep as up
from ..session import run_dir
from .base import load, query, spread, sql_strip, sql_vectors, sql_words
from .joins import lines


def sql_quality(source: str, keys: str) -> str:
    """SELECT with all quality columns; source has text, pages, file_size, profile."""
    base = f"""(SELECT *, length(c) AS total_chars, length(c) - length(regexp_replace(c, '[^{fv.VALID_CHARS}]+', '', 'g')) AS bad, length(c) - length(replace(c, chr(65533), '')) AS repl
      FROM (SELECT *, {sql_strip("coalesce(text, '')")} AS c FROM ({source})))"""
    ratio = f"""(SELECT *, total_chars / greatest(1, pages)::DOUBLE AS density, CASE WHEN total_chars = 0 THEN 0 ELSE (total_chars - bad) / total_chars::DOUBLE END AS valid,
      repl / greatest(1, total_chars)::DOUBLE AS rr, file_size >= 3145728 AND total_chars < 300 AS heavy FROM {base})"""
    act = f"""(SELECT *, CASE WHEN total_chars = 0 THEN CASE profile WHEN 'DIGITAL_BOOK' THEN 'ESCALATE_TO_SLIDE_OCR' WHEN 'SLIDE_VISUAL' THEN 'ESCALATE_TO_FULL_OCR' WHEN 'SCANNED' THEN 'FALLBACK_PYPDF' ELSE 'REJECT' END
        WHEN valid < 0.65 OR rr > 0.10 THEN 'FALLBACK_PYPDF'
        WHEN heavy THEN CASE profile WHEN 'DIGITAL_BOOK' THEN 'ESCALATE_TO_SLIDE_OCR' WHEN 'SLIDE_VISUAL' THEN 'ESCALATE_TO_FULL_OCR' ELSE 'NONE' END
        WHEN profile = 'DIGITAL_BOOK' AND density < 100 THEN 'ESCALATE_TO_SLIDE_OCR' WHEN profile = 'SLIDE_VISUAL' AND density < 25 AND total_chars < 150 THEN 'ESCALATE_TO_FULL_OCR' ELSE 'NONE' END AS action,
      CASE WHEN total_chars = 0 THEN 0 ELSE 0.5::DOUBLE * valid * (1 - least(1, 5 * rr)) + 0.5::DOUBLE * least(1, density / CASE profile WHEN 'DIGITAL_BOOK' THEN 150 ELSE 60 END) END AS score,
      CASE WHEN total_chars = 0 THEN 'empty_text' ELSE concat_ws(',', CASE WHEN rr > 0.03 THEN 'font_encoding_errors' END, CASE WHEN valid < 0.75 THEN 'low_valid_char_ratio' END, CASE WHEN heavy THEN 'large_file_little_text' END,
        CASE WHEN density < CASE profile WHEN 'DIGITAL_BOOK' THEN 120 WHEN 'SLIDE_VISUAL' THEN 30 WHEN 'SCANNED' THEN 40 ELSE -1 END THEN 'low_text_density' END) END AS warnings FROM {ratio})"""
    return f"""SELECT {keys}, total_chars, density, valid, rr, score, action, warnings,
      round(score, 2) >= 0.40 AND valid >= 0.70 AND total_chars >= 40 AND action = 'NONE' AS ok FROM {act}"""


_GATED = """SELECT v.doc_id, v.text,
    1 + n_chars // 80 AS pages, n_chars * 3000 AS file_size, CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 'SLIDE_VISUAL' WHEN source IN ('src6', 'src7', 'src8') THEN 'SCANNED' WHEN source = 'src9' THEN 'TEXT' ELSE 'DIGITAL_BOOK' END AS profile FROM documents d, LATERAL (
      SELECT d.doc_id, CASE WHEN lang = 'de' THEN repeat(chr(65533), 1 + n_chars::INT // 8) || d.text ELSE d.text END AS text
      UNION ALL SELECT -1 - d.doc_id, CASE WHEN lang = 'es' THEN '  ' ELSE 'A few words on ' || lang END WHERE lang IN ('es', 'fr')) v"""


def _gated(spark, d):
    lang, n = F.col("lang"), F.col("n_chars")
    text = (
        F.when(lang == "de", F.concat(F.repeat(F.lit("�"), (1 + F.floor(n / 8)).cast("int")), "text"))
        .otherwise(F.col("text"))
    )
    # beside each whole text of two languages a second row that is blank or short
    whole = F.struct("doc_id", text.alias("text"))
    extra = F.struct((-1 - F.col("doc_id")).alias("doc_id"), F.when(lang == "es", "  ").otherwise(F.concat(F.lit("A few words on "), lang)).alias("text"))
    rows = F.filter(F.array(whole, F.when(lang.isin("es", "fr"), extra)), lambda r: r.isNotNull())
    src = F.col("source")
    profile = (
        F.when(src.isin("src1", "src2", "src3", "src4", "src5"), "SLIDE_VISUAL").when(src.isin("src6", "src7", "src8"), "SCANNED")
        .when(src == "src9", "TEXT").otherwise("DIGITAL_BOOK")
    )
    return spread(load(spark, d, "documents"), "doc_id").select(
        F.inline(rows), (1 + F.floor(n / 80)).alias("pages"), (n * 3000).alias("file_size"), profile.alias("profile")
    )


@query("pip1_quality_gate", f"""
    SELECT doc_id, total_chars, round(density, 6) AS text_density, round(valid, 6) AS valid_char_ratio, round(rr, 6) AS replacement_ratio,
      round(score, 6)::DOUBLE AS quality_score, action, warnings, ok AS is_acceptable FROM ({sql_quality(_GATED, 'doc_id')})""")
def _(spark, d):
    t = ql.quality(_gated(spark, d))
    return t.select(
        "doc_id", "total_chars", *[F.round(c, 6).alias(c) for c in ("text_density", "valid_char_ratio", "replacement_ratio", "quality_score")],
        "action", F.array_join("warnings", ",").alias("warnings"), "is_acceptable",
    )


#: Each document with its whole text in all four extractions, and beside two languages a second row whose extractions fail.
_CANDIDATES = """SELECT v.doc_id, v.profile, 1 + n_chars // 60 AS pages, 0 AS file_size, CASE WHEN lang = 'es' THEN 'SLIDE_VISUAL' ELSE 'DIGITAL_BOOK' END AS start_profile, v.text FROM documents d, LATERAL (
    SELECT d.doc_id, p.profile, CASE p.profile WHEN 'DIGITAL_BOOK' THEN CASE lang WHEN 'de' THEN repeat(chr(65533), n_chars::INT) || d.text ELSE d.text END
      WHEN 'RAW' THEN d.text || d.text || d.text ELSE d.text END AS text FROM (VALUES ('DIGITAL_BOOK'), ('SLIDE_VISUAL'), ('SCANNED'), ('RAW')) p(profile)
    UNION ALL SELECT -1 - d.doc_id, p.profile, CASE p.profile WHEN 'DIGITAL_BOOK' THEN '' WHEN 'SLIDE_VISUAL' THEN CASE WHEN n_chars > 2000 THEN 'A few words' ELSE '' END
      WHEN 'SCANNED' THEN CASE lang WHEN 'fr' THEN d.text ELSE repeat(chr(65533), 90) END ELSE 'raw ' || d.text END FROM (VALUES ('DIGITAL_BOOK'), ('SLIDE_VISUAL'), ('SCANNED'), ('RAW')) p(profile) WHERE lang IN ('es', 'fr')) v"""


@query("pip2_choose_extraction", f"""
    WITH g AS MATERIALIZED ({sql_quality(_CANDIDATES, 'doc_id, start_profile, profile, text')}),
    a AS (SELECT g.*, start_profile AS p1, CASE WHEN ok THEN profile WHEN action = 'ESCALATE_TO_SLIDE_OCR' AND profile <> 'SLIDE_VISUAL' THEN 'SLIDE_VISUAL'
          WHEN action = 'ESCALATE_TO_FULL_OCR' AND profile <> 'SCANNED' THEN 'SCANNED' ELSE profile END AS nxt FROM g),
    s1 AS (SELECT doc_id, p1, nxt AS p2 FROM a WHERE profile = p1),
    s2 AS (SELECT s1.*, nxt AS p3 FROM s1 JOIN a ON a.doc_id = s1.doc_id AND a.profile = p2),
    s3 AS (SELECT s2.*, a.text AS t, a.ok, a.action, r.text AS raw, r.ok AS rok FROM s2 JOIN a ON a.doc_id = s2.doc_id AND a.profile = p3 JOIN a r ON r.doc_id = s2.doc_id AND r.profile = 'RAW'),
    s4 AS (SELECT *, NOT ok AND action = 'FALLBACK_PYPDF' AND length({sql_strip('raw')}) > length(t) AS use_raw FROM s3)
    SELECT doc_id, CASE WHEN use_raw THEN 'RAW' ELSE p3 END AS profile, sha256(CASE WHEN use_raw THEN raw ELSE t END) AS text_hash,
      1 + (p2 <> p1)::INT + (p3 <> p2)::INT AS attempts, CASE WHEN use_raw THEN rok ELSE ok END AS accepted FROM s4""")
def _(spark, d):
    lang, n, text, none = F.col("lang"), F.col("n_chars"), F.col("text"), F.lit("")
    broken = F.concat(F.repeat(F.lit("�"), n.cast("int")), text)
    own, extra = F.col("doc_id"), -1 - F.col("doc_id")
    rows = [
        (own, ql.BOOK, F.when(lang == "de", broken).otherwise(text)), (own, ql.SLIDE, text), (own, ql.SCAN, text),
        (own, "RAW", F.concat(text, text, text)), (extra, ql.BOOK, none), (extra, ql.SLIDE, F.when(n > 2000, "A few words").otherwise(none)),
        (extra, ql.SCAN, F.when(lang == "fr", text).otherwise(F.repeat(F.lit("�"), 90))), (extra, "RAW", F.concat(F.lit("raw "), text)),
    ]
    made = [F.struct(i.alias("document_id"), F.lit(p).alias("profile"), x.alias("text")) for i, p, x in rows]
    made[4:] = [F.when(lang.isin("es", "fr"), m) for m in made[4:]]
    t = spread(load(spark, d, "documents"), "doc_id").select(
        (1 + F.floor(n / 60)).alias("pages"), F.lit(0).alias("file_size"), F.when(lang == "es", ql.SLIDE).otherwise(ql.BOOK).alias("start_profile"),
        F.inline(F.filter(F.array(*made), lambda r: r.isNotNull())),
    )
    return ql.choose_extraction(t).select(
        F.col("document_id").alias("doc_id"), "profile", F.sha2("text", 256).alias("text_hash"), "attempts", "accepted"
    )


_REPORT_DOCS = f"""SELECT source AS project_id, doc_id, t AS text, 1 AS pages, octet_length(encode(text)) AS file_size, 'TEXT' AS profile FROM
    (SELECT *, {sql_strip("regexp_replace(regexp_replace(replace(text, chr(0), ''), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM documents)"""


@query("ingest_report", f"""
    WITH g AS MATERIALIZED ({sql_quality(_REPORT_DOCS, 'project_id, doc_id, text')}),
    c AS (SELECT project_id, substr(text, 512 * i + 1, 512) AS c FROM g, LATERAL (SELECT unnest(range(0, ceil(length(text) / 512)::BIGINT)) AS i) WHERE ok),
    k AS (SELECT project_id, count(*) AS chunks, count(DISTINCT c) AS distinct_chunks, sum(greatest(1, len({sql_words('c')})))::BIGINT AS tokens FROM c GROUP BY 1),
    n AS (SELECT project_id, count(*) AS documents, count(*) FILTER (ok) AS accepted, round(avg(score), 4) AS avg_score FROM g GROUP BY 1)
    SELECT project_id, documents, accepted, avg_score, coalesce(chunks, 0) AS chunks, coalesce(distinct_chunks, 0) AS distinct_chunks, coalesce(tokens, 0) AS tokens,
      round(coalesce(1 - distinct_chunks / chunks::DOUBLE, 0), 6) AS dedup_ratio FROM n LEFT JOIN k USING (project_id)""")
def _(spark, d):
    docs = spread(load(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), "text", F.octet_length("text").alias("file_size")
    )
    return ing.ingest_report(docs)


_CHUNKS = """SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents"""


def _staged(spark, d):
    chunks = lines(spark, d).withColumn("chunk_hash", F.sha2("content", 256))
    docs = load(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), "text", F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("file_name")
    )
    return chunks, docs


@query("joi6_str16_enrich", f"""
    SELECT doc_id AS document_id, i AS chunk_index, sha256('# Document: doc_' || doc_id || '.md' || chr(10) || chr(10) || '## Summary' || chr(10) || 'Document with ' || n || ' characters (LiteLLM Proxy not configured)'
      || chr(10) || chr(10) || '## Content' || chr(10) || c) AS h FROM ({_CHUNKS}) JOIN (SELECT doc_id, length(text) AS n FROM documents) USING (doc_id)""")
def _(spark, d):
    chunks, docs = _staged(spark, d)
    out = ing.enrich(chunks, docs)
    return out.select("document_id", "chunk_index", F.sha2("enriched_content", 256).alias("h"))


@query("pip3_dedup_enrich_link", f"""
    WITH c AS ({_CHUNKS}), o AS (SELECT c, arg_min(doc_id, (doc_id, i)) AS owner FROM c GROUP BY c)
    SELECT doc_id AS document_id, count(*) AS chunks, count(DISTINCT c) AS links, count(DISTINCT CASE WHEN owner = doc_id THEN c END) AS new_chunks FROM c JOIN o USING (c) GROUP BY 1""")
def _(spark, d):
    chunks, docs = _staged(spark, d)
    owned = dedup.dedup_chunks(chunks)
    no_links = spark.createDataFrame([], "document_id long, chunk_id string")
    links = ing.link(owned, no_links).groupBy("document_id").agg(F.count("*").alias("links"))
    counts = owned.groupBy("document_id").agg(F.count("*").alias("chunks"))
    fresh = ing.enrich(dedup.dedupe(owned.filter("is_new"), "chunk_hash", ["chunk_index"]), docs)
    fresh = fresh.groupBy("document_id").agg(F.count("enriched_content").alias("new_chunks"))
    return counts.join(links, "document_id").join(fresh, "document_id", "left").fillna(0, ["new_chunks"])


#: Per project the first document of a text is stored; its slices belong to the first document that has them.
COMPOSED = f"""
    WITH t AS (SELECT *, min(doc_id) OVER (PARTITION BY project_id, raw) AS stored FROM
        (SELECT r.*, d.text AS raw FROM ({_REPORT_DOCS}) r JOIN documents d USING (doc_id))),
    g AS MATERIALIZED ({sql_quality("SELECT * FROM t WHERE doc_id = stored", 'project_id, doc_id, text')}),
    c AS (SELECT doc_id, i, substr(text, 512 * i + 1, 512) AS c FROM g, LATERAL (SELECT unnest(range(0, ceil(length(text) / 512)::BIGINT)) AS i) WHERE ok),
    o AS (SELECT c, arg_min(doc_id, (doc_id, i)) AS owner FROM c GROUP BY c),
    f AS (SELECT c, owner, length('# Document: doc_' || owner || '.md' || 'xx## Summaryx' || 'Document with ' || length(g.text) || ' characters (LiteLLM Proxy not configured)' || 'xx## Contentx' || c) % 41 = 5 AS fails
        FROM o JOIN g ON g.doc_id = owner),
    n AS (SELECT doc_id, count(*) AS expected, count(*) FILTER (NOT fails) AS embedded, count(*) FILTER (fails AND owner = doc_id) AS failed FROM (SELECT DISTINCT doc_id, c FROM c) JOIN f USING (c) GROUP BY 1)
    SELECT t.doc_id AS document_id, t.project_id, stored AS stored_id, coalesce(expected, 0) AS expected, coalesce(expected, 0) AS links, coalesce(embedded, 0) AS embedded, coalesce(failed, 0) AS failed,
      CASE WHEN t.doc_id <> stored THEN 'CACHED' WHEN NOT ok THEN 'QUARANTINED' WHEN failed > 0 AND failed / expected::DOUBLE >= 0.05 THEN 'VIOLATED_FAILED_RATIO' WHEN failed > 0 THEN 'PARTIALLY_AVAILABLE' ELSE 'READY' END AS outcome
    FROM t LEFT JOIN g ON g.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id"""


def refusing_embedder(texts: list[str]):
    """The default embedder, but texts of certain lengths are refused."""
    if any(len(t) % 41 == 5 for t in texts):
        raise ValueError("refused")
    return HashingEmbedder()(texts)


def intake_rows(docs):
    return docs.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("file_name"), "text", F.octet_length("text").alias("file_size"),
    )


@query("pip3_composed_ingestion", COMPOSED)
def _(spark, d):
    out = cp.ingest_batch(intake_rows(load(spark, d, "documents")), run_dir(spark), fn=refusing_embedder)
    return out.select("document_id", "project_id", "stored_id", "expected", "links", "embedded", "failed", "outcome")


@query("pip4_reconcile", """
    SELECT o_orderkey, expected, links, round(failed / greatest(1, expected)::DOUBLE, 4) AS failed_ratio, links = expected AND failed = 0 AS matched,
      CASE WHEN expected > 0 AND links < floor(expected * 0.90::DOUBLE) THEN 'VIOLATED_LINKS' WHEN failed / greatest(1, expected)::DOUBLE >= 0.05 AND failed > 0 THEN 'VIOLATED_FAILED_RATIO'
        WHEN failed > 0 THEN 'PARTIALLY_AVAILABLE' ELSE 'READY' END AS outcome
    FROM (SELECT o_orderkey, CASE WHEN e > 0 THEN e ELSE n + x END AS expected, CASE WHEN l > 0 THEN l ELSE n + x END AS links, failed FROM
      (SELECT o_orderkey, o_custkey % 200 AS e, greatest(0, o_custkey % 200 - o_orderkey % 15) AS l, o_custkey % 90 AS n, o_custkey % 60 AS x, CASE o_orderstatus WHEN 'F' THEN o_orderkey % 9 ELSE 0 END AS failed FROM orders))""")
def _(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    t = load(spark, d, "orders").select(
        "o_orderkey", (c % 200).alias("expected"), F.greatest(F.lit(0), c % 200 - o % 15).alias("links"), (c % 200).alias("embedded"),
        (c % 90).alias("new_ids"), (c % 60).alias("existing_ids"), F.when(F.col("o_orderstatus") == "F", o % 9).otherwise(0).alias("failed"),
    )
    return ing.reconcile_counts(t).select("o_orderkey", "expected", "links", "failed_ratio", "matched", "outcome")


@query("pip4_reconcile_tables", f"""
    WITH c AS ({_CHUNKS}), o AS (SELECT c, arg_min(doc_id, (doc_id, i)) AS owner FROM c GROUP BY c), p AS (SELECT DISTINCT doc_id, c, owner FROM c JOIN o USING (c)),
    n AS (SELECT doc_id, count(*) AS expected, count(*) FILTER (owner = doc_id AND length(c) % 50 = 7) AS failed FROM p GROUP BY 1)
    SELECT doc_id AS document_id, expected, expected AS links, failed, CASE WHEN failed / expected::DOUBLE >= 0.05 AND failed > 0 THEN 'VIOLATED_FAILED_RATIO' WHEN failed > 0 THEN 'PARTIALLY_AVAILABLE' ELSE 'READY' END AS outcome FROM n""")
def _(spark, d):
    chunks, _ = _staged(spark, d)
    owned = dedup.dedup_chunks(chunks)
    links = ing.link(owned, spark.createDataFrame([], "document_id long, chunk_id string"))
    # lines of certain lengths stand for chunks whose embedding failed
    status = chunks.select("chunk_hash", F.when(F.length("content") % 50 == 7, "failed").otherwise("completed").alias("embed_status")).distinct()
    return ing.reconcile(owned, links, status).select("document_id", "expected", "links", "failed", "outcome")


@query("pip5_failure_classes", """
    SELECT event_id, CASE WHEN e IS NULL AND p THEN 'partial_success' WHEN e IS NULL THEN 'completed' WHEN e = 'QuarantineException' THEN 'failed_permanent' WHEN e = 'ReconciliationError' OR r THEN 'failed_retryable' ELSE 'failed_permanent' END AS task_status,
      CASE WHEN e IS NULL AND p THEN 'partially_available' WHEN e IS NULL THEN 'ready' WHEN e = 'QuarantineException' THEN 'quarantined' WHEN e = 'ReconciliationError' OR r THEN 'processing' ELSE 'failed' END AS document_status
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'QuarantineException' WHEN 'click' THEN 'ReconciliationError' WHEN 'view' THEN 'ProviderError' END AS e, value > 20 AS r, value > 60 AS p FROM events)""")
def _(spark, d):
    e = F.col("event_type")
    cls = F.when(e == "error", "QuarantineException").when(e == "click", "ReconciliationError").when(e == "view", "ProviderError")
    t = load(spark, d, "events").select(
        "event_id", cls.alias("error_class"), (F.col("value") > 20).alias("is_retryable"), (F.col("value") > 60).alias("has_partial_failures")
    )
    return up.classify_failures(t).select("event_id", "task_status", "document_status")


@query("pip6_resume_pending", """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, d):
    done = load(spark, d, "labels").select(
        F.col("doc_id").alias("document_id"), F.lit("parse").alias("step"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("action")
    )
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return up.pending(docs, done, "parse").select(F.col("document_id").alias("doc_id"))


@query("pip7_retry_dead_letter", """
    SELECT task_id, n AS attempts, CASE WHEN n > 3 THEN 'dead_letter' ELSE 'retry' END AS route, CASE WHEN n <= 3 THEN least(3600, 60 * 2 ** (n - 1))::DOUBLE END AS delay_seconds
    FROM (SELECT user_id * 31 + day(ts) AS task_id, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1)""")
def _(spark, d):
    fails = load(spark, d, "events").filter("event_type IN ('error', 'view')").select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("task_id"))
    return up.retry_plan(fails)


@query("pip8_reindex", """
    SELECT doc_id AS document_id, CASE WHEN source = 'src4' AND lang <> 'de' THEN 'processing' ELSE 'ready' END AS status, CASE WHEN source = 'src4' AND lang <> 'de' THEN 1 ELSE 0 END AS tasks FROM documents""")
def _(spark, d):
    docs = load(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), (F.col("lang") == "de").alias("is_deleted"), F.lit("ready").alias("status")
    )
    tasks, updated = up.reindex(docs, F.col("project_id") == "src4", F.lit("2024-06-01").cast("timestamp"), F.lit(7))
    n = tasks.groupBy("document_id").agg(F.count("*").alias("tasks"))
    return updated.join(n, "document_id", "left").select("document_id", "status", F.coalesce("tasks", F.lit(0)).alias("tasks"))


@query("pip9_delete_cascade", f"""
    WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), c AS ({_CHUNKS})
    SELECT doc_id AS document_id, doc_id IN (FROM g) AS is_deleted, (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id AND c.doc_id NOT IN (FROM g)) AS live_chunks, CASE WHEN doc_id IN (FROM g) THEN 0 ELSE 1 END AS vectors FROM documents d""")
def _(spark, d):
    off = {"is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp")}
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id")).withColumns(off)
    chunks = lines(spark, d).select("document_id", "chunk_index").withColumns(off)
    keys = load(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    a, b, v = up.delete_cascade(docs, chunks, docs.select("document_id"), keys, F.lit("2024-06-01").cast("timestamp"))
    live = b.filter("NOT is_deleted").groupBy("document_id").agg(F.count("*").alias("live_chunks"))
    vec = v.groupBy("document_id").agg(F.count("*").alias("vectors"))
    return a.join(live, "document_id", "left").join(vec, "document_id", "left").select(
        "document_id", "is_deleted", F.coalesce("live_chunks", F.lit(0)).alias("live_chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors")
    )


def _answer(prompts: list[str]) -> list[str]:
    """Stand-in for a model: reads the item back out of the prompt."""
    out = []
    for p in prompts:
        item = json.loads(p.split("Item:\n", 1)[1].split("\n\nRespond ONLY", 1)[0])
        if item["event_type"] == "error":
            raise ValueError("refused")
        out.append(json.dumps({"kind": item["event_type"].upper(), "user": item["user_id"]}) if item["event_type"] != "view" else "no json")
    return out


@query("pip10_extract_many", """
    SELECT event_id, event_type NOT IN ('error', 'view') AS matches, CASE WHEN event_type NOT IN ('error', 'view') THEN upper(event_type) END AS kind, CASE WHEN event_type NOT IN ('error', 'view') THEN user_id END AS "user",
      CASE WHEN event_type NOT IN ('error', 'view') THEN 1.0::DOUBLE END AS confidence, CASE event_type WHEN 'error' THEN 'refused' WHEN 'view' THEN 'reply is not valid JSON' END AS error FROM events""")
def _(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "user_id")
    t = ex.extract_many(rows, "Name the kind of event.", "kind string, user long", _answer)
    return t.select("event_id", "matches", "data.kind", "data.user", "confidence", "error")


@query("pip11_study", """
    WITH h AS (SELECT page_id, v, replace(url, 'example.net', 'apple.com') AS url, regexp_extract(url, '/([a-z]{2})/', 1) AS year FROM pages, (SELECT unnest([0, 1]) AS v)),
    o AS (SELECT * FROM h WHERE contains(lower(url), 'apple.com')), k AS (SELECT url, min((page_id, v)) AS f FROM o GROUP BY url)
    SELECT vendor, year, count(*) AS pages FROM (SELECT DISTINCT o.url, 'apple' AS vendor, coalesce(nullif(year, ''), 'unknown') AS year FROM o JOIN k ON o.url = k.url AND (o.page_id, o.v) = k.f) GROUP BY 1, 2""")
def _(spark, d):
    # fan out, keep official pages, first per url wins, coverage by vendor and language
    pages = load(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.replace("url", F.lit("example.net"), F.lit("apple.com")).alias("text"))
    wide = fan_queries(pages, ["{q}", "site: {q}"])
    official = wide.filter(is_advisory(F.col("text")))
    kept = dedup.dedupe(official, "text", ["query_id", "variant_no"]).select(
        infer_vendor(F.col("text")).alias("vendor"), F.nullif(F.regexp_extract("text", "/([a-z]{2})/", 1), F.lit("")).alias("year")
    )
    return ag.coverage(kept, ["vendor", "year"]).drop("line")


@query("pip12_hit_score", """
    SELECT page_id, round(CASE WHEN contains(url, 'example.net') THEN 0.5 ELSE 0 END + CASE WHEN length(html) > 5000 THEN 0.3 ELSE 0 END + CASE WHEN contains(url, '?') THEN 0.2 ELSE 0 END, 3)::DOUBLE AS score FROM pages""")
def _(spark, d):
    url = F.replace("url", F.lit("example.net"), F.lit("cve.org"))
    s = ex.hit_score(url, F.when(F.length("html") > 5000, 0.8).otherwise(0.1), F.contains("url", F.lit("?")))
    return load(spark, d, "pages").select("page_id", F.round(s, 3).alias("score"))


@query("vec10_reembed_failed", f"""
    WITH f AS (SELECT doc_id, text FROM documents WHERE lang = 'fr'), {sql_vectors('e', 'f', 'doc_id', 'text')}
    SELECT id AS doc_id, count(*) AS filled, sum(x)::DOUBLE AS words, 'completed' AS embed_status FROM e GROUP BY 1""")
def _(spark, d):
    t = load(spark, d, "documents").select(
        "doc_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("enriched_content"), F.sha2("text", 256).alias("chunk_hash"),
        F.when(F.col("lang") == "fr", "failed").otherwise("completed").alias("embed_status"),
    )
    out = ing.reembed(t)
    words = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).alias("filled"), words.alias("words"), "embed_status")


@query("udf1_replaceable_stage", """
    SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' AND n_chars > 500 GROUP BY 1""")
def _(spark, d):
    stages = registry.Stages(pick=lambda t: t.filter("lang = 'en'"), size=lambda t: t.filter("n_chars > 500"),
                             count=lambda t: t.groupBy("source").agg(F.count("*").alias("n")))
    stages.register("pick", lambda t: t.filter("lang = 'fr'"))
    return stages.run(load(spark, d, "documents"), ["pick", "size", "count"])


@query("udf2_pluggable_embedder", f"""
    WITH w AS (SELECT doc_id, unnest({sql_words('lower(text)')}) AS w FROM documents)
    SELECT doc_id, max(n)::DOUBLE AS biggest FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 AS b, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    from ..functions.embedding import embed

    t = load(spark, d, "documents").select("doc_id", embed(F.col("text"), HashingEmbedder(16)).alias("v"))
    return t.select("doc_id", F.array_max("v").alias("biggest"))
