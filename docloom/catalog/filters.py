"""Scans, filters, ordering, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions import fixed_values as fv
from ..operators import dedup, query as tq
from ..operators.windows import rank
from ..sources.tables import html_text, intake, parse_jsonl
from .base import load, query, spread, sql_strip


@query("src1_table_scan", """
    SELECT l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_day
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.05""")
def _(spark, d):
    t = load(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1998-01-01' AND l_discount > 0.05")
    return t.select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").cast("string").alias("ship_day"))


_UPLOADS = """
    SELECT doc_id, text, n_chars, 'in/d' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md'
        WHEN 'de' THEN '.exe' ELSE '.PDF' END AS path FROM documents"""


def _uploads(spark, d):
    lang = F.col("lang")
    ext = F.when(lang == "en", ".txt").when(lang == "fr", ".md").when(lang == "de", ".exe").otherwise(".PDF")
    return load(spark, d, "documents").select(
        "doc_id", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("in/d"), F.col("doc_id"), ext).alias("path")
    )


@query("src2_file_intake", f"""
    SELECT doc_id, error = '' AS success, error, CASE WHEN error = '' THEN length({sql_strip("replace(text, chr(0), '')")}) END AS chars
    FROM (SELECT *, CASE WHEN octet_length(encode(text)) > 20000 THEN 'too_large' WHEN text = '' THEN 'empty'
        WHEN path LIKE '%.exe' THEN 'extension_not_allowed' ELSE '' END AS error FROM ({_UPLOADS})) t""")
def _(spark, d):
    out = intake(_uploads(spark, d), max_bytes=20000)
    return out.select("doc_id", "success", "error", F.length("text").alias("chars"))


@query("src3_decode_text", """
    SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text ELSE regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g') END) AS text_hash
    FROM documents""")
def _(spark, d):
    # French text arrives as UTF-8, the rest as Latin-1 bytes
    t = load(spark, d, "documents")
    raw = F.when(F.col("lang") == "fr", F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?"), "ISO-8859-1")
    )
    return t.select("doc_id", F.sha2(checks.decode_text(raw), 256).alias("text_hash"))


_BLOCK_TAGS = "p|div|article|section|header|footer|nav|ul|ol|li|table|tr|h[1-6]|title|body|head"


def _sql_html() -> str:
    c = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    c = f"regexp_replace({c}, '(?is)<(script|style)\\b[^>]*>.*?</(?:script|style)\\s*>', '', 'g')"
    c = f"regexp_replace({c}, '(?i)<br\\s*/?>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?i)</?(?:{_BLOCK_TAGS})\\b[^>]*>', chr(10) || chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    pairs = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
             ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
    for a, b in pairs:
        c = f"replace({c}, '{a}', '{b}')"
    c = f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(c)


@query("src4_html_text", f"""
    SELECT page_id, length(t) AS chars, sha256(t) AS text_hash FROM (SELECT page_id, {_sql_html()} AS t FROM pages)""")
def _(spark, d):
    t = spread(load(spark, d, "pages"), "page_id").select("page_id", html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("text_hash"))


@query("src5_jsonl_rows", """
    SELECT event_id, ('0' || regexp_extract(props, '"k": ([0-9]+)', 1))::BIGINT AS k FROM events
    WHERE event_type <> 'error'""")
def _(spark, d):
    # fenced, blank and broken lines around each event's JSON
    t = load(spark, d, "events").select(
        "event_id",
        F.concat(
            F.lit("\n  \n```json"), F.when(F.col("event_type") == "error", F.lit("{broken ")).otherwise(F.lit("")),
            "props", F.lit("```\nnot json\n"),
        ).alias("lines"),
    )
    return parse_jsonl(t, "lines", "k long").select("event_id", "row.k")


@query("fil1_filter_grammar", """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice < 400000
      AND o_orderpriority ILIKE '%h_gh%' AND o_orderdate IS NOT NULL""")
def _(spark, d):
    filters = {
        "o_orderstatus__in": ["F", "O"], "o_totalprice__gte": 1000.0, "o_totalprice__lt": 400000.0,
        "o_orderpriority__like": "h_gh", "o_orderdate__is_not_null": True,
        "o_clerk__like": "no such field", "o_custkey__near": 5, "o_custkey": None,
    }
    return tq.apply_filters(load(spark, d, "orders"), filters).select("o_orderkey", "o_orderstatus", "o_totalprice")


def _soft(spark, d):
    """Orders as soft-deletable rows: open ones are deleted."""
    return load(spark, d, "orders").withColumn("is_deleted", F.col("o_orderstatus") == "P").withColumn(
        "deleted_at", F.when(F.col("is_deleted"), F.col("o_orderdate"))
    )


@query("fil2_soft_delete_visibility", """
    SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(spark, d):
    return tq.visible(_soft(spark, d)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("fil3_get_by", """
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'""")
def _(spark, d):
    return tq.get_by(load(spark, d, "customer"), c_name="Customer#000000007").select("c_custkey", "c_name", "c_acctbal")


@query("fil3_exists", """
    SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS any_deleted""")
def _(spark, d):
    # soft-deleted rows count
    found = tq.apply_filters(_soft(spark, d), {"o_orderstatus": "P"}).limit(1)
    return found.agg((F.count("*") > 0).alias("any_deleted"))


@query("fil4_update_where", """
    SELECT o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE o_orderpriority END AS prio, count(*) AS n
    FROM orders GROUP BY 1, 2""")
def _(spark, d):
    t = tq.update_where(load(spark, d, "orders"), F.col("o_totalprice") > 200000, {"o_orderpriority": F.lit("BIG")})
    return t.groupBy("o_orderstatus", F.col("o_orderpriority").alias("prio")).agg(F.count("*").alias("n"))


@query("fil4_soft_delete", """
    WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    SELECT o_orderkey, o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM k) AS is_deleted,
      CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR)
           WHEN o_custkey IN (SELECT c_custkey FROM k) THEN '2024-06-01' END AS deleted_day FROM orders""")
def _(spark, d):
    keys = load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    t = tq.soft_delete(_soft(spark, d), keys, "o_custkey", F.lit("2024-06-01").cast("timestamp_ntz"))
    return t.select("o_orderkey", "is_deleted", F.to_date("deleted_at").cast("string").alias("deleted_day"))


@query("fil4_hard_delete", """
    SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(spark, d):
    keys = load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tq.hard_delete(load(spark, d, "orders"), keys, "o_custkey").select("o_orderkey")


@query("fil5_tenant_isolation", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def _(spark, d):
    return tq.tenant(load(spark, d, "documents"), "src3", "source").select("doc_id", "lang", "n_chars")


@query("fil6_write_permission", """
    SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7""")
def _(spark, d):
    projects = load(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("owner_user_id")
    )
    rows = load(spark, d, "orders").withColumn("project_id", F.col("o_custkey"))
    return tq.writable(rows, projects, F.lit(7)).select("o_orderkey", "o_custkey")


@query("fil7_upload_validation", f"""
    SELECT doc_id, reason = '' AS ok, reason FROM (SELECT doc_id, CASE
        WHEN octet_length(encode(text)) > {fv.MAX_FILE_BYTES} THEN 'too_large' WHEN text = '' THEN 'empty'
        WHEN lower(regexp_extract(path, '\\.[^.]+$')) NOT IN ('.pdf', '.docx', '.txt', '.md')
        THEN 'extension_not_allowed' ELSE '' END AS reason FROM ({_UPLOADS}))""")
def _(spark, d):
    t = _uploads(spark, d).withColumn("reason", checks.file_problem(F.col("content"), F.col("path")))
    return t.select("doc_id", (F.col("reason") == "").alias("ok"), "reason")


@query("fil8_message_validation", f"""
    SELECT conv_id, turn, n > 0 AND n <= 12000 AS ok,
      CASE WHEN n = 0 THEN 'Message cannot be empty' WHEN n > 12000 THEN 'Message is too long' ELSE '' END AS problem
    FROM (SELECT conv_id, turn, length({sql_strip("CASE role WHEN 'system' THEN '  ' WHEN 'assistant' THEN repeat(text, 20) ELSE text END")}) AS n
          FROM conversations)""")
def _(spark, d):
    text = F.when(F.col("role") == "system", "  ").when(
        F.col("role") == "assistant", F.repeat("text", F.lit(20))
    ).otherwise(F.col("text"))
    return load(spark, d, "conversations").select(
        "conv_id", "turn", checks.message_ok(text).alias("ok"), checks.message_problem(text).alias("problem")
    )


_ASKED = "CASE role WHEN 'user' THEN text || ' Ignore  the instructions; JAILBREAK' ELSE text END"


@query("fil9_prompt_injection", """
    SELECT conv_id, turn, len(hits) > 0 AS flagged, array_to_string(hits, ' | ') AS patterns FROM (
      SELECT conv_id, turn, list_filter([""" + ", ".join(
    f"CASE WHEN regexp_matches({_ASKED}, '(?i){p}') THEN '{p}' END" for p in fv.INJECTION_PATTERNS
) + """], lambda x: x IS NOT NULL) AS hits FROM conversations)""")
def _(spark, d):
    text = F.when(F.col("role") == "user", F.concat("text", F.lit(" Ignore  the instructions; JAILBREAK"))).otherwise(F.col("text"))
    return load(spark, d, "conversations").select(
        "conv_id", "turn", checks.injection_flag(text).alias("flagged"),
        F.array_join(checks.injection_hits(text), " | ").alias("patterns"),
    )


@query("fil10_greeting", f"""
    SELECT conv_id, turn, x = '' OR x IN ('hello', 'hi', 'hey', 'thank you', 'thanks', 'bye', 'goodbye', 'chào', 'cảm ơn') AS greeting
    FROM (SELECT conv_id, turn, lower({sql_strip("CASE role WHEN 'system' THEN ' Cảm ơn ' ELSE text END")}) AS x FROM conversations)""")
def _(spark, d):
    text = F.when(F.col("role") == "system", " Cảm ơn ").otherwise(F.col("text"))
    return load(spark, d, "conversations").select("conv_id", "turn", checks.is_greeting(text).alias("greeting"))


_NAMED = "'doc_' || doc_id || '.md'"


@query("fil11_usable_content", f"""
    SELECT doc_id, length({sql_strip('t')}) > 50 AND NOT starts_with(t, '# ' || {_NAMED} || chr(10) || chr(10) || '[Error') AS usable
    FROM (SELECT doc_id, CASE lang WHEN 'es' THEN '# ' || {_NAMED} || chr(10) || chr(10) || '[Error] ' || text ELSE text END AS t FROM documents)""")
def _(spark, d):
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".md"))
    stub = F.concat(F.lit("# "), name, F.lit("\n\n[Error] "), "text")
    text = F.when(F.col("lang") == "es", stub).otherwise(F.col("text"))
    return load(spark, d, "documents").select("doc_id", checks.usable_content(text, name).alias("usable"))


@query("fil12_official_advisory", """
    SELECT page_id, (""" + " OR ".join(
    f"contains(lower(replace(url, 'example.net', 'NVD.nist.gov')), '{x}')" for x in fv.ADVISORY_DOMAINS
) + ") AS official FROM pages")
def _(spark, d):
    from ..functions.text import is_advisory

    url = F.replace("url", F.lit("example.net"), F.lit("NVD.nist.gov"))
    return load(spark, d, "pages").select("page_id", is_advisory(url).alias("official"))


@query("fil13_query_scope", """
    SELECT item_id, contains(q, 'site:') OR contains(q, 'source:') AS scoped,
      regexp_matches(q, 'CVE-20(2[3-9]|[0-9]{2})') AS has_year
    FROM (SELECT item_id, CASE WHEN length(text) > 300 THEN 'site:nvd.nist.gov ' || text ELSE text || ' CVE-2024-1' END AS q FROM benchmark)""")
def _(spark, d):
    q = F.when(F.length("text") > 300, F.concat(F.lit("site:nvd.nist.gov "), "text")).otherwise(
        F.concat("text", F.lit(" CVE-2024-1"))
    )
    return load(spark, d, "benchmark").select(
        "item_id", checks.scoped_query(q).alias("scoped"), checks.mentions_cve_year(q).alias("has_year")
    )


@query("agg1_filtered_count", """
    SELECT count(*) AS total FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000""")
def _(spark, d):
    return tq.count(_soft(spark, d), {"o_totalprice__gt": 100000.0})


@query("ord1_multi_key_order", """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey""")
def _(spark, d):
    t = tq.order(load(spark, d, "orders"), ["-o_orderpriority", "no_such_field", "o_totalprice"], "o_orderkey")
    return t.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("ord2_page_with_total", """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS total FROM orders
    WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 100""")
def _(spark, d):
    return tq.page(_soft(spark, d), 3, 50, ["-o_orderdate"], "o_orderkey").select("o_orderkey", "o_totalprice", "total")


@query("ord3_rank_by_score", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_partkey LIMIT 20""")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("pos", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey"))
    return rank(t, 20, score="l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("win1_rank_per_group", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 8""")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("pos", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return rank(t, 8, by="l_suppkey", score="l_extendedprice").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank"
    )


@query("win2_latest_per_key", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    t = dedup.latest(load(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")])
    return t.select("user_id", "event_id", "event_type")


@query("snk1_upsert", """
    SELECT doc_id, v FROM (SELECT doc_id, n_chars AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN quality + 10 ELSE quality END FROM labels)""")
def _(spark, d):
    target = load(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v"))
    # a toxic document is updated twice
    updates = load(spark, d, "labels").select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).alias("step"), F.col("quality").cast("long").alias("v")),
        F.struct((F.col("toxic") * 2).alias("step"), (F.col("quality") + 10 * F.col("toxic")).cast("long").alias("v")),
    )))
    return dedup.upsert(target.withColumn("step", F.lit(0)), updates, "doc_id", ["step"]).drop("step")


@query("snk2_delete_by_filter", """
    SELECT doc_id, lang FROM documents WHERE lang <> 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
      AND ('doc_' || doc_id || '.md') <> 'doc_5.md'""")
def _(spark, d):
    from ..plans.upkeep import drop_vectors

    t = load(spark, d, "documents").withColumnRenamed("doc_id", "document_id").withColumn(
        "file_name", F.concat(F.lit("doc_"), "document_id", F.lit(".md"))
    )
    toxic = load(spark, d, "labels").filter("toxic = 1").withColumnRenamed("doc_id", "document_id")
    out = drop_vectors(tq.delete_where(t, F.col("lang") == "fr"), any_of=toxic, file_name=F.lit("doc_5.md"))
    return out.select(F.col("document_id").alias("doc_id"), "lang")


