"""Text, hash and number operators over documents, chats and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import masking, numbers as nm, text as tx
from ..operators import joins
from ..operators.windows import turn_brief, working_memory
from .base import SPACES, load, query, spread, sql_strip, sql_words


def _sha(c):
    return F.sha2(c, 256)


@query("str1_summarize", f"""
    SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 80) || '...' END AS summary
    FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS t FROM documents)""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.summarize(F.col("text"), 80).alias("summary"))


@query("str2_truncate_notice", """
    SELECT doc_id, length(t) AS n, sha256(t) AS h FROM (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text
      ELSE substr(text, 1, 1000) || chr(10) || chr(10) || '... [TRUNCATED - EXCEEDED 1000 CHARS LIMIT]' END AS t FROM documents)""")
def _(spark, d):
    t = load(spark, d, "documents").select("doc_id", tx.truncate_notice(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), _sha("t").alias("h"))


_ROUGH = "chr(13) || ' ' || replace(replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(13)), 'the', 'th' || chr(0) || 'e') || chr(10)"


@query("str3_sanitize", f"""
    SELECT doc_id, length(t) AS n, sha256(t) AS h FROM (SELECT doc_id, {sql_strip(
      "regexp_replace(regexp_replace(replace(" + _ROUGH + ", chr(0), ''), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
    )} AS t FROM documents)""")
def _(spark, d):
    rough = F.concat(
        F.lit("\r "), F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n\n\r")), F.lit("the"), F.lit("th\x00e")), F.lit("\n")
    )
    t = load(spark, d, "documents").select("doc_id", tx.sanitize(rough).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), _sha("t").alias("h"))


@query("str4_join_fields", """
    SELECT conv_id, sha256(string_agg(t, ' | ' ORDER BY turn)) AS h FROM (SELECT conv_id, turn,
      CASE role WHEN 'system' THEN '' ELSE text END AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""")
def _(spark, d):
    t = load(spark, d, "conversations").withColumn("content", F.when(F.col("role") == "system", "").otherwise(F.col("text")))
    return joins.join_fields(t, "conv_id", "content", " | ", "turn").select("conv_id", _sha("joined").alias("h"))


_VENDORS = " ".join(f"WHEN contains(t, '{v}') THEN '{v}'" for v in fv.VENDORS)


@query("str5_infer_vendor", f"""
    SELECT doc_id, CASE {_VENDORS} ELSE coalesce(nullif(regexp_extract(t,
      '(?:vendor|company|product by)\\s*:\\s*([\\p{{L}}\\p{{N}}_\\-]+)', 1), ''), 'unknown') END AS vendor
    FROM (SELECT doc_id, lower(CASE lang WHEN 'en' THEN text ELSE text || ' Vendor : ' || source END) AS t FROM documents)""")
def _(spark, d):
    t = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit(" Vendor : "), "source"))
    return load(spark, d, "documents").select("doc_id", tx.infer_vendor(t).alias("vendor"))


@query("str6_parse_field", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'CVE-FROM-MAP' ELSE upper(nullif(regexp_extract(t, '(?i)(CVE-[0-9]{4}-[0-9]{4,7})', 1), '')) END AS cve_id,
      lower(nullif(regexp_extract(t, '(?i)\\b(critical|high|medium|low|info)\\b', 1), '')) AS severity,
      nullif(regexp_extract(t, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS published_date
    FROM (SELECT doc_id, lang, text || ' cve-2023-' || (10000 + doc_id) || ' Severity: High. ' || CASE lang WHEN 'fr' THEN '2024-02-' || (10 + doc_id % 20) ELSE '' END AS t FROM documents)""")
def _(spark, d):
    docs = load(spark, d, "documents")
    content = F.concat(
        "text", F.lit(" cve-2023-"), 10000 + F.col("doc_id"), F.lit(" Severity: High. "),
        F.when(F.col("lang") == "fr", F.concat(F.lit("2024-02-"), 10 + F.col("doc_id") % 20)).otherwise(""),
    )
    meta = F.when(F.col("lang") == "en", F.create_map(F.lit("cve_id"), F.lit("CVE-FROM-MAP"))).otherwise(
        F.create_map(F.lit("source"), "source")
    )
    fields = [tx.parse_field(content, meta, f).alias(f) for f in ("cve_id", "severity", "published_date")]
    return docs.select("doc_id", *fields)


_SECRETS = ("text || ' postgresql+psycopg://me:pw' || doc_id || '@host/db sk-proj-abcdefghijklmnopqrstuv' || doc_id"
            " || ' pk-lf-abcdefghijklmnopqrstuvwx Bearer eyJ' || doc_id || '.x~y=='")


def _secrets():
    return F.concat(
        "text", F.lit(" postgresql+psycopg://me:pw"), "doc_id", F.lit("@host/db sk-proj-abcdefghijklmnopqrstuv"), "doc_id",
        F.lit(" pk-lf-abcdefghijklmnopqrstuvwx Bearer eyJ"), "doc_id", F.lit(".x~y=="),
    )


def _sql_redact(c: str) -> str:
    c = f"regexp_replace({c}, '(?i){fv.DB_URL_PATTERN}', '\\1[REDACTED]\\3', 'g')"
    for pattern, repl in fv.SECRET_PATTERNS:
        c = f"regexp_replace({c}, '(?i){pattern}', '{repl}', 'g')"
    return c


@query("str7_redact", f"""
    SELECT doc_id, length(t) AS n, sha256(t) AS h FROM (SELECT doc_id, {_sql_redact(_SECRETS)} AS t FROM documents)""")
def _(spark, d):
    t = spread(load(spark, d, "documents"), "doc_id").select("doc_id", tx.redact(_secrets()).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), _sha("t").alias("h"))


@query("str8_redact_nested", f"""
    SELECT doc_id, sha256(t) AS deep, sha256(t) AS listed, n_chars AS kept
    FROM (SELECT doc_id, n_chars, {_sql_redact(_SECRETS)} AS t FROM documents)""")
def _(spark, d):
    payload = F.struct(
        F.struct(_secrets().alias("conn"), "n_chars").alias("nested"), F.array(F.struct(_secrets().alias("v"))).alias("items")
    )
    t = masking.redact_nested(load(spark, d, "documents").select("doc_id", payload.alias("p")), "p")
    return t.select(
        "doc_id", _sha("p.nested.conn").alias("deep"), _sha(F.col("p.items")[0]["v"]).alias("listed"),
        F.col("p.nested.n_chars").alias("kept"),
    )


@query("str9_mask_keys", """
    SELECT event_id, 'purchase_token_' || event_type AS name, CASE WHEN length(event_type) > 8 THEN substr(event_type, 1, 6) || '...[MASKED]' ELSE '[MASKED]' END AS short_value,
      substr('key-' || event_id || '-' || event_type, 1, 6) || '...[MASKED]' AS long_value, '[MASKED]' AS number, props AS kept FROM events""")
def _(spark, d):
    e = load(spark, d, "events")
    payload = F.struct(
        F.create_map(F.lit("API_Token"), F.col("event_type")).alias("m"),
        F.array(F.struct(F.concat(F.lit("key-"), "event_id", F.lit("-"), "event_type").alias("db_password"),
                         F.col("value").alias("secret_number"), "props")).alias("rows"),
    )
    t = masking.mask_keys(e.select("event_id", "event_type", payload.alias("p")), "p")
    row = F.col("p.rows")[0]
    return t.select(
        "event_id", F.concat(F.lit("purchase_token_"), "event_type").alias("name"),
        F.col("p.m")["API_Token"].alias("short_value"), row["db_password"].alias("long_value"),
        row["secret_number"].alias("number"), row["props"].alias("kept"),
    )


@query("str10_mask_pii", """
    SELECT doc_id, length(t) AS n, sha256(t) AS h FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
      '[\\p{L}\\p{N}_.\\-]+@[\\p{L}\\p{N}_.\\-]+', '[EMAIL]', 'g'), '\\b[0-9]{5,}\\b', '[NUM]', 'g'),
      '[A-Za-z0-9_\\-]{40,}', '[TOKEN]', 'g') AS t FROM documents)""")
def _(spark, d):
    t = spread(load(spark, d, "documents"), "doc_id").select("doc_id", tx.mask_pii(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), _sha("t").alias("h"))


@query("str11_coarse_path", """
    SELECT page_id, coalesce(list_filter(string_split(regexp_replace(regexp_replace(p, '[0-9a-fA-F]{8,}', ':id', 'g'),
      '\\b[0-9]+\\b', ':id', 'g'), '/'), lambda s: s <> '')[1], 'root') AS path
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS p FROM pages)""")
def _(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return load(spark, d, "pages").select("page_id", tx.coarse_path(path).alias("path"))


@query("str12_file_type", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'txt' ELSE lang END AS type, source AS local FROM documents""")
def _(spark, d):
    name = F.when(F.col("lang") == "en", "readme").otherwise(F.concat(F.lit("a.b."), F.upper("lang")))
    return load(spark, d, "documents").select(
        "doc_id", tx.file_type(name).alias("type"), tx.local_part(F.concat("source", F.lit("@x.org"))).alias("local")
    )


@query("str13_citations", """
    SELECT conv_id, turn, array_to_string(bad, ',') AS invalid, len(bad) > 0 AND turn >= 2 AS give_up FROM (SELECT conv_id, turn,
      list_filter(regexp_extract_all(text || ' [' || turn || '] [0] [2][17] [x]', '\\[([0-9]+)\\]', 1),
        lambda s: s::BIGINT <= 0 OR s::BIGINT > 4) AS bad FROM conversations)""")
def _(spark, d):
    answer = F.concat("text", F.lit(" ["), "turn", F.lit("] [0] [2][17] [x]"))
    bad = tx.invalid_citations(answer, F.lit(4))
    return load(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(bad, ",").alias("invalid"),
        ((F.size(bad) > 0) & (F.col("turn") >= 2)).alias("give_up"),
    )


_FENCED = """CASE role WHEN 'user' THEN 'see ```python' || chr(10) || text || chr(10) || '``` and ``` no ```'
    WHEN 'assistant' THEN '``` ' || text || ' ``` tail' ELSE text END"""


def _fenced():
    return (
        F.when(F.col("role") == "user", F.concat(F.lit("see ```python\n"), "text", F.lit("\n``` and ``` no ```")))
        .when(F.col("role") == "assistant", F.concat(F.lit("``` "), "text", F.lit(" ``` tail"))).otherwise(F.col("text"))
    )


@query("str14_code_block", f"""
    SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(t, '(?s)```python\\s+.*?\\s+```') THEN {sql_strip("regexp_extract(t, '(?s)```python\\s+(.*?)\\s+```', 1)")}
      WHEN regexp_matches(t, '(?s)```\\s+.*?\\s+```') THEN {sql_strip("regexp_extract(t, '(?s)```\\s+(.*?)\\s+```', 1)")} END) AS code
    FROM (SELECT conv_id, turn, {_FENCED} AS t FROM conversations)""")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", _sha(tx.code_block(_fenced())).alias("code"))


@query("str15_action_outcome", f"""
    SELECT conv_id, turn, coalesce(substr(list_filter(ls, lambda s: contains(s, 'sdk.'))[1], 1, 120),
        substr(list_filter(ls, lambda s: s <> '' AND NOT starts_with(s, '#'))[1], 1, 120), '(no action)') AS action,
      CASE WHEN role = 'system' THEN 'FAILED: ' || substr(string_split(text, chr(10))[1], 1, 120)
        ELSE coalesce(substr(list_filter(string_split(text || chr(10) || ' ', chr(10)), lambda s: {sql_strip('s')} <> '')[-1], 1, 120), 'OK (no output)') END AS outcome
    FROM (SELECT *, list_transform(string_split(CASE role WHEN 'user' THEN '# c' || chr(10) || text || chr(10) || '  x = sdk.rank(h)' ELSE '# note' || chr(10) || text END, chr(10)),
      lambda s: {sql_strip('s')}) AS ls FROM conversations)""")
def _(spark, d):
    code = F.when(F.col("role") == "user", F.concat(F.lit("# c\n"), "text", F.lit("\n  x = sdk.rank(h)"))).otherwise(
        F.concat(F.lit("# note\n"), "text")
    )
    rc = (F.col("role") == "system").cast("int")
    return load(spark, d, "conversations").select(
        "conv_id", "turn", tx.action_line(code).alias("action"),
        tx.outcome_line(rc, F.concat("text", F.lit("\n ")), F.col("text")).alias("outcome"),
    )


@query("str17_evidence_block", """
    SELECT conv_id, sha256(string_agg('[' || rn || '] Source: ' || role || ' (Page: ' || coalesce(page::VARCHAR, 'N/A') || ')' || chr(10) || 'Content: ' || text || chr(10) || chr(10), '' ORDER BY rn)) AS evidence
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, CASE WHEN turn > 2 THEN turn END AS page FROM conversations) GROUP BY conv_id""")
def _(spark, d):
    hit = F.struct("turn", F.col("role").alias("title"), F.when(F.col("turn") > 2, F.col("turn")).alias("page"), F.col("text").alias("content"))
    t = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return t.select("conv_id", _sha(tx.evidence_block(F.col("hits"))).alias("evidence"))


@query("str17_refusal", """
    SELECT conv_id, CASE WHEN n = 0 THEN base || chr(10) || chr(10) || 'There are currently no documents uploaded to this project. Please upload documents first.' || tail
      ELSE base || chr(10) || chr(10) || 'The documents currently uploaded in this project are:' || chr(10) || files || chr(10) || chr(10) || 'Please ask questions related to the content of these documents.' || tail END AS refusal
    FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n, string_agg('- f' || turn || '.txt', chr(10) ORDER BY 'f' || turn || '.txt') FILTER (role = 'assistant') AS files,
      'I could not find enough information in the uploaded sources for this project to answer that confidently.' AS base,
      chr(10) || chr(10) || 'What was checked:' || chr(10) || '- Relevant project document chunks' || chr(10) || '- Recent chat context' AS tail FROM conversations GROUP BY conv_id)""")
def _(spark, d):
    name = F.when(F.col("role") == "assistant", F.concat(F.lit("f"), "turn", F.lit(".txt")))
    t = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(name).alias("files"))
    return t.select("conv_id", tx.refusal(F.col("files")).alias("refusal"))


@query("str18_working_memory", """
    SELECT conv_id, turn, sha256('--- WORKING MEMORY (Turn ' || (turn + 1) || '/10) ---' || chr(10) || 'Original User Directive: d' || conv_id || chr(10) || chr(10) || 'Previous Turns History:' || chr(10)
      || string_agg('  Turn ' || turn || ':' || chr(10) || '    Action: ' || role || chr(10) || '    Outcome: ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)
      || CASE role WHEN 'system' THEN chr(10) || chr(10) || '[WARNING] Last execution encountered an error:' || chr(10) || '  ' || substr(text, 1, 500) ELSE '' END) AS memory
    FROM conversations""")
def _(spark, d):
    t = load(spark, d, "conversations").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("turn_number"),
        F.concat(F.lit("d"), "conv_id").alias("directive"), F.col("role").alias("action"), F.col("text").alias("outcome"),
        F.when(F.col("role") == "system", F.col("text")).alias("last_error"),
    )
    return working_memory(t).select(
        F.col("task_id").alias("conv_id"), F.col("turn_number").alias("turn"), _sha("memory").alias("memory")
    )


_NEXT_STEP = fv.NEXT_STEP.replace("'", "''")


@query("str18_turn_brief", f"""
    WITH h AS (SELECT conv_id, count(*) AS n, string_agg('  Turn ' || turn || ':' || chr(10) || '    Action: ' || role || chr(10) || '    Outcome: ' || text, chr(10) ORDER BY turn) AS lines,
        arg_max(CASE WHEN role = 'assistant' THEN text ELSE '' END, turn) AS err FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1)
    SELECT conv_id, sha256('--- WORKING MEMORY (Turn ' || coalesce(n, 0) + 1 || '/10) ---' || chr(10) || 'Original User Directive: d' || conv_id
      || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'Constraints:' || chr(10) || '  - cite' || chr(10) || '  - c' || conv_id ELSE '' END || chr(10)
      || coalesce(chr(10) || 'Previous Turns History:' || chr(10) || lines, chr(10) || '{fv.NO_TURNS}') || chr(10) || chr(10) || '{fv.FILES_HEAD}'
      || CASE conv_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[''a' || conv_id || '.json'']' ELSE '[''a.json'', "it''s"]' END || chr(10) || '{fv.FILES_HINT}'
      || CASE WHEN coalesce(err, '') <> '' THEN chr(10) || chr(10) || '[WARNING] Last execution encountered an error:' || chr(10) || '  ' || err ELSE '' END || chr(10) || chr(10) || '{_NEXT_STEP}') AS memory
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN h USING (conv_id)""")
def _(spark, d):
    t = load(spark, d, "conversations")
    c = F.col("task_id")
    tasks = t.select(F.col("conv_id").alias("task_id")).distinct().select(
        "task_id", F.concat(F.lit("d"), c).alias("directive"),
        F.when(c % 2 == 0, F.array(F.lit("cite"), F.concat(F.lit("c"), c))).alias("constraints"),
        F.when(c % 3 == 1, F.array(F.concat(F.lit("a"), c, F.lit(".json")))).when(c % 3 == 2, F.array(F.lit("a.json"), F.lit("it's"))).alias("state_files"),
    )
    # every fifth conversation is a task that has not begun
    turns = t.filter("conv_id % 5 <> 0").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("turn_number"), F.col("role").alias("action"), F.col("text").alias("outcome"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("last_error"),
    )
    return turn_brief(tasks, turns).select(F.col("task_id").alias("conv_id"), _sha("memory").alias("memory"))


_REPLY = """CASE WHEN role = 'user' THEN 'in_scope ( 0.' || turn || '5 )' WHEN role = 'assistant' AND turn > 2 THEN 'OUT_SCOPE (0.9' || turn || ')'
   WHEN role = 'assistant' THEN 'I say out_scope' WHEN turn > 0 THEN 'IN_SCOPE' ELSE 'hm' END"""


def _reply():
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    return (
        F.when(user, F.concat(F.lit("in_scope ( 0."), "turn", F.lit("5 )")))
        .when(bot & (F.col("turn") > 2), F.concat(F.lit("OUT_SCOPE (0.9"), "turn", F.lit(")")))
        .when(bot, "I say out_scope").when(F.col("turn") > 0, "IN_SCOPE").otherwise("hm")
    )


@query("str19_scope_label", f"""
    SELECT conv_id, turn, round(CASE WHEN label = 'IN_SCOPE' THEN 1.0 - conf WHEN label = 'OUT_SCOPE' THEN conf
      WHEN contains(upper(r), 'IN_SCOPE') THEN 0.1 WHEN contains(upper(r), 'OUT_SCOPE') THEN 0.9 ELSE 1.0 END, 6)::DOUBLE AS score
    FROM (SELECT *, upper(regexp_extract(r, '(?i)(IN_SCOPE|OUT_SCOPE)\\s*\\(\\s*([0-9.]+)\\s*\\)', 1)) AS label,
      try_cast(regexp_extract(r, '(?i)(IN_SCOPE|OUT_SCOPE)\\s*\\(\\s*([0-9.]+)\\s*\\)', 2) AS DOUBLE) AS conf
      FROM (SELECT conv_id, turn, {_REPLY} AS r FROM conversations))""")
def _(spark, d):
    return load(spark, d, "conversations").select(
        "conv_id", "turn", F.round(tx.out_of_scope_score(_reply()), 6).alias("score")
    )


@query("str20_json_list", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 0 ELSE 2 END AS n, CASE event_type WHEN 'error' THEN '' ELSE event_type || '|' || user_id END AS items FROM events""")
def _(spark, d):
    good = F.concat(F.lit("```json\n[\""), "event_type", F.lit("\", \""), "user_id", F.lit("\"]\n```"))
    reply = F.when(F.col("event_type") == "error", F.lit("no list")).otherwise(good)
    items = tx.json_list(reply)
    return load(spark, d, "events").select("event_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@query("str21_placeholder_summary", """
    SELECT doc_id, 'Document with ' || length(text) || ' characters (LiteLLM Proxy not configured)' AS summary FROM documents""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.placeholder_summary(F.col("text")).alias("summary"))


@query("hsh1_fingerprints", """
    SELECT doc_id, sha256(text) AS content_hash, sha256(doc_id || ':0:' || sha256(text)) AS chunk_fingerprint,
      sha256(sha256(text) || ':text-embedding-3-small:v1') AS embedding_fingerprint FROM documents""")
def _(spark, d):
    h = nm.content_hash(F.col("text"))
    return load(spark, d, "documents").select(
        "doc_id", h.alias("content_hash"), nm.chunk_fingerprint(F.col("doc_id"), F.lit(0), h).alias("chunk_fingerprint"),
        nm.embedding_fingerprint(h, "text-embedding-3-small").alias("embedding_fingerprint"),
    )


@query("num1_token_count", f"""
    SELECT doc_id, greatest(1, len({sql_words('text')})) AS tokens FROM documents""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", nm.token_count(F.col("text")).alias("tokens"))


@query("num2_token_estimate", f"""
    SELECT doc_id, CASE WHEN {sql_strip('text')} = '' THEN 0 ELSE length(text) // 4 END AS tokens FROM documents""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", nm.token_estimate(F.col("text")).alias("tokens"))


@query("num3_price_lookup", """
    SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.02 WHEN 'O' THEN 0.13 ELSE 0.02 END, 4) AS embed_micro_usd,
      round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.15 WHEN 'O' THEN 2.5 ELSE 0.15 END + o_custkey * CASE o_orderstatus WHEN 'F' THEN 0.6 WHEN 'O' THEN 10.0 ELSE 0.6 END, 4) AS chat_micro_usd FROM orders""")
def _(spark, d):
    s = F.col("o_orderstatus")
    em = F.when(s == "F", "text-embedding-3-small").when(s == "O", "Text-Embedding-3-LARGE").otherwise("other")
    ch = F.when(s == "F", "gpt-4o-mini").when(s == "O", "GPT-4o").otherwise("other")
    return load(spark, d, "orders").select(
        "o_orderkey", F.round(nm.embedding_cost(F.col("o_totalprice"), em) * 1e6, 4).alias("embed_micro_usd"),
        F.round(nm.chat_cost(F.col("o_totalprice"), F.col("o_custkey"), ch) * 1e6, 4).alias("chat_micro_usd"),
    )


@query("num4_progress", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(75.0::DOUBLE + l_quantity / 50 * 20.0, 1) AS embed_pct, round(10.0::DOUBLE + l_quantity / 50 * 30.0, 1) AS parse_pct FROM lineitem""")
def _(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", nm.embed_progress(F.col("l_quantity"), F.lit(50)).alias("embed_pct"),
        nm.parse_progress(F.col("l_quantity"), F.lit(50)).alias("parse_pct"),
    )


@query("num5_compression_ratio", """
    SELECT doc_id, round(CASE WHEN o = 0 THEN 0 ELSE length(text) / o::DOUBLE END, 6) AS ratio
    FROM (SELECT doc_id, text, CASE lang WHEN 'es' THEN 0 ELSE octet_length(encode(text)) END AS o FROM documents)""")
def _(spark, d):
    size = F.when(F.col("lang") == "es", 0).otherwise(F.octet_length("text"))
    return load(spark, d, "documents").select(
        "doc_id", F.round(nm.compression_ratio(size, F.length("text")), 6).alias("ratio")
    )


@query("set3_flatten", """
    SELECT doc_id, len(f) AS n, sha256(array_to_string(f, '|')) AS h, len(list_distinct(f)) AS distinct_items FROM (SELECT doc_id,
      flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))) AS f FROM documents)""")
def _(spark, d):
    nested = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    flat = tx.flatten(nested)
    return load(spark, d, "documents").select(
        "doc_id", F.size(flat).alias("n"), _sha(F.array_join(flat, "|")).alias("h"),
        F.size(tx.unique(flat)).alias("distinct_items"),
    )
