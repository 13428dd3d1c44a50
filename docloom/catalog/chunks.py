"""Chunking strategies over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as ck
from ..functions.embedding import adjacent_similarity
from ..plans.ingest import chunk_records, semantic_chunks
from .base import SPACES, load, query, spread, sql_strip, sql_words


def _docs(spark, d):
    t = spread(load(spark, d, "documents"), "doc_id")
    return t.select(F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), "text")


def _exploded(df, chunks):
    rows = ck.explode_pieces(df, ["document_id"], chunks, "chunk_index", "c")
    return rows.select("document_id", "chunk_index", F.length("c").alias("n"), F.sha2("c", 256).alias("h"))


@query("chk1_fixed", """
    SELECT doc_id AS document_id, i AS chunk_index, length(substr(text, 512 * i + 1, 512)) AS n, sha256(substr(text, 512 * i + 1, 512)) AS h
    FROM documents, LATERAL (SELECT unnest(range(0, ceil(length(text) / 512)::BIGINT)) AS i)""")
def _(spark, d):
    return _exploded(_docs(spark, d), ck.fixed(F.col("text"), 512))


def _sql_pieces(text: str) -> str:
    """Sentences: a mark is put where the split happens."""
    return f"string_split(regexp_replace({sql_strip(text)}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


def _sql_sentence_walk(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, k, c): sentence chunks of every source row."""
    return f"""
    {name}_s AS (SELECT {key} AS key, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT {key}, {_sql_pieces(text)} AS p FROM {source})),
    {name}_w AS (SELECT key, i, CASE WHEN length(s) > 512 THEN length(s) ELSE length(s) + 1 END AS cur, 0 AS k FROM {name}_s WHERE i = 1
      UNION ALL SELECT s.key, s.i, CASE WHEN w.cur + length(s) > 512 THEN length(s) ELSE w.cur + length(s) + 1 END, w.k + (w.cur + length(s) > 512)::INT
      FROM {name}_w w JOIN {name}_s s ON s.key = w.key AND s.i = w.i + 1),
    {name} AS (SELECT key, k, string_agg(s, ' ' ORDER BY i) AS c FROM {name}_w JOIN {name}_s USING (key, i) GROUP BY key, k)"""


@query("chk2_sentence", f"""
    WITH RECURSIVE {_sql_sentence_walk('x', 'documents', 'doc_id', 'text')}
    SELECT key AS document_id, k AS chunk_index, length(c) AS n, sha256(c) AS h FROM x""")
def _(spark, d):
    return _exploded(_docs(spark, d), ck.sentence(F.col("text"), 512))


@query("chk3_paragraph", f"""
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '') AS ps FROM documents),
    p AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS s FROM t),
    w AS (SELECT doc_id, i, CASE WHEN length(s) > 512 THEN -1 ELSE length(s) + 2 END AS cur, 0 AS k FROM p WHERE i = 1
      UNION ALL SELECT p.doc_id, p.i, CASE WHEN length(s) > 512 THEN -1 WHEN w.cur >= 0 AND w.cur + length(s) > 512 THEN length(s) ELSE greatest(w.cur, 0) + length(s) + 2 END,
        w.k + (w.cur < 0 OR w.cur + length(s) > 512)::INT FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
    g AS (SELECT doc_id, k, string_agg(s, chr(10) || chr(10) ORDER BY i) AS c FROM w JOIN p USING (doc_id, i) GROUP BY 1, 2),
    big AS (SELECT doc_id * 100000 + k AS gk, c FROM g WHERE length(c) > 512 AND NOT contains(c, chr(10) || chr(10))),
    {_sql_sentence_walk('x', 'big', 'gk', 'c')},
    parts AS (SELECT doc_id, g.k, coalesce(x.k, 0) AS j, coalesce(x.c, g.c) AS c FROM g LEFT JOIN x ON x.key = doc_id * 100000 + g.k)
    SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS chunk_index, length(c) AS n, sha256(c) AS h FROM parts""")
def _(spark, d):
    return _exploded(_docs(spark, d), ck.paragraph(F.replace("text", F.lit("\n"), F.lit("\n\n")), 512))


_PROSE = f"""list_filter(flatten(list_transform(list_filter(list_transform(string_split_regex({sql_strip('text')}, '\\n\\n+'), lambda p: {sql_strip('p')}), lambda p: p <> ''),
    lambda p: list_transform(string_split(regexp_replace(p, '([.!?]){SPACES}', '\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}))), lambda s: s <> '')"""


@query("chk4_prose_sentences", f"""
    SELECT doc_id AS document_id, len(p) AS n, sha256(array_to_string(p, '|')) AS h FROM (SELECT doc_id, {_PROSE} AS p FROM documents)""")
def _(spark, d):
    t = _docs(spark, d).select("document_id", ck.prose_sentences(F.col("text")).alias("p"))
    return t.select("document_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("h"))


# CTEs: s (doc_id, i, s) sentences and sims (doc_id, i, sim) to the one before
_SIMS = f"""
    s AS MATERIALIZED (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {_PROSE} AS p FROM documents)),
    sw AS (SELECT doc_id, i, unnest({sql_words('lower(s)')}) AS w FROM s),
    v AS MATERIALIZED (SELECT doc_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS x FROM sw GROUP BY 1, 2, 3),
    nn AS (SELECT doc_id, i, sqrt(sum(x * x)) AS n FROM v GROUP BY 1, 2),
    dd AS (SELECT a.doc_id, c.i, sum(a.x * c.x) AS dot FROM v a JOIN v c ON a.doc_id = c.doc_id AND a.i + 1 = c.i AND a.b = c.b GROUP BY 1, 2),
    sims AS MATERIALIZED (SELECT c.doc_id, c.i, round(coalesce(dot, 0) / (a.n * c.n), 9) AS sim FROM nn a JOIN nn c ON a.doc_id = c.doc_id AND a.i + 1 = c.i
             LEFT JOIN dd ON dd.doc_id = c.doc_id AND dd.i = c.i)"""


@query("win7_adjacent_similarity", f"""
    WITH {_SIMS} SELECT doc_id AS document_id, i - 1 AS sentence, sim AS similarity FROM sims""")
def _(spark, d):
    t = _docs(spark, d).withColumn("sims", adjacent_similarity(ck.prose_sentences(F.col("text"))))
    rows = ck.explode_pieces(t, ["document_id"], F.col("sims"), "p", "sim")
    return rows.select("document_id", (F.col("p") + 1).alias("sentence"), F.col("sim").alias("similarity"))


@query("agg13_break_threshold", f"""
    WITH {_SIMS} SELECT d.doc_id AS document_id, round(round(CASE WHEN count(sim) = 0 THEN 0.75 ELSE least(0.9, greatest(0.1, quantile_cont(sim, 0.25))) END, 9), 6)::DOUBLE AS threshold
    FROM documents d LEFT JOIN sims USING (doc_id) GROUP BY 1""")
def _(spark, d):
    t = _docs(spark, d).withColumn("sims", adjacent_similarity(ck.prose_sentences(F.col("text"))))
    return t.select("document_id", F.round(ck.break_threshold(F.col("sims")), 6).alias("threshold"))


_GROUPED = f"""
    th AS (SELECT doc_id, round(least(0.9, greatest(0.1, quantile_cont(sim, 0.25))), 9) AS t FROM sims GROUP BY 1),
    m AS MATERIALIZED (SELECT s.doc_id, s.i, length(s) AS n, coalesce(round(sim, 9), 1) < coalesce(t, 0.75) AS apart FROM s LEFT JOIN sims USING (doc_id, i) LEFT JOIN th ON th.doc_id = s.doc_id),
    w AS (SELECT doc_id, i, n AS cur, 0 AS k FROM m WHERE i = 1
      UNION ALL SELECT m.doc_id, m.i, CASE WHEN w.cur >= 100 AND (apart OR w.cur + n + 2 > 1000) THEN n ELSE w.cur + 1 + n END,
        w.k + (w.cur >= 100 AND (apart OR w.cur + n + 2 > 1000))::INT FROM w JOIN m ON m.doc_id = w.doc_id AND m.i = w.i + 1),
    g AS (SELECT doc_id, k, string_agg(s, ' ' ORDER BY i) AS c FROM w JOIN s USING (doc_id, i) GROUP BY 1, 2)"""


@query("chk5_semantic_groups", f"""
    WITH RECURSIVE {_SIMS}, {_GROUPED} SELECT doc_id AS document_id, k AS chunk_index, length(c) AS n, sha256(c) AS h FROM g""")
def _(spark, d):
    t = _docs(spark, d).withColumn("s", ck.prose_sentences(F.col("text")))
    t = t.withColumn("sims", adjacent_similarity(F.col("s")))
    t = t.withColumn("thr", ck.break_threshold(F.col("sims")))
    groups = ck.group_by_similarity(F.col("s"), F.col("sims"), F.col("thr"))
    return _exploded(t, F.when(F.size("s") > 0, groups))


@query("chk6_size_rules", f"""
    WITH l AS (SELECT doc_id, unnest(p) AS c, generate_subscripts(p, 1) AS i, len(list_filter(p, lambda x: length(x) >= 100)) AS kept FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    k AS (SELECT *, row_number() OVER w - 1 AS ci, lag(c) OVER w AS prev FROM l WHERE kept = 0 OR length(c) >= 100 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    o AS (SELECT doc_id, ci, CASE WHEN kept < 2 OR prev IS NULL THEN c ELSE array_to_string(list_slice({sql_words('prev')}, -200, -1), ' ') || ' ' || c END AS c FROM k)
    SELECT doc_id AS document_id, ci AS chunk_index, length(c) AS n, sha256(c) AS h FROM o""")
def _(spark, d):
    return _exploded(_docs(spark, d), ck.size_rules(F.split("text", "\n")))


@query("chk7_chunk_records", f"""
    SELECT doc_id AS document_id, i AS chunk_index, sha256(c) AS chunk_hash, sha256(doc_id || ':' || i || ':' || sha256(c)) AS chunk_fingerprint,
      greatest(1, len({sql_words('c')})) AS token_count, CASE WHEN i >= 1 THEN 7 ELSE 1 END AS page_number, 'pending' AS embed_status, 'auto' AS chunk_source
    FROM (SELECT doc_id, i, substr(t, 900 * i + 1, 900) AS c FROM (SELECT doc_id, substr(text, 1, 900) || CASE WHEN length(text) >= 900 THEN '<!-- page: 7-9 -->' ELSE '' END || substr(text, 901) AS t FROM documents),
      LATERAL (SELECT unnest(range(0, ceil(length(t) / 900)::BIGINT)) AS i))""")
def _(spark, d):
    mark = F.when(F.length("text") >= 900, "<!-- page: 7-9 -->").otherwise("")
    t = _docs(spark, d).withColumn("text", F.concat(F.substring("text", 1, 900), mark, F.substring("text", 901, 2**31 - 1)))
    rows = chunk_records(t, ck.fixed(F.col("text"), 900))
    return rows.drop("content", "project_id")


@query("semantic_chunker", f"""
    WITH RECURSIVE {_SIMS}, {_GROUPED},
    f AS (SELECT *, count(*) FILTER (length(c) >= 100) OVER (PARTITION BY doc_id) AS kept FROM g),
    r AS (SELECT doc_id, kept, c, row_number() OVER o - 1 AS ci, lag(c) OVER o AS prev FROM f WHERE kept = 0 OR length(c) >= 100 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    z AS (SELECT doc_id, ci, CASE WHEN kept < 2 OR prev IS NULL THEN c ELSE array_to_string(list_slice({sql_words('prev')}, -200, -1), ' ') || ' ' || c END AS c FROM r)
    SELECT doc_id AS document_id, ci AS chunk_index, length(c) AS n, sha256(c) AS h FROM z""")
def _(spark, d):
    t = semantic_chunks(F.col("text"))(_docs(spark, d))
    return _exploded(t, F.col("chunks"))
