"""Embedding, search, clustering, cache and memory lookups.

Query texts are the whole ``benchmark`` table; the corpus is all documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as nm
from ..functions.chunking import explode_pieces
from ..functions.embedding import embed
from ..operators import dedup, joins, vectors as vc
from ..operators.windows import rerank
from ..session import shared_dir
from .base import load, query, spread, sql_scores, sql_vectors

_PAIR = f"""{sql_vectors('q', 'benchmark', 'item_id', 'text')}, {sql_vectors('e', 'documents', 'doc_id', 'text')}, {sql_scores('q', 'e')}"""
_PROJECT = "CASE WHEN length(text) % 3 = 0 THEN 'en' WHEN length(text) % 3 = 1 THEN 'fr' ELSE 'de' END"


def _project():
    n = F.length("text") % 3
    return F.when(n == 0, "en").when(n == 1, "fr").otherwise("de")


def questions(spark, d):
    t = load(spark, d, "benchmark")
    return t.select(F.col("item_id").alias("query_id"), "text", embed(F.col("text")).alias("vector"), _project().alias("project_id"))


def corpus(spark, d):
    t = spread(load(spark, d, "documents"), "doc_id")
    return t.select(F.col("doc_id").alias("id"), embed(F.col("text")).alias("vector"), F.col("lang").alias("project_id"), "text")


@query("vec1_embed", f"""
    WITH {sql_vectors('e', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, b AS pos, x FROM e""")
def _(spark, d):
    t = spread(load(spark, d, "documents"), "doc_id").withColumn("v", embed(F.col("text")))
    return explode_pieces(t, ["doc_id"], F.col("v"), "pos", "x").filter("x <> 0")


@query("vec2_cosine_to_centroid", """
    WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
    c AS (SELECT label, p, avg(x) AS y FROM v GROUP BY 1, 2)
    SELECT vec_id, label, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS similarity FROM v JOIN c USING (label, p) GROUP BY 1, 2""")
def _(spark, d):
    t = load(spark, d, "embeddings")
    cells = t.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("y"))
    centroid = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "y"))).alias("c"))
    mean = centroid.select("label", F.transform("c", lambda e: e["y"]).alias("mean"))
    return t.join(mean, "label").select("vec_id", "label", F.round(nm.cosine(F.col("embedding"), F.col("mean")), 6).alias("similarity"))


@query("vec3_topk_cosine", f"""
    WITH {_PAIR} SELECT qid AS query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores WHERE score >= 0.5) WHERE rank <= 10""")
def _(spark, d):
    return vc.topk_cosine(questions(spark, d), corpus(spark, d), 10, 0.5)


@query("vec3_topk_tenant", f"""
    WITH {_PAIR} SELECT qid AS query_id, id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
      FROM scores s JOIN benchmark ON item_id = qid JOIN documents t ON doc_id = id WHERE score >= 0.3 AND t.lang = (SELECT {_PROJECT} FROM benchmark b WHERE b.item_id = qid)) WHERE rank <= 5""")
def _(spark, d):
    return vc.topk_cosine(questions(spark, d), corpus(spark, d), 5, 0.3, same="project_id")


@query("joi10_query_corpus_best", f"""
    WITH {_PAIR} SELECT qid AS query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores) WHERE rank = 1""")
def _(spark, d):
    return vc.topk_cosine(questions(spark, d), corpus(spark, d), 1, -1.0).drop("rank")


@query("win1_search_many", f"""
    WITH {_PAIR} SELECT item_id AS query_id, id, score, rank FROM benchmark LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores WHERE score >= 0.8) ON qid = item_id AND rank <= 8""")
def _(spark, d):
    return vc.search_many(questions(spark, d), corpus(spark, d), 8, 0.8)


@query("joi2_hits_to_chunks", f"""
    WITH {_PAIR} SELECT qid AS query_id, rank, id AS embedding_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores WHERE score >= 0.5) JOIN documents ON doc_id = id
      WHERE rank <= 10 AND lang = 'en'""")
def _(spark, d):
    hits = vc.topk_cosine(questions(spark, d), corpus(spark, d), 10, 0.5).withColumnRenamed("id", "embedding_id")
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("embedding_id"), F.col("lang").alias("document_id"), "n_chars")
    return joins.hits_to_chunks(hits, rows, F.lit("en")).select("query_id", "rank", "embedding_id", "n_chars")


@query("vec4_retrieve", f"""
    WITH {_PAIR} SELECT qid AS query_id, rank, id, CASE lang WHEN 'en' THEN 'Chunk ' || n_chars ELSE lang END AS title, sha256(text) AS content, score, source AS project_id
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores WHERE score >= 0) JOIN documents ON doc_id = id WHERE rank <= 10""")
def _(spark, d):
    t = load(spark, d, "documents").select(
        F.col("doc_id").alias("id"), embed(F.col("text")).alias("vector"), F.when(F.col("lang") != "en", F.col("lang")).alias("title"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("url"), F.col("doc_id").alias("document_id"),
        F.col("source").alias("project_id"), F.col("n_chars").alias("chunk_index"),
    )
    hits = vc.retrieve(questions(spark, d), t, 10)
    return hits.select("query_id", "rank", "id", "title", F.sha2("content", 256).alias("content"), "score", F.col("metadata")["project_id"].alias("project_id"))


def _sql_lloyd(k: int, rounds: int) -> str:
    ctes = [
        "v AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)",
        f"i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT k, p, x AS y FROM v JOIN i USING (vec_id))",
    ]
    for r in range(rounds):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (dist, k)) AS k FROM (SELECT vec_id, k, sum((x - y) * (x - y)) AS dist FROM v JOIN c{r} USING (p) GROUP BY 1, 2) GROUP BY 1)"
        )
        ctes.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.p, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN (SELECT k, p, avg(x) AS y FROM v JOIN a{r} USING (vec_id) GROUP BY 1, 2) m ON m.k = c.k AND m.p = c.p)"
        )
    return "WITH " + ",\n".join(ctes[:-1]) + f" SELECT vec_id, k AS cluster FROM a{rounds - 1}"


@query("vec5_kmeans", _sql_lloyd(5, 10))
def _(spark, d):
    t = load(spark, d, "embeddings").select("vec_id", "embedding")
    first = [list(r[0]) for r in t.orderBy("vec_id").limit(5).select("embedding").collect()]
    return vc.cluster(t, "embedding", 5, init=first).select("vec_id", "cluster")


@query("vec6_semantic_cache", f"""
    WITH {_PAIR}, best AS (SELECT qid, id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores s JOIN documents t ON doc_id = id
      WHERE score >= 0.7 AND t.lang = (SELECT {_PROJECT} FROM benchmark b WHERE b.item_id = qid)) WHERE rank = 1)
    SELECT item_id AS query_id, id, score, sha256(CASE WHEN n_chars > 1000 THEN text END) AS content, coalesce(n_chars > 1000, FALSE) AS hit FROM benchmark b LEFT JOIN best ON qid = item_id LEFT JOIN (SELECT doc_id, n_chars, text FROM documents) ON doc_id = id""".replace("sha256(CASE WHEN n_chars > 1000 THEN text END)", "sha256(CASE WHEN n_chars > 1000 THEN dt END)").replace("(SELECT doc_id, n_chars, text FROM documents)", "(SELECT doc_id, n_chars, text AS dt FROM documents)"))
def _(spark, d):
    # entries of documents up to 1000 characters have expired
    now = F.lit("2024-01-01").cast("timestamp")
    entries = corpus(spark, d).join(load(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id").select(
        "id", "vector", "project_id", F.col("id").cast("string").alias("redis_key"), F.col("text").alias("content"),
        (now + F.make_dt_interval(secs=F.col("n_chars") - 1000)).alias("expires_at"),
    )
    out = vc.cache_lookup(questions(spark, d), entries, now, 0.7)
    return out.select("query_id", "id", "score", F.sha2("content", 256).alias("content"), "hit")


@query("vec7_memory_recall", f"""
    WITH {_PAIR} SELECT qid AS query_id, id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
      FROM scores s JOIN documents t ON doc_id = id WHERE score >= 0.4 AND t.lang = (SELECT {_PROJECT} FROM benchmark b WHERE b.item_id = qid)) WHERE rank <= 3""")
def _(spark, d):
    asked = questions(spark, d).withColumnRenamed("project_id", "user_id")
    memories = corpus(spark, d).withColumnRenamed("project_id", "user_id").withColumnRenamed("text", "content")
    return vc.recall(asked, memories).select("query_id", "id", "score", "rank")


@query("vec8_scope_score", f"""
    WITH {_PAIR}, f AS (SELECT doc_id, source, text FROM documents d WHERE doc_id = (SELECT min(doc_id) FROM documents x WHERE x.source = d.source)),
    m AS (SELECT qid, max(score) AS sim FROM scores WHERE score >= 0 GROUP BY 1),
    p AS (SELECT qid, round(max(score), 6) AS psim FROM scores JOIN f ON doc_id = id WHERE source = 'src' || (qid % 20) GROUP BY 1)
    SELECT item_id, round(0.4 * ((50 + item_id % 50) / 100.0::DOUBLE) + 0.3 * (1 - sim) + 0.3 * (1 - psim), 8) AS oos_score,
      item_id % 7 <> 0 AND NOT contains(lower(text), 'jailbreak') AND 0.4 * ((50 + item_id % 50) / 100.0::DOUBLE) + 0.3 * (1 - sim) + 0.3 * (1 - psim) <= 0.95 AS in_scope
    FROM benchmark JOIN m ON m.qid = item_id JOIN p ON p.qid = item_id""")
def _(spark, d):
    asked = questions(spark, d).withColumn("project_id", F.concat(F.lit("src"), F.col("query_id") % 20))
    sims = vc.topk_cosine(asked, corpus(spark, d), 1, 0.0).select("query_id", F.col("score").alias("max_doc_sim"))
    docs = load(spark, d, "documents")
    first = dedup.dedupe(docs, "source", ["doc_id"]).select(F.col("source").alias("project_id"), embed(F.col("text")).alias("pv"))
    t = asked.join(sims, "query_id").join(first, "project_id").select(
        F.col("query_id").alias("item_id"), F.col("text").alias("query"), "max_doc_sim",
        F.round(nm.cosine(F.col("vector"), F.col("pv")), 6).alias("project_sim"),
        F.when(F.col("query_id") % 7 == 0, 0).otherwise(3).alias("files"),
        F.concat(F.lit("OUT_SCOPE (0."), 50 + F.col("query_id") % 50, F.lit(")")).alias("reply"),
    )
    return vc.scope_score(t).select("item_id", F.round("oos_score", 8).alias("oos_score"), "in_scope")


@query("vec9_approximate_topk")
def _(spark, d):
    return vc.approx_topk(questions(spark, d), corpus(spark, d), 64, 5)


def _sql_deep(depth: int, k: int) -> str:
    ctes = [sql_vectors("q0", "benchmark", "item_id", "text"), sql_vectors("e", "documents", "doc_id", "text")]
    for h in range(depth):
        ctes.append(f"""
    d{h} AS (SELECT a.id AS qid, c.id, sum(a.x * c.x) AS dot FROM q{h} a JOIN e c USING (b) GROUP BY 1, 2),
    h{h} AS MATERIALIZED (SELECT qid, id, score, rank, {h} AS hop FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM
      (SELECT a.id AS qid, c.id, round(CASE WHEN a.n * c.n = 0 THEN 0 ELSE coalesce(dot, 0) / (a.n * c.n) END, 6) AS score FROM q{h}_n a CROSS JOIN e_n c LEFT JOIN d{h} t ON t.qid = a.id AND t.id = c.id) WHERE score >= 0) WHERE rank <= {k}),
    m{h} AS (SELECT qid AS id, b, 0.5 * sum(x) / any_value(n) AS x FROM h{h} JOIN (SELECT qid, count(*) AS n FROM h{h} GROUP BY 1) USING (qid) JOIN e ON e.id = h{h}.id GROUP BY 1, 2),
    q{h + 1} AS MATERIALIZED (SELECT id, b, sum(x) AS x FROM (SELECT * FROM q{h} UNION ALL SELECT * FROM m{h}) GROUP BY 1, 2),
    q{h + 1}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM q{h + 1} GROUP BY 1)""")
    hops = " UNION ALL ".join(f"SELECT * FROM h{h}" for h in range(depth))
    return f"""WITH {", ".join(ctes)} SELECT qid AS query_id, id, score, hop, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY hop, rank) AS rn FROM ({hops})) WHERE rn = 1"""


@query("vec11_deep_search", _sql_deep(3, 5))
def _(spark, d):
    # every hop reads the vectors, so they are embedded once into a table
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}/vectors"
    corpus(spark, d).select("id", "vector").write.parquet(path)
    return vc.deep_search(questions(spark, d), spark.read.schema("id long, vector array<double>").parquet(path), 3, 5)


_VARIANTS = ["{q}", "vendor advisory {q} the end", "latest"]


@query("set4_fanout", f"""
    WITH f AS (SELECT item_id * 10 + v AS fid, CASE v WHEN 0 THEN text WHEN 1 THEN 'vendor advisory ' || text || ' the end' ELSE 'latest ' || text END AS t FROM benchmark, (SELECT unnest([0, 1, 2]) AS v)),
    {sql_vectors('q', 'f', 'fid', 't')}, {sql_vectors('e', 'documents', 'doc_id', 'text')}, {sql_scores('q', 'e')},
    h AS (SELECT qid // 10 AS base, qid % 10 AS variant_no, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores WHERE score >= 0)
    SELECT base, variant_no, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY base, id ORDER BY variant_no, rank) AS rn FROM h WHERE rank <= 10) WHERE rn = 1""")
def _(spark, d):
    asked = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vc.fanout(asked, _VARIANTS, corpus(spark, d)).withColumn("base", F.col("base").cast("long"))


def _sql_rerank(score: str) -> str:
    words = "list_filter(string_split_regex(lower({}), '[\\x{{9}}-\\x{{d}}\\x{{20}}]+'), lambda w: w <> '')"
    return f"""
    WITH {_PAIR}, h AS MATERIALIZED (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores WHERE score >= 0) WHERE rank <= 20),
    qt AS (SELECT DISTINCT item_id AS qid, unnest({words.format('text')}) AS term FROM benchmark),
    dt AS (SELECT doc_id AS id, unnest({words.format('text')}) AS term FROM documents WHERE doc_id IN (SELECT id FROM h)),
    tfs AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY 1, 2), sz AS (SELECT id, count(*) AS size FROM dt GROUP BY 1),
    pq AS (SELECT qid, count(*) AS n, avg(coalesce(size, 0)) AS mean FROM h LEFT JOIN sz USING (id) GROUP BY 1),
    tf AS (SELECT h.qid, h.id, term, tf, size FROM h JOIN qt ON qt.qid = h.qid JOIN tfs USING (id, term) JOIN sz USING (id)),
    df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY 1, 2),
    lx AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS lex FROM tf JOIN df USING (qid, term) JOIN pq USING (qid) GROUP BY 1, 2),
    b AS (SELECT qid, id, score, coalesce(lex, 0) AS lex FROM h LEFT JOIN lx USING (qid, id)),
    x AS (SELECT *, min(lex) OVER w AS l0, max(lex) OVER w AS l1, min(score) OVER w AS s0, max(score) OVER w AS s1 FROM b WINDOW w AS (PARTITION BY qid)),
    r AS (SELECT qid, id, round({score}, 6) AS rank_score FROM x)
    SELECT qid AS query_id, id, rank_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank_score DESC, id) AS rn FROM r) WHERE rn <= 5"""


def _hits(spark, d):
    hits = vc.topk_cosine(questions(spark, d), corpus(spark, d), 20, 0.0).drop("rank")
    asked = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return hits.join(asked, "query_id").join(docs, "id")


@query("ord4_rank_bm25", _sql_rerank("lex"))
def _(spark, d):
    return rerank(_hits(spark, d), "bm25", 5).select("query_id", "id", "rank_score")


@query("ord4_rank_hybrid", _sql_rerank(
    "0.5 * CASE WHEN l1 = l0 THEN 1 ELSE (lex - l0) / (l1 - l0) END + 0.5 * CASE WHEN s1 = s0 THEN 1 ELSE (score - s0) / (s1 - s0) END"))
def _(spark, d):
    return rerank(_hits(spark, d), "hybrid", 5).select("query_id", "id", "rank_score")
