"""Vector search, clustering, cache and memory lookup.

Exact search never forms the query x corpus product as rows: a task scores a
block of corpus vectors against a block of query vectors with one matrix
product and emits only its own best k per query, which a group-limited window
then merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import injection_flag, is_greeting
from ..functions.embedding import Embedder, embed
from ..functions.text import out_of_scope_score
from ..session import shared_dir
from .dedup import dedupe
from .skew import attach

MAX_BROADCAST_QUERIES = 10_000
MAX_BROADCAST_HITS = 1_000_000
MAX_CELLS = 1_000_000
BLOCK_ROWS = 50_000
DIGITS = 6


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in vectors])


def _best(pdf: pd.DataFrame, qdf: pd.DataFrame, same: str | None, k: int, min_score: float) -> pd.DataFrame:
    """The k best rows of this block per query: query_id, id, score.

    Scores are computed for at most ``MAX_CELLS`` pairs at a time and cut to k
    per query at once, so memory does not depend on the number of hits.
    """
    pdf, qdf = pdf[pdf["vector"].notna()], qdf[qdf["vector"].notna()]
    found = [pd.DataFrame({"query_id": qdf["query_id"][:0], "id": pdf["id"][:0], "score": np.zeros(0)})]
    pairs = [(pdf, qdf)] if len(pdf) and len(qdf) else []
    if same and pairs:
        asked = dict(tuple(qdf.groupby(same)))
        pairs = [(part, asked[t]) for t, part in pdf.groupby(same) if t in asked]
    for part, ask in pairs:
        q = _matrix(ask["vector"])
        q_norms, q_ids = np.sqrt((q * q).sum(axis=1)), ask["query_id"].to_numpy()
        step = max(1, MAX_CELLS // len(q))
        for start in range(0, len(part), step):
            rows = part.iloc[start : start + step].sort_values("id", kind="stable")
            ids, m = rows["id"].to_numpy(), _matrix(rows["vector"])
            bottom = np.outer(np.sqrt((m * m).sum(axis=1)), q_norms)
            scores = np.round(np.where(bottom == 0, 0.0, (m @ q.T) / np.where(bottom == 0, 1.0, bottom)), DIGITS)
            floor = np.full(len(q), min_score)
            if len(rows) > k:
                floor = np.maximum(floor, np.partition(scores, len(rows) - k, axis=0)[len(rows) - k])
            # of rows tied at the cut the smallest ids, so that copies never make more than k hits
            above, tied = scores > floor, scores == floor
            room = np.maximum(k - above.sum(axis=0), 0)
            r, c = np.nonzero(above | (tied & (np.cumsum(tied, axis=0, dtype=np.int32) <= room)))
            hits = pd.DataFrame({"query_id": q_ids[c], "id": ids[r], "score": scores[r, c]})
            found.append(_cut(hits, k))
            if sum(map(len, found)) > max(MAX_CELLS, 2 * k * len(qdf)):
                found = [_cut(pd.concat(found, ignore_index=True), k)]
    return pd.concat(found, ignore_index=True)


def _cut(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best hits per query, ties to the smaller id."""
    hits = hits.sort_values(["score", "id"], ascending=[False, True], kind="stable")
    return hits.groupby("query_id", sort=False).head(k)


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_cosine(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    min_score: float = 0.5,
    same: str | None = None,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Exact k best corpus vectors per query by cosine.

    ``queries``: query_id, vector [, same]; ``corpus``: id, vector [, same].
    Returns query_id, id, score (6 digits), rank; ties go to the smaller id.
    Up to ``max_broadcast`` queries ride along with the scan; more are met
    with the corpus block by block through a shuffle. Both ways are exact.
    """
    q_cols = ["query_id", "vector"] + ([same] if same else [])
    c_cols = ["id", "vector"] + ([same] if same else [])
    queries, corpus = queries.select(*q_cols), corpus.select(*c_cols)
    schema = _hit_schema(queries, corpus)

    # bounded by construction: at most max_broadcast + 1 rows reach the driver
    few = queries.limit(max_broadcast + 1).toPandas()
    if len(few) <= max_broadcast:
        shared = corpus.sparkSession.sparkContext.broadcast(few)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _best(pdf, shared.value, same, k, min_score)

        best = _merge(corpus.mapInPandas(scan, schema), k)
        # the number of hits is known to be small: joins fetch payloads for
        # them without shuffling the corpus
        return F.broadcast(best) if k * len(few) <= MAX_BROADCAST_HITS else best

    # more queries: every block of the corpus meets every block of queries
    c_blocks, q_blocks = -(-corpus.count() // BLOCK_ROWS), -(-queries.count() // max_broadcast)
    left = corpus.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )

    def meet(pdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        return _best(pdf, qdf, same, k, min_score)

    return _merge(left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(meet, schema), k)


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 10, same: str | None = None) -> DataFrame:
    """Search hits for a table of queries: top k with score >= 0.

    ``corpus`` adds payload columns title (may be null), content, url,
    document_id, project_id and chunk_index.
    """
    ranked = topk_cosine(queries, corpus, k, 0.0, same)
    payload = corpus.select("id", "title", "content", "url", "document_id", "project_id", "chunk_index")
    return ranked.join(payload, "id").select(
        "query_id", "rank", "id",
        F.coalesce("title", F.concat(F.lit("Chunk "), F.coalesce("chunk_index", F.lit(0)).cast("string"))).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"), "url", "score",
        F.create_map(
            F.lit("document_id"), F.col("document_id").cast("string"),
            F.lit("project_id"), F.col("project_id").cast("string"),
            F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        ).alias("metadata"),
    )


def search_many(queries: DataFrame, corpus: DataFrame, k: int = 8, min_score: float = 0.0) -> DataFrame:
    """k hits per query; a query without any keeps one row with null hit."""
    hits = topk_cosine(queries, corpus, k, min_score)
    return queries.select("query_id").join(hits, "query_id", "left")


def fan_queries(queries: DataFrame, variants: list[str]) -> DataFrame:
    """Each query in every variant: ``{q}`` is replaced, else put in front."""
    tmpl = F.explode(F.array(*[F.struct(F.lit(i).alias("variant_no"), F.lit(v).alias("variant")) for i, v in enumerate(variants)]))
    wide = queries.withColumn("_v", tmpl).select("*", "_v.*").drop("_v")
    text = F.when(
        F.contains("variant", F.lit("{q}")), F.replace("variant", F.lit("{q}"), F.col("text"))
    ).otherwise(F.concat("variant", F.lit(" "), "text"))
    return wide.withColumn("query", text)


def fanout(
    queries: DataFrame, variants: list[str], corpus: DataFrame, k: int = 10, fn: Embedder | None = None
) -> DataFrame:
    """Union of the hits of all variants, first variant wins per hit id."""
    wide = fan_queries(queries, variants).withColumn("base", F.col("query_id"))
    asked = wide.select(
        F.concat_ws("/", "base", "variant_no").alias("query_id"), embed(F.col("query"), fn).alias("vector")
    )
    hits = topk_cosine(asked, corpus, k, 0.0)
    parts = F.split("query_id", "/")
    hits = hits.select(
        parts[0].alias("base"), parts[1].cast("int").alias("variant_no"), "rank", "id", "score"
    )
    return dedupe(hits, ["base", "id"], ["variant_no", "rank"])


def deep_search(
    queries: DataFrame, corpus: DataFrame, depth: int = 3, k: int = 5, feedback: float = 0.5
) -> DataFrame:
    """Up to ``depth`` rounds of search, refining each query from its hits.

    The refined query mixes the query with the mean of its hits; a query
    without hits stops. First hop wins per (query, id).
    """
    hops = []
    shared_dir(queries.sparkSession)
    current = queries.select("query_id", "vector")
    for hop in range(depth):
        # k rows per query; kept, so that no later hop searches again
        hits = topk_cosine(current, corpus, k, 0.0).withColumn("hop", F.lit(hop)).checkpoint()
        hops.append(hits)
        if hop == depth - 1:
            break
        # mean hit vector: one (sum, count) pair per query and position
        found = hits.select("query_id", "id")
        if hits.count() <= MAX_BROADCAST_HITS:  # a count of the kept rows
            found = F.broadcast(found)
        spread = corpus.select("id", "vector").join(found, "id").select("query_id", F.posexplode("vector"))
        mean = (
            spread.groupBy("query_id", "pos").agg(F.avg("col").alias("v"))
            .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
            .select("query_id", F.transform("m", lambda e: e["v"]).alias("mean"))
        )
        current = current.join(mean, "query_id").select(
            "query_id",
            F.zip_with("vector", "mean", lambda a, b: a.cast("double") + feedback * b).alias("vector"),
        )
    whole = hops[0]
    for h in hops[1:]:
        whole = whole.unionByName(h)
    return dedupe(whole, ["query_id", "id"], ["hop", "rank"])


def cluster(
    df: DataFrame, vec: str = "vector", k: int = 5, iters: int = 10, seed: int = 7, init: list | None = None
) -> DataFrame:
    """K-means by squared distance, ``iters`` rounds at most. Adds ``cluster``.

    A vector that is null, holds a null or has another length than the rest belongs to no cluster:
    null. Without ``init`` Spark's own k-means finds the centres, from its seeded parallel start.
    ``init`` gives them, for runs that must be repeated exactly: Lloyd's rounds, ties to the lowest
    index, an empty cluster keeps its centroid; only k centroids and k sums per task move.
    """
    whole = F.col(vec).isNotNull() & ~F.exists(F.col(vec), lambda x: x.isNull())
    if init is None:
        dim = df.filter(whole).agg(F.mode(F.size(vec))).first()[0]
        fit = whole & (F.size(vec) == F.lit(dim))
        if dim is None or k <= 1 or df.filter(fit).select(vec).distinct().limit(2).count() < 2:
            return df.withColumn("cluster", F.when(fit, F.lit(0)))
        parts = df.withColumn("_v", array_to_vector(F.when(fit, F.transform(vec, lambda x: x.cast("double")))))
        centres = KMeans(featuresCol="_v", predictionCol="cluster", k=k, maxIter=iters, seed=seed).fit(parts.filter(fit).select("_v"))
        known = centres.transform(parts.filter(fit)).drop("_v")
        return known.unionByName(parts.filter(~F.coalesce(fit, F.lit(False))).drop("_v").withColumn("cluster", F.lit(None).cast("int")))
    cents = np.array([np.asarray(c, dtype=float) for c in init])
    fit = whole & (F.size(vec) == cents.shape[1])
    if len(cents) <= 1:
        return df.withColumn("cluster", F.when(fit, F.lit(0)))
    vectors = df.filter(fit).select(vec)

    def nearest(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.stack([((m - row) ** 2).sum(axis=1) for row in c], axis=1).argmin(axis=1)

    def sums(c: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(c)
            seen = np.zeros(len(c), dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    m = _matrix(pdf[vec])
                    who = nearest(m, c)
                    np.add.at(total, who, m)
                    seen += np.bincount(who, minlength=len(c))
            yield pd.DataFrame({"cluster": range(len(c)), "total": total.tolist(), "seen": seen})

        return run

    for _ in range(iters - 1):
        parts = vectors.mapInPandas(sums(cents), "cluster int, total array<double>, seen long")
        merged = (
            parts.select("cluster", "seen", F.posexplode("total"))
            .groupBy("cluster", "pos").agg(F.sum("col").alias("s"), F.sum("seen").alias("n")).collect()
        )
        new = cents.copy()
        for r in merged:  # k x dim numbers
            if r["n"] > 0:
                new[r["cluster"], r["pos"]] = r["s"] / r["n"]
        cents = new
    final = cents

    @F.pandas_udf("int")
    def assign(s: pd.Series) -> pd.Series:
        out, held = pd.Series([None] * len(s), dtype="Int32"), s.notna().to_numpy()
        if held.any():
            out[held] = nearest(_matrix(s[held]), final).astype(np.int32)
        return out

    return df.withColumn("cluster", assign(F.when(fit, F.col(vec))))


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column, min_score: float = 0.92) -> DataFrame:
    """Nearest cached answer of the same project, if it has not expired.

    The nearest point decides: when its entry is gone the lookup misses.
    ``cache``: id, vector, project_id, redis_key, content, expires_at.
    """
    best = topk_cosine(queries, cache, 1, min_score, same="project_id")
    entry = cache.select("id", "content", (F.col("expires_at") > now).alias("live"))
    found = best.join(entry, "id")
    hit = F.coalesce("live", F.lit(False))
    return queries.select("query_id", "project_id").join(found, "query_id", "left").select(
        "query_id", "project_id", "id", "score", F.when(hit, F.col("content")).alias("content"), hit.alias("hit")
    )


def recall(queries: DataFrame, memories: DataFrame, k: int = 3, min_score: float = 0.4) -> DataFrame:
    """A user's own best memories; both sides carry user_id."""
    return topk_cosine(queries, memories, k, min_score, same="user_id").join(
        memories.select("id", "content"), "id"
    )


def scope_score(df: DataFrame) -> DataFrame:
    """Adds ``oos_score`` and ``in_scope`` per query.

    ``df``: query, files (their number), reply (label text, null when the
    call failed), max_doc_sim, project_sim.
    """
    score = (
        0.4 * out_of_scope_score(F.col("reply"))
        + 0.3 * (1.0 - F.coalesce("max_doc_sim", F.lit(0.0)))
        + 0.3 * (1.0 - F.coalesce("project_sim", F.lit(0.0)))
    )
    refused = injection_flag(F.col("query")) | (F.col("files") == 0) | is_greeting(F.col("query"))
    return df.withColumn("oos_score", score).withColumn("in_scope", ~refused & (F.round("oos_score", 9) <= 0.95))


def _signatures(dim: int, tables: int, bits: int, seed: int):
    """Bucket numbers of a vector, one per table, from random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    powers = 1 << np.arange(bits)

    @F.pandas_udf("array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            good = s[s.notna()]
            out = pd.Series([None] * len(s), dtype=object)
            if len(good):
                m = _matrix(good)
                signs = np.stack([(m @ planes[t].T > 0) @ powers for t in range(tables)], axis=1)
                rows = iter(signs)
                out = pd.Series([next(rows) if ok else None for ok in s.notna()], dtype=object)
            yield out

    return run


def approx_topk(
    queries: DataFrame, corpus: DataFrame, dim: int, k: int = 10, min_score: float = -1.0, tables: int = 8, bits: int = 6,
    seed: int = 7, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Neighbours among vectors that share a hash bucket, scored exactly.

    Random hyperplanes bucket both sides; recall is high but not complete. A
    bucket is cut into blocks of a bounded size that all meet the bucket's
    queries, so neither a hot bucket nor its pairs ever sit in one task.
    """
    bucket = _signatures(dim, tables, bits, seed)

    def bucketed(df: DataFrame, key: str) -> DataFrame:
        hashed = df.select(key, "vector", bucket(F.col("vector")).alias("_b"))
        rows = hashed.select(key, "vector", F.posexplode_outer("_b").alias("t", "b")).filter(F.col("t").isNotNull())
        return rows.select(key, "vector", F.concat_ws("/", "t", "b").alias("bucket"))

    left, right = bucketed(corpus, "id"), bucketed(queries, "query_id")
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / block_rows).cast("int")
    )
    left = attach(left, sizes, "bucket", "n", ["id"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    left = left.drop("n", "blocks")
    right = right.join(sizes, "bucket").select(
        "query_id", "vector", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    keys = ["bucket", "block"]

    def meet(pdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        return _best(pdf, qdf, None, k, min_score)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, _hit_schema(queries, corpus))
    # one neighbour may come from several tables
    return _merge(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)
