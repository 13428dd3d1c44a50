"""Statistics, facets, quotas, histograms, step reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .skew import running_sum
from ..functions.text import file_type
from .query import visible

_COMPLETED = ["completed", "completed_with_warnings"]
_PROCESSING = ["processing", "parsing", "chunking", "embedding", "indexing"]
_FAILED = ["failed", "error"]


def run_counts(runs: DataFrame, since: Column | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Runs per user that were created since a time and are in a status."""
    rows = visible(runs)
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("created_at") >= since)
    if statuses:
        keep = keep & F.col("status").isin(statuses)
    return rows.groupBy("user_id").agg(F.count_if(keep).alias("runs"))


def status_bucket(status: Column, strict: bool = False) -> Column:
    """Four-way status; ``strict`` sends every other status to pending, else
    ready and partially available documents count as completed."""
    done = _COMPLETED if strict else [*_COMPLETED, "ready", "partially_available"]
    return (
        F.when(status.isin(done), "completed").when(status.isin(_PROCESSING), "processing")
        .when(status.isin(_FAILED), "failed").otherwise("pending")
    )


def project_stats(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Documents, chunks, bytes, status buckets and last update per project."""
    bucket = status_bucket(F.col("status"), strict)
    return visible(docs).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.sum(F.coalesce("chunk_count", F.lit(0))).alias("total_chunks"),
        F.sum(F.coalesce("file_size_bytes", F.lit(0))).alias("total_size_bytes"),
        *[F.count_if(bucket == b).alias(b) for b in ("completed", "processing", "failed", "pending")],
        F.max("updated_at").alias("last_synced_at"),
    )


def dedup_ratio(links: DataFrame, by: str = "project_id", chunk: str = "chunk_hash") -> DataFrame:
    """Share and number of chunk links that storing each chunk once saves.

    Two levels: first per (group, chunk), so a hot group is spread.
    """
    per_chunk = links.groupBy(by, chunk).agg(F.count(F.lit(1)).alias("n"))
    return per_chunk.groupBy(by).agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("chunks")).select(
        by, "links", "chunks", (F.col("links") - F.col("chunks")).alias("saved_chunks"),
        (1 - F.col("chunks") / F.col("links")).alias("dedup_ratio"),
    )


def quota(docs: DataFrame, incoming: DataFrame, limit_bytes: int = fv.QUOTA_BYTES) -> DataFrame:
    """Whether each new file fits its user's quota in the project."""
    keys = ["user_id", "project_id"]
    used = visible(docs).groupBy(*keys).agg(F.sum("storage_size_bytes").alias("used_bytes"))
    out = incoming.join(used, keys, "left").withColumn("used_bytes", F.coalesce("used_bytes", F.lit(0)))
    over = (F.col("used_bytes") > limit_bytes) | (F.col("used_bytes") + F.col("file_size") > limit_bytes)
    return out.withColumn("would_exceed", over)


def facets(docs: DataFrame, owner: str) -> DataFrame:
    """Facet buckets of a search: types count documents, the rest paragraphs.

    ``docs``: file_name and ``paragraphs`` (array).
    """
    per_type = docs.groupBy(file_type(F.col("file_name")).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    types = per_type.select(F.lit("document_types").alias("facet"), "key", "count")
    rows = docs.agg(F.coalesce(F.sum(F.size("paragraphs")), F.lit(0)).alias("count"))
    fixed = F.array(*[
        F.struct(F.lit(f).alias("facet"), F.lit(k).alias("key"))
        for f, k in (("data_sources", "local"), ("owners", owner), ("connector_types", "local"))
    ])
    return types.unionByName(rows.select(F.inline(fixed), "count").select("facet", "key", "count"))


def turn_scores(hits: DataFrame, by: list[str]) -> DataFrame:
    """Mean hit score and number of hits per turn."""
    return hits.groupBy(*by).agg(F.avg("score").alias("retrieval_score"), F.count("score").alias("evidence_count"))


def calls_per_turn(ops: DataFrame) -> DataFrame:
    return ops.groupBy("task_id", "turn_number").agg(F.count(F.lit(1)).alias("sdk_calls"))


def with_end_time(ops: DataFrame) -> DataFrame:
    """Start and end (start + duration) of every operation."""
    span = F.make_dt_interval(secs=F.col("duration_ms") / 1000)
    return ops.withColumn("started_at", F.col("created_at")).withColumn("ended_at", F.col("created_at") + span)


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts per upper bound, with +Inf, count and sum.

    One pass: all bounds are counted in the same aggregate and only the few
    aggregated rows are unfolded.
    """
    by = by or []
    edges = [*bounds, float("inf")]
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(edges)]
    agg = df.groupBy(*by).agg(*counts, F.sum(value).alias("total"))
    cells = F.array(*[
        F.struct(F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(edges)
    ])
    return agg.select(*by, F.inline(cells), "total")


def counters(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts per key combination with a text line each; missing = unknown."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    named = F.concat_ws(", ", *[F.concat(F.lit(f"'{c}': '"), F.col(c), F.lit("'")) for c in by])
    line = F.concat(F.lit("{"), named, F.lit("}: "), F.col("pages").cast("string"), F.lit(" pages"))
    return counts.withColumn("line", line)


def step_report(history: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: steps done, tries, next step, resumable step.

    ``history``: key, step, action (started/completed/failed), ts. A step's
    last action decides; the next step is the first pending or failed one.
    """
    last = history.groupBy(key, "step").agg(
        F.max_by("action", "ts").alias("action"), F.count_if(F.col("action") == "failed").alias("tries")
    )
    n = len(fv.STEPS)
    order = F.array_position(F.array(*[F.lit(s) for s in fv.STEPS]), F.col("step"))
    done = F.when(F.col("action") == "completed", order)
    busy = F.when(F.col("action") == "started", order)
    agg = last.groupBy(key).agg(
        F.array_sort(F.collect_set(done)).alias("_done"),
        F.collect_set(busy).alias("_busy"),
        F.sum("tries").alias("tries"),
        F.max_by("step", F.when(F.col("action") == "failed", order)).alias("failed_step"),
    )
    every = F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))
    open_steps = F.array_except(F.array_except(every, F.col("_done")), F.col("_busy"))
    undone = F.array_except(every, F.col("_done"))
    name = lambda pos: F.try_element_at(F.array(*[F.lit(s) for s in fv.STEPS]), pos.cast("int"))
    return agg.select(
        key,
        F.size("_done").alias("steps_done"), "tries", "failed_step",
        name(F.array_min(open_steps)).alias("next_step"),
        # everything before the first step that is not done is done
        name(F.array_min(undone)).alias("resume_from"),
    )


def sample_pages(pages: DataFrame, doc: str = "document_id", limit: int = 15) -> DataFrame:
    """Every ``max(1, total // limit)``-th page, the first ``limit`` of them.

    ``page_no`` gives the order only and may have gaps; a page's position is its rank, counted
    in runs of 1000 page numbers so that a document of any length spreads over tasks. Pages without
    a document are one document's, those without a number stand last.
    """
    # a struct is never null, so rows without a document meet their totals in the joins below
    key, columns = "_doc", pages.columns
    pages = pages.withColumns({key: F.struct(doc), "_last": F.col("page_no").isNull().cast("int")})
    totals = pages.groupBy(key).agg(F.count("*").alias("total_pages"))
    step = F.greatest(F.lit(1), F.floor(F.col("total_pages") / limit)).cast("int")
    run = F.coalesce(F.floor(F.col("page_no") / 1000), F.lit((1 << 63) - 1))
    ranked = running_sum(pages.withColumn("_one", F.lit(1)), [key], ["_last", "page_no"], "_one", "_rank", run)
    pos = F.col("_rank") - 1
    sampled = ranked.join(totals, key).filter((pos % step == 0) & (pos / step < limit))
    return sampled.select(*columns, "total_pages")


def profile_documents(sampled: DataFrame, doc: str = "document_id") -> DataFrame:
    """SCANNED, SLIDE_VISUAL or DIGITAL_BOOK per document from sampled pages."""
    low = F.lower(F.coalesce("file_name", F.lit("")))
    keyword = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in fv.SLIDE_KEYWORDS])
    agg = sampled.groupBy(doc).agg(
        F.sum("text_chars").alias("chars"),
        F.avg("text_chars").alias("avg_chars"),
        F.avg(((F.col("height") > 0) & (F.try_divide("width", "height") >= 1.15)).cast("double")).alias("landscape"),
        F.avg(F.col("has_image").cast("double")).alias("images"),
        F.max("total_pages").alias("total_pages"),
        F.bool_or(keyword).alias("keyword"),
    )
    landscape, images, avg = F.coalesce("landscape", F.lit(0.0)), F.col("images"), F.col("avg_chars")
    profile = (
        F.when((F.col("chars") < 40) & ((images > 0.4) | (F.col("total_pages") <= 3)), "SCANNED")
        .when(landscape >= 0.5, "SLIDE_VISUAL")
        .when(F.col("keyword") & ((images > 0.15) | (avg < 550)), "SLIDE_VISUAL")
        .when((images >= 0.4) & (avg < 350), "SLIDE_VISUAL")
        .otherwise("DIGITAL_BOOK")
    )
    return agg.withColumn("profile", profile)


def outcome_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, completed share and mean times per group."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg((F.col("status") == "completed").cast("double")).alias("completed_share"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


def run_quantiles(runs: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Runs, completed share and exact quantiles of duration and time to first delta per group.

    ``runs``: status, duration_ms, first_delta_ms. A first delta of 0 or null means that none came and
    does not count. Quantiles interpolate between ranks; equal values are counted before the shuffle.
    """
    delta = F.when(F.col("first_delta_ms") > 0, F.col("first_delta_ms"))
    name = lambda kind, q: f"{kind}_p{q * 100:g}"
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg((F.col("status") == "completed").cast("double")).alias("completed_share"),
        F.count(delta).alias("answered"),
        *[F.percentile("duration_ms", F.lit(q)).alias(name("duration", q)) for q in shares],
        *[F.percentile(delta, F.lit(q)).alias(name("first_delta", q)) for q in shares],
    )


def first_deltas(runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds ``first_delta_ms``: from a run's start to its first delta, 0 where none came.

    ``runs``: run_id, started_at; ``deltas``: run_id, ts. Deltas before the start do not count. Only
    the earliest delta of a run leaves a task.
    """
    first = deltas.groupBy("run_id").agg(F.min("ts").alias("_first"))
    joined = runs.join(first, "run_id", "left")
    spent = F.floor((F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000)
    return joined.withColumn("first_delta_ms", F.greatest(F.coalesce(spent, F.lit(0)), F.lit(0))).drop("_first")


def quantile_sketches(runs: DataFrame, by: list[str], value: str, window: str = "1 hour", k: int = 200) -> DataFrame:
    """One KLL sketch of ``value`` per window and group: a few hundred numbers, whatever the rows.

    Sketches of windows merge into those of any longer time, so a table of them answers for a day or
    a month without the runs. ``k`` sets the size; at 200 a rank is off by about 1.3 % at most.
    """
    w = F.window("ts", window)["start"].alias("window_start")
    return runs.groupBy(w, *by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles per group from merged sketches; groups without a value are left out."""
    merged = sketches.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{q * 100:g}") for q in shares]
    return merged.select(*by, "n", *found)


def feedback_rollup(feedback: DataFrame, by: list[str]) -> DataFrame:
    """Votes, positive share, comments and the counts of each reason tag per group.

    ``feedback``: is_positive, reason_tags (comma-separated), comment. Tags are trimmed and counted
    once per vote; ``tags`` is a map from tag to votes, empty where none was given.
    """
    split = F.transform(F.split(F.coalesce("reason_tags", F.lit("")), ","), lambda t: F.trim(t))
    tags = F.array_distinct(F.filter(split, lambda t: t != ""))
    votes = feedback.withColumn("_tags", tags)
    totals = votes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("votes"), F.avg(F.col("is_positive").cast("double")).alias("positive_share"),
        F.count_if(F.length(F.trim(F.coalesce("comment", F.lit("")))) > 0).alias("comments"),
    )
    counted = votes.select(*by, F.explode("_tags").alias("_tag")).groupBy(*by, "_tag").agg(F.count(F.lit(1)).alias("_n"))
    listed = counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_tag", "_n")))).alias("tags"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    empty = F.create_map().cast("map<string,bigint>")
    return totals.alias("a").join(listed.alias("b"), same, "left").select("a.*", F.coalesce("b.tags", empty).alias("tags"))


def cost_rollup(ops: DataFrame, cost: Column, by: list[str]) -> DataFrame:
    """Tokens and USD per group."""
    return ops.withColumn("_cost", cost).groupBy(*by).agg(
        F.sum("tokens").alias("tokens"), F.sum("_cost").alias("cost_usd")
    )


