"""Ranking, conversation context, stop states, page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.chunking import page_marker
from ..functions.text import words


def rank(df: DataFrame, top_k: int = 20, by: str | None = None, score: str = "score", pos: str = "pos") -> DataFrame:
    """Best ``top_k`` rows by score (stable by ``pos``), overall or per group."""
    order = [F.desc_nulls_last(score), F.col(pos)]
    if by is None:
        return df.orderBy(*order).limit(top_k)
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def rerank(
    hits: DataFrame, method: str = "hybrid", top_k: int = 20, weight: float = 0.5, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """Best hits per query by ``semantic``, ``bm25`` or ``hybrid`` score.

    ``hits``: query_id, query, id, content, score. Word statistics are those
    of each query's own hit list. Terms are counted inside the hit's row, so
    the data grows by the words of the query only. ``hybrid`` is a weighted
    sum of both scores, each scaled to [0, 1] within its query.
    """
    per_query = Window.partitionBy("query_id")
    scored = hits.withColumn("lex", F.lit(0.0))
    if method != "semantic":
        rows = hits.select(
            "query_id", "id", F.struct(*hits.columns).alias("hit"), F.array_distinct(words(F.lower("query"))).alias("q"),
            words(F.lower(F.coalesce("content", F.lit("")))).alias("w"),
        )
        tf = lambda t: F.struct(t.alias("term"), (F.size("w") - F.size(F.array_remove("w", t))).alias("tf"))
        rows = rows.withColumns({"size": F.size("w"), "terms": F.transform("q", tf)}).drop("q", "w")
        rows = rows.withColumns({"n": F.count(F.lit(1)).over(per_query), "mean": F.avg("size").over(per_query)})
        # one row per query word; the hit itself rides on the first of them
        parts = rows.select("query_id", "id", "size", "n", "mean", "hit", F.posexplode_outer("terms").alias("pos", "e"))
        parts = parts.withColumn("hit", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("hit")))
        parts = parts.withColumn("df", F.count_if(F.col("e.tf") > 0).over(Window.partitionBy("query_id", "e.term")))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = F.col("e.tf") * (k1 + 1) / (F.col("e.tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
        summed = parts.groupBy("query_id", "id").agg(
            F.sum(F.when(F.col("e.tf") > 0, idf * gain).otherwise(0.0)).alias("lex"), F.first("hit", True).alias("hit")
        )
        scored = summed.select("hit.*", "lex")
    if method == "hybrid":
        def scaled(c: str) -> Column:
            low, high = F.min(c).over(per_query), F.max(c).over(per_query)
            return F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low))

        scored = scored.withColumn("_rank_score", weight * scaled("lex") + (1 - weight) * scaled("score"))
    else:
        scored = scored.withColumn("_rank_score", F.col("lex" if method == "bm25" else "score"))
    scored = scored.withColumn("rank_score", F.round("_rank_score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select(
        *hits.columns, "rank_score", *([] if "rank" in hits.columns else ["rank"])
    )


def context(messages: DataFrame, head_chars: Column | None = None, limit: int = fv.HISTORY_MESSAGES,
            budget: int = fv.HISTORY_CHARS) -> DataFrame:
    """Messages that fit into the prompt of each session.

    The last ``limit`` completed messages in time order; one that would break
    the character budget is skipped and the walk goes on. At most ``limit``
    rows per session are gathered. ``messages``: session_id, seq, role,
    content; ``head_chars`` is the size already used.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    recent = messages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    item = F.struct("seq", "role", F.length(F.coalesce("content", F.lit(""))).alias("n"))
    used = head_chars if head_chars is not None else F.lit(0)
    gathered = recent.groupBy("session_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.max(used).cast("long").alias("used")
    )

    def step(state: Column, m: Column) -> Column:
        fits = state["used"] + m["n"] <= budget
        return F.struct(
            F.when(fits, state["used"] + m["n"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.array_append(state["kept"], m["seq"])).otherwise(state["kept"]).alias("kept"),
        )

    start = F.struct(F.col("used"), F.array().cast("array<long>").alias("kept"))
    kept = gathered.select("session_id", F.explode(F.aggregate("items", start, step, lambda s: s["kept"])).alias("seq"))
    return recent.drop("_rn").join(kept, ["session_id", "seq"], "left_semi")


def stop_states(turns: DataFrame, max_turns: int = 10) -> DataFrame:
    """Counters and stop reason of every agent turn.

    ``turns``: task_id, turn_number, returncode, sdk_calls, evidence_count,
    retrieval_score, coverage, confidence. A task has at most a few turns.
    """
    w = Window.partitionBy("task_id").orderBy("turn_number")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("_prev", F.lag("coverage").over(w))
    # turn 2 on: no gain continues a run of stagnation, a gain starts over
    t = t.withColumn("_stuck", (F.col("turn_number") > 1) & (F.col("coverage") <= F.coalesce("_prev", F.lit(0.0))))
    t = t.withColumn("_run", F.count_if((F.col("turn_number") > 1) & ~F.col("_stuck")).over(run))
    in_run = Window.partitionBy("task_id", "_run").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("stagnation", F.count_if("_stuck").over(in_run))
    searched = F.col("sdk_calls") > 0
    none = searched & (F.col("evidence_count") == 0)
    low = searched & (F.col("evidence_count") > 0) & (F.col("retrieval_score") < 0.25)
    t = t.withColumn("low_retrieval", F.count_if(low).over(run))
    failed = F.col("returncode") != 0
    t = t.withColumn("_failed3", F.count_if(failed).over(w.rowsBetween(-2, 0)))
    met = (F.col("coverage") >= 0.90) & (F.col("confidence") >= 0.80)
    early = none | (low & (F.col("low_retrieval") >= 2))
    reason = (
        F.when(F.col("stagnation") >= 3, "stagnated")
        .when(F.col("_failed3") >= 3, "repeated_tool_failures")
        .when(early, "insufficient_evidence")
        .when(met, "completed")
        .when(F.col("turn_number") >= max_turns, "insufficient_evidence")
    )
    return t.withColumn("stop_reason", reason).withColumn("is_complete", reason.isNotNull()).drop(
        "_prev", "_stuck", "_run", "_failed3"
    )


def page_numbers(chunks: DataFrame) -> DataFrame:
    """Page of each chunk: the last marker at or before it, else 1."""
    w = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.last(page_marker(F.col("content")), ignorenulls=True).over(w)
    return chunks.withColumn("page_number", F.coalesce(marked, F.lit(1)))


def adjacent(df: DataFrame, doc: str, idx: str, vector: str) -> DataFrame:
    """Previous vector of the same document next to each row's own."""
    w = Window.partitionBy(doc).orderBy(idx)
    return df.withColumn("previous", F.lag(vector).over(w))


def working_memory(turns: DataFrame, max_turns: int = 10) -> DataFrame:
    """Text that a task's next turn starts from, after each turn.

    ``turns``: task_id, turn_number, directive, action, outcome, last_error.
    The history is that of all turns so far; ``max_turns`` is named in the heading only.
    """
    w = Window.partitionBy("task_id").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat(
        F.lit("  Turn "), F.col("turn_number").cast("string"), F.lit(":\n    Action: "), F.col("action"),
        F.lit("\n    Outcome: "), F.col("outcome"),
    )
    text = F.concat(
        F.lit("--- WORKING MEMORY (Turn "), (F.col("turn_number") + 1).cast("string"), F.lit(f"/{max_turns}) ---\n"),
        F.lit("Original User Directive: "), F.col("directive"), F.lit("\n\nPrevious Turns History:\n"),
        F.array_join(F.collect_list(line).over(w), "\n"),
        F.coalesce(
            F.concat(F.lit("\n\n[WARNING] Last execution encountered an error:\n  "), F.substring("last_error", 1, 500)),
            F.lit(""),
        ),
    )
    return turns.withColumn("memory", text)


def _quoted(c: Column) -> Column:
    """A text as a list shows it: in single quotes, or in double ones where it holds only single ones."""
    plain = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(plain, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(single)


def turn_brief(tasks: DataFrame, turns: DataFrame, max_turns: int = 10) -> DataFrame:
    """What each task's next turn is told: directive, constraints, history, state files, last error, instructions.

    ``tasks``: task_id, directive, constraints (array), state_files (array); ``turns``: task_id,
    turn_number, action, outcome, last_error. One row per task, also for one without turns. Parts that
    are null or empty are left out; the error is that of the last turn. Turns are gathered per task,
    whose brief holds them all by definition.
    """
    line = F.concat(
        F.lit("  Turn "), F.col("turn_number").cast("string"), F.lit(":\n    Action: "), F.coalesce("action", F.lit("")),
        F.lit("\n    Outcome: "), F.coalesce("outcome", F.lit("")),
    )
    history = turns.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_number", line.alias("line")))).alias("_lines"),
        F.count(F.lit(1)).alias("_turns"),
        F.max_by(F.struct("last_error"), "turn_number").alias("_last"),
    )
    told = F.concat(F.lit("\nPrevious Turns History:\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"))
    rules = F.transform("constraints", lambda c: F.concat(F.lit("  - "), c))
    files = F.array_join(F.transform(F.coalesce("state_files", F.array().cast("array<string>")), _quoted), ", ")
    error = F.nullif(F.col("_last.last_error"), F.lit(""))
    parts = F.array(
        F.concat(F.lit("--- WORKING MEMORY (Turn "), (F.coalesce("_turns", F.lit(0)) + 1).cast("string"), F.lit(f"/{max_turns}) ---")),
        F.concat(F.lit("Original User Directive: "), F.coalesce("directive", F.lit(""))),
        F.when(F.size("constraints") > 0, F.concat(F.lit("Constraints:\n"), F.array_join(rules, "\n"))),
        F.coalesce(told, F.lit("\n" + fv.NO_TURNS)),
        F.concat(F.lit("\n" + fv.FILES_HEAD), F.lit("["), files, F.lit("]")),
        F.lit(fv.FILES_HINT),
        F.concat(F.lit("\n[WARNING] Last execution encountered an error:\n  "), error),
        F.lit("\n" + fv.NEXT_STEP),
    )
    return tasks.join(history, "task_id", "left").select(*tasks.columns, F.array_join(parts, "\n").alias("memory"))
