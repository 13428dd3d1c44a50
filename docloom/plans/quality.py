"""Extraction quality gate and choice between candidate extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import VALID_CHARS
from ..functions.text import let, strip

BOOK, SLIDE, SCAN = "DIGITAL_BOOK", "SLIDE_VISUAL", "SCANNED"
MB = 1024 * 1024
#: Runs of ASCII characters that are valid.
PLAIN = r"[ -~\n]+"
FACTS = ["total_chars", "text_density", "valid_char_ratio", "replacement_ratio", "size_to_text_ratio"]


def _by_profile(profile: Column, book, slide, scan, other) -> Column:
    return (
        F.when(profile == BOOK, F.lit(book)).when(profile == SLIDE, F.lit(slide))
        .when(profile == SCAN, F.lit(scan)).otherwise(F.lit(other))
    )


def assess(text: Column, pages: Column, size: Column, profile: Column) -> Column:
    """All quality facts of one text as a struct.

    Bad characters are counted by removing them from what is left without plain ASCII,
    which is mostly little and drops out in whole runs. Every step is bound once, so a filter on one of the facts repeats
    the work once at most, not once per mention.
    """
    def counts(both: Column) -> Column:
        rest, n = both["rest"], F.length(both["rest"])
        return F.struct(
            F.length(both["clean"]).alias("chars"),
            (n - F.length(F.regexp_replace(rest, f"[^{VALID_CHARS}]+", ""))).alias("invalid"),
            (n - F.length(F.replace(rest, F.lit("\ufffd"), F.lit("")))).alias("repl"),
        )

    def parted(clean: Column) -> Column:
        return F.struct(clean.alias("clean"), F.regexp_replace(clean, PLAIN, "").alias("rest"))

    def ratios(c: Column) -> Column:
        chars, some = c["chars"], F.greatest(F.lit(1), c["chars"])
        return F.struct(
            chars.alias("total_chars"),
            (chars / F.greatest(F.lit(1), F.coalesce(pages, F.lit(1)))).alias("text_density"),
            F.when(chars == 0, F.lit(0.0)).otherwise((chars - c["invalid"]) / some).alias("valid_char_ratio"),
            (c["repl"] / some).alias("replacement_ratio"),
            (size / some).alias("size_to_text_ratio"),
            ((size >= 3 * MB) & (chars < 300)).alias("heavy"),
        )

    def directive(r: Column) -> Column:
        density, chars = r["text_density"], r["total_chars"]
        empty = _by_profile(profile, "ESCALATE_TO_SLIDE_OCR", "ESCALATE_TO_FULL_OCR", "FALLBACK_PYPDF", "REJECT")
        # a heavy file with little text decides alone, even where it asks for nothing
        heavy = _by_profile(profile, "ESCALATE_TO_SLIDE_OCR", "ESCALATE_TO_FULL_OCR", "NONE", "NONE")
        return (
            F.when(chars == 0, empty)
            .when((r["valid_char_ratio"] < 0.65) | (r["replacement_ratio"] > 0.10), "FALLBACK_PYPDF")
            .when(r["heavy"], heavy)
            .when((profile == BOOK) & (density < 100), "ESCALATE_TO_SLIDE_OCR")
            .when((profile == SLIDE) & (density < 25) & (chars < 150), "ESCALATE_TO_FULL_OCR")
            .otherwise("NONE")
        )

    def score(r: Column) -> Column:
        validity = r["valid_char_ratio"] * (1 - F.least(F.lit(1.0), r["replacement_ratio"] * 5))
        fullness = F.least(F.lit(1.0), r["text_density"] / _by_profile(profile, 150.0, 60.0, 60.0, 60.0))
        return F.when(r["total_chars"] == 0, F.lit(0.0)).otherwise(0.5 * validity + 0.5 * fullness)

    def warnings(r: Column) -> Column:
        low = r["text_density"] < _by_profile(profile, 120.0, 30.0, 40.0, -1.0)
        found = F.array(
            F.when(r["replacement_ratio"] > 0.03, F.lit("font_encoding_errors")),
            F.when(r["valid_char_ratio"] < 0.75, F.lit("low_valid_char_ratio")),
            F.when(r["heavy"], F.lit("large_file_little_text")),
            F.when(low, F.lit("low_text_density")),
        )
        return F.when(r["total_chars"] == 0, F.array(F.lit("empty_text"))).otherwise(F.array_compact(found))

    def verdict(r: Column) -> Column:
        def full(s: Column) -> Column:
            ok = (
                (F.round(s["score"], 2) >= 0.40) & (r["valid_char_ratio"] >= 0.70)
                & (r["total_chars"] >= 40) & (s["action"] == "NONE")
            )
            return F.struct(
                *[r[c].alias(c) for c in FACTS], s["score"].alias("quality_score"), warnings(r).alias("warnings"),
                s["action"].alias("action"), ok.alias("is_acceptable"),
            )

        return let(F.struct(score(r).alias("score"), directive(r).alias("action")), full)

    clean = strip(F.coalesce(text, F.lit("")))
    return let(clean, lambda t: let(parted(t), lambda b: let(counts(b), lambda c: let(ratios(c), verdict))))


def quality(
    df: DataFrame, text: str = "text", pages: str = "pages", size: str = "file_size", profile: str = "profile"
) -> DataFrame:
    """Adds total_chars, text_density, valid_char_ratio, replacement_ratio,
    size_to_text_ratio, quality_score (unrounded), warnings, action and
    is_acceptable."""
    facts = assess(F.col(text), F.col(pages), F.col(size), F.col(profile))
    return df.withColumn("_q", facts).select(*df.columns, "_q.*")


def choose_extraction(candidates: DataFrame) -> DataFrame:
    """The text each document ends up with after escalation.

    ``candidates``: document_id, profile (one row per profile tried, plus
    ``RAW``), text, pages, file_size and ``start_profile``. Up to three tries:
    accepted text ends the walk; a book may escalate to slides, slides to a
    full scan; broken encoding takes the raw text when it is longer.
    """
    graded = quality(candidates).withColumnRenamed("total_chars", "stripped")  # the length without white space at both ends
    graded = graded.withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    facts = F.struct("profile", "action", "is_acceptable", "chars", "stripped")
    # at most four rows per document, and no text among them
    wide = graded.groupBy("document_id").agg(
        F.first("start_profile").alias("_p1"), F.collect_list(facts).alias("_facts")
    )

    def facts_of(profile: Column) -> Column:
        return F.try_element_at(F.filter("_facts", lambda f: f["profile"] == profile), F.lit(1))

    def following(profile: Column) -> Column:
        f = facts_of(profile)
        to_slide = (f["action"] == "ESCALATE_TO_SLIDE_OCR") & (profile != SLIDE)
        to_scan = (f["action"] == "ESCALATE_TO_FULL_OCR") & (profile != SCAN)
        return F.when(f["is_acceptable"], profile).when(to_slide, F.lit(SLIDE)).when(to_scan, F.lit(SCAN)).otherwise(profile)

    w = wide.withColumn("_p2", following(F.col("_p1")))
    w = w.withColumn("_p3", following(F.col("_p2")))
    w = w.withColumns({"_last": facts_of(F.col("_p3")), "_raw": facts_of(F.lit("RAW"))})
    longer = F.coalesce("_raw.stripped", F.lit(0)) > F.coalesce("_last.chars", F.lit(0))
    raw = ~F.col("_last.is_acceptable") & (F.col("_last.action") == "FALLBACK_PYPDF") & longer
    tries = 1 + (F.col("_p2") != F.col("_p1")).cast("int") + (F.col("_p3") != F.col("_p2")).cast("int")
    chosen = w.select(
        "document_id", F.when(raw, F.lit("RAW")).otherwise(F.col("_p3")).alias("profile"), tries.alias("attempts"),
        F.when(raw, F.col("_raw.is_acceptable")).otherwise(F.col("_last.is_acceptable")).alias("accepted"),
    )
    return chosen.join(candidates.select("document_id", "profile", "text"), ["document_id", "profile"])
