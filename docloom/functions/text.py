"""Text expressions: trimming, summaries, redaction, parsing, formatting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

CONTEXT_LIMIT = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a variable.

    An expression that is mentioned several times, above all inside a lambda,
    would be evaluated at every mention.
    """
    return F.transform(F.array(value), use).getItem(0)


def strip(c: Column) -> Column:
    """Trim all Unicode white space on both ends."""
    return F.trim(c, F.lit(fv.SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse every run of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"[{fv.SPACE_RANGES}]+", " "))


def words(c: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(c, f"[{fv.SPACE_RANGES}]+"), lambda w: w != "")


def summarize(c: Column, n: int = 500) -> Column:
    """White space collapsed, cut to ``n`` characters plus an ellipsis."""
    def cut(flat: Column) -> Column:
        return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit("...")))

    return let(squeeze(F.coalesce(c, F.lit(""))), cut)


def truncate_notice(c: Column, n: int = CONTEXT_LIMIT) -> Column:
    """Cut long snippets and say so."""
    notice = f"\n\n... [TRUNCATED - EXCEEDED {n} CHARS LIMIT]"
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(notice)))


def sanitize(c: Column) -> Column:
    """Drop NUL, unify line ends, allow at most one blank line, strip."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(""))
    c = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def infer_vendor(c: Column) -> Column:
    """First listed vendor found in the text, else a named one, else unknown."""
    low = F.lower(c)
    listed = [F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in fv.VENDORS]
    named = F.regexp_extract(low, r"(?:vendor|company|product by)\s*:\s*([\p{L}\p{N}_\-]+)", 1)
    return F.coalesce(*listed, F.nullif(named, F.lit("")), F.lit("unknown"))


def is_advisory(url: Column) -> Column:
    """True for pages on an official vendor-advisory domain."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(d)) for d in fv.ADVISORY_DOMAINS])


_FIELD_PATTERNS = {
    "cve_id": (r"(?i)(CVE-[0-9]{4}-[0-9]{4,7})", F.upper),
    "severity": (r"(?i)\b(critical|high|medium|low|info)\b", F.lower),
    "published_date": (r"([0-9]{4}-[0-9]{2}-[0-9]{2})", lambda c: c),
}


def metadata_text(metadata: Column) -> Column:
    """A map as searchable text, in entry order."""
    pair = lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(metadata), pair), ", "), F.lit("}"))


def parse_field(content: Column, metadata: Column | None, field: str) -> Column:
    """A metadata value when the key exists, else found in content + metadata."""
    hay = F.coalesce(content, F.lit(""))
    if metadata is not None:
        hay = F.concat(hay, F.lit(" "), F.coalesce(metadata_text(metadata), F.lit("{}")))
    found = F.lit(None).cast("string")
    if field in _FIELD_PATTERNS:
        pattern, norm = _FIELD_PATTERNS[field]
        found = norm(F.nullif(F.regexp_extract(hay, pattern, 1), F.lit("")))
    if metadata is None:
        return found
    return F.when(F.map_contains_key(metadata, F.lit(field)), metadata[field]).otherwise(found)


def redact(c: Column) -> Column:
    """Replace database passwords, then keys and bearer tokens, in order."""
    def urls(t: Column) -> Column:
        clean = F.regexp_replace(t, "(?i)" + fv.DB_URL_PATTERN, "$1[REDACTED]$3")
        return F.when(F.contains(t, F.lit("://")), clean).otherwise(t)

    c = let(c, urls)
    for pattern, repl in fv.SECRET_PATTERNS:
        c = F.regexp_replace(c, "(?i)" + pattern, repl)
    return c


def mask_pii(c: Column) -> Column:
    """E-mail addresses, numbers of five or more digits, long tokens."""
    # most texts have none of these, and a plain look is far cheaper
    def emails(t: Column) -> Column:
        masked = F.regexp_replace(t, r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+", "[EMAIL]")
        return F.when(F.contains(t, F.lit("@")), masked).otherwise(t)

    def numbers(t: Column) -> Column:
        return F.when(t.rlike("[0-9]{5}"), F.regexp_replace(t, r"(?U)\b[0-9]{5,}\b", "[NUM]")).otherwise(t)

    masked = let(let(c, emails), numbers)
    return F.regexp_replace(masked, r"[A-Za-z0-9_\-]{40,}", "[TOKEN]")


def coarse_path(c: Column) -> Column:
    """First path segment with ids replaced; ``root`` when there is none."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[0-9a-fA-F]{8,}", ":id")
    c = F.regexp_replace(c, r"\b[0-9]+\b", ":id")
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("root"))


def file_type(name: Column) -> Column:
    """Lower-case extension; ``txt`` for names without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("txt")


def local_part(email: Column) -> Column:
    return F.split(email, "@").getItem(0)


def citations(c: Column) -> Column:
    """Numbers cited as ``[n]``, in order of appearance."""
    return F.regexp_extract_all(c, F.lit(r"\[([0-9]+)\]"), 1)


def invalid_citations(c: Column, evidence: Column) -> Column:
    """Cited numbers that point at no evidence row."""
    # more than 18 digits cannot be a valid index and would overflow
    def bad(n: Column) -> Column:
        value = F.when(F.length(F.ltrim(n, F.lit("0"))) > 18, F.lit(2**62)).otherwise(n.cast("long"))
        return (value <= 0) | (value > evidence)

    return F.filter(citations(c), bad)


def code_block(c: Column) -> Column:
    """First fenced python block, else first bare block, else null."""
    named = F.regexp_extract(c, r"(?s)```python\s+(.*?)\s+```", 1)
    bare = F.regexp_extract(c, r"(?s)```\s+(.*?)\s+```", 1)
    return (
        F.when(c.rlike(r"(?s)```python\s+.*?\s+```"), strip(named))
        .when(c.rlike(r"(?s)```\s+.*?\s+```"), strip(bare))
    )


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\r\n|\n|\r")


def action_line(code: Column, n: int = 120) -> Column:
    """First line that calls the toolkit, else first non-comment line."""
    def pick(lines: Column) -> Column:
        call = F.try_element_at(F.filter(lines, lambda s: F.contains(s, F.lit("sdk."))), F.lit(1))
        plain = F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
        first = F.try_element_at(plain, F.lit(1))
        return F.coalesce(F.substring(call, 1, n), F.substring(first, 1, n), F.lit("(no action)"))

    return let(F.transform(_lines(code), strip), pick)


def outcome_line(returncode: Column, stdout: Column, stderr: Column, n: int = 120) -> Column:
    """Last printed line of a good run; first error line of a failed one."""
    err = F.when(F.coalesce(stderr, F.lit("")) == "", F.lit("error")).otherwise(_lines(stderr).getItem(0))
    full = F.filter(_lines(stdout), lambda s: strip(s) != "")
    last = F.try_element_at(full, F.lit(-1))
    return F.when(
        returncode != 0, F.concat(F.lit("FAILED: "), F.substring(err, 1, n))
    ).otherwise(F.coalesce(F.substring(last, 1, n), F.lit("OK (no output)")))


def enriched(title: Column, summary: Column, content: Column) -> Column:
    """Chunk text with its document's title and summary in front."""
    return F.concat(
        F.lit("# Document: "), title,
        F.lit("\n\n## Summary\n"), F.coalesce(F.nullif(summary, F.lit("")), F.lit("No summary available")),
        F.lit("\n\n## Content\n"), content,
    )


def placeholder_summary(text: Column) -> Column:
    """Summary used where no model is configured."""
    return F.concat(
        F.lit("Document with "), F.length(text).cast("string"),
        F.lit(" characters (LiteLLM Proxy not configured)"),
    )


def evidence_block(hits: Column) -> Column:
    """Numbered evidence text from an array of (title, content, page)."""
    def one(h: Column, i: Column) -> Column:
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), F.coalesce(h["title"], F.lit("Document")),
            F.lit(" (Page: "), F.coalesce(h["page"].cast("string"), F.lit("N/A")),
            F.lit(")\nContent: "), F.coalesce(h["content"], F.lit("")), F.lit("\n\n"),
        )

    return F.array_join(F.transform(hits, one), "")


_REFUSAL = (
    "I could not find enough information in the uploaded sources for this project to answer that confidently."
)
_CHECKED = "\n\nWhat was checked:\n- Relevant project document chunks\n- Recent chat context"


def refusal(files: Column) -> Column:
    """Refusal text naming the project's files in order."""
    listed = F.array_join(F.transform(F.array_sort(files), lambda f: F.concat(F.lit("- "), f)), "\n")
    none = (
        _REFUSAL + "\n\nThere are currently no documents uploaded to this project. "
        "Please upload documents first." + _CHECKED
    )
    some = F.concat(
        F.lit(_REFUSAL + "\n\nThe documents currently uploaded in this project are:\n"), listed,
        F.lit("\n\nPlease ask questions related to the content of these documents." + _CHECKED),
    )
    return F.when(F.coalesce(F.size(files), F.lit(0)) <= 0, F.lit(none)).otherwise(some)


def out_of_scope_score(reply: Column) -> Column:
    """``IN_SCOPE (0.95)`` style reply -> score; no reply (failed call) -> 0."""
    pattern = r"(?i)(IN_SCOPE|OUT_SCOPE)\s*\(\s*([0-9.]+)\s*\)"
    label = F.upper(F.regexp_extract(reply, pattern, 1))
    number = F.regexp_extract(reply, pattern, 2)
    conf = number.try_cast("double")
    return (
        F.when(reply.isNull(), F.lit(0.0))
        .when((label != "") & conf.isNull(), F.lit(0.0))
        .when(label == "IN_SCOPE", 1.0 - conf)
        .when(label == "OUT_SCOPE", conf)
        .when(F.contains(F.upper(reply), F.lit("IN_SCOPE")), F.lit(0.1))
        .when(F.contains(F.upper(reply), F.lit("OUT_SCOPE")), F.lit(0.9))
        .otherwise(F.lit(1.0))
    )


def unfence(c: Column) -> Column:
    """Drop one leading json/bare fence and one trailing fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), "^(?:```json)?(?:```)?", ""), "```$", ""))


def json_list(c: Column) -> Column:
    """Array of strings from a fenced JSON reply; anything else is empty."""
    return F.coalesce(F.from_json(unfence(c), "array<string>"), F.array().cast("array<string>"))


def flatten(c: Column) -> Column:
    return F.flatten(c)


def unique(c: Column) -> Column:
    return F.array_distinct(c)
