"""Predicates over text, files and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import strip


def injection_hits(c: Column) -> Column:
    """The prompt-injection patterns a text matches, in list order."""
    each = [F.when(c.rlike("(?i)" + p), F.lit(p)) for p in fv.INJECTION_PATTERNS]
    return F.array_compact(F.array(*each))


def injection_flag(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike("(?i)" + p) for p in fv.INJECTION_PATTERNS])


def is_greeting(c: Column) -> Column:
    """Blank, or nothing but a greeting or thanks."""
    low = F.lower(strip(c))
    return (low == "") | low.isin(fv.GREETINGS)


def message_ok(c: Column) -> Column:
    """Not blank and not longer than the message limit."""
    size = F.length(strip(F.coalesce(c, F.lit(""))))
    return (size > 0) & (size <= fv.MAX_MESSAGE_CHARS)


def message_problem(c: Column) -> Column:
    size = F.length(strip(F.coalesce(c, F.lit(""))))
    return (
        F.when(size == 0, F.lit("Message cannot be empty"))
        .when(size > fv.MAX_MESSAGE_CHARS, F.lit("Message is too long"))
        .otherwise(F.lit(""))
    )


def usable_content(text: Column, name: Column) -> Column:
    """More than 50 characters after trimming and not an error stub."""
    stub = F.concat(F.lit("# "), name, F.lit("\n\n[Error"))
    return (F.length(strip(F.coalesce(text, F.lit("")))) > 50) & ~F.startswith(text, stub)


def scoped_query(c: Column) -> Column:
    return F.contains(c, F.lit("site:")) | F.contains(c, F.lit("source:"))


def mentions_cve_year(c: Column) -> Column:
    return c.rlike(r"CVE-20(2[3-9]|[0-9]{2})")


def detected_type(content: Column) -> Column:
    """Media type from the first bytes; null when nothing fits."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(F.length(content) == 0, F.lit(None).cast("string"))
        .when(head == fv.MAGIC_PDF, F.lit("application/pdf"))
        .when(
            head.isin(fv.MAGIC_WORD),
            F.lit("application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
        )
        .when(F.is_valid_utf8(F.substring(content, 1, 100).cast("string")), F.lit("text/plain"))
    )


def file_extension(name: Column) -> Column:
    """Suffix with its dot in lower case, as a path library would give it."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_extract(base, r"[^.]\.*(\.[^.]+)$", 1))


def file_problem(content: Column, name: Column, max_bytes: int = fv.MAX_FILE_BYTES) -> Column:
    """Empty string for an acceptable upload, else why it is refused."""
    size = F.length(content)
    # every detectable type is an allowed one, so only size and suffix refuse
    return (
        F.when(size > max_bytes, F.lit("too_large"))
        .when(size == 0, F.lit("empty"))
        .when(~file_extension(name).isin(fv.ALLOWED_EXTENSIONS), F.lit("extension_not_allowed"))
        .otherwise(F.lit(""))
    )


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
