"""Chunking expressions: text in, array of chunks out, no shuffle.

Packing is a fold over the array of pieces that records only where a chunk
starts; chunks are then cut out with ``slice``. The state of the fold is two
integers and the start list, so a long text costs no repeated string copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import PAGE_MARKER, SPACE_RANGES
from .text import let, strip, words


def fixed(c: Column, size: int = 512) -> Column:
    """Consecutive slices of ``size`` characters, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def _starts(pieces: Column, begins: Callable, grow: Callable) -> Column:
    """Positions (from 0) at which a new group of pieces begins.

    ``begins(state, piece, i)`` decides on a break before piece ``i``;
    ``grow(state, piece, broke)`` gives the next value of ``state.size``.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("i")
    )

    def step(state: Column, piece: Column) -> Column:
        broke = (state["i"] == 0) | begins(state, piece)
        return F.struct(
            F.when(broke, F.array_append(state["starts"], state["i"])).otherwise(state["starts"]).alias("starts"),
            grow(state, piece, broke).cast("int").alias("size"),
            (state["i"] + 1).alias("i"),
        )

    return F.aggregate(pieces, start, step, lambda s: s["starts"])


def _groups(pieces: Column, starts: Column) -> Column:
    """Split ``pieces`` into arrays at ``starts``."""
    def cut(s: Column) -> Column:
        ends = F.array_append(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.size(pieces))
        # without any piece there is one end but no start
        return F.slice(F.zip_with(s, ends, lambda a, b: F.slice(pieces, a + 1, b - a)), 1, F.size(s))

    return let(starts, cut)


def sentences(c: Column) -> Column:
    """Split after ., ! or ? followed by spaces."""
    return F.split(strip(c), r"(?<=[.!?]) +")


def sentence(c: Column, size: int = 512) -> Column:
    """Whole sentences packed up to ``size``; a longer one stands alone."""
    def pack(pieces: Column) -> Column:
        starts = _starts(
            F.transform(pieces, F.length),
            begins=lambda s, n: s["size"] + n > size,
            # a chunk opened by overflow starts at its sentence's bare length
            grow=lambda s, n, broke: F.when(s["size"] + n > size, n).otherwise(s["size"] + n + 1),
        )
        return F.transform(_groups(pieces, starts), lambda g: F.array_join(g, " "))

    return F.when(F.length(c) > 0, let(sentences(c), pack)).otherwise(F.array().cast("array<string>"))


def paragraph(c: Column, size: int = 512) -> Column:
    """Paragraphs packed up to ``size``; a longer one becomes sentence chunks."""
    def render(group: Column) -> Column:
        first = group.getItem(0)
        return F.when(F.length(first) > size, sentence(first, size)).otherwise(
            F.array(F.array_join(group, "\n\n"))
        )

    def pack(pieces: Column) -> Column:
        # a piece that overflows on its own leaves a negative size behind,
        # which makes the following piece open a new group
        starts = _starts(
            F.transform(pieces, F.length),
            begins=lambda s, n: (s["size"] < 0) | (s["size"] + n > size),
            grow=lambda s, n, broke: F.when(n > size, F.lit(-1))
            .when((s["size"] >= 0) & (s["size"] + n > size), n)
            .otherwise(F.greatest(s["size"], F.lit(0)) + n + 2),
        )
        return F.flatten(F.transform(_groups(pieces, starts), render))

    pieces = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")
    return F.when(F.length(c) > 0, let(pieces, pack)).otherwise(F.array().cast("array<string>"))


def chunk(c: Column, strategy: str = "paragraph", size: int = 512) -> Column:
    """Array of chunks by strategy: ``fixed``, ``sentence`` or ``paragraph``."""
    if strategy == "fixed":
        return fixed(c, size)
    if strategy == "sentence":
        return sentence(c, size)
    return paragraph(c, size)


def prose_sentences(c: Column) -> Column:
    """Sentences within paragraphs, trimmed, none empty."""
    paras = F.filter(F.transform(F.split(strip(c), "\n\n+"), strip), lambda p: p != "")
    cut = lambda p: F.transform(F.split(p, f"(?<=[.!?])[{SPACE_RANGES}]+"), strip)
    return F.filter(F.flatten(F.transform(paras, cut)), lambda s: s != "")


def break_threshold(sims: Column, pct: float = 0.25) -> Column:
    """Percentile of adjacent similarities, linear, kept within [0.1, 0.9]."""
    pos = (F.size(sims) - 1) * F.lit(pct)
    low = F.floor(pos).cast("int")

    def between(ranked: Column) -> Column:
        a = F.try_element_at(ranked, low + 1)
        b = F.coalesce(F.try_element_at(ranked, low + 2), a)
        return F.round(a + (b - a) * (pos - low), 9)

    value = F.least(F.lit(0.9), F.greatest(F.lit(0.1), let(F.array_sort(sims), between)))
    return F.when(F.size(sims) == 0, F.lit(0.75)).otherwise(value)


def group_by_similarity(
    pieces: Column, sims: Column, threshold: Column, max_size: int = 1000, min_size: int = 100
) -> Column:
    """Join sentences until meaning or size asks for a break.

    ``sims`` holds the similarity of each sentence to the one before it.
    """
    def pack(p: Column, limit: Column) -> Column:
        paired = F.zip_with(
            F.transform(p, F.length),
            F.concat(F.array(F.lit(1.0)), sims),
            lambda n, s: F.struct(n.alias("n"), s.alias("sim")),
        )

        def begins(s: Column, x: Column) -> Column:
            return (s["size"] >= min_size) & ((x["sim"] < limit) | (s["size"] + x["n"] + 2 > max_size))

        starts = _starts(
            paired, begins, grow=lambda s, x, broke: F.when(broke, x["n"]).otherwise(s["size"] + 1 + x["n"])
        )
        return F.transform(_groups(p, starts), lambda g: F.array_join(g, " "))

    return let(pieces, lambda p: let(threshold, lambda t: pack(p, t)))


def size_rules(chunks: Column, min_size: int = 100, overlap_words: int = 200) -> Column:
    """Drop short chunks unless all are short; prefix the previous one's tail."""
    def tail(text: Column) -> Column:
        def last(w: Column) -> Column:
            return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - overlap_words + 1), overlap_words), " ")

        return let(words(text), last)

    def overlapped(kept: Column) -> Column:
        # pair every chunk with the one before it; the first has none
        first = F.array(F.lit(None).cast("string"))
        before = F.concat(first, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        return F.zip_with(
            kept, before, lambda c, p: F.when(p.isNull(), c).otherwise(F.concat(tail(p), F.lit(" "), c))
        )

    def rules(all_chunks: Column) -> Column:
        def choose(kept: Column) -> Column:
            return F.when(F.size(kept) == 0, all_chunks).when(F.size(kept) == 1, kept).otherwise(overlapped(kept))

        return let(F.filter(all_chunks, lambda c: F.length(c) >= min_size), choose)

    return let(chunks, rules)


def search_paragraphs(text: Column, name: Column, usable: Column, fallback: Column, count: Column) -> Column:
    """Paragraphs over 20 characters; else the fallback text once per chunk."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 20)
    repeat = F.array_repeat(fallback, F.greatest(F.coalesce(count, F.lit(0)), F.lit(1)).cast("int"))
    return let(parts, lambda p: F.when(usable & (F.size(p) > 0), p).otherwise(repeat))


def page_marker(c: Column) -> Column:
    """Page number named by a marker in the text, else null."""
    groups = [F.nullif(F.regexp_extract(c, PAGE_MARKER, g), F.lit("")) for g in (1, 2, 3)]
    return F.when(F.rlike(c, F.lit(PAGE_MARKER)), F.coalesce(*groups).try_cast("int"))


def explode_pieces(df: DataFrame, cols: list[str], pieces: Column, index: str, name: str) -> DataFrame:
    """One row per array element with its position.

    The plain generator would make the optimizer repeat the whole array
    expression in a filter for non-empty arrays; the outer one does not, and
    its null row is dropped afterwards.
    """
    rows = df.select(*cols, F.posexplode_outer(pieces).alias(index, name))
    return rows.filter(F.col(index).isNotNull())


def carried_pages(chunks: Column) -> Column:
    """Page of each chunk of one text: the last marker so far, else 1."""
    start = F.struct(F.array().cast("array<int>").alias("pages"), F.lit(1).alias("page"))

    def step(state: Column, marker: Column) -> Column:
        page = F.coalesce(marker, state["page"])
        return F.struct(F.array_append(state["pages"], page).alias("pages"), page.alias("page"))

    return F.aggregate(F.transform(chunks, page_marker), start, step, lambda s: s["pages"])
