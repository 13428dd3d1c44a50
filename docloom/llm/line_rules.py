"""Quality rules, line first: bad lines go, then documents that lost too much text."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

# fixed values
SYMBOLS = "#*$%&|<>"
#: Share of a line's characters that may be symbols, in percent.
MAX_SYMBOLS = 10
#: Words of a line that may end in repeated exclamation or question marks, in percent.
MAX_SHOUTED = 30
#: Words of a line that may be lone separators, in percent.
MAX_SEPARATORS = 25
SEPARATORS = (b"|", b">", b"<", b"/", b"-", b"\xc2\xb7", b"\xe2\x80\xa2", b"\xc2\xbb")
#: Lines of at most so many words go if they hold one of these, in lower case.
SHORT_LINE = 30
BOILERPLATE = (
    b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use", b"terms of service",
    b"enable javascript", b"click here", b"sign up", b"log in", b"read more", b"share this", b"lorem ipsum",
)
#: Share of a text's words that removed lines may hold, in percent.
MAX_LOST = 50
MIN_WORDS = 50
MAX_REPEATED = 50

_SYMBOLS = re.compile(rf"[{SYMBOLS}]".encode())
_SHOUT = re.compile(rb"[!?]{2,}$")
#: Heading, list and quotation marks; rules and fences.
_MARK = re.compile(rb"#{1,6}|[*+>-]|\xe2\x80\xa2|\xc2\xb7")
_RULE = re.compile(rb"(?:[*_=~`-][ \t]*){3,}")
_PHRASE = re.compile(rb"(?<![^\W_])(?:%s)(?![^\W_])" % b"|".join(BOILERPLATE))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window that the text holds twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = codes[:n]
    for i in range(1, width):  # number the windows of each width in turn, so keys never overflow
        if len(number) < 1 << 20 and width == 3:
            key = key * len(number) + codes[i : n + i]
        else:
            key = np.unique(key, return_inverse=True)[1] * len(number) + codes[i : n + i]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


def breaks_marks(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a punctuation or navigation rule."""
    if 100 * len(_SYMBOLS.findall(line)) > MAX_SYMBOLS * sum(map(len, words)):
        return True
    if (b"!!" in line or b"??" in line or b"!?" in line) and 100 * sum(
        1 for w in words if _SHOUT.search(w)
    ) > MAX_SHOUTED * len(words):
        return True
    return 100 * sum(map(words.count, SEPARATORS)) > MAX_SEPARATORS * len(words)


def bad_line(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a punctuation, navigation or boilerplate rule."""
    if breaks_marks(line, words):
        return True
    if len(words) <= SHORT_LINE:
        low = line.lower()
        return any(phrase in low for phrase in BOILERPLATE)
    return False


def bad_prose_line(line: bytes, words: list[bytes]) -> bool:
    """Like ``bad_line``, but marks and phrases are judged by what the line is.

    The marks of a heading, list item or quotation and the bars of a table row are not counted, so
    none of them fails a line alone. A phrase must stand at word boundaries, and the phrases must
    hold at least half of the line's words.
    """
    if line.count(b"|") > 1 and words[0].startswith(b"|") and words[-1].endswith(b"|"):
        words = [w for w in line.replace(b"|", b" ").split() if w.strip(b"-:")]
    elif _MARK.fullmatch(words[0]):
        words = words[1:]
    elif _RULE.fullmatch(line.strip()):
        return False
    if not words:
        return False
    rest = b" ".join(words)
    if len(words) > SHORT_LINE:
        return bad_line(rest, words)
    said = sum(len(m[0].split()) for m in _PHRASE.finditer(rest.lower()))
    return 2 * said >= len(words) or breaks_marks(rest, words)


def judge(text: str | None, bad: Callable[[bytes, list[bytes]], bool] = bad_line) -> dict:
    """Counts, verdicts and the cleaned text of one document; ``bad`` judges each line."""
    data = (text or "").encode()
    words = data.split()
    seen: set[bytes] = set()
    good, n_dup, n_bad, lost = [], 0, 0, 0
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        dup = line in seen
        seen.add(line)
        n_dup += dup
        if dup or bad(line, own):
            n_bad += 1
            lost += len(own)
        else:
            good.append(line)
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)) if data.isascii() else sum(len(w.decode()) for w in words),
        "n_symbols": len(_SYMBOLS.findall(data)),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= MAX_LOST * len(words),
        "n_bad_lines": n_bad,
        "lost_words": lost,
        "clean_text": b"\n".join(good).decode() if n_bad else text,
    }


def apply_line_rules(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), bad: Callable[[bytes, list[bytes]], bool] = bad_line
) -> DataFrame:
    """Judge every row by its whole text; one row out for each row in.

    ``keep`` names columns to carry along. Added: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_bad_lines, lost_words and clean_text (the text without
    its failed lines; blank lines stay). A null text has no words and no lines, so it fails and
    its clean_text is null. ``bad`` judges a line: ``bad_line`` as the SQL does, ``bad_prose_line``
    by whole phrases and without the marks of headings, lists and tables. A line equal to an earlier one fails like one that breaks a rule.
    Rows are judged one by one: ties and repeated rows do not matter, an empty table gives none.
    """
    fields = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)
    schema = ", ".join(
        [f"`{c}` {fields[c]}" for c in keep]
        + [f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + ["base_failed boolean", "kept boolean", "n_bad_lines long", "lost_words long", "clean_text string"]
    )

    def run(batch: pa.RecordBatch) -> dict:
        rows = [judge(t, bad) for t in batch.column("text").to_pylist()]
        return {c: [r[c] for r in rows] for c in rows[0]} | {c: batch.column(c) for c in keep}

    return map_texts(docs, [*dict.fromkeys((*keep, "text"))], schema, run)
