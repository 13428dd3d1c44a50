"""Language identification by words first, and shorter and shorter n-grams for unseen words.

A word that the model knows scores by its log frequency in each language. An unseen word falls
back to the mean over its known character n-grams of the longest order that has any. The language
with the best mean over all words wins.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, map_texts

ORDERS = (4, 3, 2, 1)
#: Size of the model, shared out evenly to the languages: its most frequent words, and n-grams of each order.
WORDS_KEPT, GRAMS_KEPT = 100_000, 20_000
#: Negative log10 frequency of what a language has not.
PENALTY = 7.0
#: The score is the share of the best language if so many words had the text's mean.
CERTAINTY_WORDS = 20
#: Entries a worker counts before it hands them on; unseen words whose scores it remembers.
FLUSH, REMEMBERED = 200_000, 100_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between spaces; single characters without them."""
    padded = word if order == 1 else f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _counted(counts: dict[tuple, int], names: tuple[str, ...]) -> pa.RecordBatch:
    keys = list(zip(*counts, strict=True))
    types = {"lang": pa.string(), "part": pa.string(), "n_chars": pa.int32()}
    columns = [pa.array(k, types[c]) for k, c in zip(keys, names, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=[*names, "n"])


def _count_words(batches):
    per: dict[str, Counter] = {}

    def flush():
        for lang, counts in per.items():
            if counts:
                yield _counted({(lang, w): n for w, n in counts.items()}, ("lang", "part"))
        per.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            per.setdefault(lang, Counter()).update(split(text))
            if sum(map(len, per.values())) >= FLUSH:
                yield from flush()
    yield from flush()


def _count_grams(batches):
    counts: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "n")), strict=True):
            for order in ORDERS:
                for gram in grams(word, order):
                    counts[lang, order, gram] += n
            if len(counts) >= FLUSH:
                yield _counted(counts, ("lang", "n_chars", "part"))
                counts.clear()
    if counts:
        yield _counted(counts, ("lang", "n_chars", "part"))


def _top(counts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The most frequent parts per key with their log frequency over all counted parts."""
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("all"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), "part")
    best = counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)
    best = best.join(F.broadcast(totals), keys)  # a row per language and order
    return best.select(*keys, "part", (-F.log10(F.col("n") / F.col("all"))).alias("score"))


class Model:
    """Scores (negative log10 frequency, a column per language) of known words and n-grams."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], parts: dict[str, list[float]]):
        self.langs, self.words, self.parts = langs, words, parts

    def unseen(self, word: str) -> list[float] | None:
        for order in ORDERS:
            known = [self.parts[g] for g in grams(word, order) if g in self.parts]
            if known:
                return [sum(column) / len(known) for column in zip(*known, strict=True)]
        return None


class _Rows(dict):
    """Row number of each word in a growing matrix of scores; row 0 is for words without any."""

    def __init__(self, model: Model):
        self.model = model
        self.known = {w: i + 1 for i, w in enumerate(model.words)}
        width = len(model.langs)
        self.table = np.zeros((len(self.known) + 1 + REMEMBERED, width), np.float32)
        self.table[1 : len(self.known) + 1] = np.array(list(model.words.values()), np.float32).reshape(-1, width)
        super().__init__(self.known)

    def __missing__(self, word: str) -> int:
        scores = self.model.unseen(word)
        if scores is None:
            return 0
        at = len(self) + 1
        self.table[at] = scores
        self[word] = at
        return at

    def tidy(self) -> None:
        if len(self) > len(self.known) + REMEMBERED // 2:
            self.clear()
            self.update(self.known)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.model.langs:
            return UNDETERMINED, 0.0
        words, total, n = split(text), np.zeros(len(self.model.langs)), 0
        for i in range(0, len(words), REMEMBERED // 2):
            self.tidy()
            rows = np.fromiter(map(self.__getitem__, words[i : i + REMEMBERED // 2]), np.int64)
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            n += int(np.count_nonzero(rows))
        mean = total / max(n, 1)
        chance = np.exp((mean.min() - mean) * np.log(10) * min(n, CERTAINTY_WORDS))
        best = int(mean.argmin())  # of equal languages the first by name
        return self.model.langs[best], float(chance[best] / chance.sum())


def learn(rows: DataFrame) -> Model:
    """A model from all rows (text, lang) whose text and lang are not null.

    Every word of every text is counted; only the model's size is bounded, by WORDS_KEPT and
    GRAMS_KEPT, as rarer words are what n-grams are for.
    """
    rows = rows.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    words = rows.mapInArrow(_count_words, "lang string, part string, n long")
    words = words.groupBy("lang", "part").agg(F.sum("n").alias("n"))
    kept = Kept(rows.sparkSession, "language")
    words = kept(words)
    parts = words.mapInArrow(_count_grams, "lang string, n_chars int, part string, n long")
    parts = kept(parts.groupBy("lang", "n_chars", "part").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    tables: list[dict[str, list[float]]] = []
    share = max(1, len(langs))
    for counts, keys, limit in ((words, ["lang"], WORDS_KEPT // share), (parts, ["lang", "n_chars"], GRAMS_KEPT // share)):
        table: dict[str, list[float]] = {}
        # at most WORDS_KEPT, and len(ORDERS) * GRAMS_KEPT, rows
        for r in _top(counts, keys, max(1, limit)).collect():
            table.setdefault(r["part"], [PENALTY] * len(langs))[langs.index(r["lang"])] = r["score"]
        tables.append(table)
    kept.drop(words)
    kept.drop(parts)
    return Model(langs, tables[0], tables[1])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the ``keep`` columns; one row per row of ``docs``.

    A null text, one without a letter, and any text under a model of no language is ``und`` with
    score 0. Letters that no word or n-gram of the model has give the first language by name, as
    do ties. Rows are judged one by one; an empty table gives none.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["lang_pred string", "score double"])
    own: list[_Rows] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not own:
            own.append(_Rows(model))
        found = [own[0].predict(t) for t in batch.column("text").to_pylist()]
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]} | {c: batch.column(c) for c in keep}

    return map_texts(docs, [*dict.fromkeys((*keep, "text"))], schema, run)
