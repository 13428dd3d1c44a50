"""Quality classifier: supervised subword embeddings, averaged per document.

Words, pairs of neighbouring words and character n-grams are hashed to rows of one embedding
table; a document is the mean of its rows, and a softmax over two classes reads it. The table is
trained by numpy stochastic gradient descent in parallel shares whose results are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, map_texts, mix, raw_bytes, runs, span_hashes, split_words

BITS, WIDTH = 16, 8
CHARS = (3, 4)
#: Labelled rows to train on: a pseudorandom sample of about this many, or all if there are fewer.
SAMPLE = 12_000
SHARES, ROUNDS, EPOCHS, RATE = 6, 3, 3, 20.0
SEED = 5
THRESHOLD = 0.3
_END = 0  # the row that every document has, an empty one too


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features of all texts, and the number of each text's first one (one more at the end)."""
    data, offsets = raw_bytes(texts)
    starts, ends, first = split_words(data, offsets)
    words = mix(span_hashes(data, starts, ends))
    # a pair is hashed by difference: every repetition of a word is one and the same feature
    pairs = mix(words[1:] - words[:-1] + np.uint64(1))
    inside = np.ones(max(len(words) - 1, 0), bool)
    cut = first[1:-1]
    inside[cut[(cut > 0) & (cut < len(words))] - 1] = False
    place = np.searchsorted(offsets, np.arange(len(data)), "right") - 1
    owner = [np.arange(len(offsets) - 1), place[starts], place[starts[:-1]][inside]]
    found = [np.full(len(offsets) - 1, _END, np.uint64), words, pairs[inside]]
    wide = data.astype(np.uint64)
    for n in CHARS:
        if len(data) < n:
            continue
        code = wide[: len(data) - n + 1].copy()
        for i in range(1, n):
            code = code << np.uint64(8) | wide[i : len(data) - n + 1 + i]
        whole = place[: len(code)] == place[n - 1 :]
        owner.append(place[: len(code)][whole])
        found.append(mix(code[whole] + np.uint64(n << 40)))
    rows = np.concatenate([found[0], *((f >> np.uint64(64 - BITS)) | np.uint64(1) for f in found[1:])]).astype(np.int32)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    return rows[order], np.concatenate(([0], np.cumsum(counts)))


class Model:
    """Embedding table, output layer and its bias; quality 1 is the second class."""

    def __init__(self, table: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.table, self.output, self.bias = table, output, bias

    @classmethod
    def fresh(cls) -> Model:
        rng = np.random.default_rng(SEED)
        return cls(
            rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32),
            rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32),
        )

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int, rate: float, until: float) -> None:
        """Passes over (rows, weights) of each document, the rate falling evenly to ``until``."""
        rng, steps, total = np.random.default_rng(seed), 0, max(1, EPOCHS * len(docs))
        for _ in range(EPOCHS):
            for i in rng.permutation(len(docs)):
                rows, weights = docs[i]
                now = rate + (until - rate) * steps / total
                vector = weights @ self.table[rows]
                logits = vector @ self.output + self.bias
                chance = np.exp(logits - logits.max())
                chance /= chance.sum()
                chance[labels[i]] -= 1
                pull = self.output @ chance
                self.output -= (now * 0.05 * np.outer(vector, chance)).astype(np.float32)
                self.bias -= (now * 0.005 * chance).astype(np.float32)
                self.table[rows] -= now * weights[:, None] * pull[None, :]
                steps += 1

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Softmax chance of quality 1 of each text."""
        rows, first = features(texts)
        line = self.table @ (self.output[:, 1] - self.output[:, 0])  # the mean is linear: one number a row
        sums = np.add.reduceat(line[rows].astype(np.float64), first[:-1]) if len(first) > 1 else np.zeros(0)
        logit = sums / np.diff(first) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _fit(start: tuple[np.ndarray, ...], rate: float, until: float, seed: int):
    """Training of one share from the model ``start``; gives back its tables."""

    def fit(table: pa.Table) -> pa.Table:
        docs, labels = [], []
        for batch in table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).to_batches():
            for part in runs(batch):
                rows, first = features(part.column("text"))
                for a, b in zip(first, first[1:], strict=False):
                    own, counts = np.unique(rows[a:b], return_counts=True)
                    docs.append((own, (counts / (b - a)).astype(np.float32)))
                labels += part.column("quality").to_pylist()
        own = Model(*(x.copy() for x in start))
        own.train(docs, labels, seed, rate, until)
        data = b"".join(x.astype(np.float32).tobytes() for x in (own.table, own.output, own.bias))
        return pa.table({"model": pa.array([data], pa.binary()), "n": pa.array([len(docs)], pa.int64())})

    return fit


def learn(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, quality 0 or 1); rows must be no more than SAMPLE or so.

    Each round SHARES tasks start from one model, pass over their documents and send back their
    table; the driver averages SHARES tables of 2 ** BITS rows.
    """
    model = Model.fresh()
    # shares are groups, so their number, and with it what the driver gets, does not follow the partitions
    shares = labelled.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    schema = "model binary, n long"
    for r in range(ROUNDS):
        start = (model.table, model.output, model.bias)
        rate, until = RATE * (1 - r / ROUNDS), RATE * (1 - (r + 1) / ROUNDS)

        parts = shares.groupBy("share").applyInArrow(_fit(start, rate, until, SEED + r), schema).collect()
        if not parts:
            break
        total = sum(p["n"] for p in parts)
        mean = sum(np.frombuffer(p["model"], np.float32) * (p["n"] / total) for p in sorted(parts, key=lambda p: bytes(p["model"])))
        cells = model.table.size
        model = Model(
            mean[:cells].reshape(model.table.shape).astype(np.float32),
            mean[cells : cells + 2 * WIDTH].reshape(WIDTH, 2).astype(np.float32), mean[-2:].astype(np.float32),
        )
    return model


def training_rows(docs: DataFrame, labels: DataFrame, usable: str) -> DataFrame:
    """(doc_id, text, quality) of at most about SAMPLE labelled rows that meet the condition ``usable``.

    Labels decide the sample before any text is read; a doc_id with several labels has the least. A
    quality other than 0 or 1 is no label.
    """
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(usable)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, SAMPLE / max(1, marks.count()))
    # by hash, so reruns agree, and as a double, so no number of labels rounds the share to nothing
    marks = marks.filter(F.xxhash64("doc_id", F.lit(SEED)).cast("double") <= F.lit(share * 2.0**64 - 2.0**63))
    kept = Kept(docs.sparkSession, "quality")
    return kept(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))  # about SAMPLE rows of 16 bytes


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted; one row per row of ``docs``.

    A null text is an empty one, scored like any other. Rows are scored one by one, so ties and
    repeated rows do not matter; an empty table gives none. With no label at all the model is
    untrained and its scores say nothing.
    """

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": model.scores(batch.column("text"))}

    scored = map_texts(docs, ["doc_id", "text"], "doc_id long, score double", run)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
