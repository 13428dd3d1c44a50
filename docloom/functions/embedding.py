"""Text embedding through a pluggable batch function.

An embedder is ``Callable[[list[str]], numpy.ndarray]``; the default hashes
words into counts, so results are deterministic and need no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
DIM = 64
# equal similarities must compare equal whatever order they were summed in
SIM_DIGITS = 9
#: Bytes of text that a worker holds as Python values at a time.
PART_BYTES = 1 << 20


class _Hashes(dict):
    """Hashes of words, each computed once while it is held."""

    def __missing__(self, word: str) -> int:
        found = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return found


#: One per worker process: a batch that is refused is embedded again text by text.
HASHES = _Hashes()


class HashingEmbedder:
    """Counts of lower-cased words by hash bucket."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            hashes = list(map(HASHES.__getitem__, text.lower().split()))
            out[row] = np.bincount(np.array(hashes, np.int64) % self.dim, minlength=self.dim)
            if len(HASHES) > 100_000:
                HASHES.clear()
        return out


def _clean(text: str | None) -> str:
    return text if text and text.strip() else " "


def embed_rows(fn: Embedder, texts: list[str | None], batch: int) -> list[list[float] | None]:
    """Embed in batches; a failing batch is retried row by row, then null."""
    out: list[list[float] | None] = []
    for i in range(0, len(texts), batch):
        part = [_clean(t) for t in texts[i : i + batch]]
        try:
            out.extend(np.asarray(fn(part), dtype=float).tolist())
        except Exception:
            for one in part:
                try:
                    out.append(np.asarray(fn([one]), dtype=float)[0].tolist())
                except Exception:
                    out.append(None)
    return out


def parts(column: pa.Array, rows: int, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of texts, or of arrays of them, of ``rows`` at most and about ``size`` bytes, or one row."""
    texts = column.values if pa.types.is_list(column.type) else column
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if texts is not column:
        ends = ends[np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, ends[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), start + rows, len(column))
        yield column.slice(start, stop - start)
        start = stop


def embed(text: Column, fn: Embedder | None = None, batch: int = 1000) -> Column:
    """Vector column; null where the embedder failed on the row.

    Spark hands over thousands of rows at once. Only a part of them is ever held as Python values.
    """
    model = fn or HashingEmbedder()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float64())
        for column in batches:
            found = [pa.array(embed_rows(model, p.to_pylist(), batch), kind, from_pandas=True) for p in parts(column, batch)]
            yield pa.concat_arrays([pa.array([], kind), *found])

    return run(text)


def adjacent_similarity(pieces: Column, fn: Embedder | None = None, batch: int = 100) -> Column:
    """Cosine of each array element's embedding with the one before it."""
    model = fn or HashingEmbedder()

    def similar(texts: list[str] | None) -> list[float]:
        sims: list[float] = []
        last = None
        # one block of sentences at a time, whatever the text's length
        for i in range(0, 0 if texts is None else len(texts), batch):
            vecs = np.asarray(model([_clean(t) for t in texts[i : i + batch]]), dtype=float)
            norms = np.sqrt((vecs * vecs).sum(axis=1))
            if last is not None:
                vecs = np.vstack([last[0], vecs])
                norms = np.concatenate([[last[1]], norms])
            bottom = norms[1:] * norms[:-1]
            dots = (vecs[1:] * vecs[:-1]).sum(axis=1)
            sim = np.where(bottom == 0, 0.0, dots / np.where(bottom == 0, 1.0, bottom))
            sims.extend(np.round(sim, SIM_DIGITS).tolist())
            last = (vecs[-1], norms[-1])
        return sims

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float64())
        for column in batches:
            found = [pa.array([similar(t) for t in p.to_pylist()], kind, from_pandas=True) for p in parts(column, len(column))]
            yield pa.concat_arrays([pa.array([], kind), *found])

    return run(pieces)
