"""Hashes, token counts, prices, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import strip, words


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_fingerprint(doc: Column, idx: Column, chunk_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc.cast("string"), idx.cast("string"), chunk_hash), 256)


def embedding_fingerprint(chunk: Column, model: str, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws(":", chunk.cast("string"), F.lit(model), F.lit(version)), 256)


def token_count(c: Column) -> Column:
    """White-space words, at least one."""
    return F.greatest(F.lit(1), F.size(words(c)))


def token_estimate(c: Column) -> Column:
    """Four characters per token; blank text has none."""
    return F.when(F.length(strip(c)) == 0, F.lit(0)).otherwise(F.floor(F.length(c) / 4))


def _price(model: Column, prices: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(model)), F.lit(default))


def embedding_cost(tokens: Column, model: Column) -> Column:
    return tokens * _price(model, fv.EMBEDDING_PRICES, fv.EMBEDDING_DEFAULT_PRICE)


def chat_cost(prompt: Column, completion: Column, model: Column) -> Column:
    inp = _price(model, {m: p[0] for m, p in fv.CHAT_PRICES.items()}, fv.CHAT_DEFAULT_PRICE[0])
    out = _price(model, {m: p[1] for m, p in fv.CHAT_PRICES.items()}, fv.CHAT_DEFAULT_PRICE[1])
    return prompt * inp + completion * out


def embed_progress(done: Column, total: Column) -> Column:
    return F.round(75.0 + done / total * 20.0, 1)


def parse_progress(page: Column, total: Column) -> Column:
    return F.round(10.0 + page / total * 30.0, 1)


def compression_ratio(original: Column, compressed: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise(compressed / original)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in array order."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, unequal or zero vectors."""
    bottom = norm(a) * norm(b)
    unusable = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0) | (bottom == 0)
    return F.when(unusable, F.lit(0.0)).otherwise(dot(a, b) / bottom)
