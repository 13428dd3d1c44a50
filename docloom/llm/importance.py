"""Target-distribution importance resampling over hashed word runs.

Features are runs of words, counted in buckets of their CRC-32. The CRC of a span is linear in its
bytes: a byte's share depends on its value and its distance from the end, so all spans of a run of
texts are hashed by one look-up per byte and ``bitwise_xor.reduceat``, plus a constant of the length.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, map_texts, runs, term_spans

#: Distances from the end that the position table holds; longer spans fold block by block.
REACH = 64
POLYNOMIAL = 0xEDB88320


def _step(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC registers after one more zero byte."""
    return (state >> np.uint32(8)) ^ table[state & np.uint32(0xFF)]


def _position_table() -> np.ndarray:
    """Row d, column b: what byte b adds to the CRC at distance d from the end of its span."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> np.uint32(1)) ^ np.where(row & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [row]
    while len(rows) < REACH:
        rows.append(_step(rows[-1], rows[0]))
    return np.stack(rows)


POSITION = _position_table()
#: CRC of so many zero bytes.
LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


@functools.lru_cache(maxsize=None)
def _jump(level: int) -> np.ndarray:
    """Registers after ``REACH * 2^level`` zero bytes, by each of their four bytes."""
    if level:
        half = _jump(level - 1)
        return np.stack([_advance(row, level - 1) for row in half])
    table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(REACH):
        table = _step(table, POSITION[0])
    return table


def _advance(state: np.ndarray, level: int) -> np.ndarray:
    table, byte = _jump(level), np.uint32(0xFF)
    return (
        table[0][state & byte] ^ table[1][(state >> np.uint32(8)) & byte]
        ^ table[2][(state >> np.uint32(16)) & byte] ^ table[3][state >> np.uint32(24)]
    )


def _long_crc(span: np.ndarray) -> int:
    """CRC of one span over REACH bytes: blocks counted from the end, folded in pairs."""
    blocks, head = divmod(len(span), REACH)
    distance = np.arange(REACH)[::-1]
    whole = np.bitwise_xor.reduce(POSITION[distance, span[head:].reshape(blocks, REACH)], axis=1)
    start = LENGTH[head] ^ np.uint32(0xFFFFFFFF)  # the register after the head's bytes
    if head:
        start ^= np.bitwise_xor.reduce(POSITION[distance[-head:], span[:head]])
    state, level = np.array([start], np.uint32), 0
    while blocks >> level:
        if blocks >> level & 1:
            state = _advance(state, level)
        level += 1
    level = 0
    while len(whole) > 1:
        if len(whole) % 2:  # zeros in front add nothing
            whole = np.concatenate([np.zeros(1, np.uint32), whole])
        whole = _advance(whole[0::2], level) ^ whole[1::2]
        level += 1
    return int(state[0] ^ whole[0] ^ np.uint32(0xFFFFFFFF))


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte spans [start, end), none of them empty; spans may overlap."""
    out = np.zeros(len(starts), np.uint32)
    sizes = ends - starts
    short = np.flatnonzero(sizes <= REACH)
    if len(short):
        n = sizes[short]
        first = np.cumsum(n) - n
        back = np.repeat(first + n - 1, n) - np.arange(n.sum())
        place = np.repeat(ends[short] - 1, n) - back
        out[short] = np.bitwise_xor.reduceat(POSITION[back, data[place]], first) ^ LENGTH[n]
    for i in np.flatnonzero(sizes > REACH):
        out[i] = _long_crc(data[starts[i] : ends[i]])
    return out


def features(texts: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC of each feature, number of the text that has it, and words of each text.

    Words are lower-cased in A-Z alone; a feature is a run of 1 to ``longest`` consecutive words of
    one text, joined by one space.
    """
    data, starts, ends, owner = term_spans(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    if longest > 1:  # words side by side with one space between, so that runs are spans
        sizes = ends - starts
        new_starts = np.cumsum(sizes + 1) - (sizes + 1)
        joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[np.repeat(new_starts, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
        data, starts, ends = joined, new_starts, new_starts + sizes
    found, owners = [], []
    for k in range(longest):
        same = owner[: len(owner) - k] == owner[k:]
        found.append(span_crcs(data, starts[: len(starts) - k][same], ends[k:][same]))
        owners.append(owner[k:][same])
    return np.concatenate(found), np.concatenate(owners), n_words


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(bucket, n): features of all texts by bucket; at most ``buckets`` rows leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in runs(batch):
                total += np.bincount(features(part.column("text"), longest)[0] % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """Gain of each bucket: 1000 times the log of its smoothed share in the target over that in ``raw``.

    Two tables of at most ``buckets`` rows come to the driver, whatever the input.
    """
    held = np.zeros((2, buckets), np.int64)
    for side, docs in enumerate((raw, target)):
        for row in bucket_counts(docs, buckets, longest).collect():
            held[side, row["bucket"]] = row["n"]
    total, wanted = (int(x) for x in held.sum(axis=1))
    ratio = [(float(t + 1) * (total + buckets)) / (float(s + 1) * (wanted + buckets)) for s, t in held.T.tolist()]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of the gains of a text's features."""

    def run(batch: pa.RecordBatch) -> dict:
        crcs, owner, n_words = features(batch.column("text"), longest)
        n = np.bincount(owner, minlength=len(batch))
        total = np.zeros(len(batch), np.int64)
        np.add.at(total, owner, gain[crcs % len(gain)])
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        return {"doc_id": batch.column("doc_id"), "n_words": n_words.astype(np.int64), "n_features": n.astype(np.int64), "weight": weight}

    return map_texts(docs, ["doc_id", "text"], "doc_id long, n_words long, n_features long, weight long", run)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in thousandths: its id and the seed decide."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1,
    seed: int = 2024,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank: one row per row of ``docs``.

    ``share`` percent of the documents with ``least_words`` words are drawn without replacement, by
    the highest weight plus noise; rank is 1, 2, 3, ... in that order, null where not drawn. Ties go
    to the smaller doc_id, null ids last; rows that repeat an id have the same noise and ranks of
    their own. Null or empty texts have no feature, weight 0 and are never drawn. An empty target
    leaves smoothing alone to decide; an empty table gives no rows.

    Scores are whole numbers within about 44,000 of zero (1000 times the log of a ratio of 64-bit
    counts) plus noise from -3,200 to 22,900, so their histogram has at most some 115,000 rows,
    whatever the input: it comes to the driver, and rank needs one window for each score, of which
    none holds more than about 1 in 2,700 of documents with ids of their own.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "importance")
    scored = weigh(docs, gains(docs, target, buckets, longest), longest)
    scored = kept(scored.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")))
    fit = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["n"]) for r in scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = share * sum(n for _, n in counts) // 100
    above, ahead = [], 0
    for score, n in counts:
        if ahead >= drawn:
            break
        above.append((score, ahead))
        ahead += n
    none = F.lit(None).cast("long")
    if not above:
        return scored.withColumn("rank", none)
    inside = fit & (F.col("score") >= above[-1][0])
    ahead_of = F.broadcast(spark.createDataFrame(above, "score long, _ahead long"))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    top = scored.filter(inside).join(ahead_of, "score").withColumn("rank", place)
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.select(*scored.columns, "rank").unionByName(scored.filter(~inside).withColumn("rank", none))
