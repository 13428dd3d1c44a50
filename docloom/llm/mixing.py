"""Mixing sources to target weights by blocks, shard draws and index permutations.

Each source's words are packed in a fixed document order into blocks of equal length. The output
is a row of shards of slots. Every shard draws how many slots each source fills: a multinomial
draw, conditioned on the totals, so that each source ends exactly on its target. A source's n-th
slot, counted over all shards, maps through a pseudorandom permutation of the source's block
numbers, a fresh one for each pass, and slots join blocks by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.skew import running_sum
from .common import WORD, Kept, mix, n_words

#: White space beside words.
SPACE = r"[\x20\x09-\x0D]*"

#: Weights of the sources by rank of their names in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words, and no source more than CAP times its size.
BUDGET, CAP = 1.5, 2.0
BLOCK_WORDS, SHARD_SLOTS = 256, 1024
#: Sources are listed on the driver; more than this many is an error, never a cut.
MAX_SOURCES = 100_000
SEED = 7
#: Rows of one bucket of the running sum that packs a source.
BUCKET_ROWS = 20_000


def targets(sizes: DataFrame) -> DataFrame:
    """source, number, source_size, target, take: one row per source.

    The budget is shared by weight; a source whose share is over CAP times its size stops there and
    the rest is shared again. In order of CAP * size / weight the stopped sources come first, so
    running sums over them give the final share per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("number", (F.row_number().over(rank) - 1).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("number") % len(WEIGHTS) + 1)
    per = per.withColumn("weight", weight).withColumn("limit", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("budget", BUDGET * F.sum("source_size").over(whole)).withColumn("all", F.sum("weight").over(whole))
    share = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("all") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # while sources stop, the share per weight does not fall below what stopped them
    per = per.withColumn("share", share)
    free = F.col("share") * F.col("weight") < F.col("limit")
    per = per.withColumn("final", F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), "number", "share"))).over(whole)["share"])
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight")))
    return per.select("source", "number", "rows", "source_size", target.alias("target"), F.round(target).cast("long").alias("take"))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds, walked until back in range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 4 + r) % (1 << 64))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def split(quota: np.ndarray, left: int, lo: int, hi: int) -> np.ndarray:
    """How many of each source's slots fall into the first ``left`` slots of a range."""
    total = int(quota.sum())
    if total < 1_000_000_000:
        rng = np.random.default_rng([SEED, lo, hi])
        return rng.multivariate_hypergeometric(quota, left)
    exact = quota * (left / total)  # beyond the sampler's range, where the deviation is negligible
    out = np.floor(exact).astype(np.int64)
    out[np.argsort(out - exact, kind="stable")[: left - int(out.sum())]] += 1
    return out


def shard_counts(quota: np.ndarray, shard: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard and in all shards before it, by halving the row of shards."""
    lo, hi = 0, -(-int(quota.sum()) // slots)
    before = np.zeros_like(quota)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        first = split(quota, (middle - lo) * slots, lo, hi)
        if shard < middle:
            quota, hi = first, middle
        else:
            before, quota, lo = before + first, quota - first, middle
    return quota, before


def draw_slots(sources: list, spark, block_words: int, shard_slots: int) -> DataFrame:
    """shard, slot, number, turn, block, words: what fills each slot (``words`` from the block's start).

    turn is the pass over the source; a pass holds no block twice.
    """
    size = np.array([s.source_size for s in sources], np.int64)
    take = np.array([s.take for s in sources], np.int64)
    full, tail = size // block_words, size % block_words
    per_pass = full + (tail > 0)
    passes, rest = take // np.maximum(size, 1), take % np.maximum(size, 1)
    quota = passes * per_pass + -(-rest // block_words)
    last = rest - (-(-rest // block_words) - 1) * block_words  # words of a source's last slot, if it ends within a pass
    n_shards = -(-int(quota.sum()) // shard_slots)

    def fill(batches):
        for batch in batches:
            for shard in batch["id"]:
                counts, before = shard_counts(quota, int(shard), shard_slots)
                number = np.repeat(np.arange(len(quota)), counts)
                place = np.random.default_rng([SEED, int(shard)]).permutation(len(number))
                out = []
                for s in np.flatnonzero(counts):
                    nth = before[s] + np.arange(counts[s])
                    turn, index = nth // per_pass[s], nth % per_pass[s]
                    block = index.copy()  # the short block at a source's end closes each pass
                    for p in np.unique(turn):
                        here = (turn == p) & (index < full[s])
                        block[here] = permute(index[here], int(full[s]), int(mix(np.uint64([SEED * 1_000_003 + s * 64 + p]))[0]))
                    words = np.where(index < full[s], block_words, tail[s])
                    if rest[s]:
                        words = np.where(nth == quota[s] - 1, np.minimum(words, last[s]), words)
                    out.append((turn, block, words))
                if out:
                    yield pd.DataFrame({
                        "shard": int(shard), "slot": place, "number": number.astype(np.int32),
                        **{name: np.concatenate(parts) for name, parts in zip(("turn", "block", "words"), zip(*out), strict=True)},
                    })

    return spark.range(n_shards).mapInPandas(fill, "shard long, slot long, number int, turn long, block long, words long")


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken, pieces; one row per row of ``docs``.

    ``pieces`` lists what the mix takes of the row: (turn, first word, number of words, shard, slot),
    pass by pass in the order of the text; shard and slot are the piece's place in the mix.
    A source's taken words are its target rounded to a whole word, and no row is taken more than
    CAP times. Weights go by rank of the source's name; a null source is one source, the last.
    A null or empty text has size 0 and nothing is taken. Repeated rows are packed one by one and
    ties of doc_id are ordered by text, so reruns agree. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "mixing")
    sizes = kept(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    table = kept(targets(sizes))
    sources = table.orderBy("number").limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    slots = draw_slots(sources, spark, block_words, shard_slots)
    facts = F.broadcast(table.withColumnRenamed("source", "_source"))  # at most MAX_SOURCES rows, checked above
    rows = sizes.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "rows", "take")
    n_buckets = 1 + sum(s.rows for s in sources) // BUCKET_ROWS
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets))
    packed = running_sum(rows, ["number"], ["doc_id", "text_hash", "size"], "size", "end", bucket)
    packed = kept(packed.withColumn("start", F.col("end") - F.col("size")))
    spans = packed.filter("size > 0").select(
        "number", "start", "end",
        F.explode(F.sequence((F.col("start") / block_words).cast("long"), ((F.col("end") - 1) / block_words).cast("long"))).alias("block"),
    )
    at = F.col("block") * block_words
    first, stop = F.greatest("start", at), F.least("end", at + F.col("words"))
    taken = spans.join(slots, ["number", "block"]).withColumn("first", first).withColumn("n", stop - first).filter("n > 0")
    piece = F.struct("turn", (F.col("first") - F.col("start")).alias("first"), "n", "shard", "slot")
    per_row = taken.groupBy("number", "start", "end").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    # an empty row may start where another does, but only a row with words ends elsewhere
    return packed.join(per_row, ["number", "start", "end"], "left").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces",
    )


def mixed_documents(docs: DataFrame, **sizes: int) -> DataFrame:
    """The mix as documents: each row's taken pieces in the order of its text, with the columns of ``docs``.

    Pieces are cut from the text as they stand: a word goes with the white space behind it, the
    first word also with that before it. A row taken whole in one pass keeps its text unchanged;
    passes are parted by a newline. Rows of which nothing is taken go. Rows that repeat doc_id, source and text share the other
    columns of the first of them.
    """
    drawn = mix_sources(docs, **sizes).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "pieces"
    )
    # columns of ``docs`` travel in one struct, so that none clashes with a name used here
    texts = docs.select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_h"), F.struct(*docs.columns).alias("_row")
    ).dropDuplicates(["_d", "_s", "_h"])
    key = [F.col("_d").eqNullSafe(F.col("_id")), F.col("_s").eqNullSafe(F.col("_source")), F.col("_h") == F.col("_hash")]
    rows = texts.join(drawn, key)

    def cut(words: Column) -> Column:
        def one_pass(turn: Column) -> Column:
            pieces = F.filter("pieces", lambda p: p["turn"] == turn)
            return F.array_join(F.flatten(F.transform(pieces, lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["n"].cast("int")))), "")

        return F.array_join(F.transform(F.array_distinct(F.col("pieces.turn")), one_pass), "\n")

    rows = rows.withColumn("_text", let(F.regexp_extract_all(F.col("_row")["text"], F.lit(f"{SPACE}{WORD}{SPACE}"), 0), cut))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
