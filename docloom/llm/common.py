"""Helpers shared by the corpus operators: kept tables, word splitting, hashing, components."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: A word is a run of characters other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Text of one numpy pass; a single longer document makes a pass of its own.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Number of words (long); null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc(column: Column) -> Column:
    """Unsigned CRC32 of a value's text; a null value counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


class Kept:
    """Intermediate tables as Parquet in the cluster's shared checkpoint folder.

    Writing cuts the lineage: a lost executor costs no more than the running stage.
    ``drop`` removes a table that nothing will read again; tables below a returned
    lazy DataFrame stay in the folder, like checkpoints do.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.tables):03d}"
        df.write.parquet(path)
        # the declared schema: an empty table has no file to infer it from
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, df: DataFrame) -> None:
        for table, path in self.tables:
            if table is df:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def map_texts(
    df: DataFrame, columns: list[str], schema: str, fn: Callable[[pa.RecordBatch], dict[str, object]], size: int = CHUNK_BYTES
) -> DataFrame:
    """``mapInArrow`` over runs of whole rows whose ``text`` is about ``size`` bytes long.

    Long texts are never cut, but a run holds no more rows than fit, so a task's memory is
    bounded by the chunk or the longest single text. ``fn`` gives the output columns.
    """
    target = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            for part in runs(batch, size):
                found = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], f.type) for f in out],
                    schema=out,
                )

    return df.select(*columns).mapInArrow(run, schema)


def runs(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about ``size`` bytes of text or of one row."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; the longest table so far is reused."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        table = np.ones(max(n, CHUNK_BYTES + 4096), np.uint64)
        table[1:] = np.uint64(base)
        table = np.multiply.accumulate(table)
        if n <= CHUNK_BYTES + 4096:
            _POWERS[base] = table
    return table[:n]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offset of each; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the text's first word (one more entry at the end)."""
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = ~_SPACE[data]
    before, after = full[:-2].copy(), full[2:].copy()
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(full[1:-1] & ~before)
    ends = np.flatnonzero(full[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def term_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, start and end of each term, and the number of the text that holds it.

    A term is a run of ASCII letters, digits and bytes over 0x7F; null is an empty text.
    """
    data, offsets = raw_bytes(texts)
    data = _LOWER[data]
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(full[1:-1] & (~full[:-2] | cut[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | cut[1:])) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the number of each text's first word."""
    data, offsets = raw_bytes(texts)
    starts, ends, first = split_words(data, offsets)
    return mix(span_hashes(_LOWER[data] if lower else data, starts, ends)), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of byte spans, alike wherever the bytes stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_STEP, len(data)), out=total[1:])
    return (total[ends] - total[starts]) * powers(_BACK, len(data) + 1)[starts]


#: Bits of a sieve: at most 2^18 rows of one long each are broadcast, whatever the input.
SIEVE_BITS = 1 << 24


def sieve(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in the one column of ``wanted``: none that is there is lost.

    A Bloom filter of one hash and of fixed size, so a join that keeps few rows shuffles little
    else. The more is wanted, the more rows pass: an exact join must follow. Null passes never.
    """

    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(SIEVE_BITS))

    at = place(F.col(wanted.columns[0]))
    bit = at.alias("_at"), F.shiftright(at, 6).alias("_word")
    words = wanted.select(*bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 AS int)))").alias("_bits"))
    here = place(F.col(column))
    rows = df.withColumn("_word", F.when(F.col(column).isNotNull(), F.shiftright(here, 6))).join(F.broadcast(words), "_word")
    passed = rows.filter(F.expr(f"(shiftrightunsigned(_bits, cast(pmod(xxhash64(`{column}`), {SIEVE_BITS}) % 64 AS int)) & 1) = 1"))
    return passed.select(*df.columns)


def split_by_sieve(df: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``column`` may be in the one column of ``wanted``, and rows where it surely is not.

    As ``sieve``, but nothing is lost: what need not meet a join stays where it is. Null is in the second part.
    """
    place = F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(SIEVE_BITS))
    words = wanted.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_at % 64 AS int)))").alias("_bits")
    )
    here = F.pmod(F.xxhash64(F.col(column)), F.lit(SIEVE_BITS))
    rows = df.withColumn("_word", F.when(F.col(column).isNotNull(), F.shiftright(here, 6))).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.expr(f"(shiftrightunsigned(_bits, cast(pmod(xxhash64(`{column}`), {SIEVE_BITS}) % 64 AS int)) & 1) = 1"), F.lit(False))
    return rows.filter(hit).select(*df.columns), rows.filter(~hit).select(*df.columns)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended, before the next large step needs the disk.

    Spark deletes them once the driver's garbage is collected; what the first round only finds, the
    second frees. Deletion runs beside, so this waits a moment.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def components(edges: DataFrame, kept: Kept) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the smallest node reachable.

    Rounds of large-star and small-star: each node's neighbours move to their smallest member.
    Stars shrink to one link per node, sums are combined before the shuffle, and every round is
    written, so a component may have any size and no node's neighbours are ever gathered.
    """
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node links to the smallest around that node
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.filter("a <> b").distinct())
        # small star: the smaller neighbours of a node, and itself, link to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = kept(small.unionByName(down.withColumnRenamed("m", "b")).filter("a <> b").distinct())
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        kept.drop(now)
        kept.drop(large)
        now = small
        if seen == mark:
            break
        mark = seen
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
