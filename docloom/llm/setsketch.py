"""MinHash near-duplicates with SetSketch registers.

A register holds the least of exponentially distributed hashes of a set, on an exponentially
spaced scale (base B) truncated to 0..Q+1: ``clip(floor(1 - log_B(minimum)))``. Registers of two
sets merge by maximum, and equal registers are as likely as the sets are similar. Bands of
registers give candidates, the joint likelihood of all registers drops distant pairs, and the
full shingle sets confirm every link.

Larger buckets are compared where they meet: a task gets registers and texts of at most two blocks
of a bucket, estimates all pairs, confirms the near ones on full sets and hands on a forest of the
links, fewer than it has members. A few bands come first, block by block. Then the members of
every bucket that still holds several components are compared across them; those of its largest
component meet all others, but not each other. No link between components is lost, and what is
shuffled grows with the members, not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from .common import Kept, components, map_texts, mix, sieve, word_hashes

WIDTH = 5
SIMILARITY = 0.75
#: Registers; a band is ROWS of them, the next one starts STEP further.
M, ROWS, STEP = 128, 6, 3
BANDS = (M - ROWS) // STEP + 1
#: Large buckets of so many bands are joined up first; most others then hold one component only.
FIRST_BANDS = 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose estimate is over four deviations under the similarity are not confirmed.
NEAR = SIMILARITY - 0.15
#: Members of a larger bucket are compared block by block.
BLOCK = 256
#: Distinct shingles of one product that counts the intersections of a block.
COLUMNS = 4096
_MULTIPLIERS = mix(np.arange(1, M + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of ``width`` consecutive words; all words as one if there are fewer."""
    if len(words) == 0:
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    total = np.full(n, width_here, np.uint64)
    for i in range(width_here):
        total = mix(total + words[i : i + n])
    return np.unique(total)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(items):
        return np.zeros(M, np.uint16)
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 256):
        block = items[i : i + 256, None] * _MULTIPLIERS
        np.minimum(least, block.min(axis=0), out=least)
    uniform = np.maximum(least.astype(np.float64), 1.0) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likeliest(higher: np.ndarray, lower: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = M) -> np.ndarray:
    """Most likely Jaccard similarity J of pairs: how many of m registers of a are higher and lower, and set sizes.

    With u, v the shares of the sizes, registers are higher, lower and equal with chances u - vJ,
    v - uJ and J, as far as BASE is near 1 (at 1.001 the error is under 0.0005). The derivative
    of the joint log-likelihood is zero where m*u*v*J^2 - t*J + u*v*equal = 0.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    t = u * u * (m - higher) + v * v * (m - lower)
    root = np.sqrt(np.maximum(t * t - 4 * m * u * u * v * v * (m - higher - lower), 0))
    return np.minimum((t - root) / (2 * m * u * v), np.minimum(u / v, v / u))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, given rows of registers and set sizes."""
    return likeliest((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b, a.shape[1])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (MD5 of the lower-cased word sequence), registers (binary)."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        hashes, first = word_hashes(texts, lower=True)
        sets = [shingles(hashes[a:b]) for a, b in zip(first, first[1:], strict=False)]
        keys = [hashlib.md5(b" ".join((t or "").encode().lower().split())).digest() for t in texts.to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "n_shingles": np.array([len(s) for s in sets], np.int64),
            "key": pa.array(keys, pa.binary()),
            "registers": pa.array([registers(s).tobytes() for s in sets], pa.binary()),
        }

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_texts(rows, rows.columns, "doc_id long, text_hash long, n_shingles long, key binary, registers binary", run)


def near_pairs(regs: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Symmetric matrix: which of the allowed pairs may be linked."""
    n, size = len(sizes), sizes.astype(np.float64)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 16):
        part = regs[i : i + 16, None, :]
        higher, lower = (part > regs[None]).sum(axis=2, dtype=np.int16), (part < regs[None]).sum(axis=2, dtype=np.int16)
        near[i : i + 16] = likeliest(higher.astype(float), lower.astype(float), size[i : i + 16, None], size[None, :]) >= NEAR
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    near &= allowed & (100 * low >= 100 * SIMILARITY * high)
    return near | near.T


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, by products of slices of the incidence matrix."""
    shared = np.zeros((len(sets), len(sets)), np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what only one set holds is in no intersection
    number = np.cumsum(count > 1) - 1
    several = (count > 1)[column]
    owner, column = owner[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, n, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        slice_ = np.zeros((len(sets), min(COLUMNS, n - first)), np.float32)
        slice_[owner[a:b], column[a:b] - first] = 1
        shared += slice_ @ slice_.T
    return shared


def strongest(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest of a symmetric matrix of weights (0: no edge)."""
    n = len(weights)
    best, via, out = np.zeros(n), np.full(n, -1), np.zeros(n, bool)
    edges = []
    for _ in range(n):
        at = int(np.where(out, -1.0, best).argmax())
        out[at] = True
        if best[at] > 0:
            edges.append((via[at], at))
        closer = weights[at] > best
        best, via = np.where(closer, weights[at], best), np.where(closer, at, via)
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _bucket_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A forest of the links across the components of one block of a bucket, or across two blocks."""
    table = table.sort_by("node")
    regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, M)
    node, n, part, block = (table.column(c).to_numpy() for c in ("node", "n", "component", "block"))
    allowed = part[:, None] != part[None, :]
    if key[1].as_py() != key[2].as_py():
        allowed &= block[:, None] != block[None, :]
    near = near_pairs(regs, n, allowed)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    hashes, first = word_hashes(table.column("text").combine_chunks().take(pa.array(rows)), lower=True)
    sets = [shingles(hashes[x:y]) for x, y in zip(first, first[1:], strict=False)]
    size = np.array([len(s) for s in sets])
    shared = intersections(sets)
    union = size[:, None] + size[None, :] - shared
    linked = near[np.ix_(rows, rows)] & (100 * shared >= 100 * SIMILARITY * union)
    i, j = strongest(np.where(linked, shared / union, 0))
    node = node[rows]
    return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})


def _pair_estimates(batches):
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("reg_a", "reg_b")
        )
        n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
        near = estimate(a, b, n_a, n_b) >= NEAR
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _confirm(batches):
    sets: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(node: int, text: str) -> np.ndarray:
        if node not in sets:
            if len(sets) >= 64:
                sets.popitem(last=False)
            hashes, first = word_hashes(pa.array([text]), lower=True)
            sets[node] = shingles(hashes)
        return sets[node]

    for batch in batches:
        rows = []
        for a, b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            x, y = of(a, text_a), of(b, text_b)
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            rows.append(100 * shared >= 100 * SIMILARITY * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(rows, pa.bool_()))


class _Search:
    """State of one run: one row per class of equal word sequences."""

    def __init__(self, docs: DataFrame, kept: Kept):
        self.docs, self.kept = docs, kept
        self.rows = kept(sketch(docs))
        known = self.rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        # a doc_id may stand for several texts, so nodes have numbers of their own, fixed as they are written
        classes = known.groupBy("key").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("n_shingles").alias("n"), F.min("registers").alias("registers")
        )
        self.nodes = kept(classes.select(F.monotonically_increasing_id().alias("node"), "key", "first.*", "n", "registers"))

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """Pairs that are a bucket of their own, and (bucket, node, size) of larger buckets.

        Of buckets with the same members, which near copies have in many bands, one is kept.
        """
        key = F.xxhash64("band", F.expr(f"substring(registers, band * {2 * STEP} + 1, {2 * ROWS})"))
        rows = self.nodes.select("node", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
        rows = rows.select("node", "band", key.alias("bucket"))
        members = F.count("*").alias("size"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("x")
        full = rows.groupBy("band", "bucket").agg(*members).filter("a <> b")
        full = full.groupBy("size", "a", "b", "x").agg(F.min(F.struct("band", "bucket")).alias("first"))
        full = self.kept(full.select("size", "a", "b", "first.*"))
        large = full.filter("size > 2").select("band", "bucket", "size")
        rows = sieve(rows, "bucket", large.select("bucket"))
        return full.filter("size = 2").select("a", "b"), self.kept(rows.join(large, ["band", "bucket"]))

    def of_two(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and registers let them be linked."""
        facts = self.nodes.select("node", "n", "registers")
        first = facts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("reg_a"))
        second = facts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("reg_b"))
        sized = pairs.join(second, "b").join(first, "a")
        sized = sized.filter(100 * F.least("n_a", "n_b") >= 100 * SIMILARITY * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", "n_a", "n_b", "reg_a", "reg_b").mapInArrow(_pair_estimates, "a long, b long")

    def texts(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """node, n, registers, text of all nodes that are to be confirmed."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
        # one row speaks for a node: that of its least doc_id, told by its hash from other texts of that doc_id
        wanted = self.kept(self.nodes.select("node", "doc_id", "text_hash").join(wanted, "node"))
        # not a semi join: Spark would move that below the sieve
        texts = sieve(self.docs.select("doc_id", "text"), "doc_id", wanted.select("doc_id")).withColumn("text_hash", F.xxhash64("text"))
        texts = texts.join(wanted, ["doc_id", "text_hash"]).groupBy("node").agg(F.min("text").alias("text"))
        return self.kept(texts.join(self.nodes.select("node", "n", "registers"), "node"))

    def first_links(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """Links inside the blocks of larger buckets; every band deals its blocks out anew."""
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int"))
        rows = rows.withColumn("component", F.col("node")).withColumn("low", F.col("block")).withColumn("high", F.col("block"))
        return self.links(rows, texts)

    def other_links(self, members: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
        """Links across the components of larger buckets that hold several.

        The largest component (blocks -1, -2, ...) meets the others (blocks 0, 1, ...), which also
        meet each other; a bucket of one block stays whole. Small buckets of the first bands are done.
        """
        now = members.filter((F.col("band") >= FIRST_BANDS) | (F.col("size") > BLOCK)).join(found, "node", "left")
        now = now.withColumn("component", F.coalesce("component", "node"))
        parts = now.groupBy("bucket", "component").agg(F.count("*").alias("rows"))
        parts = parts.groupBy("bucket").agg(F.max(F.struct("rows", "component")).alias("top"), F.count("*").alias("parts"))
        rows = now.join(parts.filter("parts > 1").select("bucket", "top"), "bucket")
        small, main = F.col("size") <= BLOCK, F.col("component") == F.col("top.component")
        mains = F.ceil(F.col("top.rows") / BLOCK).cast("int")
        others = F.ceil((F.col("size") - F.col("top.rows")) / BLOCK).cast("int")
        dealt = F.xxhash64("node", "bucket")
        block = F.when(small, 0).when(main, -1 - F.pmod(dealt, mains)).otherwise(F.pmod(dealt, others)).cast("int")
        among = F.sequence(F.lit(0), others - 1)
        meets = F.when(small, F.array(F.lit(0))).when(main, among).otherwise(F.concat(F.sequence(-mains, F.lit(-1)), among))
        rows = rows.withColumn("block", block).withColumn("with", F.explode(meets))
        rows = rows.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
        return self.links(rows, texts)

    def links(self, rows: DataFrame, texts: DataFrame) -> DataFrame:
        rows = rows.select("bucket", "low", "high", "node", "component", "block").join(texts, "node")
        return rows.groupBy("bucket", "low", "high").applyInArrow(_bucket_links, "a long, b long")

    def labels(self) -> DataFrame:
        """(node, component) of every node that is linked with another text."""
        pairs, members = self.buckets()
        pairs = self.kept(self.of_two(pairs))
        texts = self.texts(pairs, members)
        a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        linked = pairs.join(b, "b").join(a, "a").mapInArrow(_confirm, "a long, b long")
        links = self.kept(linked.unionByName(self.first_links(members.filter(F.col("band") < FIRST_BANDS), texts)))
        found = self.kept(components(links, self.kept))
        more = self.kept(self.other_links(members, found, texts))
        if not more.isEmpty():
            # a component is one link to its least node by now
            known = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = self.kept(components(known.unionByName(more), self.kept))
        self.kept.drop(texts)
        return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept, text_hash, key.

    Words are lower-cased in A-Z only; the set holds distinct runs of five words, or all words
    where there are fewer. Documents are linked if their sets' intersection is at least 0.75 of
    their union; component_id is the least doc_id reachable, kept marks that document.

    A null or empty text has an empty set and is linked with nothing, equal texts are one class
    and always linked. Rows that repeat a doc_id with other words are texts of their own, each
    with its own links: of several in one component, kept marks those of one class. Rows without
    doc_id take their class's component, or none, and are kept only if no row with a doc_id has
    the same words. text_hash (xxhash64) and key (of the class) tell rows of one doc_id apart.
    An empty table gives no rows.
    """
    kept = Kept(docs.sparkSession, "setsketch")
    search = _Search(docs, kept)
    found = search.labels()
    rows = search.rows
    nodes = search.nodes.select("node", "key", "doc_id").join(found, "node", "left")
    nodes = kept(nodes.withColumn("component", F.coalesce("component", "node")))
    least = nodes.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("rows"))
    # a component may have any share of all nodes
    classes = attach(nodes, kept(least), "component", "rows", ["node"]).select(
        "key", F.col("least.doc_id").alias("component_id"), (F.col("least.key") == F.col("key")).alias("leads")
    )
    joined = rows.drop("registers").join(classes, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    leads = (F.col("doc_id") == component) & F.coalesce("leads", F.lit(True))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(leads, component.isNull()).alias("kept"), "text_hash", "key"
    )
