"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are cut into blocks. A block's grid has a row for each asked term and a column for each
document; its cells hold impacts, the part of a score that needs no document frequency. The grid is
a quadtree in level order: four bits a node say which quarters hold a cell, and a node stores how
far its largest impact lies below its parent's. An item follows the paths of its rows jointly from
the root: a range of documents is bounded by the weighted sum of the largest impacts that each row
has in it, the range with the highest bound is split first, and what cannot reach the best ``k``
is never opened.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, mix, runs, span_hashes, term_spans

#: A block ends at so many documents or cells, whichever comes first.
BLOCK_DOCS, BLOCK_CELLS = 1 << 16, 1 << 20
#: Text of the items that ride along with one search; more items take further searches.
ITEM_BYTES = 16 << 20
#: Ranges split at once: few until the best ``k`` are known about, then many.
FIRST_RANGES, NEXT_RANGES = 64, 1024
#: Numbers that open ranges may hold before search goes depth first.
OPEN_NUMBERS = 1 << 25

_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of ``sizes``, in a row."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Vocabulary:
    """Asked terms, found in texts by hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        hashes = mix(span_hashes(self.data, self.starts, self.starts + self.sizes))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        # terms that share a hash stand side by side and are tried in turn
        self.tries = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the spans that are asked terms, and of their terms."""
        if not len(self.terms) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = mix(span_hashes(data, starts, ends))
        place = np.searchsorted(self.hashes, hashes)
        spans, terms = [], []
        for k in range(self.tries):
            at = np.minimum(place + k, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == hashes) & (place + k < len(self.hashes)))
            term = self.order[at[hit]]
            alike = self.sizes[term] == (ends - starts)[hit]
            hit, term = hit[alike], term[alike]
            if len(hit):
                n = self.sizes[term]
                same = data[ragged(starts[hit], n)] == self.data[ragged(self.starts[term], n)]
                equal = np.logical_and.reduceat(same, np.cumsum(n) - n)
                spans.append(hit[equal])
                terms.append(term[equal])
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(spans), np.concatenate(terms)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of numbers under 2^32 with a zero after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Height, nodes of each level, quarter bits of all inner nodes, and drops of all nodes.

    Cells are distinct and there is at least one. A node's drop is its parent's largest impact less
    its own; the root's is its largest impact.
    """
    height = max(int(rows.max()), int(columns.max())).bit_length()
    code = spread_bits(rows) << np.uint64(1) | spread_bits(columns)
    order = np.argsort(code)
    code, best = code[order], impacts[order].astype(np.int64)
    bits, drops, counts = [], [], [len(code)]
    for _ in range(height):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        above = np.maximum.reduceat(best, first)
        parent = np.cumsum(np.concatenate([[0], (up[1:] != up[:-1]).astype(np.int64)]))
        drops.append(above[parent] - best)
        quarter = np.left_shift(1, (code & np.uint64(3)).astype(np.int64))
        bits.append(np.bitwise_or.reduceat(quarter, first).astype(np.uint8))
        code, best = up[first], above
        counts.append(len(code))
    drops.append(best)
    joined = np.concatenate(bits[::-1]) if bits else np.zeros(0, np.uint8)
    return height, np.array(counts[::-1], np.int64), joined, np.concatenate(drops[::-1]).astype(np.uint32)


class Treap:
    """A block's quadtree, opened: per level the quarter bits, the first child and the largest impact of each node."""

    def __init__(self, height: int, counts: list[int], bits: np.ndarray, drops: np.ndarray):
        self.height = height
        self.bits, self.first, self.best = [], [], []
        at_bits = at_drops = 0
        above = None
        for level, n in enumerate(counts):
            best = drops[at_drops : at_drops + n].astype(np.int64)
            if level:
                best = np.repeat(above, ones) - best
            at_drops += n
            above = best
            self.best.append(np.append(best, 0))  # the last node stands for none
            if level < height:
                own = bits[at_bits : at_bits + n]
                at_bits += n
                ones = _ONES[own]
                self.bits.append(np.append(own, 0).astype(np.int64))
                self.first.append(np.append(np.cumsum(ones) - ones, 0))

    def children(self, level: int, nodes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """For each node its child in the column's quarter; none where there is none."""
        bits = self.bits[level][nodes]
        child = self.first[level][nodes] + _ONES[bits & ((1 << quarter) - 1)]
        return np.where(bits >> quarter & 1, child, len(self.best[level + 1]) - 1)


class Best:
    """The ``k`` best documents so far: highest score first, then smaller id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def least(self) -> int:
        """Score that another document must reach; one above zero until ``k`` are known."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, ids])
        null = np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Offer ``best`` every document of the block that may be among the best, most promising range first."""
    none = np.zeros((1, len(rows)), np.int64)
    bound = int(weights.sum() * treap.best[0][0])
    heap = [(-bound, 0, 0, none, np.array([bound]), np.zeros(1, np.int64))]
    count, held = 1, len(rows)
    while heap and -heap[0][0] >= best.least():
        if held > OPEN_NUMBERS:  # many rows and ranges: the deepest first, so that few stay open
            deepest = min(range(len(heap)), key=lambda i: heap[i][1])
            heap[deepest], heap[-1] = heap[-1], heap[deepest]
            _, depth, _, nodes, bounds, columns = heap.pop()
            heapq.heapify(heap)
        else:
            _, depth, _, nodes, bounds, columns = heapq.heappop(heap)
        level, least = -depth, best.least()
        if level == treap.height:  # the tree of one cell
            best.offer(bounds, ids[columns], null[columns])
            continue
        held -= nodes.size
        some = min(int(np.searchsorted(-bounds, -least, "right")), FIRST_RANGES if count <= treap.height else NEXT_RANGES)
        if len(bounds) > some and bounds[some] >= least:
            heapq.heappush(heap, (-int(bounds[some]), depth, count, nodes[some:], bounds[some:], columns[some:]))
            held += nodes[some:].size
            count += 1
        half = rows >> (treap.height - 1 - level) & 1
        parts = []
        for side in (0, 1):
            child = treap.children(level, nodes[:some], half * 2 + side)
            parts.append((child, treap.best[level + 1][child] @ weights, columns[:some] * 2 + side))
        child, bounds, columns = (np.concatenate(x) for x in zip(*parts))
        keep = np.flatnonzero(bounds >= least)
        keep = keep[np.argsort(-bounds[keep], kind="stable")]
        if not len(keep):
            continue
        if level + 1 == treap.height:
            best.offer(bounds[keep], ids[columns[keep]], null[columns[keep]])
        else:
            heapq.heappush(heap, (-int(bounds[keep[0]]), depth - 1, count, child[keep], bounds[keep], columns[keep]))
            held += len(keep) * len(rows)
            count += 1


INDEX_SCHEMA = (
    "doc_ids array<long>, terms array<int>, frequencies array<int>, height int, counts array<int>, bits binary, drops binary"
)


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for batch in batches:
            for part in runs(batch):
                _, starts, _, owner = term_spans(part.column("text"))
                some += len(np.unique(owner))
                every += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.array([every], pa.int64())], names=["n", "l"])

    row = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, terms: list[bytes], n_docs: int, n_terms: int) -> DataFrame:
    """One row per block of documents: its K2-treap over the asked terms.

    Every document that holds an asked term is a column of exactly one block. Within a block,
    documents stand in order of length, so that neighbours have alike impacts. A task holds one
    block; a text of any length is one column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Vocabulary(terms)
        block = Block(len(terms))
        for batch in batches:
            for part in runs(batch):
                data, starts, ends, owner = term_spans(part.column("text"))
                span, term = asked.find(data, starts, ends)
                block.add(part.column("doc_id"), np.bincount(owner, minlength=len(part)), owner[span], term)
                if block.cells >= BLOCK_CELLS or block.documents >= BLOCK_DOCS:
                    yield block.close(n_docs, n_terms)
                    block = Block(len(terms))
        if block.cells:
            yield block.close(n_docs, n_terms)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX_SCHEMA)


class Block:
    """Documents and their term counts, gathered until the block is full."""

    def __init__(self, n_asked: int):
        self.n_asked = max(n_asked, 1)
        self.ids, self.null, self.lengths, self.parts = [], [], [], []
        self.documents = self.cells = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, owner: np.ndarray, term: np.ndarray) -> None:
        key, times = np.unique(owner * self.n_asked + term, return_counts=True)
        owner, term = np.divmod(key, self.n_asked)
        kept = np.unique(owner)
        if not len(kept):
            return
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False)[kept])
        self.null.append(ids.is_null().to_numpy(zero_copy_only=False)[kept])
        self.lengths.append(lengths[kept])
        self.parts.append((self.documents + np.searchsorted(kept, owner), term, times))
        self.documents += len(kept)
        self.cells += len(term)

    def close(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        lengths = np.concatenate(self.lengths)
        order = np.argsort(lengths, kind="stable")
        column = np.empty_like(order)
        column[order] = np.arange(len(order))
        owner, term, times = (np.concatenate(x) for x in zip(*self.parts))
        asked, row, frequency = np.unique(term, return_inverse=True, return_counts=True)
        scale = 100 - 50 + (50 * lengths * n_docs) // n_terms
        impact = (1_000_000_000 * times) // (1000 * times + 20 * scale[owner])
        height, counts, bits, drops = build_treap(row, column[owner], impact)
        ids = pa.array(np.concatenate(self.ids)[order], mask=np.concatenate(self.null)[order])
        whole = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([asked.tolist()], whole), pa.array([frequency.tolist()], whole),
             pa.array([height], pa.int32()), pa.array([counts.tolist()], whole), pa.array([bits.tobytes()], pa.binary()),
             pa.array([drops.tobytes()], pa.binary())],
            names=["doc_ids", "terms", "frequencies", "height", "counts", "bits", "drops"],
        )


def search_index(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of each task's blocks for each item.

    ``items``: the asked terms of each item; ``weights``: one per asked term. A task carries its best
    from block to block, so later blocks open less, and hands over at most ``k`` rows an item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in items]
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = row["doc_ids"].values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                treap = Treap(
                    row["height"].as_py(), row["counts"].as_py(), np.frombuffer(row["bits"].as_buffer(), np.uint8),
                    np.frombuffer(row["drops"].as_buffer(), np.uint32),
                )
                place = np.full(len(weights), -1)
                asked = row["terms"].values.to_numpy(zero_copy_only=False)
                place[asked] = np.arange(len(asked))
                for best, terms in zip(found, items):
                    terms = terms[place[terms] >= 0]
                    if len(terms):
                        descend(treap, place[terms], weights[terms], ids, null, best)
        for item, best in enumerate(found):
            if len(best.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.ids), item)), pa.array(best.ids, mask=best.null), pa.array(best.scores)],
                    names=["item", "doc_id", "score"],
                )

    return index.mapInArrow(run, "item long, doc_id long, score long")


def item_terms(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct terms of all items, and of each item as numbers of those."""
    data, starts, ends, owner = term_spans(pa.array(texts, pa.string()))
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    own: list[set[int]] = [set() for _ in texts]
    for a, b, i in zip(starts.tolist(), ends.tolist(), owner.tolist()):
        own[i].add(number.setdefault(raw[a:b], len(number)))
    return list(number), [np.array(sorted(x), np.int64) for x in own]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` highest-scoring documents of each item.

    ``docs``: doc_id, text; ``items``: item_id, text. Distinct rows of ``items`` are items of their
    own, so repeated rows count once and an item_id with two texts has two rankings. Rows of ``docs``
    that repeat a doc_id are documents of their own. Null and empty texts hold no term: such documents
    are in no ranking and such items have none. Equal scores rank by ascending doc_id, null last.
    Empty tables give no rows. Items come to the driver and ride to the tasks in portions of about
    ITEM_BYTES of text, each searched against all documents.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "ranked-search")
    n_docs, n_terms = totals(docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = 1 + size // ITEM_BYTES if n_docs and size else 0
    for portion in range(portions):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == portion).collect()
        terms, own = item_terms([r["text"] for r in rows])
        if not terms:
            continue
        index = kept(build_index(docs, terms, n_docs, n_terms))
        df = index.select(F.inline(F.arrays_zip("terms", "frequencies"))).groupBy("terms").agg(F.sum("frequencies").alias("df"))
        held = np.zeros(len(terms), np.int64)
        for r in df.collect():  # no more rows than asked terms
            held[r["terms"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in held.tolist()], np.int64)
        own = [x[weights[x] > 0] for x in own]
        found = search_index(index, own, weights, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
