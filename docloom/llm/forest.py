"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors again and again at a threshold of a random projection; vectors close
to a threshold go to both sides. Vectors of one leaf are compared with one another in double
precision, the links that leaves find are united, and every link is counted once however many
leaves see it. The trees are fitted on a bounded sample; every vector is put into all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, components

COSINE = 0.9
#: The fewest trees; there are more where they are deep, so that all of them part a barely linked pair with a chance
#: of at most MISSED. KEPT is the chance that one level keeps such a pair together, of vectors spread evenly.
TREES, MISSED, KEPT = 8, 0.001, 0.925
#: Vectors wanted in a leaf; splitting goes on until the whole table would leave about so many.
LEAF = 256
#: Numbers in the sample that the trees are fitted on, and the fewest sampled vectors of a node that is split.
SAMPLE_VALUES, LEAST_SAMPLED = 2_000_000, 32
#: Vectors on either side of a threshold that go to both, as a share of the deviation of a barely linked pair.
SPILL = 0.25
#: A node whose best threshold has more than this share of its sample that close is not split.
MAX_SPILLED = 0.3
#: Vectors of one block; a larger leaf is compared block by block.
BLOCK = 1024
SEED = 11
MAX_DEPTH = 24


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Tree:
    """Splits by node (children of i are 2i and 2i + 1): a direction and a threshold."""

    def __init__(self, sample: np.ndarray, depth: int, seed: list[int]):
        self.width = SPILL * np.sqrt(2 - 2 * COSINE) / np.sqrt(sample.shape[1])
        self.splits: dict[int, tuple[np.ndarray, float]] = {}
        rng, todo = np.random.default_rng(seed), [(1, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop(0)
            if level >= depth or len(rows) < LEAST_SAMPLED:
                continue
            direction = rng.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            at = sample[rows] @ direction
            # of the middle thresholds the one with the fewest vectors nearby: never through a dense group
            tries = np.quantile(at, np.linspace(0.3, 0.7, 17))
            ordered = np.sort(at)
            near = np.searchsorted(ordered, tries + self.width) - np.searchsorted(ordered, tries - self.width)
            best = int(near.argmin())
            if near[best] > MAX_SPILLED * len(rows):
                continue
            self.splits[node] = (direction, float(tries[best]))
            todo += [(2 * node, rows[at < tries[best]], level + 1), (2 * node + 1, rows[at >= tries[best]], level + 1)]

    @property
    def levels(self) -> int:
        return max((node.bit_length() for node in self.splits), default=0)

    def leaves(self, vectors: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, row numbers) of all leaves that hold any of the vectors."""
        out, todo = [], [(1, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node not in self.splits:
                out.append((node, rows))
                continue
            direction, threshold = self.splits[node]
            at = vectors[rows] @ direction
            todo += [(2 * node, rows[at < threshold + self.width]), (2 * node + 1, rows[at >= threshold - self.width])]
        return out


def usable(vector: str) -> str:
    """SQL condition: has a direction, and no component that is null or not finite."""
    bad = f"x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')"
    return f"{vector} IS NOT NULL AND NOT exists({vector}, {bad}) AND exists({vector}, x -> x <> 0)"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def trees_for(levels: int) -> int:
    """How many trees of so many levels miss a barely linked pair with a chance of at most MISSED."""
    return int(np.ceil(np.log(MISSED) / np.log1p(-(KEPT**levels)))) if levels else 1


def grow(sample: np.ndarray, depth: int, least: int) -> list[Tree]:
    """``least`` trees, or as many more as the deepest of them asks for."""
    forest: list[Tree] = []
    while len(forest) < max(least, trees_for(max((t.levels for t in forest), default=0))):
        forest.append(Tree(sample, depth, [SEED, sample.shape[1], len(forest)]))
    return forest


def fit(classes: DataFrame, total: int, dim: int, trees: int) -> list[Tree]:
    """Trees for vectors of one dimension, ``trees`` or more, fitted on SAMPLE_VALUES numbers at most."""
    most = max(LEAST_SAMPLED, SAMPLE_VALUES // dim)
    # a hash decides, so reruns fit the same trees; about ``most`` classes pass, whatever the total
    place = F.xxhash64("key", F.lit(SEED)).cast("double")
    picked = classes.filter(place <= F.lit(min(1.0, most / max(1, total)) * 2.0**64 - 2.0**63)).select("key", "unit")
    rows = sorted((bytes(r["key"]), bytes(r["unit"])) for r in picked.collect())
    sample = np.frombuffer(b"".join(u for _, u in rows), np.float64).reshape(-1, dim)
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, total) / LEAF)))))
    return grow(sample, depth, trees)


def _place(forest: list[Tree], dim: int):
    """Rows (tree, leaf, places) of each vector: places lists all its (tree, leaf)."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                vectors = _matrix(part.column("unit"), dim)
                found = [(t, leaf, row) for t, tree in enumerate(forest) for leaf, rows in tree.leaves(vectors) for row in rows]
                codes: list[list[int]] = [[] for _ in range(len(part))]
                for t, leaf, row in found:
                    codes[row].append(t << 32 | leaf)
                places = [np.array(sorted(c), np.int64).tobytes() for c in codes]
                rows = pa.array([f[2] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f[0] << 32 | f[1] for f in found], pa.int64()),
                        *(part.column(c).take(rows) for c in ("node", "copies", "unit")),
                        pa.array([places[f[2]] for f in found], pa.binary()),
                    ],
                    names=["place", "node", "copies", "unit", "places"],
                )

    return run


def _compare(dim: int):
    """Within one pair of blocks of a leaf: links counted here first, and one link to each local component's least."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        place, low, high = (k.as_py() for k in key)
        nodes, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        block = table.column("block").to_numpy()
        vectors = _matrix(table.column("unit").combine_chunks(), dim)
        link = vectors @ vectors.T >= COSINE
        np.fill_diagonal(link, False)
        if low != high:
            link &= block[:, None] != block[None, :]
        earlier = [c[c < place] for c in (np.frombuffer(p, np.int64) for p in table.column("places").to_pylist())]
        codes, column = np.unique(np.concatenate(earlier), return_inverse=True)
        seen = np.zeros((len(nodes), max(1, len(codes))), np.float32)
        seen[np.repeat(np.arange(len(nodes)), [len(e) for e in earlier]), column] = 1
        first = link & ((seen @ seen.T) == 0)
        label, before = nodes.copy(), None
        while before is None or (label != before).any():
            before = label
            label = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        return pa.table({"node": nodes, "found": first @ copies, "other": label})

    return run


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``table``.

    Vectors are linked at a cosine of 0.9 or more, computed in double precision; n_links counts the
    other rows linked directly, component_id is the least vec_id reachable. A vector that is null,
    empty, zero or holds a null or non-finite component is linked with nothing; so are vectors of
    different lengths with one another. Equal vectors are one class: compared once, linked always.
    Rows with a null or repeated vec_id are counted as links like others. Links are between classes,
    which have numbers of their own: rows that share a vec_id but not a vector keep their own links
    and components, and a component is named by the least vec_id in it (null where none has one; its
    rows are then kept). An empty table gives no rows. ``trees`` is the least number of trees; deep ones are more.
    """
    spark = table.sparkSession
    kept = Kept(spark, "forest")
    wide = F.transform(vector, lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.when(F.expr(usable(f"`{vector}`")), wide).alias("v"))

    def units(batches):
        for batch in batches:
            values = batch.column("v").to_pylist()
            data = [None if v is None else unit(np.array([v]))[0].tobytes() for v in values]
            keys = [None if v is None else np.array(v, np.float64).tobytes() for v in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(data, pa.binary()), pa.array([v and len(v) for v in values], pa.int32()), pa.array(keys, pa.binary())],
                names=["vec_id", "unit", "dim", "raw"],
            )

    rows = rows.mapInArrow(units, "vec_id long, unit binary, dim int, raw binary")
    rows = kept(rows.select("vec_id", "unit", "dim", F.unhex(F.md5("raw")).alias("key")))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("unit").alias("unit"), F.min("dim").alias("dim")
    )
    # numbered as it is written, so a class has one number from then on
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()))
    found = edges = None
    for dim, total in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        mine = classes.filter(F.col("dim") == dim)
        forest = fit(mine, total, dim, trees)
        placed = mine.select("node", "copies", "unit").mapInArrow(
            _place(forest, dim), "place long, node long, copies long, unit binary, places binary"
        )
        placed = kept(placed)
        # leaves of more than a block: each block meets each other one, in a task of its own
        sizes = placed.groupBy("place").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        cut = placed.join(sizes, "place").withColumn("block", F.pmod(F.xxhash64("node", "places"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cut = cut.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
        pairs = cut.groupBy("place", "low", "high").applyInArrow(_compare(dim), "node long, found long, other long")
        pairs = kept(pairs.filter("found > 0 OR node <> other"))
        kept.drop(placed)
        edges = pairs if edges is None else edges.unionByName(pairs)
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = edges.groupBy("node").agg(F.sum("found").alias("found"))
    united = components(edges.select(F.col("node").alias("a"), F.col("other").alias("b")), kept)
    named = united.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("name"))
    facts = classes.join(found, "node", "left").join(united, "node", "left").join(named, "component", "left").select(
        "key", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("c"),
    )
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    joined = rows.select("vec_id", "key").join(facts, "key", "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )
