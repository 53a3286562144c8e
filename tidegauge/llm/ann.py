"""Nearest neighbours by inner product: low-dimensional stable projections, kd-tree, chi-square stopping test.

With M the largest norm, x becomes (x / M, sqrt(1 - |x|^2 / M^2)) and a query q becomes (q / |q|, 0), all of length 1;
then the nearest by distance are those of largest inner product. DIMS random projections with normally
distributed (2-stable) weights map them to few dimensions, where the square of a distance d becomes d^2 times a
chi-square variable with DIMS degrees of freedom.

A kd-tree over the projections, with splits from a bounded sample, deals all rows into cells, and within a cell a
kd-tree goes on down to its leaves. A query takes cells, and leaves in them, in the order of their
projected distance, and verifies the rows there on the original vectors. With d the distance of the worst
of the best found so far, it stops as soon as a row within d would have shown up nearer than the next
cell or leaf with probability SURE. Cells are taken in waves, one, then WIDER times as many each: a wave's results
lower d before the next one is dealt out.

Copies of one vector are one row of the index with their COPIES smallest ids, all that can be in a result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import cut

#: Neighbours of a query, projected dimensions, probability of the stopping test, seed of the projections.
K, DIMS, SURE, SEED = 20, 8, 0.98, 42
#: Rows of a cell (on average) and of a leaf, sampled rows, queries verified at once and in one part of a cell.
CELL, LEAF, SAMPLE, AT_ONCE, PART = 8192, 256, 1 << 15, 512, 4096
#: How many times as many cells each wave takes, the deepest tree of cells (then cells grow instead), and numbers held by a search for cells.
WIDER, DEEPEST, HELD = 8, 16, 1 << 22


# ---- projections and the kd-tree -----------------------------------------------------------------------------

def weights(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, dims))


def projected(vectors: np.ndarray, largest: float | None, by: np.ndarray) -> np.ndarray:
    """Projections of indexed vectors for the largest norm, or of queries if there is none."""
    norm = np.linalg.norm(vectors, axis=1)
    if largest is None:
        return (vectors / norm[:, None]) @ by[:-1]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (norm / largest) ** 2))
    return (vectors / largest) @ by[:-1] + rest[:, None] * by[-1]


def split(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Leaves of a kd-tree as row numbers: halves at the median of the widest dimension, down to `rows` each."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            leaves.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        order = own[np.argsort(points[own, axis], kind="stable")]
        todo += [order[:len(own) // 2], order[len(own) // 2:]]
    return leaves


def planes(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """The splits of a complete kd-tree of that depth in heap order: (dimension, value; the upper half is above)."""
    tree: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for own in level:
            axis = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            tree.append((axis, at))
            upper = own[:, axis] > at if len(own) else np.zeros(0, bool)
            below += [own[~upper], own[upper]]
        level = below
    return tree


def cells_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The number of each point's cell."""
    at, depth = np.zeros(len(points), np.int64), (len(tree) + 1).bit_length() - 1
    axis, value = np.array([a for a, _ in tree], np.int64), np.array([v for _, v in tree])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > value[at])
    return at - len(tree)


def far(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(0.0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of the chi-square law for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1.0 - np.exp(-half) * total


def over(distance: np.ndarray, worst: np.ndarray, norm: np.ndarray, largest: float, sure: float) -> np.ndarray:
    """Whether the stopping test holds: rows of an inner product above `worst` would, with that probability, have a
    squared projected distance below `distance`. With fewer than K found (`worst` is -inf) it never holds."""
    d2 = np.maximum(2.0 - 2.0 * worst / (norm * largest), 1e-12)
    return np.isfinite(worst) & (chi_square(distance / d2, DIMS) >= sure)


# ---- verification in a cell ------------------------------------------------------------------------------------

class Cell:
    """The rows of a cell: vectors, their copies' ids, and the leaves of a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, ids: list, largest: float, by: np.ndarray):
        points = projected(vectors, largest, by)
        self.vectors, self.ids, self.largest, self.by = vectors, ids, largest, by
        self.leaves = split(points, LEAF)
        self.low = np.array([points[leaf].min(0) for leaf in self.leaves])
        self.high = np.array([points[leaf].max(0) for leaf in self.leaves])

    def search(self, queries: np.ndarray, worst: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows (or -1) and inner products of the best k found in this cell, given the worst
        inner product that still counts."""
        norm = np.linalg.norm(queries, axis=1)
        distance = far(projected(queries, None, self.by), self.low, self.high)
        order = np.argsort(distance, axis=1, kind="stable")
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1, np.int64)
        active = np.arange(len(queries))
        for turn in range(len(self.leaves)):
            leaf = order[active, turn]
            bound = np.maximum(worst[active], best[active, -1])
            go = ~over(distance[active, leaf], bound, norm[active], self.largest, sure)
            active, leaf = active[go], leaf[go]
            for one in np.unique(leaf):
                mine = active[leaf == one]
                members = self.leaves[one]
                score = np.hstack([best[mine], queries[mine] @ self.vectors[members].T])
                place = np.hstack([rows[mine], np.broadcast_to(members, (len(mine), len(members)))])
                top = np.argsort(-score, axis=1, kind="stable")[:, :k] if score.shape[1] <= 2 * k else \
                    np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, place = np.take_along_axis(score, top, 1), np.take_along_axis(place, top, 1)
                down = np.argsort(-score, axis=1, kind="stable")
                best[mine], rows[mine] = np.take_along_axis(score, down, 1), np.take_along_axis(place, down, 1)
        return rows, best

    def results(self, queries: np.ndarray, own: list, worst: np.ndarray, k: int, sure: float) -> Iterator[tuple]:
        """(query's place, id, inner product) of at most k rows a query, not its own; the query's own vector may
        take a place, so one more is looked for. Inner products are added in one order everywhere."""
        rows, _ = self.search(queries, worst, k + 1, sure)
        for i, (found, query) in enumerate(zip(rows, queries)):
            found = found[found >= 0]
            score = (self.vectors[found] * query).sum(1)
            pairs = sorted((-s, x) for s, r in zip(score.tolist(), found.tolist()) if s >= worst[i] for x in self.ids[r] if x != own[i])
            for s, x in pairs[:k]:
                yield i, x, -s


# ---- the index -------------------------------------------------------------------------------------------------

def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, once each; floats stay floats, other components become doubles."""
    kind = rows.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vec"))
    return plain.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(
        F.forall("vec", good) & F.exists("vec", lambda x: x != 0)).distinct()


def widened(rows: DataFrame, width: int) -> DataFrame:
    """Vectors of one width; shorter ones are filled with zeros."""
    zero = F.lit(0).cast(rows.schema["vec"].dataType.elementType)
    return rows.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")).otherwise(
        F.concat("vec", F.array_repeat(zero, F.lit(width) - F.size("vec")))))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


class Index:
    """All rows dealt into the cells of a kd-tree; `tree` and the cells' boxes are small and go with each task."""

    def __init__(self, vectors: DataFrame, k: int = K, cell: int = CELL, sample: int = SAMPLE):
        self.spark: SparkSession = vectors.sparkSession
        self.k, self.kind = k, vectors.schema["vec"].dataType.simpleString()
        shape = vectors.agg(F.max(F.size("vec")).alias("width"), F.max(norm(F.col("vec"))).alias("largest"), F.count(F.lit(1)).alias("n")).first()
        self.width, self.largest, n = shape["width"] or 1, shape["largest"] or 1.0, shape["n"]
        self.by = weights(self.width)
        self.depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, n / cell))))))
        distinct = Window.partitionBy("vec").orderBy("vec_id")
        once = widened(vectors, self.width).withColumn("copy", F.row_number().over(distinct)).where(F.col("copy") <= k + 1) \
            .groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        once = cut(once)
        share = min(1.0, sample / max(1, n))
        drawn = once.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "vec"), 24) < int(share * (1 << 40))) if share < 1 else once
        drawn = drawn.select("vec").limit(2 * sample).toArrow()  # the share bounds it in expectation, this in any case
        points = projected(matrix(drawn["vec"].combine_chunks(), self.width), self.largest, self.by) if len(drawn) else np.zeros((0, DIMS))
        self.tree = planes(points, self.depth)
        self.cells = cut(self._dealt(once))
        boxes = self.cells.groupBy("cell").agg(*[f(F.col("point")[d]).alias(f"{n}{d}") for n, f in (("l", F.min), ("h", F.max)) for d in range(DIMS)]).toArrow()
        boxes = boxes.sort_by("cell").to_pydict()  # one row a cell
        self.numbers = np.array(boxes["cell"], np.int64)
        self.low, self.high = (np.array([boxes[f"{n}{d}"] for d in range(DIMS)], float).T.reshape(-1, DIMS) for n in "lh")

    def _dealt(self, once: DataFrame) -> DataFrame:
        width, largest, by, tree = self.width, self.largest, self.by, self.tree

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = projected(matrix(batch.column(0), width), largest, by)
                cell = cells_of(points, tree)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(list(points), pa.list_(pa.float64()))],
                                                 ["vec", "ids", "cell", "point"])

        return once.mapInArrow(run, f"vec {self.kind}, ids array<long>, cell long, point array<double>")

    def visits(self, asked: DataFrame, skip: int, most: int, sure: float) -> DataFrame:
        """(q, vec_id, vec, worst, cell): the cells that each query of asked (q, vec_id, vec, worst) takes in a wave, those at
        places skip to most in the order of their projected distance for which the stopping test fails."""
        by, low, high, numbers, largest, width = self.by, self.low, self.high, self.numbers, self.largest, self.width
        rows = max(1, min(AT_ONCE, HELD // max(1, len(numbers))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    batch = whole.slice(at, rows)
                    vectors = matrix(batch.column(2), width)
                    worst = batch.column(3).to_numpy(zero_copy_only=False)
                    distance = far(projected(vectors, None, by), low, high)
                    order = np.argsort(distance, axis=1, kind="stable")[:, skip:most]
                    size = np.linalg.norm(vectors, axis=1)[:, None]
                    go = ~over(np.take_along_axis(distance, order, 1), np.broadcast_to(worst[:, None], order.shape), size, largest, sure)
                    query, place = np.nonzero(go)
                    for part in range(0, len(query), 1 << 13):
                        some = query[part:part + (1 << 13)]
                        yield pa.RecordBatch.from_arrays(
                            [*batch.take(pa.array(some)).columns, pa.array(numbers[order[some, place[part:part + (1 << 13)]]], pa.int64())],
                            ["q", "vec_id", "vec", "worst", "cell"])

        return asked.select("q", "vec_id", "vec", "worst").mapInArrow(run, f"q long, vec_id long, vec {self.kind}, worst double, cell long")

    def verified(self, visits: DataFrame, sure: float) -> DataFrame:
        """(q, query_id, vec_id, score): the best rows of each query in each cell that it takes. A cell with many queries
        is verified in parts; a task holds one cell's rows and AT_ONCE queries."""
        largest, by, k, width = self.largest, self.by, self.k, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, rows, ids, cell, asked = None, [], [], None, []

            def answers() -> Iterator[pa.RecordBatch]:
                found = list(cell.results(np.array([a[2] for a in asked]), [a[1] for a in asked], np.array([a[3] for a in asked]), k, sure))
                which = [asked[i] for i, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[0] for w in which], pa.int64()), pa.array([w[1] for w in which], pa.int64()),
                     pa.array([x for _, x, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())],
                    ["q", "query_id", "vec_id", "score"])
                asked.clear()

            for batch in batches:
                vectors = matrix(batch.column("vec"), width)
                columns = [batch.column(c).to_pylist() for c in ("cell", "part", "ids", "q", "vec_id", "worst")]
                for i, (number, part, copies, q, vec_id, worst) in enumerate(zip(*columns)):
                    if (number, part) != key:
                        if asked:
                            yield from answers()
                        key, rows, ids, cell = (number, part), [], [], None
                    if copies is not None:  # a cell's rows come before its queries
                        rows.append(vectors[i])
                        ids.append(copies)
                        continue
                    if cell is None:
                        cell = Cell(np.array(rows), ids, largest, by)
                    asked.append((q, vec_id, vectors[i], worst))
                    if len(asked) == AT_ONCE:
                        yield from answers()
            if asked:
                yield from answers()

        visits = cut(visits)
        parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # one row a cell
        none = lambda kind: F.lit(None).cast(kind)
        asked = visits.join(parts, "cell").select("cell", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"),
                                                  "vec", none("array<long>").alias("ids"), "q", "vec_id", "worst")
        held = self.cells.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                                                     "vec", "ids", none("long").alias("q"), none("long").alias("vec_id"), none("double").alias("worst"))
        return asked.unionByName(held).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind") \
            .mapInArrow(run, "q long, query_id long, vec_id long, score double")

    def nearest(self, queries: DataFrame, sure: float = SURE) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest found for each of the queries (vec_id, vec)."""
        asked = cut(widened(queries, self.width).withColumn("q", F.xxhash64("vec_id", "vec")))
        by = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
        best, skip, most = None, 0, 1
        while skip < max(1, len(self.numbers)):
            if best is None:
                todo = asked.withColumn("worst", F.lit(float("-inf")))
            else:
                kth = best.where(F.col("rank") == self.k).select("q", F.col("score").alias("kth"))
                todo = asked.join(kth, "q", "left").withColumn("worst", F.coalesce("kth", F.lit(float("-inf"))))
            found = self.verified(self.visits(todo, skip, most, sure), sure)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            best = cut(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= self.k))
            skip, most = most, most + WIDER * (most - skip)
        return best.select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
           sure: float = SURE, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of rows for which `queries` holds: its k nearest found among all rows
    but its own id, by inner product in double precision, ties to the smaller id, all candidates if there are fewer.
    Rows with a null id, and vectors that are null, zero, or hold a null or non-finite component, take no part;
    shorter vectors are filled with zeros; copies of a vector under different ids are candidates each, repeated
    rows count once, and different vectors under one id are queries and candidates each; other columns are not read;
    an empty table gives an empty result. The sample for the tree's splits has about SAMPLE rows; all rows are indexed."""
    plain = cut(usable(rows, vec_id, vector))
    return Index(plain, k, cell).nearest(usable(rows.where(queries), vec_id, vector), sure)
