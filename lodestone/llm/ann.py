"""Nearest neighbours by cosine: a forest of random-projection trees, searched through one priority queue per query, and
exact reranking of the rows in the leaves it reaches.

Planes lie halfway between two random points; below the depth that a sample supports, they are random directions through
the node's sample mean.  One tree, from a bounded sample of the rows, cuts the space into cells of about `CELL` rows;
every row goes to its cell, once.  A query goes to as many of the nearest cells as hold nearly all neighbours of a few
probes within the sample, where neighbours are farther apart than among all rows: the cautious side.  In each cell, a
forest is grown from all rows of the cell, and the queue gives the nearest leaves over its trees, as many as find nearly
all neighbours of some probes there.  Candidates that several trees find are looked at once.  So both budgets follow the
data: vectors in clusters need few cells and leaves, vectors without any need about half of the rows.

Equal vectors are indexed once; of each, the smallest k + 1 ids are kept, which is all that k results and a query's own
row can use.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite parts, and those of another length than
most, take no part; a query with fewer than k other vectors gets them all; ties go to the smaller id; rows that repeat
an id count once; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged

K = 5
TREES = 8
LEAF = 64
#: Rows to a cell.
CELL = 8192
#: Rows that cells are chosen from, at most, and probes that budgets are chosen with.
SAMPLE, PROBES = 20_000, 128
#: Share of the probes' neighbours that the cells, and in each cell the leaves, have to hold.
FOUND = 0.98
#: Leaves of a cell's forest that are tried, in this order, as shares of all.
SHARES = (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.3, 0.5, 1.0)


@dataclass
class Tree:
    normal: np.ndarray  # nodes x dimensions
    offset: np.ndarray
    child: np.ndarray  # nodes x 2; -1 - leaf for a leaf
    leaves: int


def _grow(points: np.ndarray, least: int, extra: int, rng: np.random.Generator) -> Tree:
    """least: sample points to a leaf; extra: levels below the sample's."""
    normals: list[np.ndarray] = []
    offsets: list[float] = []
    children: list[list[int]] = []
    leaves = 0
    dims = points.shape[1]

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    def node(rows: np.ndarray, spare: int) -> int:
        if len(rows) > least and len(rows) > 1:
            for _ in range(5):
                a, b = points[rng.choice(rows, 2, replace=False)]
                way = a - b
                size = np.linalg.norm(way)
                if size == 0:
                    continue
                way = way / size
                at = float(way @ (a + b)) / 2
                side = points[rows] @ way > at
                if 0.03 < side.mean() < 0.97:
                    return split(way, at, rows[~side], rows[side], spare)
            way = rng.normal(size=dims)
            way /= np.linalg.norm(way)
            p = points[rows] @ way
            at = float(np.median(p))
            side = p > at
            if side.any():
                return split(way, at, rows[~side], rows[side], spare)
        if spare <= 0:
            return leaf()
        way = rng.normal(size=dims)
        way /= np.linalg.norm(way)
        return split(way, float(points[rows].mean(0) @ way) if len(rows) else 0.0, rows, rows, spare - 1)

    def split(way: np.ndarray, at: float, left: np.ndarray, right: np.ndarray, spare: int) -> int:
        i = len(normals)
        normals.append(way)
        offsets.append(at)
        children.append([0, 0])
        for k, rows in enumerate((left, right)):
            children[i][k] = node(rows, spare)
        return i

    root = node(np.arange(len(points)), extra)
    if root < 0:
        normals, offsets, children = [np.zeros(dims)], [0.0], [[-1, -1]]
    return Tree(np.array(normals, dtype=np.float32), np.array(offsets, dtype=np.float32), np.array(children, dtype=np.int32), leaves)


class Forest:
    def __init__(self, points: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        """points: unit vectors of the sample; rows: of the index."""
        share = max(1.0, rows / max(1, len(points)))
        least = max(1, int(leaf / share))
        extra = max(0, int(np.ceil(np.log2(share / leaf)))) if share > leaf else 0
        rng = np.random.default_rng(seed)
        self.trees = [_grow(points.astype(np.float64), least, extra, rng) for _ in range(trees)]

    @classmethod
    def of(cls, trees: list[Tree]) -> Forest:
        out = cls.__new__(cls)
        out.trees = trees
        return out

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """rows x trees: each row's leaf in each tree."""
        out = np.empty((len(vectors), len(self.trees)), dtype=np.int32)
        for k, t in enumerate(self.trees):
            at = np.zeros(len(vectors), dtype=np.int32)
            live = np.arange(len(vectors))
            while len(live):
                here = at[live]
                side = np.einsum("ij,ij->i", vectors[live], t.normal[here]) > t.offset[here]
                at[live] = t.child[here, side.astype(np.int8)]
                live = live[at[live] >= 0]
            out[:, k] = -1 - at
        return out

    def search(self, vector: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one shared queue reaches first."""
        margins = [(t.normal @ vector - t.offset).tolist() for t in self.trees]
        queue = [(-np.inf, k, 0) for k in range(len(self.trees))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < leaves:
            cost, k, i = heapq.heappop(queue)
            while i >= 0:
                m = margins[k][i]
                near, far = self.trees[k].child[i, int(m > 0)], self.trees[k].child[i, int(m <= 0)]
                heapq.heappush(queue, (max(cost, abs(m)), k, int(far)))
                i = int(near)
            found.append((k, -1 - i))
        return found


def cells_needed(tree: Tree, points: np.ndarray, k: int, found: float = FOUND, probes: int = PROBES) -> int:
    """How many of the nearest cells hold `found` of the k neighbours of some probes among the points."""
    if tree.leaves == 1 or len(points) < 2:
        return 1
    router = Forest.of([tree])
    where = router.places(points)[:, 0]
    ranks = []
    for i in np.linspace(0, len(points) - 1, min(probes, len(points))).astype(int):
        score = points @ points[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(points) - 1) - 1)[:k]
        place = np.empty(tree.leaves, dtype=np.int64)
        place[[leaf for _, leaf in router.search(points[i], tree.leaves)]] = np.arange(tree.leaves)
        ranks.append(place[where[near]])
    return int(np.quantile(np.concatenate(ranks), found, method="higher")) + 1


class Cell:
    """A cell's rows, in order of id, with their forest."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, trees: int, leaf: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.k = ids[order], rows[order], k
        self.norms = np.linalg.norm(self.rows, axis=1)
        self.unit = (self.rows / self.norms[:, None]).astype(np.float32)
        self.forest = Forest(self.unit, len(ids), trees, leaf)
        self.members = []
        for t, where in zip(self.forest.trees, self.forest.places(self.unit).T, strict=True):
            by_leaf = np.argsort(where, kind="stable")
            self.members.append((by_leaf, np.searchsorted(where[by_leaf], np.arange(t.leaves + 1))))
        self.leaves = self._needed()

    def candidates(self, unit: np.ndarray, leaves: int) -> np.ndarray:
        """Distinct rows in the leaves that the queue reaches first."""
        parts = [self.members[k][0][self.members[k][1][x] : self.members[k][1][x + 1]] for k, x in self.forest.search(unit, leaves)]
        hit = np.zeros(len(self.ids), dtype=bool)
        for part in parts:
            hit[part] = True
        return np.flatnonzero(hit)

    def _needed(self) -> int:
        n, total = len(self.ids), sum(t.leaves for t in self.forest.trees)
        probes = np.linspace(0, n - 1, min(PROBES // 4, n)).astype(int)
        score = self.unit[probes] @ self.unit.T
        score[np.arange(len(probes)), probes] = -np.inf
        k = min(self.k, n - 1)
        near = np.argsort(-score, axis=1)[:, :k]
        for share in SHARES:
            leaves = max(1, int(np.ceil(share * total)))
            got = sum(np.isin(near[j], self.candidates(self.unit[i], leaves)).sum() for j, i in enumerate(probes))
            if got >= FOUND * near.size:
                return leaves
        return total

    def nearest(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best candidates, and how many there were.  Ties go to the smaller id."""
        size = np.linalg.norm(query)
        at = self.candidates((query / size).astype(np.float32), self.leaves)
        score = (self.rows[at] @ query) / (size * self.norms[at])
        top = np.argsort(-score, kind="stable")[: self.k + 1]
        return self.ids[at[top]], score[top], len(at)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row for which `queries`, a condition on id_col,
    holds; and looked_at, the number of distances that were computed for the query."""
    spark = vectors.sparkSession
    good = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("q"))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = lengths[0][0] if lengths else 0
    keyed = good.filter(F.size("v") == dims).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    # Of equal vectors, the k + 1 smallest ids; and every query, which is the stated set.
    ranked = keyed.withColumn("n", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("n") <= k + 1)
    distinct = staged(ranked.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    n = distinct.count()
    asked = keyed.filter("q").select(F.col("id").alias("query_id"), "v").dropDuplicates(["query_id"])
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, looked_at long")
    cut = distinct.select(F.xxhash64("id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    points = np.array([r[0] for r in distinct.filter(F.xxhash64("id") <= cut).orderBy("id").select("v").collect()], dtype=np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    router = Forest(points, n, 1, cell)
    most = cells_needed(router.trees[0], points.astype(np.float32), k)
    held = spark.sparkContext.broadcast(router)

    def unit(m: np.ndarray) -> np.ndarray:
        return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                where = held.value.places(unit(_matrix(batch.column(1), dims)))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.zeros(len(batch), dtype=np.int32)), batch.column(0), batch.column(1)], names=["cell", "asks", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 256):
                part = batch.slice(s, 256)
                visits = [[x for _, x in held.value.search(v, most)] for v in unit(_matrix(part.column(1), dims))]
                rows = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in visits]))
                yield pa.RecordBatch.from_arrays([pa.array([y for x in visits for y in x], pa.int32()), pa.array(np.ones(len(rows), dtype=np.int32)), part.column(0).take(rows), part.column(1).take(rows)], names=["cell", "asks", "id", "v"])

    schema = f"cell int, asks int, id long, v {dict(distinct.dtypes)['v']}"
    met = distinct.select("id", "v").mapInArrow(lean(place), schema).unionByName(asked.mapInArrow(lean(ask), schema))
    met = met.repartition("cell").sortWithinPartitions("cell", "asks", "id")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell by cell: the rows come first, then the queries.  A cell's rows are held; its queries stream by."""
        key, ids, rows, held_cell = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            where, asks, own = (batch.column(i).to_numpy() for i in range(3))
            m = _matrix(batch.column(3), dims)
            cuts = np.flatnonzero(np.diff(where.astype(np.int64) * 2 + asks)) + 1
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip([0, *cuts], [*cuts, len(where)], strict=True):
                if where[a] != key:
                    key, ids, rows, held_cell = where[a], [], [], None
                if not asks[a]:
                    ids.append(own[a:b])
                    rows.append(m[a:b])
                elif ids:
                    held_cell = held_cell or Cell(np.concatenate(ids), np.concatenate(rows), k, trees, leaf)
                    for i in range(a, b):
                        found, score, looked = held_cell.nearest(m[i])
                        seen = np.zeros(len(found), dtype=np.int64)
                        seen[:1] = looked
                        got.append((np.full(len(found), own[i]), found, score, seen))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=["query_id", "id", "score", "looked"])

    found = met.mapInArrow(lean(rerank), "query_id long, id long, score double, looked long")
    per_query = Window.partitionBy("query_id")
    near = found.withColumns({"looked_at": F.sum("looked").over(per_query), "r": F.row_number().over(per_query.orderBy(F.desc("score"), "id"))}).filter(F.col("r") <= k + 1)
    each = near.join(distinct.select("id", "ids"), "id").select("query_id", "score", "looked_at", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    last = per_query.orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "looked_at")
