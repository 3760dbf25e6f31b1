"""Exact top-k inner products through an M-tree (Ciaccia, Patella, Zezula 1997) of trees.

Largest inner product is nearest neighbour once every vector gets one more coordinate that
brings all of them to one norm: |q - x|^2 = |q|^2 + N - 2 q.x, with N the largest squared norm.

The root's pivots are a bounded sample; each row goes to its nearest one, and a pivot's rows, a cell with
a covering radius, make one tree or several of about `TREE` rows. A tree is a table of pages: a page has
a pivot, a covering radius and the distance to its parent's pivot; a leaf's entries have their
distances to its pivot. Trees are built once and written.

Search has two waves. Each query first goes to a tree of its nearest cell, which gives a floor, its k-th score there;
then to the trees of those other cells that can still beat the floor by pivot and radius. The first wave pops the most
promising page first and ends when no page can beat the k-th score; the second is a range search, which takes every page
that may hold a score of the floor or more, and the floor rises from tree to tree. Stored distances rule out pages and
entries before any product is computed. Queries that open the same page are answered together.

In the second wave queries are dealt into strips and trees into parts. A strip meets a part in a tile: a query travels
once for each part that it needs, a tree once for each strip, and of a tile's hits the k best of each query are kept.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.plans.session import materialize

#: Rows of a tree and of a leaf about, children of a page, queries that meet a tree at once, and pivots of the root at most.
TREE, LEAF, FANOUT, QUERIES, PIVOTS = 16_384, 256, 16, 8192, 4096
#: Queries of a strip about, tiles at least, parts at least where there are many strips, bytes of a part's trees about, and hits that wait to be cut to the k best.
STRIP, TILES, PARTS, PART_BYTES, HITS = 65_536, 64, 16, 32 << 20, 1 << 20
#: Spark's name of a type of whole numbers.
_NAMES = {np.int8: "tinyint", np.int16: "smallint", np.int32: "int", np.int64: "bigint"}
#: Bounds are widened by this share against rounding in distances; scores are whole numbers and exact.
SLACK = 1e-6


def whole(norm: int) -> type:
    """The smallest type that holds components of vectors of a squared norm of `norm` at most."""
    return np.int8 if norm < 1 << 14 else np.int16 if norm < 1 << 30 else np.int32 if norm < 1 << 62 else np.int64


def lifted(vectors: np.ndarray, norm: int) -> np.ndarray:
    """`vectors` with the coordinate that brings their squared norms to `norm`."""
    flat = vectors.astype(np.float64)
    return np.column_stack([flat, np.sqrt(np.maximum(0.0, norm - np.einsum("ij,ij->i", flat, flat)))])


def most(reach: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The best score at a distance of `near` or more; `reach` is |q|^2 + N."""
    return (reach - np.maximum(0.0, near) ** 2) / 2 + SLACK * reach + SLACK


class MTree:
    """`ids` (int64) and `vectors` (whole numbers, a row each) under squared norms of at most `norm`.

    `own` are the numbers by which a query leaves out its own row, the ids if not given. `computed` counts
    the distances and products that searches have computed.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: int, own: np.ndarray | None = None):
        exact = np.float32 if norm < 1 << 23 else np.float64 if norm < 1 << 52 else np.int64
        self.exact, self.norm, self.computed = exact, norm, 0
        order = np.argsort(ids, kind="stable")
        self.ids, self.own, self.vectors = ids[order], (ids if own is None else own)[order], vectors[order].astype(exact)
        self._points = lifted(vectors[order], norm)
        #: Of each page: pivot's row, covering radius, distance to the parent's pivot, child pages, rows of a leaf, their distances to its pivot.
        self.pivot: list[int] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray | None] = []
        self.to_pivot: list[np.ndarray | None] = []
        self._rng = np.random.default_rng(len(ids))
        if len(ids):
            self._grow(np.arange(len(ids)), 0, 0.0)
            self._settle()
        self._pivots = np.array(self.pivot, dtype=np.int64)
        self._radii, self._to_parents = np.array(self.radius), np.array(self.to_parent)

    def to_bytes(self) -> bytes:
        """The pages and vectors; what follows from them is made again."""
        return pickle.dumps({k: v for k, v in vars(self).items() if k not in ("_points", "_rng")} | {"vectors": self.vectors.astype(whole(self.norm))}, protocol=5)

    @staticmethod
    def from_bytes(data: bytes) -> MTree:
        tree = MTree.__new__(MTree)
        vars(tree).update(pickle.loads(data))
        tree.vectors = tree.vectors.astype(tree.exact)
        return tree

    def _distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self._points[rows] - self._points[pivot]) ** 2).sum(axis=1))

    def _grow(self, rows: np.ndarray, pivot: int, to_parent: float) -> int:
        page = len(self.pivot)
        away = self._distance(rows, pivot)
        for column, value in ((self.pivot, pivot), (self.radius, float(away.max())), (self.to_parent, to_parent), (self.children, None), (self.rows, None), (self.to_pivot, None)):
            column.append(value)
        if len(rows) <= LEAF:
            self.rows[page], self.to_pivot[page] = rows, away
            return page
        pivots = self._rng.choice(rows, min(FANOUT, -(-len(rows) // LEAF)), replace=False)
        points = self._points[pivots]
        nearest = (np.einsum("ij,ij->i", points, points) - 2 * self._points[rows] @ points.T).argmin(axis=1)
        if np.bincount(nearest, minlength=len(pivots)).max() == len(rows):  # equal vectors: any split does
            nearest = np.arange(len(rows)) * len(pivots) // len(rows)
        self.children[page] = np.array([self._grow(rows[nearest == k], int(p), float(np.linalg.norm(self._points[p] - self._points[pivot]))) for k, p in enumerate(pivots) if (nearest == k).any()])
        return page

    def _settle(self) -> None:
        """Put each leaf's rows side by side, in order of their distances to its pivot."""
        order, at = [], 0
        for page, rows in enumerate(self.rows):
            if rows is not None:
                by = np.argsort(self.to_pivot[page], kind="stable")
                order.append(rows[by])
                self.rows[page], self.to_pivot[page] = np.arange(at, at := at + len(rows), dtype=np.int32), self.to_pivot[page][by]
        order = np.concatenate(order)
        place = np.argsort(order)
        self.ids, self.own, self.vectors, self._points = self.ids[order], self.own[order], self.vectors[order], self._points[order]
        self.pivot = [int(place[p]) for p in self.pivot]

    def within(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the query, score, id) of the rows that score `floor` or more, without rows of the query's own id, leaf by leaf. `floor` may rise meanwhile."""
        if not len(self.ids):
            return
        asked, flat = queries.astype(self.exact), queries.astype(np.float64)
        reach = np.einsum("ij,ij->i", flat, flat) + self.norm  # |q - x|^2 = reach - 2 score
        square = reach * (1 + 2 * SLACK) + 2 * SLACK - 2 * floor  # `most` at this distance is the floor
        far = np.where(square < 0, -1.0, np.sqrt(np.maximum(0.0, square)))

        def distance(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(q) * len(rows)
            return np.sqrt(np.maximum(0.0, reach[q][:, None] - 2 * (flat[q] @ self.vectors[rows].astype(np.float64).T)))

        everyone = np.arange(len(queries))
        root = distance(everyone, self._pivots[:1])[:, 0]
        q = np.flatnonzero(np.maximum(0.0, root - self._radii[0]) <= far)
        stack = [(0, q, root[q])] if len(q) else []
        while stack:
            page, q, d = stack.pop()
            if (children := self.children[page]) is not None:
                open_ = np.abs(d[:, None] - self._to_parents[children]) - self._radii[children] <= far[q][:, None]
                use = np.flatnonzero(open_.any(axis=0))
                away = distance(q, self._pivots[children[use]])
                open_ = open_[:, use] & (away - self._radii[children[use]] <= far[q][:, None])
                for j in np.flatnonzero(open_.any(axis=0)):
                    at = np.flatnonzero(open_[:, j])
                    stack.append((int(children[use[j]]), q[at], away[at, j]))
                continue
            first, stored = int(self.rows[page][0]), self.to_pivot[page]
            low, high = first + np.searchsorted(stored, (d - far[q]).min()), first + np.searchsorted(stored, (d + far[q]).max(), side="right")
            if low >= high:
                continue
            self.computed += len(q) * int(high - low)
            scores = asked[q] @ self.vectors[low:high].T
            least = floor[q] if self.exact is np.int64 else floor[q].astype(self.exact)
            i, j = np.divmod(np.flatnonzero(scores >= least[:, None]), high - low)
            others = self.own[low + j] != query_ids[q[i]]
            i, j = i[others], j[others]
            if len(i):
                yield q[i], scores[i, j].astype(np.int64), self.ids[low + j]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each query's k best, without rows of its own id; ties to the smaller id. Scores below `floor` may be left out."""
        n = len(query_ids)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
        floor = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)
        if not len(self.ids):
            return best
        asked, flat = queries.astype(self.exact), queries.astype(np.float64)
        reach = np.einsum("ij,ij->i", flat, flat) + self.norm  # |q - x|^2 = reach - 2 score

        def bound_of(near: np.ndarray, q: np.ndarray) -> np.ndarray:
            return most(reach[q][:, None], near)

        def distance(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(q) * len(rows)
            return np.sqrt(np.maximum(0.0, reach[q][:, None] - 2 * (flat[q] @ self.vectors[rows].astype(np.float64).T)))

        root = distance(np.arange(n), self._pivots[:1])[:, 0]
        heaps = [[(-float(m), 0, float(d))] for m, d in zip(most(reach, root - self._radii[0]), root, strict=True)]
        while True:
            popped: dict[int, tuple[list[int], list[float]]] = {}
            for q, heap in enumerate(heaps):
                if heap:
                    bound, page, d = heapq.heappop(heap)
                    if -bound < floor[q]:
                        heap.clear()  # the others promise no more
                    else:
                        qs, ds = popped.setdefault(page, ([], []))
                        qs.append(q)
                        ds.append(d)
            if not popped:
                return best
            for page, (qs, ds) in popped.items():
                q, d = np.array(qs), np.array(ds)
                if (children := self.children[page]) is not None:
                    early = bound_of(np.abs(d[:, None] - self._to_parents[children]) - self._radii[children], q)
                    open_ = early >= floor[q][:, None]
                    use = np.flatnonzero(open_.any(axis=0))
                    if not len(use):
                        continue
                    away = distance(q, self._pivots[children[use]])
                    bound = bound_of(away - self._radii[children[use]], q)
                    for i, j in zip(*np.nonzero(open_[:, use] & (bound >= floor[q][:, None])), strict=True):
                        heapq.heappush(heaps[qs[i]], (-float(bound[i, j]), int(children[use[j]]), float(away[i, j])))
                    continue
                rows, stored = self.rows[page], self.to_pivot[page]
                open_ = bound_of(np.abs(d[:, None] - stored), q) >= floor[q][:, None]
                use = np.flatnonzero(open_.any(axis=0))
                if not len(use):
                    continue
                ids = self.ids[rows[use]]
                self.computed += len(q) * len(use)
                scores = asked[q] @ self.vectors[rows[use]].T
                good = (scores >= floor[q][:, None]) & (self.own[rows[use]] != query_ids[q][:, None])
                for i in np.flatnonzero(good.any(axis=1)):
                    at = good[i]
                    s = np.concatenate([best[qs[i]][0], scores[i, at].astype(np.int64)])
                    x = np.concatenate([best[qs[i]][1], ids[at]])
                    top = np.lexsort((x, -s))[:k]
                    best[qs[i]] = s[top], x[top]
                    if len(top) == k:
                        floor[qs[i]] = max(floor[qs[i]], s[top[-1]])


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    lengths, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _floors(scores: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """None for a floor is none; scores beyond 2^53 are rounded, as they are wherever they meet a floor."""
    return np.array(scores.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy())


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


class _Root(NamedTuple):
    """The root's page: pivots (lifted), and of each cell its radius, its first tree and how many trees it has."""

    pivots: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    trees: np.ndarray
    width: int
    norm: int

    def away(self, vectors: np.ndarray, lift: bool) -> np.ndarray:
        """Distances to all pivots, of rows (`lift`) or of queries."""
        points = lifted(vectors, self.norm) if lift else np.column_stack([vectors.astype(np.float64), np.zeros(len(vectors))])
        squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None, :]
        return np.sqrt(np.maximum(0.0, squares - 2 * points @ self.pivots.T))


def _to_cells(root: _Root):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = root.away(_matrix(batch.column("v"), root.width), lift=True)
            cell = away.argmin(axis=1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("away", pa.array(away[np.arange(len(away)), cell]))

    return run


def _home(root: _Root):
    """The tree that each query asks first: one of its nearest cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = np.where(root.trees > 0, root.away(_matrix(batch.column("v"), root.width), lift=False), np.inf)
            cell = away.argmin(axis=1) if len(away) else np.empty(0, np.int64)
            yield batch.append_column("tree", pa.array(root.first[cell] + _column(batch, "q") % np.maximum(1, root.trees[cell])))

    return run


def _others(root: _Root, parts: int):
    """The parts in which trees, besides the first one, stand whose cells can beat each query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stand = np.zeros((len(root.trees), parts))  # trees of each cell in each part
        np.add.at(stand, (np.repeat(np.arange(len(root.trees)), root.trees), np.arange(root.trees.sum()) % parts), 1)
        for batch in batches:
            vectors = _matrix(batch.column("v"), root.width).astype(np.float64)
            reach = (vectors**2).sum(axis=1) + root.norm
            floor, home = _floors(batch.column("floor")), _column(batch, "tree")
            open_ = most(reach[:, None], root.away(vectors, lift=False) - root.radius) >= floor[:, None]
            asks, every = open_ @ stand, np.arange(len(home))
            asks[every, home % parts] -= open_[every, np.searchsorted(root.first, home, side="right") - 1]
            i, part = np.nonzero(asks > 0)
            yield batch.append_column("parts", pa.ListArray.from_arrays(np.searchsorted(i, np.arange(len(home) + 1)).astype(np.int32), pa.array(part, pa.int64())))

    return run


def _build(width: int, norm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                tree = MTree(rows.field("vec_id").to_numpy(zero_copy_only=False), _matrix(rows.field("v"), width), norm, rows.field("own").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("tree").slice(i, 1), pa.array([tree.to_bytes()], pa.binary())], names=["tree", "pages"])

    return run


_HITS = T.StructType([T.StructField("q", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _answer(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (t := batch.column("tree")[i].as_py()) != last:
                    last, tree = t, MTree.from_bytes(batch.column("pages")[i].as_py())
                asked = batch.column("asked")[i].values
                q, ids, own = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("q", "vec_id", "own"))
                found = tree.search(own, _matrix(asked.field("v"), width), k)
                many = [len(s) for s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q, many)), pa.array(np.repeat(ids, many)), pa.array(np.concatenate([x for _, x in found])), pa.array(np.concatenate([s for s, _ in found]))], names=_HITS.names
                )

    return run


class _Best:
    """The k best hits (number of the query, score, id) so far; `floor` rises to each query's k-th score."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.waiting = k, floor, 0
        self.hits = [(np.empty(0, np.int64),) * 3]

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> bool:
        """Whether floors have risen."""
        self.hits.append((q, scores, ids))
        self.waiting += len(q)
        return self.waiting > HITS and self.cut()

    def cut(self) -> bool:
        q, scores, ids = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last, kept = rank == self.k - 1, rank < self.k
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last])
        self.hits, self.waiting = [(q[kept], scores[kept], ids[kept])], 0
        return True


def _tile(k: int, width: int):
    """The k best hits of each of a strip's queries in a part's trees, but for the query's home tree."""

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        strip, part = (t.combine_chunks() for t in tables)
        q, ids, own, home = (strip.column(c).to_numpy() for c in ("q", "vec_id", "own", "tree"))
        best = _Best(k, _floors(strip.column("floor")))
        vectors = _matrix(pa.concat_arrays(strip.column("v").chunks), width) if len(q) else None
        for i in range(part.num_rows if len(q) else 0):
            tree, asks = MTree.from_bytes(part.column("pages")[i].as_py()), np.flatnonzero(home != part.column("tree")[i].as_py())
            for block in (asks[at : at + QUERIES] for at in range(0, len(asks), QUERIES)):
                floor = best.floor[block]
                for at, scores, found in tree.within(own[block], vectors[block], floor):
                    if best.add(block[at], scores, found):
                        floor[:] = best.floor[block]
        best.cut()
        at, scores, found = best.hits[0]
        yield pa.table([q[at], ids[at], found, scores], names=_HITS.names)

    return lambda strip, part: next(tidy(run)(iter((strip, part))))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, own: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest inner products of each row of `queries` among `rows`.

    Both have vec_id and v, an array of whole numbers; shorter arrays count as ending in zeros. Each query row is
    answered, those that repeat a vec_id too. A query leaves out the rows whose column `own`, whole numbers in both
    tables, is its own. Ties go to the smaller vec_id. Rows whose vec_id or v is null take no part. Fewer candidates
    than k give all. Products that leave 64 bits, which the score couldn't hold, are an error.
    """
    spark = rows.sparkSession

    def taken(df: DataFrame, *more) -> DataFrame:
        return df.where("vec_id is not null and v is not null").select("vec_id", "v", F.col(own).cast("long").alias("own"), *more)

    rows = materialize(taken(rows), "vectors")
    queries = materialize(taken(queries, F.monotonically_increasing_id().alias("q")), "queries")
    squared = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    told, asked = (df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(squared).alias("norm")).first() for df in (rows, queries))
    if not told["n"] or not asked["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = int(max(told["norm"] or 0, asked["norm"] or 0))
    if norm >= 1 << 62:
        raise ValueError("inner products would leave 64 bits")
    width, kind = max(told["width"] or 0, asked["width"] or 0), _NAMES[whole(norm)]
    rows, queries = (df.withColumn("v", F.col("v").cast(f"array<{kind}>")) for df in (rows, queries))
    # PIVOTS rows at most, chosen on the executors among about twice as many: collected in order, each task would send so many to the driver
    wanted = max(1, min(PIVOTS, -(-told["n"] // TREE)))
    few = rows.where(F.xxhash64("own") < min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (2 * wanted + 64) // told["n"]))
    some = materialize(few.orderBy(F.xxhash64("own"), "own").limit(wanted).select("v"), "pivots").collect() or rows.select("v").limit(1).collect()
    pivots = lifted(_padded([r["v"] for r in some], width), norm)
    none = np.zeros(len(pivots), np.int64)
    root = _Root(pivots, none, none, none, width, norm)

    cells = rows.mapInArrow(tidy(_to_cells(root)), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    cells = materialize(cells, "cells")
    size, radius = none.copy(), np.zeros(len(pivots))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # a row for each pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    trees = -(-size // TREE)
    root = root._replace(radius=radius, first=np.cumsum(trees) - trees, trees=trees)
    cell_rows = spark.createDataFrame([(c, int(f), int(t)) for c, (f, t) in enumerate(zip(root.first, trees, strict=True))], "cell int, first long, trees long")
    dealt = cells.join(F.broadcast(cell_rows), "cell").withColumn("tree", F.col("first") + F.pmod(F.xxhash64("own"), "trees"))  # rows for pivots only
    grown = dealt.groupBy("tree").agg(F.collect_list(F.struct("own", "vec_id", "v")).alias("rows"))
    forest = materialize(grown.mapInArrow(tidy(_build(width, norm)), "tree long, pages binary"), "trees")

    # joins of vectors go by exchange: Spark takes the size of compressed files for theirs, and would broadcast them through the driver
    homes = T.StructType([*queries.schema.fields, T.StructField("tree", T.LongType())])
    at_home = materialize(queries.mapInArrow(tidy(_home(root)), homes), "homes")
    many = at_home.groupBy("tree").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    blocks = at_home.join(F.broadcast(many), "tree").groupBy("tree", F.pmod(F.xxhash64("q"), "blocks").alias("block")).agg(F.collect_list(F.struct("q", "vec_id", "own", "v")).alias("asked"))  # a row for each tree
    hits = materialize(blocks.hint("merge").join(forest, "tree").select("tree", "pages", "asked").mapInArrow(tidy(_answer(k, width)), _HITS), "hits")
    if (n := int(trees.sum())) > 1:
        strips = -(-asked["n"] // STRIP)
        parts = min(n, max(-(-TILES // strips), PARTS, -(-n * TREE * (width * np.dtype(whole(norm)).itemsize + 32) // PART_BYTES)))
        floors = hits.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        open_ = at_home.join(floors.hint("merge"), "q", "left").select("q", "vec_id", "own", "v", "floor", "tree")
        open_ = open_.mapInArrow(tidy(_others(root, parts)), f"q long, vec_id long, own long, v array<{kind}>, floor long, tree long, parts array<long>")
        strip = open_.select("q", "vec_id", "own", "v", "floor", "tree", F.pmod(F.xxhash64("q"), F.lit(strips)).alias("strip"), F.explode("parts").alias("part"))
        part = forest.select("tree", "pages", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("strip"), (F.col("tree") % parts).alias("part"))
        tiles = strip.groupBy("strip", "part").cogroup(part.groupBy("strip", "part"))
        hits = hits.unionByName(materialize(tiles.applyInArrow(_tile(k, width), _HITS), "hits"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v, the components times `scale` rounded down; vectors with a null or non-finite component are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = embeddings.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    """The best 20 of every row whose vec_id is divisible by 20, among all rows but itself."""
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    vectors = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "embeddings")  # written, so that the numbers stay what they are
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20, own="row")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
