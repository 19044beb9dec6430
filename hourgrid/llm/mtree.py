"""Exact top-k by inner product with an M-tree: paged metric nodes, covering radii, stored distances to the parent.

A vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared length, and a query gets 0. Then
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest vectors are those with the largest inner products and the triangle
inequality holds. Scores themselves are integers; distances only decide what need not be looked at, and are widened by
a margin for rounding, so the result is exact.

Layout. Every vector belongs to the nearest of some pivots (a cell); a cell of any size is dealt out evenly to subtrees
of bounded size, each an M-tree kept as one row. Search. A query first visits the cell most promising for it, which
gives it a lower bound of its k-th score; then it visits those other cells whose covering ball can hold a better score.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import stored, to_batch

SCALE = 64
PIVOTS = 16
SUBTREE = 8192
PAGE = 512
FANOUT = 8
BLOCK = 256  # queries that go down a tree together
MARGIN = 1e-7
QUERY_PART = 50_000
WIDEST = 1 << 62


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, v``: floor(scale * x) of every component as long, without vectors that are null or hold a null or a
    non-finite component. A component beyond 2^62 in size becomes that bound."""
    clean = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"),
                           vectors["embedding"].cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    bound = float(WIDEST)
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * scale))).cast("long"))
    return clean.where(F.col("e").isNotNull() & finite).select("vec_id", F.size("e").alias("dim"), whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Float vectors with the added coordinate."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1, keepdims=True)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the row(s) of ``a`` to one point."""
    d = a - b
    return np.sqrt((d * d).sum(axis=-1))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``x`` with those of ``q``; exact also where 64 bits would not hold them
    (then cut to the range of a long)."""
    if not x.size or not q.size:
        return np.zeros((len(x), len(q)), np.int64)
    most = max(abs(int(x.max())), abs(int(x.min()))) * max(abs(int(q.max())), abs(int(q.min())))
    if most * x.shape[1] < 1 << 53:  # then doubles are exact
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most * x.shape[1] < 1 << 62:
        return x @ q.T
    exact = x.astype(object) @ q.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Subtree:
    """An M-tree over some thousand vectors. Nodes are arrays; a leaf page's entries lie together, by distance to its
    centre."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, page: int = PAGE, fanout: int = FANOUT):
        lifted = _lifted(vectors, longest)
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        order: list[np.ndarray] = []
        self.filled = 0

        def build(rows: np.ndarray, centre: np.ndarray, parent: np.ndarray | None) -> int:
            node = len(self.centre)
            away = _distances(lifted[rows], centre)
            self.centre.append(centre)
            self.radius.append(float(away.max(initial=0.0)))
            self.to_parent.append(0.0 if parent is None else float(_distances(centre, parent)))
            self.children.append([])
            self.span.append((0, 0))
            if len(rows) > page and away.max() > 0:
                # Routing objects: rows spread evenly over the order by distance, which gives pages of like sizes.
                spread = rows[np.argsort(away, kind="stable")][np.linspace(0, len(rows) - 1, fanout).astype(np.int64)]
                apart = np.stack([_distances(lifted[rows], lifted[s]) for s in spread])
                best = apart.argmin(axis=0)
                if (best != best[0]).any():
                    for s in np.unique(best).tolist():
                        self.children[node].append(build(rows[best == s], lifted[spread[s]], centre))
                    return node
            rows = rows[np.argsort(away, kind="stable")]  # equal vectors stay one page, whatever their number
            order.append(rows)
            self.span[node] = (self.filled, self.filled + len(rows))
            self.filled += len(rows)
            return node
        build(np.arange(len(ids)), lifted.mean(axis=0), None)
        rows = np.concatenate(order)
        self.ids, self.vectors = ids[rows], vectors[rows]
        self.away = np.concatenate([_distances(lifted[o], self.centre[n]) for o, n in
                                    zip(order, [i for i, s in enumerate(self.span) if not self.children[i]])])
        self.centres = np.array(self.centre)
        self.radii, self.parents = np.array(self.radius), np.array(self.to_parent)
        self.slack = MARGIN * (1.0 + np.sqrt(longest))
        self.longest = longest

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> "Answers":
        """The ``k`` best entries of each query whose score reaches its floor, ties to the smaller id, not its own.

        Queries go down the tree together. Nodes are taken best first (by the least bound of any query); a query takes
        part in a node only if the node's ball reaches into its own search ball. For a child that is first asked of the
        stored distance to the parent, without computing a distance; in a page, the stored distances to the centre leave
        a run of entries.
        """
        best = Answers(own, k, floors)
        lifted = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        square = (lifted * lifted).sum(axis=1) + self.longest
        slack = self.slack + MARGIN * np.sqrt(square)

        def reach(rows: np.ndarray) -> np.ndarray:
            floor = best.floors[rows]
            r = np.sqrt(np.maximum(0.0, square[rows] - 2.0 * np.where(np.isinf(floor), 0.0, floor))) + slack[rows]
            return np.where(np.isinf(floor), np.inf, r)
        every = np.arange(len(queries))
        root = _distances(lifted, self.centres[0])
        low = np.maximum(0.0, root - self.radii[0])
        queue = [(float(low.min()), 0, every, root, low)]
        while queue:
            _, node, rows, d, low = heapq.heappop(queue)
            r = reach(rows)
            stay = low <= r
            if not stay.any():
                continue
            rows, d, r = rows[stay], d[stay], r[stay]
            for kid in self.children[node]:
                near = np.abs(d - self.to_parent[kid]) - self.radius[kid] <= r
                if not near.any():
                    continue
                away = _distances(lifted[rows[near]], self.centres[kid])
                bound = np.maximum(0.0, away - self.radius[kid])
                inside = bound <= r[near]
                if inside.any():
                    heapq.heappush(queue, (float(bound[inside].min()), kid, rows[near][inside], away[inside], bound[inside]))
            if not self.children[node]:
                lo, hi = self.span[node]
                a = lo + int(np.searchsorted(self.away[lo:hi], (d - r).min()))
                b = lo + int(np.searchsorted(self.away[lo:hi], (d + r).max(), side="right"))
                if a < b:
                    best.offer(rows, self.ids[a:b], products(self.vectors[a:b], queries[rows]))
        return best


def as_floor(score: np.ndarray) -> np.ndarray:
    """Scores as doubles that are not above them."""
    f = score.astype(np.float64)
    return np.where(np.abs(f) < 1 << 53, f, np.nextafter(f, -np.inf))


class Answers:
    """The best entries of a block of queries; ``floors``: the score an entry must reach, -inf for any."""

    def __init__(self, own: np.ndarray, k: int, floors: np.ndarray):
        self.own, self.k, self.floors = own, k, floors.copy()
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: an entry's row for each of ``ids`` and a column for each query of ``rows``."""
        keep = (scores >= self.floors[rows]) & (ids[:, None] != self.own[rows])
        entry, column = np.nonzero(keep)
        if not len(entry):
            return
        query = np.concatenate([self.query, rows[column]])
        id_ = np.concatenate([self.id, ids[entry]])
        score = np.concatenate([self.score, scores[entry, column]])
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        starts = np.concatenate([[0], np.nonzero(np.diff(query))[0] + 1])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        full = np.nonzero(place == self.k - 1)[0]
        self.floors[query[full]] = np.maximum(self.floors[query[full]], as_floor(score[full]))
        within = place < self.k
        self.query, self.id, self.score = query[within], id_[within], score[within]


class Directory:
    """The cells: pivots with covering radii, at most ``PIVOTS`` for each number of components met in the sample."""

    def __init__(self, pivots: dict[int, np.ndarray], longest: float):
        self.pivots, self.longest = pivots, longest
        self.lifted = {dim: _lifted(p, longest) for dim, p in pivots.items()}
        self.radius: dict[tuple[int, int], float] = {}

    def nearest(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of each vector; cell -1 where no pivot has so many components."""
        if dim not in self.lifted:
            return np.full(len(x), -1), np.zeros(len(x))
        own, p = _lifted(x, self.longest), self.lifted[dim]
        near = np.argmin((p * p).sum(axis=1)[None, :] - 2 * own @ p.T, axis=1)
        return near, _distances(own, p[near])

    def bounds(self, dim: int, q: np.ndarray) -> list[tuple[float, int]]:
        """(lower bound of the distance, cell) of the cells that hold vectors of ``dim`` components, best first."""
        cells = [c for d, c in self.radius if d == dim]
        at = np.append(q.astype(np.float64), 0.0)
        return sorted((0.0 if c < 0 else max(0.0, float(_distances(self.lifted[dim][c], at)) - self.radius[dim, c]), c)
                      for c in cells)

    def reach(self, q: np.ndarray, least: int | None) -> float:
        if least is None:
            return np.inf
        square = float((q.astype(np.float64) ** 2).sum()) + self.longest
        return float(np.sqrt(max(0.0, square - 2.0 * least))) * (1 + MARGIN) + MARGIN * (1 + np.sqrt(square))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, matrix) of a batch with columns dim and v."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    column = batch.column(batch.schema.get_field_index("v"))
    for dim in np.unique(dims).tolist():
        rows = np.nonzero(dims == dim)[0]
        yield dim, rows, _matrix(column.take(pa.array(rows)), dim)


def _assigned(directory: Directory):
    schema = pa.schema([("cell", pa.int32()), ("away", pa.float64()), ("vec_id", pa.int64()), ("dim", pa.int32()),
                        ("v", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, rows, x in _by_dim(batch):
                cell[rows], away[rows] = directory.nearest(dim, x)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(away), batch.column(0), batch.column(1), batch.column(2)],
                                             schema=schema)
    return run


def _wanted(directory: Directory, first: bool):
    """For each query (vec_id, dim, v[, least]) the cells to visit: the first round's one, or the rest within reach."""
    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64())),
                        ("least", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dim, at, x in _by_dim(batch):
                for i, q in zip(at.tolist(), x):
                    least = None if first else batch.column(3)[i].as_py()
                    cells = directory.bounds(dim, q)
                    if first:
                        cells = cells[:1]
                    else:
                        r = directory.reach(q, least)
                        cells = [c for c in cells[1:] if c[0] <= r]
                    rows += [(dim, c, batch.column(0)[i].as_py(), q.tolist(), least) for _, c in cells]
            if rows:
                yield to_batch(rows, schema)
    return run


def _searched(longest: float, k: int):
    """For ``mapInArrow`` over rows sorted by subtree, its vectors first: builds each tree once, then answers queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, kind, dim, ids, matrix, floors) of rows that follow one another, at most ``BLOCK`` queries at a time."""
        for batch in batches:
            keys = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            kinds, dims, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in (1, 2, 3))
            least = batch.column(5)
            floors = np.where(least.is_valid().to_numpy(zero_copy_only=False),
                              as_floor(least.fill_null(0).to_numpy(zero_copy_only=False)), -np.inf)
            change = np.nonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0))[0] + 1
            cuts = [0, *change.tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                step = BLOCK if kinds[lo] else hi - lo
                for at in range(lo, hi, step):
                    n = min(step, hi - at)
                    yield (batch.column(0)[at].as_py(), kinds[at], ids[at:at + n], _matrix(batch.column(4).slice(at, n), int(dims[at])),
                           floors[at:at + n])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for now, kind, ids, matrix, floors in runs(batches):
            if now != key:
                key, held, tree = now, [], None
            if kind == 0:
                held.append((ids, matrix))
                continue
            if held and tree is None:
                tree = Subtree(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held]), longest)
                held = []
            if tree is not None:
                found = tree.search(ids, matrix, k, floors)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found.query]), pa.array(found.id), pa.array(found.score)],
                                                 schema=schema)
    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, pivots: int = PIVOTS,
          subtree: int = SUBTREE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id and as many
    components. Ties go to the smaller vec_id; a query with fewer candidates has fewer rows. Vectors that are null or
    hold a null or non-finite component, and rows without a vec_id, take no part. A vec_id on several rows: each row is
    a candidate; its different vectors all ask under that id, and their answers are ranked together. Pivots are a documented sample
    of ``pivots`` vectors chosen by hash; every vector is indexed.
    """
    spark = vectors.sparkSession
    points = stored(scaled(vectors, scale).where("vec_id is not null"), "vectors")
    out = "query_id long, vec_id long, score long"
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = points.agg(F.max(square).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not longest["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn: dict[int, list] = {}
    for r in points.select("dim", "v").orderBy(F.xxhash64("v", F.lit(3))).limit(4 * pivots).collect():
        drawn.setdefault(r["dim"], []).append(tuple(r["v"]))
    chosen = {dim: np.array(own := list(dict.fromkeys(v))[:pivots], np.int64).reshape(len(own), dim)
              for dim, v in drawn.items()}
    directory = Directory(chosen, float(longest["m"]) * (1 + 1e-12))
    entries = stored(points.mapInArrow(_assigned(directory), "cell int, away double, vec_id long, dim int, v array<long>")
                     .withColumn("row", F.monotonically_increasing_id()), "cells")
    sizes = entries.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()
    directory.radius = {(r["dim"], r["cell"]): r["r"] for r in sizes}
    parts = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // subtree)) for r in sizes], "dim int, cell int, parts long")
    asked = points.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    copies = max(1, -(-asked.count() // QUERY_PART))
    # Cells are few (a parameter), so their numbers of subtrees are broadcast.
    leaf = entries.join(F.broadcast(parts), ["dim", "cell"])
    name = lambda part, copy: F.concat_ws("/", "dim", "cell", part, copy)
    trees = leaf.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "*").select(
        name(F.col("row") % F.col("parts"), F.col("copy")).alias("key"), F.lit(0).alias("kind"), "dim", "vec_id", "v",
        F.lit(None).cast("long").alias("least"))

    def answers(requests: DataFrame) -> DataFrame:
        spread = (requests.join(F.broadcast(parts), ["dim", "cell"])
                  .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
                  .select(name(F.col("part"), F.pmod(F.xxhash64("vec_id"), F.lit(copies))).alias("key"),
                          F.lit(1).alias("kind"), "dim", "vec_id", "v", "least"))
        needed = trees.join(spread.select("key").distinct(), "key", "left_semi")
        return (needed.union(spread).repartition("key").sortWithinPartitions("key", "kind")
                .mapInArrow(_searched(directory.longest, k), out))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    wanted = "dim int, cell int, vec_id long, v array<long>, least long"
    first = stored(answers(asked.select("vec_id", "dim", "v").mapInArrow(_wanted(directory, True), wanted))
                   .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "first-answers")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    again = asked.select("vec_id", "dim", "v").join(floors, "vec_id", "left")
    rest = answers(again.mapInArrow(_wanted(directory, False), wanted))
    ranked = (first.select("query_id", "vec_id", "score").union(rest).withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= k))
    return ranked.select("query_id", "rank", "vec_id", "score")
