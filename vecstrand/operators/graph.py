"""Graphs over the nearest rows of a seed: k-NN, hubs, walks, spanning trees and threshold components.

These are views of a bounded subset by definition (VIEW_MAX rows nearest to the seed), so its matrix (VIEW_MAX x width doubles, a few MB) is the
one thing that is broadcast; everything per row is a map over it. The all-corpus k-NN of the training-data operators has no such bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstrand.operators.rank import scored

#: Rows of a view.
VIEW_MAX = 8_000


class View:
    """The rows nearest to the seed (and extras that are in the corpus), in id order, with their unit vectors."""

    def __init__(self, m: DataFrame, seed: DataFrame, extra_ids: list[str] | None = None, limit: int = VIEW_MAX):
        rows = scored(m, seed).select("track_id", "vec", "sim")
        picked = rows.orderBy(F.desc("sim"), "track_id").limit(limit)
        if extra_ids:
            picked = picked.unionByName(rows.filter(F.col("track_id").isin(extra_ids[:50]))).dropDuplicates(["track_id"])
        got = picked.select("track_id", "vec").toPandas().sort_values("track_id")  # at most limit + 50 rows
        self.spark, self.ids = m.sparkSession, list(got["track_id"])
        x = np.array(list(got["vec"]), np.float64).reshape(len(got), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        self.unit = x / np.where(n == 0, 1, n)
        self.shared = self.spark.sparkContext.broadcast((self.ids, self.unit))

    def _rows(self) -> DataFrame:
        return self.spark.range(0, len(self.ids), 1, max(1, len(self.ids) // 500))

    def map_rows(self, kernel: Callable[[list, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
        """kernel(ids, unit, row numbers) -> tuples, run over slices of the rows."""
        shared, names = self.shared, [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            for b in batches:
                rows = b.column(0).to_numpy()
                for at in range(0, len(rows), 256):
                    out = kernel(ids, unit, rows[at : at + 256])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

        return self._rows().mapInArrow(run, schema)

    def whole(self, kernel: Callable[[list, np.ndarray], list[tuple]], schema: str) -> DataFrame:
        """One task over the bounded view, for algorithms that step from row to row."""
        shared, names = self.shared, [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    out = kernel(*shared.value)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

        return self.spark.range(0, 1, 1, 1).mapInArrow(run, schema)


def nearest(unit: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, distances) of the rows: k smallest cosine distances, itself left out, ties by row. Distances are rounded, so that ties are ties."""
    d = np.round(1 - unit[rows] @ unit.T, 9)
    d[np.arange(len(rows)), rows] = np.inf
    k = min(k, unit.shape[0] - 1)
    order = np.zeros((len(rows), k), np.int64)
    if k:
        # Only what is no farther than the k-th is sorted; ties of the k-th are among it.
        far = np.partition(d, k - 1, axis=1)[:, k - 1]
        for r in range(len(rows)):
            close = np.flatnonzero(d[r] <= far[r])
            order[r] = close[np.argsort(d[r, close], kind="stable")[:k]]
    return order, np.take_along_axis(d, order, axis=1)


def knn_edges(view: View, k: int = 8) -> DataFrame:
    """Directed edges (src, dst, distance)."""

    def kernel(ids, unit, rows):
        order, d = nearest(unit, rows, k)
        return [(ids[i], ids[j], float(w)) for i, js, ws in zip(rows, order, d) for j, w in zip(js, ws)]

    return view.map_rows(kernel, "src string, dst string, distance double")


def symmetric(edges: DataFrame) -> DataFrame:
    """An edge either way; a node's degree may exceed k."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def hubs(view: View, k: int = 8) -> DataFrame:
    """(track_id, count, centrality): in how many rows' k nearest a row is (0 kept), and its mean cosine with the others."""
    counts = knn_edges(view, k).groupBy("dst").agg(F.count("*").alias("count")).withColumnRenamed("dst", "track_id")

    def mean(ids, unit, rows):
        total = unit.sum(axis=0)
        own = (unit[rows] ** 2).sum(axis=1)
        return [(ids[i], float(v)) for i, v in zip(rows, (unit[rows] @ total - own) / max(1, len(ids) - 1))]

    return view.map_rows(mean, "track_id string, centrality double").join(counts, "track_id", "left").select("track_id", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "centrality")


def tree(unit: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree (i < j) by rising distance: Prim from row 0, lowest row on ties."""
    n = len(unit)
    if n < 2:
        return []
    best, via, out = np.full(n, np.inf), np.zeros(n, np.int64), []
    done = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.round(1 - unit @ unit[at], 9), 0)
        closer = ~done & (d < best)
        best[closer], via[closer] = d[closer], at
        nxt = int(np.argmin(np.where(done, np.inf, best)))
        out.append((min(nxt, int(via[nxt])), max(nxt, int(via[nxt])), float(best[nxt])))
        at = nxt
    return sorted(out, key=lambda e: (e[2], e[0], e[1]))


def spanning_tree(view: View) -> DataFrame:
    return view.whole(lambda ids, unit: [(ids[i], ids[j], d) for i, j, d in tree(unit)], "a string, b string, distance double")


def barcode(view: View) -> DataFrame:
    """Deaths of the connected components as the threshold rises: the tree's distances, n - 1 bars."""
    return view.whole(lambda ids, unit: [(k, d) for k, (_, _, d) in enumerate(tree(unit))], "bar long, death double")


def components_at(view: View, threshold: float) -> DataFrame:
    """(track_id, component): joined where a distance is at most the threshold. The tree's edges suffice; a component is named by its least id."""

    def kernel(ids, unit):
        parent = list(range(len(ids)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j, d in tree(unit):
            if d <= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        return [(ids[i], ids[find(i)]) for i in range(len(ids))]

    return view.whole(kernel, "track_id string, component string")


def walk(view: View, start: str, end: str | None = None, k: int = 8) -> DataFrame:
    """(hops, geodesic, ambient, detour, path): the shortest walk over the symmetric k-NN graph; no row if the two are not connected. Without an
    end, to the row that is least like the start of all that it reaches (the smallest id on ties)."""

    def kernel(ids, unit):
        if start not in ids or end is not None and end not in ids:
            return []
        s, e = ids.index(start), -1 if end is None else ids.index(end)
        graph: list[dict[int, float]] = [{} for _ in ids]
        for at in range(0, len(ids), 256):
            rows = np.arange(at, min(at + 256, len(ids)))
            for i, js, ws in zip(rows.tolist(), *(x.tolist() for x in nearest(unit, rows, k))):
                for j, w in zip(js, ws):
                    graph[i][j] = min(max(w, 0.0), graph[i].get(j, np.inf))
                    graph[j][i] = min(max(w, 0.0), graph[j].get(i, np.inf))
        seen, queue = {s: (0.0, -1)}, [(0.0, s)]
        while queue:
            far, i = heapq.heappop(queue)
            if i == e:
                break
            if far > seen[i][0]:
                continue
            for j, w in graph[i].items():
                if far + w < seen.get(j, (np.inf, 0))[0]:
                    seen[j] = (far + w, i)
                    heapq.heappush(queue, (far + w, j))
        if end is None:
            sims = np.round(unit @ unit[s], 9)
            e = min(seen, key=lambda i: (sims[i], i))
        if e not in seen:
            return []
        path = [e]
        while path[-1] != s:
            path.append(seen[path[-1]][1])
        ambient = 1 - float(unit[s] @ unit[e])
        return [(len(path) - 1, seen[e][0], ambient, seen[e][0] / ambient if ambient > 1e-12 else 1.0, [ids[i] for i in path[::-1]])]

    return view.whole(kernel, "hops long, geodesic double, ambient double, detour double, path array<string>")


def bfs(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(node, hop): level-synchronous search over edges(src, dst) from roots(node), each node at its first hop. Bounded hops, one anti join each."""
    seen = roots.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen
