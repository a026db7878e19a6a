"""Deduplicating new batches against all history: a persisted inverted file of vector cells, opened by each job and appended to.

A store is a folder: vectors by cell (one folder a cell), the values (ids and keys) met so far by hash bucket, and a manifest a version with the tree of
centroids and each cell's radii and rows. Centroids are learned on bounded samples; a cell of more than GROWN times its share is split by centroids
of its own, so cells multiply with the data. A batch asks only the cells that can hold a match. With c* the centroid nearest to a query q among those of
a split, a vector x below centroid c is on c's side of the plane between c and c*, so |q - x| >= (|q-c|^2 - |q-c*|^2) / 2|c-c*|; and a cell's
vectors lie between its two radii from c, so |q - x| >= |q-c| - R and >= r - |q-c|. Cells are probed while all bounds are within the radius that the
wanted cosine allows; beyond them no nearer match is possible. What the probed cells hold is ranked by exact cosine, and the batch is appended.

A batch reads the folders of the cells and buckets it touches, never all history, and the next session goes on from the manifest. Queries meet
their cells on the executors, a cell in blocks of about BLOCK rows. Vectors of one direction under one artist are stored once a batch, with
their first row. A version that was not finished is not in a manifest and is not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstrand.llm.blocks import directions, vectors
from vecstrand.llm.components import keyed
from vecstrand.llm.names import same_lead_artist
from vecstrand.plans.durable import Scratch
from vecstrand.sources.tables import WIDTH, usable

#: Vectors from which the centroids of a split are learned, and centroids of a split at most.
SAMPLE, FAN = 20_000, 1_024
#: Vectors of a cell on average, at least (the root of their number if that is greater), and how many times that a cell may hold.
CELL, GROWN = 4_096, 4
#: Rows of a cell that one task holds; values of a bucket.
BLOCK, BUCKET = 65_536, 100_000
#: Repeats have a cosine above this.
COSINE = 0.995
#: Order of rows that were there before the first arrival.
BEFORE = -1
#: Up to so many buckets a batch reads them all, without asking first which it touches.
FEW = 64


def learn_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical-data k-means (euclidean, centroids not normalized). Fewer rows than cells give a cell a row."""
    if len(sample) <= count:
        return sample if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
    centres = sample[np.random.default_rng(seed).choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((centres * centres).sum(1) - 2 * (sample @ centres.T), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=count)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1 + (centres * centres).sum(1) - 2 * (unit @ centres.T), 0))


class Tree:
    """Centroids of each split and the cells at its ends. Node 0 is the root; a node without centroids is a cell."""

    def __init__(self, width: int):
        self.splits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # node -> children, centres, gaps between them
        self.least, self.most, self.rows = np.full(1, np.inf), np.full(1, -np.inf), np.zeros(1, np.int64)
        self.solid: set[int] = set()  # cells that no split would make smaller
        self.centre_of = {0: np.zeros(width, np.float32)}

    def split(self, node: int, centres: np.ndarray) -> None:
        children = np.arange(len(self.rows), len(self.rows) + len(centres))
        gaps = np.sqrt(np.maximum((centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T, 1e-12))
        self.splits[node] = children, centres.astype(np.float32), gaps
        self.least, self.most = np.concatenate([self.least, np.full(len(centres), np.inf)]), np.concatenate([self.most, np.full(len(centres), -np.inf)])
        self.rows = np.concatenate([self.rows, np.zeros(len(centres), np.int64)])
        self.centre_of |= dict(zip(children.tolist(), centres.astype(np.float32)))

    def cells(self) -> list[int]:
        return [k for k in range(len(self.rows)) if k not in self.splits]

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centroid) of each row."""
        cell, far = np.zeros(len(unit), np.int64), np.ones(len(unit))
        waiting = [(0, np.arange(len(unit)))]
        while waiting:
            node, rows = waiting.pop()
            if node not in self.splits:
                cell[rows], far[rows] = node, distances(unit[rows], self.centre_of[node][None])[:, 0]
                continue
            children, centres, _ = self.splits[node]
            own = np.argmin(distances(unit[rows], centres), axis=1)
            waiting += [(int(children[c]), rows[own == c]) for c in np.unique(own)]
        return cell, far

    def probe(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that can hold a vector within the radius of the row."""
        rows_out, cells_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        waiting = [(0, np.arange(len(unit)))]
        while waiting:
            node, rows = waiting.pop()
            if node not in self.splits:
                d = distances(unit[rows], self.centre_of[node][None])[:, 0]
                rows = rows[(d <= self.most[node] + radius) & (d >= self.least[node] - radius)]
                rows_out.append(rows)
                cells_out.append(np.full(len(rows), node))
                continue
            children, centres, gaps = self.splits[node]
            d = distances(unit[rows], centres)
            own = np.argmin(d, axis=1)
            plane = (d**2 - d[np.arange(len(own)), own][:, None] ** 2) / (2 * gaps[own])
            for c in np.flatnonzero((plane <= radius).any(axis=0)):
                waiting.append((int(children[c]), rows[plane[:, c] <= radius]))
        return np.concatenate(rows_out), np.concatenate(cells_out)


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


class CellStore:
    """Persisted cells of rows (ord long, artist string, vec binary), and values met so far. ord tells which row came first."""

    def __init__(self, spark: SparkSession, path: str, cosine: float, width: int):
        self.spark, self.path, self.cosine, self.width = spark, path, cosine, width
        self.radius, self.scratch = math.sqrt(2 - 2 * cosine) + 1e-4, Scratch(spark, "batches")
        self.tree, self.versions, self.share, self.buckets = Tree(width), [], CELL, 1

    @classmethod
    def create(cls, spark: SparkSession, path: str, history: DataFrame, values: DataFrame | None = None, cosine: float = COSINE, width: int = WIDTH) -> CellStore:
        """A store of history(ord, artist, vec) and values(ord, value) at a path that is still free."""
        self = cls(spark, path, cosine, width)
        known = self.scratch.save(self._once(history))
        n = known.count()
        self.share = max(CELL, math.isqrt(n))
        self._split(0, known, max(1, min(FAN, n // self.share)))
        self._append(self._placed(known.drop("copies")))
        self._grow()
        if values is not None:
            first = self.scratch.save(values.groupBy("value").agg(F.min("ord").alias("ord")))
            self.buckets = max(8, first.count() // BUCKET)
            self._keep(first)
        self._commit()
        self.scratch.free(known)
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellStore:
        """The store as its last finished batch left it."""
        there = [int(f.getPath().getName()) for f in _fs(spark, path).listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")) if f.getPath().getName().isdigit()]
        stream = _fs(spark, path).open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{max(there)}"))
        got = np.load(io.BytesIO(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
        self = cls(spark, path, float(got["cosine"]), int(got["width"]))
        self.versions, self.share, self.buckets = got["versions"].tolist(), int(got["share"]), int(got["buckets"])
        for node in got["nodes"].tolist():
            self.tree.split(node, got[f"centres{node}"])
        self.tree.least, self.tree.most, self.tree.rows, self.tree.solid = got["least"], got["most"], got["rows"], set(got["solid"].tolist())
        return self

    def _commit(self) -> None:
        """Writes the manifest under another name and moves it to its place, so that it is there whole or not at all."""
        t, raw = self.tree, io.BytesIO()
        np.savez(
            raw, nodes=np.array(list(t.splits), np.int64), least=t.least, most=t.most, rows=t.rows, solid=np.array(sorted(t.solid), np.int64), versions=np.array(self.versions, np.int64),
            share=self.share, buckets=self.buckets, cosine=self.cosine, width=self.width, **{f"centres{n}": c for n, (_, c, _) in t.splits.items()},
        )
        fs, place = _fs(self.spark, self.path), self.spark._jvm.org.apache.hadoop.fs.Path
        number = max([int(f.getPath().getName()) for f in fs.listStatus(place(f"{self.path}/manifest")) if f.getPath().getName().isdigit()], default=0) + 1 if fs.exists(place(f"{self.path}/manifest")) else 1
        stream = fs.create(place(f"{self.path}/manifest/{number}.part"), True)
        stream.write(bytearray(raw.getvalue()))
        stream.close()
        fs.rename(place(f"{self.path}/manifest/{number}.part"), place(f"{self.path}/manifest/{number}"))

    def _once(self, rows: DataFrame) -> DataFrame:
        """Vectors as directions, one row for each direction and artist."""
        width = self.width

        def canon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = directions(vectors(b.column(2), width))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in d], pa.binary())], ["ord", "artist", "vec"])

        named = rows.filter(F.col("artist").isNotNull() & F.col("ord").isNotNull() & (F.octet_length("vec") == width)).select("ord", "artist", "vec")
        return named.mapInArrow(canon, "ord long, artist string, vec binary").groupBy("artist", "vec").agg(F.min("ord").alias("ord"), F.collect_list("ord").alias("copies"))

    def _split(self, node: int, rows: DataFrame, count: int) -> None:
        got = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
        sample = _unit(np.array([np.frombuffer(r[0], np.int8) for r in got], np.float32).reshape(-1, self.width))
        self.tree.split(node, learn_centroids(sample, count))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with the cell of each and its distance to the centroid, saved; the cells' radii and sizes take them in."""
        tree, width, others = self.tree, self.width, [c for c in rows.columns if c not in ("ord", "artist", "vec")]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2_000):
                    part = b.slice(at, 2_000)
                    cell, far = tree.assign(_unit(vectors(part.column(2), width)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), *part.columns], ["cell", "r", *part.schema.names])

        schema = "cell int, r double, ord long, artist string, vec binary" + (", copies array<bigint>" if others else "")
        placed = self.scratch.save(rows.select("ord", "artist", "vec", *others).mapInArrow(assign, schema))
        for cell, low, high, n in placed.groupBy("cell").agg(F.min("r"), F.max("r"), F.count("*")).collect():  # a row a cell
            tree.least[cell], tree.most[cell] = min(tree.least[cell], low), max(tree.most[cell], high)
            tree.rows[cell] += n
        return placed

    def _append(self, placed: DataFrame) -> None:
        """Writes rows to the folders of their cells as a new version; the manifest takes it up at the next commit."""
        version = max(self.versions, default=0) + 1
        path = f"{self.path}/vectors/v={version}"
        placed.select("cell", "r", "ord", "artist", "vec").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        if self._wrote(path):
            self.versions.append(version)

    def _wrote(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any("cell=" in s.getPath().getName() for s in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where))

    def _read(self, versions: list[int], cells: list[int] | None = None) -> DataFrame:
        """Only the folders of the versions and cells are read."""
        rows = self.spark.read.schema("r double, ord long, artist string, vec binary, v int, cell int").parquet(f"{self.path}/vectors")
        rows = rows.filter(F.col("v").isin(versions))
        return rows if cells is None else rows.filter(F.col("cell").isin(cells))

    def _grow(self) -> None:
        """Splits cells that hold more than GROWN shares, until none does or no split would help."""
        tree = self.tree
        while large := [c for c in tree.cells() if tree.rows[c] > GROWN * self.share and c not in tree.solid]:
            for cell in large:
                rows = self.scratch.save(self._read(self.versions, [cell]).select("ord", "artist", "vec"))
                self._split(cell, rows, max(2, min(FAN, int(tree.rows[cell]) // self.share)))
                self._append(self._placed(rows))
                children = tree.splits[cell][0]
                tree.solid |= {int(c) for c in children if tree.rows[c] > 0.9 * tree.rows[cell]}
                self.scratch.free(rows)

    def _bucket(self):
        return F.pmod(F.xxhash64("value"), F.lit(self.buckets)).cast("int")

    def _keep(self, first: DataFrame) -> None:
        first.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/values")

    def ingest(self, batch: DataFrame, values: DataFrame | None = None, same: Callable[[str, str], bool] = same_lead_artist) -> DataFrame:
        """Appends batch(ord, artist, vec) and values(ord, value); returns (ord) of the rows that repeat an earlier one: of the batch, or of those
        before it if the batch came late."""
        once = self._placed(self._once(batch))
        self._append(once)
        found = self._meet(once, same).unionByName(once.select(F.explode("copies").alias("o"), "ord").filter("o > ord").select(F.col("o").alias("ord")))
        if values is None:
            found = self.scratch.save(found.distinct())
        else:
            both, met = self._met_values(values)
            found = self.scratch.save(found.unionByName(met).distinct())
            self._keep(both.select("value", F.col("first").alias("ord")))
        self._grow()
        self._commit()
        return found

    def _met_values(self, values: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the batch's values with their first rows here and in the store, the rows that come after a first one)."""
        first = values.groupBy("value").agg(F.min("ord").alias("first"))
        known = self.spark.read.schema("value string, ord long, bucket int").parquet(f"{self.path}/values")
        if self.buckets > FEW:
            known = known.filter(F.col("bucket").isin([r[0] for r in first.select(self._bucket()).distinct().collect()]))
        stored = known.join(first, "value", "left_semi").groupBy("value").agg(F.min("ord").alias("stored"))
        both = self.scratch.save(first.join(stored, "value", "left"))
        later = values.join(both, "value").filter(F.col("ord") > F.least("first", F.coalesce("stored", "first"))).select("ord")
        overtaken = both.filter(F.col("stored") > F.col("first")).select(F.col("stored").alias("ord"))
        return both, later.unionByName(overtaken)

    def _meet(self, once: DataFrame, same: Callable[[str, str], bool]) -> DataFrame:
        tree, width, radius, cosine = self.tree, self.width, self.radius, self.cosine

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2_000):
                    part = b.slice(at, 2_000)
                    rows, cells = tree.probe(_unit(vectors(part.column(2), width)), radius)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), *(c.take(take) for c in part.columns)], ["cell", "ord", "artist", "vec"])

        asked = once.select("ord", "artist", "vec").mapInArrow(probe, "cell int, ord long, artist string, vec binary")
        touched = [r[0] for r in asked.select("cell").distinct().collect()]  # at most the number of cells
        blocks = {c: -(-int(tree.rows[c]) // BLOCK) for c in touched}
        many = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() if n > 1 for x in (c, n)]), F.col("cell")) if max(blocks.values(), default=1) > 1 else F.lit(1)
        many = F.coalesce(many, F.lit(1))
        stored = self._read(self.versions, touched).select("cell", F.pmod(F.xxhash64("ord", "artist", "vec"), many.cast("long")).cast("int").alias("block"), F.lit(0).alias("asks"), "ord", "artist", "vec")
        asking = asked.select("cell", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), F.lit(1).alias("asks"), "ord", "artist", "vec")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, held, block, out = None, [], None, set()
            for b in batches:
                keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    part = b.slice(x, y - x)
                    if keys[x][:2] != unit:
                        unit, held, block = keys[x][:2], [], None
                    if not keys[x][2]:
                        held.append(part)
                        continue
                    if block is None and held:
                        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        block = t.column(3).to_numpy(), t.column(4), _unit(vectors(t.column(5), width).astype(np.float64))
                    if block is None:
                        continue
                    ords, artists, queries = part.column(3).to_numpy(), part.column(4), _unit(vectors(part.column(5), width).astype(np.float64))
                    for at in range(0, len(ords), 256):
                        for i, j in np.argwhere(queries[at : at + 256] @ block[2].T > cosine):
                            q, o = int(ords[at + i]), int(block[0][j])
                            if q != o and max(q, o) not in out and same(artists[at + int(i)].as_py(), block[1][int(j)].as_py()):
                                out.add(max(q, o))
                yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], ["ord"])
                out = set()

        laid = stored.unionByName(asking).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
        return laid.mapInArrow(meet, "ord long")


def identity(df: DataFrame, order) -> DataFrame:
    """(ord, value): the ids and the stored keys that name a recording."""
    ids = df.filter(F.col("track_id").isNotNull()).select(order.alias("ord"), F.concat(F.lit("i:"), "track_id").alias("value"))
    return ids.unionByName(keyed(df).select(order.alias("ord"), F.concat(F.lit("k:"), "dedupe_key").alias("value")))


def repeats(spark: SparkSession, tracks: DataFrame, arrivals: DataFrame, path: str | None = None) -> DataFrame:
    """(arrival_id) of every arrival that repeats a row of tracks or an arrival of smaller id. The store is written at path (a scratch folder if
    none is given), opened from there, and every batch appended to it.

    Defined cases: an arrival without a usable vector or artist is judged by its id and key alone, one without those is no repeat; null arrival ids are
    ignored; rows that share an arrival id are one arrival; batches may come in any order and batch_no may be null (judged last); empty tables
    give no rows; other columns are ignored.
    """
    arrivals, path = arrivals.filter(F.col("arrival_id").isNotNull()), path or f"{Scratch(spark, 'cells').root}"
    number = F.col("arrival_id").cast("long")
    before = F.lit(BEFORE).cast("long")
    CellStore.create(spark, path, usable(tracks).select(before.alias("ord"), "artist", F.col("embedding").alias("vec")), identity(tracks, before))
    # As a later job would: from the manifest alone.
    store, found = CellStore.open(spark, path), None
    for (batch,) in arrivals.select("batch_no").distinct().orderBy(F.col("batch_no").asc_nulls_last()).toLocalIterator():
        new = arrivals.filter(F.col("batch_no").eqNullSafe(F.lit(batch)))
        part = store.ingest(usable(new).select(number.alias("ord"), "artist", F.col("embedding").alias("vec")), identity(new, number))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "arrival_id long")
    return found.select(F.col("ord").alias("arrival_id")).filter(F.col("arrival_id") != BEFORE).distinct()
