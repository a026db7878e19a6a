"""Batch de-duplication by key and by vector within an artist."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstrand.operators.blocks import in_pairs, units

#: Rows of a block: an artist of more is compared in pairs of blocks, all of them.
BLOCK = 2_000
#: Rows of a block that meet it in one product.
_SLICE = 256


def vector_marks(rows: DataFrame, near: float = 0.995, block: int = BLOCK) -> DataFrame:
    """rows(artist, track_id, at, vec) -> (track_id, primary_id): within an artist, oldest first, a row whose cosine to an earlier unmarked row is
    above near is marked with the earliest such row. Artists of any size: near pairs are found in pairs of blocks, and the greedy pass goes over
    these pairs alone."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sizes = rows.groupBy("artist").agg(F.ceil(F.count("*") / block).alias("blocks"))
    paired = in_pairs(rows.join(sizes, "artist"), "track_id", F.col("blocks"))
    laid = paired.repartition("artist", "unit").sortWithinPartitions("artist", "unit", "at", "track_id").select("artist", "unit", "a", "at", "track_id", "vec")
    names = ["artist", "at", "track_id", "first_at", "first_id"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in units(batches, 2):
            n = table.num_rows
            x = np.array(table.column("vec").to_pylist(), np.float64).reshape(n, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x /= np.where(norm == 0, 1, norm)
            a = table.column("a").to_numpy()
            # Rows of one block also meet in the units of that block with others; there only pairs across count.
            crossed = a.min() != a.max()
            for at in range(0, n, _SLICE):
                late, early = np.nonzero(x[at : at + _SLICE] @ x[: at + _SLICE].T > near)
                late += at
                kept = (early < late) & (~crossed | (a[early] != a[late]))
                late, early = table.take(late[kept]), table.take(early[kept])
                if late.num_rows:
                    columns = [late.column("artist"), late.column("at"), late.column("track_id"), early.column("at"), early.column("track_id")]
                    yield from pa.table(columns, names).to_batches()

    kind = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, ("artist", "at", "track_id", "at", "track_id")))
    found = laid.mapInArrow(pairs, kind)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        artist, marked = None, set()
        for b in batches:
            marks = []
            for x, t, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                if x != artist:
                    artist, marked = x, set()
                # A row's earlier ones come oldest first, and all of them are settled.
                if t not in marked and first not in marked:
                    marked.add(t)
                    marks.append((t, first))
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*marks)], ["track_id", "primary_id"])

    ordered = found.repartition("artist").sortWithinPartitions(*names).select("artist", "track_id", "first_id")
    return ordered.mapInArrow(fold, "track_id string, primary_id string")
