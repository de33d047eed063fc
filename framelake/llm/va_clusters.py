"""Centroid clustering over a vector-approximation file.

Components become whole numbers. Beside each vector lies its approximation: for every dimension the
number of the cell that holds the component, ``bits`` bits each, packed. Cells are cut around the mean of
the dimension, evenly within three deviations; the outermost reach to the least and the largest value, all
from one aggregate over all vectors. In a round, two tables a dimension give for every cell and centroid
the least and the largest squared difference that a component of that cell can have. Adding them up over
the dimensions puts each distance into an interval. A centroid whose interval begins above the least
interval end cannot be nearest. Where one centroid is left the row is decided by its cells alone; only
where intervals overlap the vector itself is taken and compared, in whole numbers, with the centroids that
are left. So the assignment equals that of comparing everything, ties included, with any number of bits.

A round is one pass without a shuffle of vectors: a task reads its part of the file, which holds cells and
vectors in one row, and hands out one exact sum per cluster and dimension. The driver holds centroids
only, ``k`` times ``dims`` numbers.

Rows whose vector is null, has another number of components or holds a null or non-finite one are left
out. A component beyond 2**27 in size counts as that, so that distances fit a long; a sum that does not fit
is null. Ties go to the smaller cluster number. Repeated rows count each. Null ids are kept but start no
cluster unless there are too few others; rows of equal id start clusters in the order of their
components. With fewer rows than ``k`` there are fewer clusters; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framelake.llm.common import schema_of
from framelake.llm.vectors import group_sums, matrix, total, whole_rows, whole_vectors
from framelake.workspace import materialize

SCALE, DIMS, CLUSTERS, ROUNDS, BITS = 64, 64, 16, 3, 6
#: Cells are cut within so many deviations of a dimension's mean.
SPREAD = 3.0
#: Rows that a task compares at a time.
CHUNK = 2048


class Cells:
    """Least and largest whole number of every cell, by dimension: two matrices (dims, 2**bits)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int):
        steps = np.linspace(-SPREAD, SPREAD, (1 << bits) - 1)
        inner = np.ceil(mean[:, None] + deviation[:, None] * steps).astype(np.int64)
        #: Where the second cell and those after it begin.
        self.begins = np.clip(inner, low[:, None], high[:, None] + 1)
        self.bits, self.dims = bits, len(mean)
        self.least = np.concatenate([low[:, None], self.begins], axis=1)
        self.largest = np.concatenate([self.begins - 1, high[:, None]], axis=1)

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers of each row, ``bits`` bits a dimension."""
        cells = np.empty(vectors.shape, np.uint8)
        for d in range(self.dims):
            cells[:, d] = np.searchsorted(self.begins[d], vectors[:, d], side="right")
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return np.packbits(bits.reshape(len(cells), -1), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1)[:, :self.dims * self.bits].reshape(-1, self.dims, self.bits)
        return np.packbits(bits, axis=2)[:, :, 0] >> (8 - self.bits)


class Intervals:
    """Distance intervals between cells and centroids, from lookup tables."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.cells, self.centroids = cells, centroids
        least, largest = cells.least[:, :, None], cells.largest[:, :, None]
        middle = centroids.T[:, None, :]
        outside = np.maximum(np.maximum(least - middle, middle - largest), 0)
        across = np.maximum(np.abs(middle - least), np.abs(middle - largest))
        self.lows, self.highs = outside**2, across**2  # (dims, cells, centroids)

    def left(self, packed: np.ndarray) -> np.ndarray:
        """(rows, centroids): whether a centroid can still be the nearest."""
        cells = self.cells.unpack(packed)
        low = np.zeros((len(cells), len(self.centroids)), np.int64)
        high = np.zeros_like(low)
        for d in range(self.cells.dims):
            low += self.lows[d][cells[:, d]]
            high += self.highs[d][cells[:, d]]
        return low <= high.min(1, keepdims=True)

    def nearest(self, packed: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, whether the vector was needed) of each row; ``vectors`` is read where intervals overlap."""
        left = self.left(packed)
        cluster = left.argmax(1)
        open_rows = np.flatnonzero(left.sum(1) > 1)
        best = np.full(len(open_rows), np.iinfo(np.int64).max)
        fetched = vectors[open_rows].astype(np.int64)
        for c, centroid in enumerate(self.centroids):
            near = np.flatnonzero(left[open_rows, c])
            distance = ((fetched[near] - centroid) ** 2).sum(1)
            closer = distance < best[near]
            best[near[closer]] = distance[closer]
            cluster[open_rows[near[closer]]] = c
        needed = np.zeros(len(cluster), bool)
        needed[open_rows] = True
        return cluster, needed


def _spread(df: DataFrame, vector: str, scale: int, dims: int) -> dict[str, np.ndarray] | None:
    """Rows, mean, deviation, least and largest whole number of every dimension; None without rows."""
    columns = "d int, n long, total double, squares double, low long, high long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims), np.zeros(dims)
        low, high = np.full(dims, 1 << 40), np.full(dims, -(1 << 40))
        for batch in batches:
            rows = whole_rows(batch.column(0), scale, dims)[1].astype(np.float64)
            if len(rows):
                n, sums, squares = n + len(rows), sums + rows.sum(0), squares + (rows**2).sum(0)
                low, high = np.minimum(low, rows.min(0)), np.maximum(high, rows.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(sums), pa.array(squares),
                 pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], schema=schema_of(columns))

    parts = df.select(F.col(vector).cast("array<double>")).mapInArrow(run, columns)
    rows = parts.groupBy("d").agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.min("low"), F.max("high")).collect()
    if not rows:
        return None
    _, n, sums, squares, low, high = (np.array(x) for x in zip(*sorted(map(tuple, rows))))
    mean = sums / n
    return {"mean": mean, "deviation": np.sqrt(np.maximum(squares / n - mean**2, 0)), "low": low, "high": high}


def approximate(df: DataFrame, vec_id: str, vector: str, scale: int, dims: int, bits: int) -> tuple[DataFrame, Cells] | None:
    """The file of (vec_id, components, cells), written, and what its cells mean; None without rows."""
    spread = _spread(df, vector, scale, dims)
    if spread is None:
        return None
    cells = Cells(spread["low"], spread["high"], spread["mean"], spread["deviation"], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = cells.pack(matrix(batch.column(0), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array([row.tobytes() for row in packed], pa.binary())],
                names=["vec_id", "components", "cells"])

    whole = whole_vectors(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), ["vec_id"], "vector", scale, dims)
    kind = whole.schema["vec_id"].dataType.simpleString()
    file = whole.mapInArrow(run, f"vec_id {kind}, components array<int>, cells binary")
    return materialize(file, "vector-cells"), cells


def first_centroids(file: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids hash lowest."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = file.select("components", hashed.alias("hashed")).orderBy(F.asc_nulls_last("hashed"), "components").limit(k)
    return np.array([r.components for r in rows.collect()], np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, cells, vectors), ``CHUNK`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            packed = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            yield part, packed, matrix(part.column("components"), dims)


def move(file: DataFrame, cells: Cells, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(centroids after one round, rows whose vector the assignment needed)."""
    k, dims = centroids.shape
    columns = "c int, n long, needed long, sums array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(cells, centroids)
        counts, sums, needed = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, packed, vectors in _chunks(batches, dims):
            cluster, open_rows = intervals.nearest(packed, vectors)
            n, added = group_sums(cluster, vectors, k)
            counts, sums, needed = counts + n, sums + added, needed + np.bincount(cluster[open_rows], minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(needed[some]),
             pa.array(list(sums[some]), pa.list_(pa.int64()))], schema=schema_of(columns))

    parts = file.select("cells", "components").mapInArrow(run, columns)
    by_component = parts.select("c", "n", "needed", F.posexplode("sums").alias("d", "part")).groupBy("c", "d").agg(
        F.sum("n").alias("n"), F.sum("needed").alias("needed"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    moved, needed = centroids.copy(), 0
    for r in by_component.collect():
        moved[r.c, r.d] = int(r.total) // r.n
        needed += r.needed if r.d == 0 else 0
    return moved, needed


def assign(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(cells, centroids)
        for part, packed, vectors in _chunks(batches, dims):
            cluster, _ = intervals.nearest(packed, vectors)
            distance = ((vectors.astype(np.int64) - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])

    kind = file.schema["vec_id"].dataType.simpleString()
    return file.select("vec_id", "cells", "components").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, dims: int = DIMS,
            k: int = CLUSTERS, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark: SparkSession = df.sparkSession
    made = approximate(df, vec_id, vector, scale, dims, bits)
    summary = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if made is None:
        kind = df.schema[vec_id].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long{summary.removeprefix('cluster int')}")
    file, cells = made
    centroids = first_centroids(file, k)
    for _ in range(rounds):
        centroids, _ = move(file, cells, centroids)
    rows = materialize(assign(file, cells, centroids), "assigned-vectors")
    # k rows at most.
    sums = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(total("distance").alias("inertia")).collect()}
    whole = None if None in sums.values() or (add := sum(sums.values())) >= 1 << 63 else add
    per_cluster = spark.createDataFrame([(c, s, whole, centroid_digest(centroids[c])) for c, s in sums.items()], summary)
    return rows.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
