"""Vector code compression: product codes trained with Drake and Hamerly's adaptive bounds.

Components become whole numbers and a vector is cut into ``PARTS`` equal parts, each of which is coded by
the nearest entry of its position's codebook. The first assignment compares a part with every entry and
keeps, for the part, its ``b`` closest entries in order with a lower bound of the distance to each, and one
outer bound below the distance to all others. When entries move, every bound gives way by as much as its
entry moved, the outer bound by the largest move, and bounds are put in order again from the outside in.
The part's own entry is measured in whole numbers; entries whose bound is beyond that distance cannot be
nearest. Only those before the first such bound are measured, and all entries where not even the outer
bound is beyond. Bounds are floating numbers rounded down and entries are ruled out only by a margin, so
every uncertain case is decided by whole numbers, and codes equal those of comparing everything, ties
included.

``b`` adapts: it starts at a quarter of the entries, and each batch of rows goes on with as many as one of
its parts needed, an eighth of the entries at least. Bounds lie in the written table beside their row, so
they outlive tasks and executors. A round is one pass that hands out exact sums per part, entry and
component; vectors are not shuffled. The driver holds the codebooks only.

Rows whose vector is null, has another number of components or holds a null or non-finite one are left
out. A component beyond 2**27 in size counts as that, so that distances fit a long; a sum that does not fit
is null. Ties go to the lower entry. Repeated rows count each; rows of equal id start codebooks in the order of
their components, null ids come last. With fewer rows than entries the codebooks are shorter. An empty
table gives an empty result. Other columns than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelake.llm.common import schema_of
from framelake.llm.vectors import group_sums, matrix, total, whole_vectors
from framelake.workspace import materialize

SCALE, DIMS, PARTS, ENTRIES, ROUNDS = 256, 64, 16, 64, 2
#: Shares of the entries that are tracked at first and at least.
FIRST, LEAST = 4, 8
#: Relative margin that covers the rounding of roots, moves and their sums; bounds are floats of 32 bits.
MARGIN = 1e-5
#: Rows that a task compares at a time.
CHUNK = 512


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(points, entries): squared distances in longs."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


def below(squares: np.ndarray) -> np.ndarray:
    """A float below each square's root."""
    return (np.sqrt(squares.astype(np.float64)) * (1 - MARGIN)).astype(np.float32)


class Bounds:
    """Of each point: its closest entries in order, lower bounds of their distances, and one of all others."""

    def __init__(self, near: np.ndarray, lows: np.ndarray, outer: np.ndarray):
        self.near, self.lows, self.outer = near, lows, outer

    @property
    def width(self) -> int:
        return self.near.shape[1]

    def cut(self, width: int) -> Bounds:
        """The ``width`` closest; the outer bound takes the others in."""
        if width >= self.width:
            return self
        outer = np.minimum(self.outer, self.lows[:, width:].min(1))
        return Bounds(self.near[:, :width], self.lows[:, :width], outer)


def searched(points: np.ndarray, entries: np.ndarray, width: int) -> Bounds:
    """Bounds from measuring every entry."""
    squares = squared(points, entries)
    order = np.argsort(squares, axis=1, kind="stable")  # ties: the lower entry first
    ranked = np.take_along_axis(squares, order, axis=1)
    outer = below(ranked[:, width]) if width < len(entries) else np.full(len(points), np.inf, np.float32)
    return Bounds(order[:, :width].astype(np.uint8), below(ranked[:, :width]), outer)


def moved(bounds: Bounds, moves: np.ndarray) -> Bounds:
    """Bounds after entries moved by ``moves``, in order again."""
    give = np.nextafter(moves.astype(np.float32), np.float32(np.inf)) * np.float32(1 + MARGIN)
    # A bound below zero says nothing, so that rounding it up does no harm.
    away = lambda kept, by: np.nextafter(kept * np.float32(1 - MARGIN) - by, np.float32(-np.inf))
    outer = away(bounds.outer, give.max())
    lows = away(bounds.lows, give[bounds.near])
    lows = np.minimum.accumulate(np.concatenate([lows, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    return Bounds(bounds.near, lows[:, :-1], outer)


def reassigned(points: np.ndarray, entries: np.ndarray, bounds: Bounds) -> tuple[Bounds, int, int]:
    """(bounds with the nearest entry first, most entries a point needed, distances measured)."""
    rows = np.arange(len(points))
    own = ((points - entries[bounds.near[:, 0]]) ** 2).sum(1)
    # Beyond by a margin: strictly farther, whatever was rounded.
    reach = (np.sqrt(own.astype(np.float64)) * (1 + MARGIN)).astype(np.float32)
    reach = np.nextafter(reach, np.float32(np.inf))
    beyond = bounds.lows > reach[:, None]
    beyond[:, 0] = False
    inside = bounds.outer > reach
    # Ordered bounds: the entries before the first one beyond are to be measured.
    need = np.where(beyond.any(1), beyond.argmax(1), bounds.width)
    near, lows, outer = bounds.near.copy(), bounds.lows.copy(), bounds.outer.copy()
    full = rows[~inside & (need == bounds.width)]
    most, measured = 1, len(points)
    for width in np.unique(need):
        some = rows[(need == width)]
        some = some[inside[some]] if width == bounds.width else some
        if width < 2 or not len(some):
            continue
        most, measured = max(most, int(width)), measured + len(some) * int(width)
        ids = near[some, :width].astype(np.int64)
        squares = ((points[some, None, :] - entries[ids]) ** 2).sum(2)
        order = np.lexsort((ids, squares), axis=1)
        near[some, :width] = np.take_along_axis(ids, order, axis=1)
        lows[some, :width] = below(np.take_along_axis(squares, order, axis=1))
    if len(full):
        again = searched(points[full], entries, bounds.width)
        near[full], lows[full], outer[full] = again.near, again.lows, again.outer
        measured += len(full) * len(entries)
    alone = rows[need == 1]
    lows[alone, 0] = below(own[alone])
    # A measured entry may lie farther than a bound behind it; a bound that is too low stays true.
    lows = np.minimum.accumulate(np.concatenate([lows, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :-1]
    return Bounds(near, np.ascontiguousarray(lows), outer), most, measured


STATE = ["code", "near", "lows", "outer"]


def _state_columns(kept: list[tuple[str, str]]) -> str:
    return ", ".join(["components array<int>", *(f"`{name}` {kind}" for name, kind in kept),
                      "code binary, near binary, lows binary, outer binary, measured long"])


def _write(batch: pa.RecordBatch, plain: list[str], per_part: list[Bounds], measured: int) -> pa.RecordBatch:
    """Rows with their codes and the bounds of all parts, one after the other."""
    n, parts, width = batch.num_rows, len(per_part), per_part[0].width
    near = np.stack([b.near for b in per_part], axis=1)
    lows = np.stack([b.lows for b in per_part], axis=1).astype(np.float32)
    outer = np.stack([b.outer for b in per_part], axis=1).astype(np.float32)
    packed = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(name) for name in plain), packed(near[:, :, 0]), packed(near.reshape(n, parts * width)),
         packed(lows.reshape(n, parts * width)), packed(outer), pa.array([measured] + [0] * (n - 1), pa.int64())],
        names=[*plain, *STATE, "measured"])


def _parts_of(batch: pa.RecordBatch, parts: int, dims: int) -> np.ndarray:
    return matrix(batch.column("components"), dims).astype(np.int64).reshape(batch.num_rows, parts, dims // parts)


def start(vectors: DataFrame, books: np.ndarray, kept: list[tuple[str, str]]) -> DataFrame:
    """First assignment: every part with every entry."""
    parts, entries, size = books.shape
    width, plain = max(1, entries // FIRST), ["components", *(name for name, _ in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                points = _parts_of(some, parts, parts * size)
                found = [searched(points[:, p], books[p], width) for p in range(parts)]
                yield _write(some, plain, found, some.num_rows * parts * entries)

    return vectors.select(plain).mapInArrow(run, _state_columns(kept))


def advance(state: DataFrame, books: np.ndarray, moves: np.ndarray, kept: list[tuple[str, str]]) -> DataFrame:
    """The next assignment, from the bounds of the last one and how far each entry moved."""
    parts, entries, size = books.shape
    least, plain = max(1, entries // LEAST), ["components", *(name for name, _ in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("near").to_pylist()])
            edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)] if len(lengths) else [0]
            for low, high in zip(edges, edges[1:]):  # rows of one width
                for at in range(low, high, CHUNK):
                    yield step(batch.slice(at, min(CHUNK, high - at)), int(lengths[low]) // parts)

    def step(some: pa.RecordBatch, width: int) -> pa.RecordBatch:
        points, n = _parts_of(some, parts, parts * size), some.num_rows
        read = lambda name, kind, shape: np.frombuffer(b"".join(some.column(name).to_pylist()), kind).reshape(shape)
        near, lows = read("near", np.uint8, (n, parts, width)), read("lows", np.float32, (n, parts, width))
        outer, found, most, measured = read("outer", np.float32, (n, parts)), [], 1, 0
        for p in range(parts):
            bounds = moved(Bounds(near[:, p], lows[:, p], outer[:, p]), moves[p])
            bounds, needed, distances = reassigned(points[:, p], books[p], bounds)
            found.append(bounds)
            most, measured = max(most, needed), measured + distances
        adapted = max(least, min(width, most))
        return _write(some, plain, [b.cut(adapted) for b in found], measured)

    return state.mapInArrow(run, _state_columns(kept))


def first_books(vectors: DataFrame, parts: int, entries: int, dims: int) -> np.ndarray:
    """(parts, entries, components): the parts of the vectors with the smallest ids."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "components").limit(entries).collect()
    taken = np.array([r.components for r in rows], np.int64).reshape(len(rows), parts, dims // parts)
    return np.ascontiguousarray(taken.transpose(1, 0, 2))


def next_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every used entry at the rounded-down mean of its parts."""
    parts, entries, size = books.shape
    columns = "part int, entry int, n long, sums array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _parts_of(batch, parts, parts * size)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                n, added = group_sums(codes[:, p].astype(np.int64), points[:, p], entries)
                counts[p] += n
                sums[p] += added
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], schema=schema_of(columns))

    partial = state.select("components", "code").mapInArrow(run, columns)
    added = partial.select("part", "entry", "n", F.posexplode("sums").alias("d", "x")).groupBy("part", "entry", "d").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
    out = books.copy()
    for r in added.collect():  # parts * entries * components of a part
        out[r.part, r.entry, r.d] = int(r.total) // r.n
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
          scale: int = SCALE, dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """(rows with their state after the last assignment, final codebooks); None without rows.

    ``measured`` of the first row of a batch counts the distances that the batch's assignment measured.
    """
    if dims % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide the components, and a code is one byte")
    renamed = [F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")]
    renamed += [F.col(label).alias("label")] if label else []
    columns = ["vec_id", *(["label"] if label else [])]
    vectors = materialize(whole_vectors(df.select(renamed), columns, "vector", scale, dims), "whole-vectors")
    kept = [(f.name, f.dataType.simpleString()) for f in vectors.schema if f.name != "components"]
    books = first_books(vectors, parts, entries, dims)
    if not books.shape[1]:
        return None
    state = materialize(start(vectors, books, kept), "bounds")
    for _ in range(rounds):
        after = next_books(state, books)
        moves = np.sqrt(((after - books) ** 2).sum(2).astype(np.float64))
        books = after
        state = materialize(advance(state, books, moves, kept), "bounds")
    return state, books


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every usable vector."""
    spark = df.sparkSession
    trained = train(df, vec_id, vector, label, **options)
    if trained is None:
        kind = df.schema[vec_id].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    state, books = trained
    parts, _, size = books.shape

    @F.arrow_udf("bigint")
    def error(components: pa.Array, codes: pa.Array) -> pa.Array:
        if not len(codes):
            return pa.array([], pa.int64())
        points = matrix(components, parts * size).astype(np.int64).reshape(-1, parts, size)
        chosen = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, parts)
        return pa.array(((points - books[np.arange(parts), chosen]) ** 2).sum((1, 2)))

    coded = materialize(state.select("vec_id", "label", "code", error("components", "code").alias("error")), "coded-vectors")
    # Written, so that Spark knows how small the totals are before it joins them.
    totals = materialize(
        coded.groupBy(F.col("label").alias("of_label")).agg(total("error").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"))
