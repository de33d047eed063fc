"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is the rate at which its documents are taken: the whole part of the
rate for each, and a fractional inclusion probability that the cube method settles. Its flight
phase takes a window of undecided documents and moves their probabilities along the null space of
two constraints, expected words and expected documents of the source, until one of them is 0 or 1;
so both totals stay exact. Within a block of documents the flight leaves two undecided at most.
Undecided documents of all blocks meet in the next round, in far fewer blocks, until a source has
one block; the landing then gives up the document count first and settles the last one by chance.
Blocks run from large documents to small ones, so what lands is small.

Blocks are chosen by a hash of the row's values and hold about ``block`` documents each; a task
streams through its blocks and keeps one window in memory, so neither a hot source nor a hot
key needs room. The random numbers hash the values of the rows they move, not their place, so
reruns agree.

Nulls: a null text has no words; a null source is a source of its own and sorts last. Repeated rows
are sampled each for itself; ties in size are ordered by all columns given in ``keys``. Rows of equal
keys are interchangeable. Documents without words are never taken. An empty table gives an empty
result. Other columns are passed on; those with the name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from framelake.llm.common import word_count
from framelake.workspace import materialize

BLOCK = 1024
#: Undecided documents that a flight holds; smaller moves of a document count as none.
WINDOW, TINY = 32, 1e-12
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: weights repeat over the sources by code point.

    Targets share ``share`` times all words by weight and stop at ``most`` times their source's, the
    excess going to the others by weight until none is above. In closed form: with sources ordered
    by cap over weight, the capped ones are a prefix, and the level of the rest is what remains over
    their weight. Both windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(n, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / F.sum("weight").over(rest)
    # The level counts from the first source below its cap on; capped ones come before it.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = F.first(F.col("open"), ignorenulls=True).over(every)
    return ranked.withColumn("level", level).withColumn("open", open_level).withColumn("final", final).select(
        "source", "source_size",
        F.coalesce(F.least("cap", F.col("final") * F.col("weight")), "cap").cast("double").alias("target"))


class Flight:
    """The flight phase over a stream of units [size, probability, name, payload] by falling size.

    A window of units is held. Each move projects the largest one on the null space of the
    constraints within the window, so that it moves most and is settled first while many smaller
    ones make up for it a little each; what is left in the end is small.
    """

    def __init__(self, seed: int, window: int = WINDOW):
        self.seed, self.window, self.units = seed, window, []

    def feed(self, unit: list) -> list:
        """Take a unit; returns the units that are now 0 or 1."""
        if unit[1] <= 0.0 or unit[1] >= 1.0:
            return [unit]
        self.units.append(unit)
        return self.move() if len(self.units) >= self.window else []

    def close(self) -> list:
        """Move until two units are undecided at most."""
        done = []
        while len(self.units) > 2:
            done += self.move()
        return done

    def move(self) -> list:
        sizes = np.array([u[0] for u in self.units])
        scaled = sizes - sizes.mean()  # orthogonal to the constant of the document total
        spread = float(scaled @ scaled)
        direction = -np.full(len(sizes), 1 / len(sizes))
        direction[0] += 1
        if spread > 1e-9 * max(1.0, float(sizes @ sizes)):
            direction -= scaled * (scaled[0] / spread)
        if abs(direction).max() < 1e-9:  # the largest one alone cannot move: the next ones can
            direction[1:] = 0
            direction[1:3] = 1.0, -1.0
        return self.step((direction / abs(direction).max()).tolist())

    def land(self) -> list:
        """Settle what is left: keep the words where two are left, then by chance."""
        done = self.close()
        while self.units:
            if len(self.units) == 2:
                a, b = self.units  # words stay: a.size * da + b.size * db = 0
                scale = max(a[0], b[0]) or 1.0
                done += self.step([b[0] / scale, -a[0] / scale] if a[0] or b[0] else [1.0, -1.0])
            else:
                done += self.step([1.0])
        return done

    def chance(self) -> float:
        names = repr((len(self.units), self.units[0][2], self.units[-1][2], self.units[0][1]))
        return xxhash.xxh64_intdigest(names.encode(), self.seed) / 2.0**64

    def step(self, direction: list[float]) -> list:
        """Move to one end of the segment inside the unit cube, so that the mean stays."""
        up = min(((1 - u[1]) / d if d > 0 else -u[1] / d) for u, d in zip(self.units, direction) if abs(d) > TINY)
        down = min((u[1] / d if d > 0 else (u[1] - 1) / d) for u, d in zip(self.units, direction) if abs(d) > TINY)
        forward = self.chance() * (up + down) < down
        at = up if forward else -down
        left, done = [], []
        for unit, d in zip(self.units, direction):
            unit[1] += at * d if abs(d) > TINY else 0.0
            if abs(d) > TINY and (unit[1] < 1e-9 or unit[1] > 1 - 1e-9):
                unit[1] = float(round(unit[1]))
                done.append(unit)
            else:
                left.append(unit)
        self.units = left
        return done


def _fly(schema: pa.Schema, last: bool):
    """Flight over batches sorted by source, block and falling size; ``last`` also lands."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, cell = None, None

        def close() -> list:
            if flight is None:
                return []
            return flight.land() if last else flight.close() + flight.units

        def emit(batch: pa.RecordBatch | None, rows: list[int], values: list[float], held: list) -> Iterator[pa.RecordBatch]:
            """``rows`` of this batch by position, and units held from earlier ones as rows of their own."""
            parts = ([(batch.take(pa.array(rows)), values)] if rows else []) + [(u[3], [u[1]]) for u in held]
            for part, chance in parts:
                columns = [part.column(n) for n in names if n not in ("__chance", "__open")]
                chance = np.array(chance)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(chance), pa.array((chance > 0) & (chance < 1))], schema=schema)

        for batch in batches:
            sizes = batch.column("__size").to_pylist()
            chances = batch.column("__chance").to_pylist()
            marks = batch.column("__name").to_pylist()
            cells = list(zip(batch.column("__group").to_pylist(), batch.column("__block").to_pylist()))
            rows, values, held = [], [], []

            def settle(units: list) -> None:
                for unit in units:
                    if isinstance(unit[3], int):
                        rows.append(unit[3])
                        values.append(unit[1])
                    else:
                        held.append(unit)

            for i in range(batch.num_rows):
                if cells[i] != cell:
                    settle(close())
                    flight, cell = Flight(xxhash.xxh32_intdigest(repr(cells[i]).encode())), cells[i]
                settle(flight.feed([sizes[i], chances[i], marks[i], i]))
            yield from emit(batch, rows, values, held)
            for unit in flight.units if flight else ():
                if isinstance(unit[3], int):  # a copy, so that the batch can go
                    unit[3] = batch.take(pa.array([unit[3]]))
        yield from emit(None, [], [], close())

    return run


def mix(docs: DataFrame, sizes: DataFrame, size: str = "size", source: str = "source",
        keys: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """``docs`` with ``target`` and ``source_size`` of its source and ``copies``, how often it is taken.

    ``sizes`` has source, source_size and target; ``keys`` tell documents of a source apart.
    """
    plan = sizes.select(
        F.col("source").alias("__source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"))
    # The caller's columns travel in one, so that no name of theirs meets a name from here.
    fresh = docs.drop("source_size", "target", "copies")
    packed = fresh.select(
        F.struct(*[F.col(f"`{c}`") for c in fresh.columns]).alias("__row"), F.col(source).alias("__of"),
        F.col(size).alias("__words"), F.xxhash64(*(F.col(k) for k in keys), F.col(size)).alias("__name"))
    counts = packed.groupBy(F.col("__of").alias("__source")).agg(F.count("*").alias("__docs"))
    plan = materialize(plan.alias("p").join(counts.alias("c"), F.col("p.__source").eqNullSafe(F.col("c.__source")))
                       .select("p.*", "__docs"), "mix-plan")
    some = F.col("__words") > 0
    units = packed.join(plan, F.col("__of").eqNullSafe(F.col("__source")), "left").select(
        "__row", "source_size", "target", F.col("__words").cast("double").alias("__size"), "__name",
        F.when(some, F.floor("__rate")).otherwise(F.lit(0)).cast("long").alias("copies"),
        F.col("__of").cast("string").alias("__group"), F.ceil(F.col("__docs") / block).cast("long").alias("__blocks"),
        F.when(some, F.col("__rate") - F.floor("__rate")).otherwise(F.lit(0.0)).alias("__chance"),
    ).withColumn("__block", F.pmod("__name", F.col("__blocks")).cast("long"))
    columns = [c for c in units.columns if c != "__chance"]
    out = StructType([*(units.schema[c] for c in columns), StructField("__chance", DoubleType()),
                      StructField("__open", BooleanType())])
    decided, most = [], plan.agg(F.coalesce(F.max(F.ceil(F.col("__docs") / block)), F.lit(1))).first()[0]
    while True:
        last = most <= 1
        flown = units.repartition("__group", "__block") \
            .sortWithinPartitions("__group", "__block", F.desc("__size"), "__name") \
            .mapInArrow(_fly(_arrow(out), last), out)
        table = materialize(flown, "mix")
        decided.append(table if last else table.filter("NOT __open"))
        if last:
            break
        # At most two undecided documents a block: the next round has 1 / block of the blocks.
        most = -(-2 * most // block)
        units = table.filter("__open").drop("__open").withColumn(
            "__blocks", F.ceil(2 * F.col("__blocks") / block).cast("long")
        ).withColumn("__block", F.pmod(F.xxhash64("__name"), F.col("__blocks")).cast("long")).select(
            *columns, "__chance")
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    return every.select("__row.*", "source_size", "target", (F.col("copies") + F.col("__chance").cast("long")).alias("copies"))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", keys: tuple[str, ...] = ("doc_id",),
                  weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                  block: int = BLOCK, carry: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken: the words that the mix takes of each.

    ``carry=False`` drops the text once it is counted, for callers that want the decisions only.
    """
    sized = docs.withColumn("size", word_count(text))
    sized = sized if carry else materialize(sized.drop(text), "sizes")
    sizes = materialize(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "source-targets")
    return mix(sized, targets, "size", source, keys, block).withColumn("taken", F.col("size") * F.col("copies"))
