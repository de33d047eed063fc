"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into blocks, so many that two fingerprints within the threshold
differ by one bit at most in some block. The anchors of a block are the code words of a Hamming
code over its first 2**r - 1 bits, with every value of the bits left over: each block value lies
within one bit of exactly one anchor, its home. A fingerprint goes to its home and, as a guest, to
every anchor within the covering radius plus the block's threshold, two bits. Of two near
fingerprints, each is a guest where the other is at home, so comparing homes with guests per anchor
finds every pair. Per anchor a spanning forest of the links leaves the task, never all pairs.

``first_of_groups`` keeps one row of each group of linked fingerprints: the one of the smallest id, of equal ids
the one whose row hashes lowest, and one of rows that are equal in all columns. A null id comes last.

Only different fingerprints are compared: exact copies share one. An anchor with more than ``CELL``
fingerprints is cut into cells of home slices and guest slices, so a task's memory and work per cell
are bounded however many near copies a document has.

Nulls: a null text is an empty one; both have fingerprint zero. Null document ids stay rows; a
component's id is its smallest non-null id. Repeated rows give a row each. Ties cannot occur: the
id is a minimum. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framelake.llm.common import folded_words, schema_of
from framelake.llm.components import components
from framelake.workspace import materialize

BITS = 64
#: Most homes, and most guests, that one cell compares.
CELL = 4096
#: Shingles whose bits are summed at a time, so that long texts need little memory.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles in order, ``CHUNK`` at a time."""
    words = folded_words(text)
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    if len(words) > shingle:
        starts, ends = starts[:-shingle + 1] if shingle > 1 else starts, ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        yield np.array([hashed(joined[s:e], seed) for s, e in part], np.uint64)


def simhash_of(chunks: Iterable[np.ndarray]) -> int:
    """Bits that are set in over half of the hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for values in chunks:
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(values)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the XXH64 of the text's word shingles."""
    return simhash_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))],
                schema=schema_of("doc_id long, fp long"))

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, fp long")


class Block:
    """Anchors of one block of bits: a Hamming code on its low bits, all values of the others."""

    def __init__(self, shift: int, width: int):
        self.shift, self.width = np.uint64(shift), width
        self.mask = np.uint64((1 << width) - 1)
        self.coded = 1
        while 2 * self.coded + 1 <= width:
            self.coded = 2 * self.coded + 1  # 2**r - 1
        self.parities = [  # bit j of the syndrome: parity of the positions whose number has bit j
            np.uint64(sum(1 << (p - 1) for p in range(1, self.coded + 1) if p >> j & 1))
            for j in range(self.coded.bit_length())
        ]

    def values(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.shift) & self.mask

    def home(self, values: np.ndarray) -> np.ndarray:
        """The anchor within one bit: the syndrome is the position to flip."""
        syndrome = np.zeros(values.shape, np.uint64)
        for j, parity in enumerate(self.parities):
            syndrome |= (np.bitwise_count(values & parity).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
        flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        return values ^ flip

    def reached(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of the anchors within the radius plus one bit that are some near value's home.

        They are the homes of the value itself and of all values one bit away, two bits away at most.
        """
        near = values[:, None] ^ np.concatenate(
            [np.zeros(1, np.uint64), np.uint64(1) << np.arange(self.width, dtype=np.uint64)])
        anchors = np.sort(self.home(near), axis=1)
        fresh = np.ones(anchors.shape, bool)
        fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
        rows, columns = np.nonzero(fresh)
        return rows, anchors[rows, columns]


def blocks_for(threshold: int) -> list[Block]:
    """Blocks such that fingerprints within ``threshold`` differ by one bit at most in one of them."""
    n = (threshold + 2) // 2
    edges = [BITS * i // n for i in range(n + 1)]
    return [Block(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def to_anchors(distinct: DataFrame, threshold: int) -> DataFrame:
    """(block, anchor, fp, home): where each fingerprint is at home or a guest."""
    fields = "block int, anchor long, fp long, home boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = blocks_for(threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, block in enumerate(blocks):
                values = block.values(fps)
                rows, anchors = block.reached(values)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), i, np.int32)), pa.array(anchors.view(np.int64)),
                    pa.array(fps[rows].view(np.int64)), pa.array(anchors == block.home(values)[rows]),
                ], schema=schema_of(fields))

    return distinct.select("fp").mapInArrow(run, fields)


def forest(homes: np.ndarray, guests: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what homes and guests within the threshold connect."""
    if not len(homes) or len(guests) < 2:
        return guests[:0], guests[:0]
    nodes = np.unique(np.concatenate([homes, guests]))
    root = list(range(len(nodes)))
    at_guest = np.searchsorted(nodes, guests)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for start in range(0, len(homes), 256):
        part = homes[start:start + 256]
        near, other = np.nonzero(np.bitwise_count(part[:, None] ^ guests[None, :]) <= threshold)
        at_home = np.searchsorted(nodes, part)
        for x, y in zip(at_home[near].tolist(), at_guest[other].tolist()):
            if x != y and (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
    top = np.array([find(i) for i in range(len(nodes))], np.int64)
    linked = top != np.arange(len(nodes))
    return nodes[top[linked]], nodes[linked]


def _compare_cells(threshold: int):
    """A function over Arrow batches sorted by cell; a cell's rows are bounded, so they are gathered."""
    keys = ("block", "anchor", "home_slice", "guest_slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_fps, open_homes, last = [], [], None  # the cell that the next batch may continue
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home = batch.column("home").to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(fps))
            found = []
            if last is not None and last != tuple(c[0] for c in columns):
                found.append(forest(np.concatenate(open_homes), np.concatenate(open_fps), threshold))
                open_fps, open_homes = [], []
            open_fps.append(fps[:ends[0]])
            open_homes.append(fps[:ends[0]][home[:ends[0]]])
            if len(starts) > 1:
                found.append(forest(np.concatenate(open_homes), np.concatenate(open_fps), threshold))
                # Most cells have one row, or no home, and need no comparison.
                worth = (ends - starts > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
                for i in (np.flatnonzero(worth[1:-1]) + 1).tolist():
                    part = fps[starts[i]:ends[i]]
                    found.append(forest(part[home[starts[i]:ends[i]]], part, threshold))
                open_fps = [fps[starts[-1]:]]
                open_homes = [open_fps[0][home[starts[-1]:]]]
            last = tuple(c[-1] for c in columns)
            if found := [x for x in found if len(x[0])]:
                yield links(found)
        if open_fps and len((x := forest(np.concatenate(open_homes), np.concatenate(open_fps), threshold))[0]):
            yield links([x])

    def links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema_of("a long, b long"))

    return run


def near_links(distinct: DataFrame, threshold: int = 3, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect what pairs within ``threshold`` bits connect.

    ``distinct`` holds different fingerprints in ``fp``.
    """
    placed = to_anchors(distinct, threshold)
    full = materialize(
        placed.groupBy("block", "anchor").agg(F.count("*").alias("guests"), F.count_if("home").alias("homes"))
        .filter((F.col("guests") > cell) & (F.col("homes") > 0))
        .select("block", "anchor", F.ceil(F.col("guests") / cell).cast("int").alias("guest_slices"),
                F.ceil(F.col("homes") / cell).cast("int").alias("home_slices")),
        "full-anchors")
    # Guests of one slice meet the homes of every slice, and homes the guests of every slice.
    own = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n).cast("int")
    sliced = placed.join(full, ["block", "anchor"], "left").withColumns({
        "home_slices": F.coalesce("home_slices", F.lit(1)), "guest_slices": F.coalesce("guest_slices", F.lit(1))})
    guests = sliced.withColumn("guest_slice", own(F.col("guest_slices"), 1)).withColumn(
        "home_slice", F.explode(F.sequence(F.lit(0), F.col("home_slices") - 1))
    ).withColumn("home", F.col("home") & (F.col("home_slices") * F.col("guest_slices") == 1))
    homes = sliced.filter("home AND home_slices * guest_slices > 1").withColumn(
        "home_slice", own(F.col("home_slices"), 2)
    ).withColumn("guest_slice", F.explode(F.sequence(F.lit(0), F.col("guest_slices") - 1)))
    columns = ["block", "anchor", "home_slice", "guest_slice", "fp", "home"]
    cells = guests.select(columns).union(homes.select(columns))
    dealt = cells.repartition(*columns[:4]).sortWithinPartitions(*columns[:4])
    return dealt.mapInArrow(_compare_cells(threshold), "a long, b long").distinct()


def _classes(distinct: DataFrame, threshold: int, cell: int) -> DataFrame:
    """(fp, first_id, root): different fingerprints with the smallest fingerprint they reach."""
    return _rooted(distinct, "fp", near_links(distinct, threshold, cell))


def _rooted(distinct: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, first_id, root): the smallest key that links reach."""
    roots = components(links)
    return distinct.join(roots, distinct[key] == roots["node"], "left").select(
        key, "first_id", F.coalesce("root", key).alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    threshold: int = 3, cell: int = CELL) -> DataFrame:
    """doc_id, fp, fingerprint and component_id for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``threshold`` bits reach.
    """
    marked = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    rooted = _classes(distinct, threshold, cell)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(ids, "root").select("fp", "component_id"), "fingerprint-classes")
    return marked.join(classes, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    threshold: int = 3, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``near_duplicates`` groups them.

    Groups and the rows to keep are found on (id, hash of the row, fingerprint); each text is read once for
    its fingerprint and moved once, to meet the list of rows to keep.
    """
    mark = next(name for n in range(len(docs.columns) + 1) if (name := f"__row{n}") not in docs.columns)

    @F.arrow_udf("bigint")
    def print_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    place = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(*docs.columns).alias("row"))
    narrow = materialize(docs.select(place.alias("place"), print_of(F.col(text)).alias("fp")), "fingerprints")
    # Copies are combined where they are, so a group of any size is one row from here on.
    distinct = materialize(narrow.groupBy("fp").agg(F.min("place").alias("first_id")), "distinct-fingerprints")
    best = _classes(distinct, threshold, cell).groupBy("root").agg(F.min("first_id").alias("best"))
    keep = materialize(best.select(F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "kept")
    marked = docs.withColumn(mark, F.xxhash64(*docs.columns))
    kept = marked.join(keep, marked[doc_id].eqNullSafe(keep["keep_id"]) & (marked[mark] == keep["keep_row"]), "left_semi")
    return kept.dropDuplicates([doc_id, mark]).drop(mark)
