"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's pattern, and each pre-token is merged on its own. Its
bytes form a linked list. Every neighbouring pair that the vocabulary holds stands in the bucket of its
rank, by the position of its first part. Two levels of bitmaps over the ranks tell which buckets hold
something: a find-first-set in each gives the lowest rank, and the bucket its leftmost position. A merge relinks three nodes and puts at most two new pairs
into their buckets; pairs that it breaks stay where they are and are skipped when their turn comes. So a
pre-token of n bytes costs some n log n steps, however long it is, where a search for the best pair after
each merge would cost n squared.

A rank is a token's id, and the lowest rank goes first, the leftmost of equal ones; a pre-token that is a
token as a whole is taken as it is. Pre-tokens of up to ``CACHED_BYTES`` bytes are remembered, in two
generations of ``CACHED`` in a worker; that changes the time only. They are remembered as packed ids, so that
a text's ids are its pre-tokens' bytes joined, without a step of the interpreter for each.

Nulls: a null text has no tokens, as an empty one; null ids decode to no bytes. Ids that the vocabulary
lacks, or a null among them, make the decoded bytes null. Repeated rows give a row each, an empty table an
empty one. All other columns are passed on; a column named like the result is replaced.
"""

from __future__ import annotations

import base64
import importlib.util
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Bits of a bitmap word; two levels of them hold 65,536 ranks.
SHIFT = 8
WORD = 1 << SHIFT
BIT = [1 << i for i in range(WORD)]
#: Pre-tokens that a worker remembers in each of two generations, and the longest of them.
CACHED, CACHED_BYTES = 1 << 18, 64
#: Texts whose ids a task hands over at a time.
ROWS = 256
FOLLOWING, PRECEDING = list(range(1, CACHED_BYTES + 1)), list(range(-1, CACHED_BYTES - 1))


def default_vocabulary() -> str:
    """Where the installed public vocabulary for many languages lies."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_multi_50k.tiktoken")


def read_vocabulary(path: str | None = None) -> bytes:
    """A rank file's lines, base64 of a token and its rank; read once, on the driver."""
    return Path(path or default_vocabulary()).read_bytes()


class RankQueue:
    """Buckets of positions by rank, heaps each, and bitmaps of those that hold something.

    ``words`` has a bit per bucket. A third part, a bit per word that is not zero, belongs to the pre-token
    that is being merged: everything here is empty between pre-tokens, so that nothing is set up for a new
    one. ``Codec.merge`` works on the parts directly, as a call per step would cost as much as the step.
    """

    def __init__(self, ranks: int):
        if ranks > WORD * WORD:
            raise ValueError(f"two levels hold {WORD * WORD} ranks")
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * -(-ranks // WORD)


class Recent(dict[str, bytes]):
    """Packed ids by pre-token; ``find`` gives those of one that is not here."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, part: str) -> bytes:
        return self.find(part)


class Codec:
    """Encoding and decoding by one vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex

        lines = (line.split() for line in vocabulary.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.column = pa.array([self.tokens.get(rank) for rank in range(max(self.tokens) + 1)], pa.binary())
        self.queue = RankQueue(max(self.tokens) + 1)
        self.split = regex.compile(pattern).findall
        self.single = [self.ranks.get(bytes([value])) for value in range(256)]
        if None in self.single:
            raise ValueError("the vocabulary lacks single bytes")
        #: Rank of two bytes, or -1.
        self.couple = [[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.recent = Recent(self.remembered)
        self.before: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n, rank_of, single, couple = len(piece), ranks.get, self.single, self.couple
        buckets, words, top = self.queue.buckets, self.queue.words, 0
        # Short pre-tokens take their places from prepared lists.
        following = FOLLOWING[:n] if n <= CACHED_BYTES else list(range(1, n + 1))
        preceding = PRECEDING[:n] if n <= CACHED_BYTES else list(range(-1, n - 1))
        tokens = [single[value] for value in piece]
        # Rank of the pair that begins here; -1 where there is none.
        pair = [couple[a][b] for a, b in zip(piece, piece[1:])]
        for at, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    top |= BIT[rank >> SHIFT]
                    words[rank >> SHIFT] |= BIT[rank & WORD - 1]
                bucket.append(at)  # positions rise, so it is a heap
        pair.append(-1)
        while top:
            # The lowest rank, by a find-first-set in each level, and its leftmost position.
            word = (top & -top).bit_length() - 1
            bits = words[word]
            lowest = bits & -bits
            rank = word << SHIFT | lowest.bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                words[word] = bits = bits ^ lowest
                if not bits:
                    top &= top - 1
            if pair[at] != rank:
                continue  # stale: one of its parts went into another pair
            gone = following[at]
            following[at] = end = following[gone]
            tokens[at], pair[gone], pair[at] = rank, -1, -1
            if end < n:
                preceding[end] = at
                pair[at] = made = rank_of(piece[at:following[end]], -1)
                if made >= 0:
                    bucket = buckets[made]
                    if not bucket:
                        top |= BIT[made >> SHIFT]
                        words[made >> SHIFT] |= BIT[made & WORD - 1]
                    heappush(bucket, at)
            if at:
                left = preceding[at]
                pair[left] = made = rank_of(piece[left:end], -1)
                if made >= 0:
                    bucket = buckets[made]
                    if not bucket:
                        top |= BIT[made >> SHIFT]
                        words[made >> SHIFT] |= BIT[made & WORD - 1]
                    heappush(bucket, left)
        ids, at = [], 0
        while at < n:
            ids.append(tokens[at])
            at = following[at]
        return tuple(ids)

    def remembered(self, part: str) -> bytes:
        """Packed ids of a pre-token that is not among the recent ones."""
        ids = self.before.get(part)
        if ids is None:
            piece = part.encode("utf-8", "surrogatepass")
            ids = array("i", self.merge(piece)).tobytes()
            if len(piece) > CACHED_BYTES:
                return ids
        if len(self.recent) >= CACHED:
            self.before = dict(self.recent)
            self.recent.clear()  # the same dict goes on, as a text that is being encoded reads it
        self.recent[part] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, four bytes each."""
        return b"".join(map(self.recent.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        coded = [self.packed(text) for text in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, coded)], dtype=np.int64) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))

    def decode_all(self, coded: pa.ListArray) -> pa.BinaryArray:
        """Bytes of each list of ``encode_all``: tokens are taken one after the other, and the lists' ends part them."""
        _, ends, data = self.column.take(coded.values).buffers()
        ends = np.frombuffer(ends, np.int32)[coded.offsets.to_numpy()]
        return pa.BinaryArray.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer(ends), data])

    def decode(self, ids: Iterable[int] | None) -> bytes | None:
        try:
            return b"".join(map(self.tokens.__getitem__, ids)) if ids is not None else b""
        except KeyError:
            return None


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One per vocabulary and Python worker."""
    return Codec(vocabulary, pattern)


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        return public_tokenizers.PATTERN
    return pattern


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text``, an array of int, in ``into``.

    The vocabulary, of some 50,000 tokens or 1 MB, travels with the tasks' code, so executors need no
    file of it.
    """
    data, cut = read_vocabulary(vocabulary), _pattern(pattern)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return codec(data, cut).encode_all(texts)

    return docs.withColumn(into, run(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in ``into``."""
    data = read_vocabulary(vocabulary)

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        own = codec(data, "")
        return pa.array([own.decode(value.as_py()) for value in column], pa.binary())

    return df.withColumn(into, run(F.col(ids).cast("array<int>")))


def round_trip(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and the bytes they ``decoded`` to, both from one pass of a task over its texts.

    As two functions one after the other, Spark would encode a text for the ids and again for the bytes.
    Rows leave a task ``ROWS`` at a time, so that it holds the ids of few texts.
    """
    data, cut = read_vocabulary(vocabulary), _pattern(pattern)
    rest = [f for f in docs.schema if f.name not in ("ids", "decoded")]
    name = "_" * (1 + max((len(f.name) for f in rest), default=0))  # longer than any, so no column's
    texts = docs.select(F.col(text).alias(name), *[F.col(f"`{f.name}`") for f in rest])
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                coded = own.encode_all(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], coded, own.decode_all(coded)], names=schema.names)

    return texts.mapInArrow(run, schema)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    coded = round_trip(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
