"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences in lower case. Runs of ``match`` words that both
hold are the seeds: the hashes of all runs of a block of items lie in one sorted array, in which each
document looks up its own runs. For every item that shares a seed, the tiling repeatedly takes the
longest match of words not marked yet, marks it on both sides, and goes on until none of ``match``
words is left; matches are found and extended by rolling Karp-Rabin hashes and confirmed on the
words. The share of an item's words under tiles is its coverage, so passages in another order count
in full. Documents that cover an item by ``coverage`` or more are contaminated.

Items are the query set. Their different texts come in blocks of about ``block_words`` words, chosen
by hash, and each block meets all documents in one pass, so that a task holds one block however large
the benchmark is and however often it repeats a text; the ids of the items are joined to what is found. An item with fewer than ``match`` words, which any text may
hold by chance, counts only where it is the document's whole text.

Nulls: null texts have no words; such documents match nothing and such items are left out. Repeated
documents give a row each; repeated items too. Of tiles of equal length the first in the document
wins, then the first in the item. Empty tables give an empty result. Texts are compared whole; a
column of the input is replaced where it bears an output name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelake.llm.common import folded_words, schema_of, word_count
from framelake.workspace import materialize

MATCH, COVERAGE, BLOCK_WORDS = 8, 0.5, 4_000_000
_BASE = 0x9E3779B97F4A7C15


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``n`` word ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    base = np.uint64(_BASE)
    for i in range(n):
        out = out * base + ids[i:len(ids) - n + 1 + i]
    return out


def word_ids(tokens: list[bytes]) -> np.ndarray:
    """Word hashes; Python's own are stable within a process, which is all that is needed."""
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


def tile(doc: list[bytes], item: list[bytes], match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length), in the order of marking."""
    match = min(match, len(item))
    if not match:
        return []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    doc_ids, item_ids = word_ids(doc), word_ids(item)
    tiles = []
    at: dict[int, list[int]] = {}
    for j, h in enumerate(run_hashes(item_ids, match).tolist()):
        at.setdefault(h, []).append(j)
    hashes = run_hashes(doc_ids, match)
    hits = np.flatnonzero(np.isin(hashes, np.fromiter(at, np.uint64, len(at))))
    seeds = [(i, at[h]) for i, h in zip(hits.tolist(), hashes[hits].tolist())]
    while seeds:
        best: list[tuple[int, int, int]] = []
        longest = match - 1
        for i, places in seeds:
            if not free_doc[i:i + match].all():
                continue
            for j in places:
                # Part of a longer match that began one word earlier.
                if i and j and free_doc[i - 1] and free_item[j - 1] and doc[i - 1] == item[j - 1]:
                    continue
                n, most = 0, min(len(doc) - i, len(item) - j)
                while n < most and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > longest:
                    best, longest = [(i, j, n)], n
                elif n == longest and n >= match:
                    best.append((i, j, n))
        if not best:
            return tiles
        for i, j, n in best:
            if free_doc[i:i + n].all() and free_item[j:j + n].all():
                free_doc[i:i + n] = free_item[j:j + n] = False
                tiles.append((i, j, n))
        seeds = [(i, places) for i, places in seeds if free_doc[i:i + match].all()]
    return tiles


class SeedIndex:
    """Runs of a block of items as sorted hashes with the item and place of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], match: int):
        self.items, self.match = items, match
        self.lengths = np.array([len(t) for _, t in items], np.int64)
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        for k, (_, t) in enumerate(items):
            if len(t) < match:
                self.short.setdefault(tuple(t), []).append(k)
        own = [(k, run_hashes(word_ids(t), match)) for k, (_, t) in enumerate(items) if len(t) >= match]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in own)])
        item = np.repeat(np.array([k for k, _ in own], np.int64), [len(h) for _, h in own])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for _, h in own)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]

    def candidates(self, tokens: list[bytes], coverage: float) -> list[int]:
        """Items whose words under shared seeds reach ``coverage``: no tiling can cover more.

        All hits are sorted once by item and place, however many items share a seed.
        """
        found = list(self.short.get(tuple(tokens), ())) if len(tokens) < self.match else []
        own = np.unique(run_hashes(word_ids(tokens), self.match))
        low = np.searchsorted(self.hashes, own, "left")
        counts = np.searchsorted(self.hashes, own, "right") - low
        low, counts = low[counts > 0], counts[counts > 0]
        if not len(low):
            return found
        at = np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        item, place = self.item[at], self.place[at]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        # Words that a run adds: up to where the next run of its item begins.
        added = np.full(len(item), self.match, np.int64)
        together = item[1:] == item[:-1]
        added[:-1][together] = np.minimum(self.match, place[1:][together] - place[:-1][together])
        first = np.flatnonzero(np.concatenate([[True], ~together]))
        covered, which = np.add.reduceat(added, first), item[first]
        return found + which[covered >= coverage * self.lengths[which]].tolist()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", match: int = MATCH,
                 coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, tiles, covered, coverage, longest per document and item that reach ``coverage``."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.sha2(item_text, 256).alias("item"))
    texts, blocks = _different_texts(benchmark, item_text, block_words)
    found = None
    for k in range(blocks):
        block = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        rows = [(r.item, t) for r in block if (t := folded_words(r.text))]
        part = _against_block(docs.select(doc_id, text), rows, match, coverage)
        if blocks > 1:
            part = materialize(part, "tiles")  # one block in memory at a time
        found = part if found is None else found.union(part)
    return found.join(items, "item").select("doc_id", "item_id", "tiles", "covered", "coverage", "longest")


def _different_texts(benchmark: DataFrame, item_text: str, block_words: int) -> tuple[DataFrame, int]:
    """(text, item) per different text of the items, item being its digest; and the number of blocks."""
    texts = materialize(benchmark.select(F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
                        .withColumn("item", F.sha2("text", 256)), "item-texts")
    total = texts.agg(F.coalesce(F.sum(word_count("text")), F.lit(0))).first()[0]
    return texts, max(1, math.ceil(total / block_words))


def _against_block(docs: DataFrame, rows: list[tuple[str, list[bytes]]], match: int, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    fields = "doc_id long, item string, tiles long, covered long, coverage double, longest long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        index = SeedIndex(items, match)
        for batch in batches:
            out = []
            for id_, value in zip(batch.column(0), batch.column(1)):
                tokens = folded_words(value.as_py())
                for k in index.candidates(tokens, coverage):
                    item, words = items[k]
                    tiles = tile(tokens, words, match)
                    covered = sum(n for _, _, n in tiles)
                    if covered >= coverage * len(words):
                        out.append((id_.as_py(), item, len(tiles), covered, covered / len(words),
                                    max(n for _, _, n in tiles)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema_of(fields))], schema=schema_of(fields))

    return docs.mapInArrow(run, fields)


def is_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", flag: str = "contaminated",
                    item_text: str = "text", **settings) -> DataFrame:
    """``docs`` with a flag per row, by the same tiling; needs no key and moves no rows.

    Only for a benchmark of one block; with more, each block adds its flag in turn.
    """
    match, coverage = settings.get("match", MATCH), settings.get("coverage", COVERAGE)
    texts, blocks = _different_texts(benchmark, item_text, settings.get("block_words", BLOCK_WORDS))
    out = docs.withColumn(flag, F.lit(False))
    for k in range(blocks):
        block = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast([("", t) for r in block if (t := folded_words(r.text))])
        out = out.withColumn(flag, F.col(flag) | _flag(shared, match, coverage)(F.col(text)))
        if blocks > 1:
            out = materialize(out, "flagged")
    return out


def _flag(shared, match: int, coverage: float):
    index: list[SeedIndex] = []  # built once per Python worker and block

    @F.arrow_udf("boolean")
    def flag(texts: pa.Array) -> pa.Array:
        if not index:
            index.append(SeedIndex(shared.value, match))
        out = []
        for value in texts:
            tokens = folded_words(value.as_py())
            out.append(any(
                sum(n for _, _, n in tile(tokens, index[0].items[k][1], match)) >= coverage * len(index[0].items[k][1])
                for k in index[0].candidates(tokens, coverage)))
        return pa.array(out, pa.bool_())

    return flag
