"""Leave-one-out perplexity under modified Kneser-Ney word bigrams, one model per language.

The model has an entry for every different pair of words of a language, so it grows with the corpus and
never lies in one place. Texts are read once, in blocks of ``BLOCK`` bytes. A block's words become numbers
of its own word list, and that is written. The different pairs of a block, summed up, are dealt to ranges of
about ``ENTRIES`` pairs, the cells of a grid: the row by a hash of the first word, the column by one of the second.
So a word goes along to the cells of a row and of a column only, and a frequent one is still spread over
many. A range merges what all blocks sent into one sorted array of keys with
counts, and answers each block with the counts of its pairs. What a range learns about the words (how often
and with how many different followers each occurs as a context, after how many different words it comes)
is summed up in the same way by ranges of words, which answer the blocks too. A block then scores its
documents on its own; blocks are kept in buckets, so that only the answers are shuffled to them. A frequent pair is one entry per block, not one per occurrence.

The counts of a document and of its exact copies are taken off before it is scored, else a word that only
one text uses would look certain there. Discounts and the totals of a language are left as they are, one document changes
them little.

Words are what white space, full stops and commas part, in lower case; other signs and characters of
scripts without spaces are words of their own. A word is known by a hash of 32 bits within its language:
of ten million words about one in four hundred shares its hash with another.
"""

from __future__ import annotations

import math
import re
import secrets
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from framelake.llm.common import schema_of
from framelake.llm.transcripts import groups
from framelake.workspace import materialize, new_folder, setting

#: Bytes of text and documents of a block, and pairs or words of a range.
BLOCK, DOCS, ENTRIES = 1 << 25, 1 << 16, 1 << 22
#: Documents are scored in slices of about this many words.
SLICE = 1 << 18
#: Most bytes of rows that go to Python at once, but for a longer row: a row can be a whole block.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
_APART = re.compile("([^\\w\\s]|[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray, kind: str) -> bytes:
    """Whole numbers as compressed bytes, equal places together."""
    planes = np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).ravel(), 3)


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def words_of(text: str) -> list[str]:
    return _APART.sub(r" \1 ", text.lower().replace(".", " ").replace(",", " ")).split()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)), keys.dtype.str)


def unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_pairs(keys: np.ndarray) -> bytes:
    """Sorted pairs of hashes as a sorted list of hashes and places in it."""
    left, right = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    words, at = np.unique(np.concatenate([left, right]).astype("<u4"), return_inverse=True)
    parts = [pack_sorted(words), pack_sorted(at[:len(keys)].astype("<u4")), pack(at[len(keys):], "<u4")]
    return struct.pack("<qq", len(parts[0]), len(parts[1])) + b"".join(parts)


def unpack_pairs(data: bytes) -> np.ndarray:
    first, second = struct.unpack_from("<qq", data)
    words = unpack_sorted(data[16:16 + first], "<u4").astype(np.uint64)
    left, right = unpack_sorted(data[16 + first:16 + first + second], "<u4"), unpack(data[16 + first + second:], "<u4")
    return words[left] << np.uint64(32) | words[right]


# Blocks of texts ---------------------------------------------------------------------------------

BLOCKS = ("block long, tokens long, distinct long, ids array<bigint>, measures array<bigint>, doc_langs array<int>, "
          "lengths array<bigint>, texts array<bigint>, langs array<string>, vocabulary binary, word_langs binary, words binary")


#: Whole numbers that are read off a text on the way, the same many of each.
Measure = Callable[[str | None], tuple[int, ...]]


class Block:
    """Texts as numbers of a word list; the first word of a language is the start of a text."""

    def __init__(self):
        self.bytes, self.langs, self.seeds, self.known = 0, {}, [], []
        self.hashes, self.hash_langs, self.words = array("I"), array("I"), array("I")
        self.ids, self.measures, self.doc_langs, self.lengths, self.texts = [], [], [], [], []

    def _word(self, lang: int, word: str) -> int:
        if (at := self.known[lang].get(word)) is None:
            at = self.known[lang][word] = len(self.hashes)
            self.hashes.append(xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), self.seeds[lang]))
            self.hash_langs.append(lang)
        return at

    def add(self, doc_id: int | None, lang: str | None, text: str, measures: tuple[int, ...]) -> None:
        if (k := self.langs.get(lang)) is None:
            k = self.langs[lang] = len(self.langs)
            self.seeds.append(0 if lang is None else xxhash.xxh32_intdigest(lang.encode(), 1))
            self.known.append({})
            self._word(k, "")
        words = words_of(text)
        found = list(map(self.known[k].get, words))
        if None in found:
            found = [self._word(k, word) if at is None else at for at, word in zip(found, words)]
        self.ids.append(doc_id)
        self.measures += measures
        self.doc_langs.append(k)
        self.words.extend(found)
        self.lengths.append(len(found))
        self.texts += struct.unpack("<qq", xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"), self.seeds[k]))
        self.bytes += len(text)

    def row(self) -> pa.RecordBatch:
        """The block as a row; no text can be added then."""
        self.known.clear()
        words, hashes, langs = (np.frombuffer(x, np.uint32) for x in (self.words, self.hashes, self.hash_langs))
        _, first, at = np.unique(langs.astype(np.uint64) << np.uint64(32) | hashes, return_index=True, return_inverse=True)
        if len(first) < len(hashes):  # words of the same hash are one, in the place of the first
            places = np.sort(first)
            words = np.searchsorted(places, first).astype(np.uint32)[at][words]
            hashes, langs = hashes[places], langs[places]
        columns = [
            [secrets.randbits(62)], [len(words)], [len(hashes)], [self.ids], [self.measures], [self.doc_langs],
            [self.lengths], [self.texts], [list(self.langs)], [pack(hashes, "<u4")], [pack(langs, "<u4")], [pack(words, "<u4")]]
        schema = schema_of(BLOCKS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Pairs:
    """Word pairs of a written block; the numbers of a pair's words lie in one whole number."""

    def __init__(self, row: dict):
        self.langs = row["langs"]
        self.hashes = unpack(row["vocabulary"], "<u4")
        self.word_langs = unpack(row["word_langs"], "<u4").astype(np.int32)
        lengths = np.array(row["lengths"], np.int64)
        self.lengths, self.ends = lengths, np.cumsum(lengths)
        self.words = unpack(row["words"], "<u4")
        _, first = np.unique(self.word_langs, return_index=True)  # a language's first word starts its texts
        self.begins = (self.ends - lengths)[lengths > 0]
        self.starts = first[np.array(row["doc_langs"], np.int64)[lengths > 0]]
        both = self._both(0, len(self.words))
        both.sort()  # in place, as a block's words are many
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else [])
        self.different = both[first]
        del both
        self.counts = np.diff(first, append=len(self.words)).astype(np.uint32)

    def keys_of(self, part: np.ndarray | slice) -> np.ndarray:
        left, right = halves(self.different[part])
        keys = self.hashes[left].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= self.hashes[right]
        return keys

    @property
    def keys(self) -> np.ndarray:
        return self.keys_of(slice(None))

    def _both(self, start: int, end: int) -> np.ndarray:
        both = np.empty(end - start, np.int64)
        both[:1] = self.words[max(start - 1, 0):max(start, 1)][:len(both)]
        both[1:] = self.words[start:max(end - 1, start)]
        texts = slice(*np.searchsorted(self.begins, (start, end)))
        both[self.begins[texts] - start] = self.starts[texts]
        both <<= 32
        both |= self.words[start:end]
        return both

    def places(self, start: int, end: int) -> np.ndarray:
        """Where the pairs that end at these words stand among the different ones."""
        both = self._both(start, end)
        order = np.argsort(both)  # looked up in order, neighbours lie close in memory
        found = np.empty(len(both), np.int64)
        found[order] = np.searchsorted(self.different, both[order])
        return found

    def dealt(self, ranges: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(range, language, pairs in order of their keys); as many ranges or a few more, to fill a grid."""
        rows = math.isqrt(ranges)
        columns = -(-ranges // rows)
        cells = (slot_of(self.hashes, rows) * columns).astype(np.int32)[self.different >> 32]
        cells += slot_of(self.hashes, columns).astype(np.int32)[self.different & 0xFFFFFFFF]
        ends = np.cumsum(np.bincount(cells, minlength=rows * columns))
        order = np.argsort(cells).astype(np.uint32)
        del cells
        for cell, end in enumerate(ends.tolist()):  # one at a time is put in the order of its keys
            pairs = order[ends[cell - 1] if cell else 0:end]
            langs = self.word_langs[halves(self.different[pairs])[1]]
            for _, lang, part in _parts(np.zeros(len(pairs), np.int8), langs, self.keys_of(pairs)):
                yield cell, lang, pairs[part]

    def dealt_words(self, ranges: int) -> Iterator[tuple[int, int, np.ndarray]]:
        return _parts(slot_of(self.hashes, ranges), self.word_langs, self.hashes)


def halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the first and of the second words."""
    return pairs >> 32, pairs & 0xFFFFFFFF


def slot_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) * _MIX) >> np.uint64(32)).astype(np.int64) % ranges


def _parts(ranges: np.ndarray, langs: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    if not len(keys):
        return
    order = np.lexsort((keys, langs, ranges))
    ends = np.flatnonzero((np.diff(ranges[order]) != 0) | (np.diff(langs[order]) != 0)) + 1
    for part in np.split(order, ends):
        yield int(ranges[part[0]]), int(langs[part[0]]), part


def blocks_of(docs: DataFrame, measure: Measure, size: int = BLOCK, text: str = "text", lang: str = "lang",
              doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """The blocks of all texts, in buckets of a table, and its name; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for i in range(batch.num_rows):
                number, name, whole = (batch.column(k)[i].as_py() for k in range(3))
                block.add(number, name, whole or "", measure(whole))
                if block.bytes >= size or len(block.ids) >= DOCS:
                    yield block.row()
                    block = Block()
        if block.ids:
            yield block.row()

    rows = docs.select(F.col(doc_id).cast("long"), F.col(lang).cast("string"), F.col(text).cast("string"))
    spark = docs.sparkSession
    name, buckets = f"ngram_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, BATCH):
        rows.mapInArrow(run, BLOCKS).write.option("path", new_folder(spark, "ngram-blocks")).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name), name


# Ranges of pairs and words -----------------------------------------------------------------------

SENT = "range long, lang string, block long, keys binary, counts binary"
#: From a range of pairs: answers to blocks (kind 1), statistics of words (2), counts of counts (3).
LEARNT = "kind int, range long, lang string, block long, keys binary, counts binary, sums array<bigint>"
_STATS = 5  # of a word: occurrences as context, its followers with counts 1, 2, 3 or more, words before it


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = schema_of(ddl)
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _row_of(table: pa.Table | pa.RecordBatch, i: int) -> dict:
    return {name: table.column(name)[i].as_py() for name in table.schema.names}


def _send_pairs(blocks: DataFrame, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row_of(batch, i)
                pairs = Pairs(row)
                yield _rows(SENT, [(r, pairs.langs[k], row["block"], pack_pairs(pairs.keys_of(part)), pack(pairs.counts[part], "<u4"))
                                   for r, k, part in pairs.dealt(ranges)])

    return blocks.drop("ids", "measures", "texts").mapInArrow(run, SENT)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def word_statistics(keys: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order and their statistics, from different pairs and their counts."""
    left, right = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    words, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    stats = np.zeros((_STATS, len(words)), np.int64)
    stats[0] = np.bincount(at[:len(keys)], totals, len(words))
    for k in (1, 2, 3):
        stats[k] = np.bincount(at[:len(keys)], np.minimum(totals, 3) == k, len(words))
    stats[4] = np.bincount(at[len(keys):], minlength=len(words))
    return words, stats


def _merge_pairs(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ("range", "lang")):
            lang, number = table["lang"][0].as_py(), table["range"][0].as_py()
            sent = [unpack_pairs(x.as_py()) for x in table["keys"]]
            keys, at = np.unique(np.concatenate(sent), return_inverse=True)
            totals = np.bincount(at, np.concatenate([unpack(x.as_py(), "<u4") for x in table["counts"]]), len(keys)).astype(np.int64)
            ends = np.cumsum([len(x) for x in sent])
            out = [(1, number, lang, block, None, pack(totals[at[end - len(x):end]], "<u8"), None)
                   for block, x, end in zip(table["block"].to_pylist(), sent, ends)]
            words, stats = word_statistics(keys, totals)
            for slot, _, part in _parts(slot_of(words, slots), np.zeros(len(words), np.int64), words):
                out.append((2, slot, lang, None, pack_sorted(words[part]), pack(stats[:, part].ravel(), "<u8"), None))
            out.append((3, None, lang, None, None, None, counts_of_counts(totals)))
            yield _rows(LEARNT, out)

    return run


#: From a range of words: answers (kind 2) and the language's counts of counts, number of pairs and of words (4).
def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("range", "lang")):
        lang, number = table["lang"][0].as_py(), table["range"][0].as_py()
        known = [i for i, c in enumerate(table["counts"].is_valid().to_pylist()) if c]
        sent = [unpack_sorted(x.as_py(), "<u4") for x in table["keys"]]
        words, at = np.unique(np.concatenate(sent), return_inverse=True)
        ends = np.cumsum([len(x) for x in sent])
        places = [at[end - len(x):end] for x, end in zip(sent, ends)]
        stats = np.zeros((_STATS, len(words)), np.int64)
        for i in known:
            stats[:, places[i]] += unpack(table["counts"][i].as_py(), "<u8").reshape(_STATS, -1).astype(np.int64)
        blocks = table["block"].to_pylist()
        out = [(2, number, lang, blocks[i], None, pack(stats[:, places[i]].ravel(), "<u8"), None)
               for i in range(len(sent)) if blocks[i] is not None]
        after = stats[4]
        out.append((4, None, lang, None, None, None, [*counts_of_counts(after), int((after >= 3).sum()),
                                                      int(after.sum()), int((after > 0).sum())]))
        yield _rows(LEARNT, out)


COPIES = "block long, first long, second long, n long"


def _copies(blocks: DataFrame) -> DataFrame:
    """(block, copies): hashes and numbers of the texts that occur more than once; a text is one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(*(c.to_pylist() for c in batch.columns)):
                found, n = np.unique(np.array(texts, np.int64).reshape(-1, 2), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), pa.array(found[:, 0]),
                                                  pa.array(found[:, 1]), pa.array(n)], schema=schema_of(COPIES))

    counted = blocks.select("block", "texts").mapInArrow(run, COPIES) \
        .withColumn("all", F.sum("n").over(Window.partitionBy("first", "second"))).filter("all > 1")
    return counted.groupBy("block").agg(F.flatten(F.collect_list(F.array("first", "second", "all"))).alias("sums"))


def _send_words(blocks: DataFrame, slots: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, langs = (unpack(batch.column(c)[i].as_py(), "<u4") for c in (1, 2))
                names = batch.column(3)[i].as_py()
                yield _rows(SENT, [(slot, names[k], batch.column(0)[i].as_py(), pack_sorted(hashes[part]), None)
                                   for slot, k, part in _parts(slot_of(hashes, slots), langs.astype(np.int64), hashes)])

    return blocks.select("block", "vocabulary", "word_langs", "langs").mapInArrow(run, SENT)


# Scores ------------------------------------------------------------------------------------------

def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many entries have counts 1, 2, 3 and 4."""
    if min(n[:3]) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])  # too few entries to estimate from
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.01), k) for d, k in zip(found, (1, 2, 3)))])


def scores(pairs: Pairs, totals: np.ndarray, stats: np.ndarray, sums: dict[int, tuple[list[int], list[int]]],
           copies: np.ndarray, at_once: int = SLICE) -> np.ndarray:
    """Mean negative log-probability a word of each document; NaN for documents without words.

    ``totals`` are the pairs' counts, ``stats`` the words' statistics, ``sums`` of each language the counts
    of counts of pairs and what a range of words tells, ``copies`` how often each document's text occurs.
    """
    low, high = np.zeros((len(pairs.langs), 4)), np.zeros((len(pairs.langs), 4))
    rest, whole, kinds = (np.ones(len(pairs.langs)) for _ in range(3))
    for k, (of_pairs, of_words) in sums.items():
        high[k], low[k] = discounts(of_pairs), discounts(of_words[:4])
        rest[k] = low[k][1:] @ np.array([of_words[0], of_words[1], of_words[4]])
        whole[k], kinds[k] = of_words[5], of_words[6] + 1
    size, vocabulary = len(totals), len(pairs.hashes)
    lost = np.zeros(len(pairs.lengths))
    start = 0
    while start < len(pairs.words):  # a slice ends with a document
        end = int(pairs.ends[np.searchsorted(pairs.ends, min(start + at_once, len(pairs.words)))])
        within = slice(np.searchsorted(pairs.ends, start, side="right"), np.searchsorted(pairs.ends, end, side="right"))
        docs = np.repeat(np.arange(within.start, within.stop), pairs.lengths[within])
        own, times = np.unique(docs * size + pairs.places(start, end), return_counts=True)
        doc, pair = own // size, own % size
        start = end
        (left, right), total = halves(pairs.different[pair]), totals[pair]
        taken = times * copies[doc]
        count = total - taken

        at = np.cumsum(np.diff(doc * vocabulary + left, prepend=0) != 0)  # pairs are in order of their first word
        context = stats[0][left] - np.bincount(at, taken)[at].astype(np.int64)
        followers = []
        for k in (1, 2, 3):
            change = (np.minimum(count, 3) == k).astype(np.int64) - (np.minimum(total, 3) == k)
            followers.append(stats[k][left] + np.bincount(at, change)[at].astype(np.int64))
        _, at = np.unique(doc * vocabulary + right, return_inverse=True)
        after = stats[4][right] - np.bincount(at, count == 0)[at].astype(np.int64)

        lang = pairs.word_langs[right]
        lower = (np.maximum(after - low[lang, np.minimum(after, 3)], 0) + rest[lang] / kinds[lang]) / whole[lang]
        held = sum(high[lang, k] * followers[k - 1] for k in (1, 2, 3))
        kept = np.maximum(count - high[lang, np.minimum(count, 3)], 0)
        probability = np.where(context > 0, (kept + held * lower) / np.maximum(context, 1), lower)
        lost += np.bincount(doc, -np.log(probability) * times, len(lost))
    return np.where(pairs.lengths > 0, lost / np.maximum(pairs.lengths, 1), np.nan)


SCORES = "id long, lang string, measures array<bigint>, score double"


def _score(ranges: int, slots: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (_row_of(batch, i) for batch in batches for i in range(batch.num_rows)):
            pairs = Pairs(row)
            told = {(x["kind"], x["range"], x["lang"]): x["sums"] if x["kind"] > 2 else x["counts"] for x in row["told"] or []}
            totals, stats = np.zeros(len(pairs.different), np.int64), np.zeros((_STATS, len(pairs.hashes)), np.int64)
            for r, k, part in pairs.dealt(ranges):
                totals[part] = unpack(told[1, r, pairs.langs[k]], "<u8")
            for s, k, part in pairs.dealt_words(slots):
                stats[:, part] = unpack(told[2, s, pairs.langs[k]], "<u8").reshape(_STATS, -1)
            sums = {k: (told[3, None, lang], told[4, None, lang]) for k, lang in enumerate(pairs.langs)
                    if (3, None, lang) in told}
            known = dict(zip(zip(of[0::3], of[1::3]), of[2::3])) if (of := told.get((5, None, None))) else {}
            copies = np.array([known.get(t, 1) for t in zip(row["texts"][0::2], row["texts"][1::2])], np.int64)
            found = scores(pairs, totals, stats, sums, copies, at_once) if len(totals) else np.full(len(pairs.lengths), np.nan)
            measures = np.array(row["measures"], np.int64).reshape(len(found), -1).tolist()
            yield _rows(SCORES, [(i, pairs.langs[k], m, None if np.isnan(x) else float(x))
                                 for i, k, m, x in zip(row["ids"], row["doc_langs"], measures, found)])

    return run


def _dealt(df: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def perplexity(docs: DataFrame, measure: Measure = lambda text: (), block: int = BLOCK, entries: int = ENTRIES,
               at_once: int = SLICE, **columns) -> DataFrame:
    """(id, lang, measures, score) of every row, written; a text without words scores null."""
    blocks, name = blocks_of(docs, measure, block, **columns)
    with setting(docs.sparkSession, BATCH):
        found = _scored(blocks, entries, at_once)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the entry only, the files lie in the run's folder
    return found


def _scored(blocks: DataFrame, entries: int, at_once: int) -> DataFrame:
    size = blocks.agg(F.sum("tokens"), F.sum("distinct")).first()
    ranges, slots = (-(-(n or 1) // entries) or 1 for n in size)
    learnt = materialize(_dealt(_send_pairs(blocks, ranges), "range", "lang").mapInArrow(_merge_pairs(slots), LEARNT), "ngram-counts", tidy=True)
    statistics = learnt.filter("kind = 2").select("range", "lang", "block", "keys", "counts")
    told = materialize(_dealt(_send_words(blocks, slots).unionByName(statistics), "range", "lang").mapInArrow(_merge_words, LEARNT), "ngram-words", tidy=True)

    parts = learnt.filter("kind = 3").unionByName(told.filter("kind = 4"))
    sums = parts.groupBy("kind", F.col("lang").alias("of")).agg(
        F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(7))).alias("sums"))
    members = blocks.select("block", F.explode("langs").alias("lang"))
    totals = members.join(sums, F.col("lang").eqNullSafe(F.col("of"))).select("kind", "block", "lang", "sums")
    answers = learnt.filter("kind = 1").unionByName(told.filter("kind = 2")).select("kind", "range", "block", "lang", "counts")
    every = answers.unionByName(totals, allowMissingColumns=True) \
        .unionByName(_copies(blocks).withColumn("kind", F.lit(5)), allowMissingColumns=True)
    told_all = every.groupBy("block").agg(F.collect_list(F.struct("kind", "range", "lang", "counts", "sums")).alias("told"))
    return materialize(blocks.join(told_all, "block", "left").mapInArrow(_score(ranges, slots, at_once), SCORES), "perplexity", tidy=True)
