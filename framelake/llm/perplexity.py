"""Quality rules: base counts of each text, and perplexity bands of a model of each language.

The model, modified Kneser-Ney over word pairs, is that of ``kneser_ney``; a document's score is its mean
negative log-probability a word, without its own counts. Each language has a band around
the median of its documents: ``WIDTH`` robust deviations to either side for long texts, and more for
short ones, whose means vary more, by the factor ``sqrt(1 + SHORT / words)``. Documents outside are
rejected. Medians are taken from an exact histogram of scores on a fixed grid, over all documents.

Nulls: a null text has no words, null scores and fails the base rule. A null language is a language
of its own. Repeated rows count each. An empty table gives an empty result. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from framelake.llm import kneser_ney
from framelake.workspace import materialize

#: Grid of the score histogram, in nats per word; width of the band in robust deviations, the number of
#: words at which it is wider by the root of two, and the least deviation as a share of the median.
GRID, WIDTH, SHORT, LEAST_SPREAD = 0.001, 5.0, 40.0, 0.01


# Base rules of one text ------------------------------------------------------------------------

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WINDOW)], np.uint64)


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside windows of eight that the text has twice or more, the first ones included."""
    n = len(tokens) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        windows += hashes[i:i + n] * factor
    ordered = np.sort(windows)  # much faster than their order, which few texts need
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    # Equal hashes are candidates; the words decide.
    twice, first = np.zeros(n, bool), {}
    for i in sorted({*order[1:][equal].tolist(), *order[:-1][equal].tolist()}):
        key = tuple(tokens[i:i + WINDOW])
        if (j := first.setdefault(key, i)) != i:
            twice[i] = twice[j] = True
    steps = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(twice), 1)
    np.add.at(steps, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return again


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens = text.encode("utf-8", "surrogatepass").split()
    white = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(tokens), len(text) - white, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(tokens)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_documents(docs: DataFrame, **columns) -> DataFrame:
    """Per row: doc_id, lang, base counts, and the mean negative log-probability of its words."""
    scored = kneser_ney.perplexity(docs, base_counts, **columns)
    return scored.select(F.col("id").alias(columns.get("doc_id", "doc_id")), "lang",
                         *(F.get("measures", F.lit(k)).alias(name) for k, name in enumerate(COUNTS)), "score")


def bands(scores: DataFrame) -> DataFrame:
    """(lang, median, deviation) from all scores.

    The deviation is 1.4826 times the median distance from the median, at least ``LEAST_SPREAD`` of
    the median. Both come from counts per grid cell, of which a language has no more than the grid,
    as scores are at most ``-log`` of the smallest probability.
    """
    cells = scores.filter("score IS NOT NULL").select("lang", F.round(F.col("score") / GRID).cast("long").alias("cell"))
    counts = materialize(cells.groupBy("lang", "cell").agg(F.count("*").alias("n")), "score-cells")

    def median(of: DataFrame) -> DataFrame:  # one row a language, written so that later joins see its size
        up = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("lang")
        found = of.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(every)) \
            .filter(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg((F.min("cell") * GRID).alias("median"))
        return materialize(found, "medians")

    middle = median(counts)
    away = counts.alias("c").join(middle.alias("m"), F.col("c.lang").eqNullSafe(F.col("m.lang"))).select(
        "c.lang", "n", F.abs(F.col("cell") - F.round(F.col("median") / GRID)).cast("long").alias("cell"))
    spread = median(away.groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    return middle.alias("m").join(spread.alias("s"), F.col("m.lang").eqNullSafe(F.col("s.lang"))).select(
        F.col("m.lang").alias("lang"), F.col("m.median").alias("median"),
        F.greatest(1.4826 * F.col("s.median"), LEAST_SPREAD * F.col("m.median")).alias("deviation"))


def quality_rules(docs: DataFrame, width: float = WIDTH, **columns) -> DataFrame:
    """Base counts, base verdict, score, band and the final verdict of every row."""
    scored = score_documents(docs, **columns)
    limits = materialize(bands(scored), "bands").select(F.col("lang").alias("band_lang"), "median", "deviation")
    half = width * F.col("deviation") * F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.coalesce(F.col("score").between(F.col("lower"), F.col("upper")), F.lit(False))
    # One row per language; sent to all tasks only if its size, known from the written table, allows.
    banded = scored.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    return banded.withColumns({"lower": F.col("median") - half, "upper": F.col("median") + half}) \
        .withColumns({"base_failed": failed, "kept": ~failed & inside}).drop("band_lang", "median", "deviation")
