"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings come in ordered grades. One weight vector over hashed text features gives a document's score
s, and ordered thresholds t1 < t2 < ... cut it: P(grade <= k) = 1 / (1 + exp(s - t(k+1))). All
grades share the weights, so a document has one scale, and the expected grade as well as the
probability of a high grade follow from it.

Features of a text, all taken from the whole of it: the set of its words without punctuation, hashed
to ``BUCKETS`` presence features; in the same buckets the beginnings that two, or three and more, of
its different words share, as compounds and inflections of a rated word seldom recur as they are; the
square roots of its byte frequencies, hashed by byte; the share of different words and the mean word
length.

The model is fitted on a sample of rated documents, of ``SAMPLE`` at most, those whose ids hash
lowest: the bound is a parameter, and what comes to the driver is the features of that sample. All
documents are scored.

Nulls: a null text is scored as an empty one; ratings with a null id or grade are left out, and a
document rated twice has its lowest grade. Repeated documents are scored each. Without ratings every
document has the highest grade. An empty table gives an empty result. Other columns are passed on;
those with the name of an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framelake.workspace import materialize

BUCKETS, BYTES = 1 << 18, 256
DIMENSIONS = BUCKETS + BYTES + 2
#: Most rated documents that a fit uses; least number of them that a word needs for a weight; penalty;
#: standard errors of a word's screen.
SAMPLE, SUPPORT, PENALTY, SCREEN = 10_000, 5, 0.0002, 3.5
PUNCTUATION = b".,;:!?\"'()[]{}|*#$%&<>"
#: Lengths in bytes of the beginnings that are counted.
BEGINNINGS = (4, 6, 8)


def shared_beginnings(different: set[bytes]) -> list[bytes]:
    """Beginnings of at least two different words, and again, marked apart, of at least three."""
    found = []
    for n in BEGINNINGS:
        for start, words in Counter([w[:n] for w in different if len(w) >= n]).items():
            if words > 1:
                found.append(start + b" 2")
                if words > 2:
                    found.append(start + b" 3")
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; indices do not repeat."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    tokens = raw.lower().translate(None, PUNCTUATION).split()
    different = set(tokens)
    named = [*different, *shared_beginnings(different)]  # no word holds a space, so the names differ
    hashed = np.unique(np.fromiter(map(xxhash.xxh32_intdigest, named), np.int64, len(named)) & (BUCKETS - 1))
    frequency = np.bincount(np.frombuffer(raw, np.uint8), minlength=BYTES) / max(len(raw), 1)
    seen = np.flatnonzero(frequency)
    n = max(len(tokens), 1)
    index = np.concatenate([hashed, BUCKETS + seen, [DIMENSIONS - 2, DIMENSIONS - 1]])
    value = np.concatenate([
        np.ones(len(hashed)), 4 * np.sqrt(frequency[seen]), [len(different) / n, sum(map(len, tokens)) / n / 8]])
    return index, value


@dataclass
class CumulativeLink:
    """Weights and ordered thresholds; ``len(thresholds) + 1`` grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        index, value = features(text)
        return float((self.weights[index] * value).sum())

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the last, one column each."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """The mean grade: the sum of P(grade > k)."""
        return (1 - self.at_most(scores)).sum(1)

    def tail(self, scores: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        return 1 - self.at_most(scores)[:, grade - 1] if grade > 0 else np.ones(len(scores))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = 300,
          penalty: float = PENALTY, support: int = SUPPORT, screen: float = SCREEN) -> CumulativeLink:
    """Penalised maximum likelihood by Adam over all rows; deterministic.

    ``penalty`` is the weight of the squared weights. Words of fewer than ``support`` rows, or whose
    rows' mean grade is within ``screen`` standard errors of that of all rows, get none.
    """
    if not len(rows):
        return CumulativeLink(np.zeros(DIMENSIONS, np.float32), np.full(levels - 1, -np.inf))
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row_of = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    # Words are screened by how far the mean grade of their rows lies from that of all rows, in
    # standard errors; the noise of thousands of ordinary words would drown the few that matter.
    often = np.bincount(index, minlength=DIMENSIONS)
    away = np.bincount(index, grades[row_of] - grades.mean(), DIMENSIONS)
    common = (often >= support) & (np.abs(away) >= screen * max(grades.std(), 1e-9) * np.sqrt(often))
    common[BUCKETS:] = True  # each row has features of this kind, so none is left empty
    kept = common[index]
    index, value, row_of = index[kept], value[kept].astype(np.float64), row_of[kept]
    used, where = np.unique(index, return_inverse=True)
    starts = np.searchsorted(row_of, np.arange(len(rows)))
    n = len(rows)
    share = np.clip([(grades <= k).mean() for k in range(levels - 1)], 0.01, 0.99)
    first = np.log(share / (1 - share))
    # Parameters: weights, the first threshold, logarithms of the gaps between thresholds.
    p = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros(len(p)), np.zeros(len(p))
    for step in range(1, rounds + 1):
        w, cuts = p[:len(used)], np.cumsum(np.concatenate([p[len(used):len(used) + 1], np.exp(p[len(used) + 1:])]))
        score = np.add.reduceat(w[where] * value, starts)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = edges[grades], edges[grades + 1]
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        f_high, f_low = np.where(np.isinf(high), 1.0, sig(high - score)), np.where(np.isinf(low), 0.0, sig(low - score))
        mass = np.maximum(f_high - f_low, 1e-12)
        d_high, d_low = f_high * (1 - f_high) / mass, f_low * (1 - f_low) / mass
        by_score = d_high - d_low  # of the negative log-likelihood
        gradient = np.bincount(where, by_score[row_of] * value, len(used)) / n + penalty * w
        by_cut = np.zeros(levels - 1)
        np.add.at(by_cut, grades[grades < levels - 1], -d_high[grades < levels - 1])
        np.add.at(by_cut, grades[grades > 0] - 1, d_low[grades > 0])
        by_cut = np.cumsum(by_cut[::-1])[::-1] / n  # a gap moves all later thresholds
        gradient = np.concatenate([gradient, by_cut[:1], by_cut[1:] * np.exp(p[len(used) + 1:])])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = p[:len(used)]
    return CumulativeLink(weights, np.cumsum(np.concatenate([p[len(used):len(used) + 1], np.exp(p[len(used) + 1:])])))


def fit(docs: DataFrame, ratings: DataFrame, levels: int, doc_id: str = "doc_id", text: str = "text",
        sample: int = SAMPLE) -> CumulativeLink:
    """The model of at most ``sample`` rated documents. ``ratings``: the id column and ``grade`` from 0."""
    rated = ratings.filter(F.col(doc_id).isNotNull() & F.col("grade").isNotNull()) \
        .groupBy(F.col(doc_id).alias("rated_id")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = materialize(rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample), "rated")

    @F.arrow_udf("struct<index:array<int>,value:array<float>>")
    def vector(texts: pa.Array) -> pa.Array:
        found = [features(t.as_py()) for t in texts]
        lists = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float32()))]
        return pa.StructArray.from_arrays(lists, ["index", "value"])

    # Copies of a rated document add nothing: one row an id comes to the driver.
    joined = docs.select(F.col(doc_id).alias("rated_id"), F.col(text).alias("rated_text")).join(chosen, "rated_id") \
        .groupBy("rated_id", "grade").agg(F.min(F.coalesce("rated_text", F.lit(""))).alias("rated_text"))
    rows = joined.select("rated_id", "grade", vector("rated_text").alias("v")).toArrow().sort_by("rated_id")
    grades = rows.column("grade").to_numpy().astype(np.int64)
    vectors = rows.column("v").combine_chunks()
    lists = list(zip(*(
        [np.asarray(x.values) for x in (vectors.field(k) if isinstance(vectors, pa.StructArray) else vectors.chunk(0).field(k))]
        for k in ("index", "value")))) if len(grades) else []
    return train(lists, grades, levels)


def rate(docs: DataFrame, model: CumulativeLink, text: str = "text", grade: int = 1,
         least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail = P(grade >= ``grade``) and kept = tail >= ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade:double,tail:double>")
    def judge(texts: pa.Array) -> pa.Array:
        link = shared.value
        scores = np.array([link.score(t.as_py()) for t in texts])
        return pa.StructArray.from_arrays(
            [pa.array(link.expected(scores)), pa.array(link.tail(scores, grade))], ["expected_grade", "tail"])

    return docs.withColumn("__grades", judge(F.col(text))).withColumns({
        "expected_grade": F.col("__grades.expected_grade"), "tail": F.col("__grades.tail"),
        "kept": F.col("__grades.tail") >= least}).drop("__grades")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of ``labels``: 0 for toxic documents, 1 for others of poor quality, 2 for good ones.

    Toxic is the lowest grade, so that evidence of it adds up without a bound: between the others it
    would have to stay within their band, too weak to outweigh an otherwise fine text.
    """
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))
