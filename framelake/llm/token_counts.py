"""Exact token-length histogram and what its suffix sums answer.

Documents are encoded with a public byte-level vocabulary and aggregated by encoded length: first
within each task, then by one shuffle of (length, documents). Everything else is a running sum over
lengths, so totals, quantiles and truncated totals for any context limit cost no second pass over
the texts.

Nulls: a null text has no tokens (length 0, as an empty text). Repeated rows count each. An empty
table gives an empty histogram and null quantiles. Other columns are not read.
"""

from __future__ import annotations

import base64
import importlib.util
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from framelake.llm.common import schema_of
from framelake.workspace import materialize

#: Lengths per block of the two-level running sum.
BLOCK = 1024


def default_vocabulary() -> str:
    """Where the installed public vocabulary lies."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """Byte-level BPE of a rank file; loaded once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path or default_vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(vocabulary).encode_ordinary, Counter()
        for batch in batches:
            counts.update(len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())],
            schema=schema_of("n_tokens long, n_docs long"),
        )

    partial = docs.select(text).mapInArrow(run, "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length L, with everything a context limit of L needs.

    ``docs_ge`` and ``tokens_ge`` sum over lengths >= L, ``docs_le`` and ``tokens_le`` over lengths
    <= L. ``truncated_tokens`` is the total when each document is cut at L tokens, ``lost_tokens``
    what the cut removes, ``quantile`` the share of documents with at most L tokens. Sums run in two
    levels, over blocks of lengths and within a block, so no task sees more lengths than a block or
    more blocks than the longest document has.
    """
    # A few thousand rows, written: both levels read them, and texts are encoded once.
    histogram = materialize(histogram, "length-histogram")
    cells = histogram.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    order = Window.orderBy("block")
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
        F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.join(blocks, "block")
        .withColumn("docs_le", F.col("docs_before") + F.sum("n_docs").over(within))
        .withColumn("tokens_le", F.col("tokens_before") + F.sum("tokens").over(within))
        .select(
            "n_tokens", "n_docs", "tokens", "docs_le", "tokens_le",
            (F.col("all_docs") - F.col("docs_le") + F.col("n_docs")).alias("docs_ge"),
            (F.col("all_tokens") - F.col("tokens_le") + F.col("tokens")).alias("tokens_ge"),
            (F.col("tokens_le") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_le"))).alias("truncated_tokens"),
            (F.col("all_tokens") - F.col("tokens_le")
             - F.col("n_tokens") * (F.col("all_docs") - F.col("docs_le"))).alias("lost_tokens"),
            (F.col("docs_le") / F.col("all_docs")).alias("quantile"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when documents are cut at ``limit``, whether or not a length equals it."""
    fits, most = F.col("n_tokens") <= limit, lambda column: F.coalesce(F.max(column), F.lit(0))
    rest = most("docs_le") - most(F.when(fits, F.col("docs_le")))
    return sums.agg((most(F.when(fits, F.col("tokens_le"))) + F.lit(limit) * rest).alias("tokens"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that a share ``q`` of the documents does not exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
