"""Token counts by an exact length histogram.

Documents are counted by encoded length, first in each task, so the shuffle carries one row a
task and length. Suffix sums over the histogram then answer, for every context limit, how many
documents and tokens reach it, what is left when longer texts are truncated, and quantiles.
The sums run in two levels, over blocks of lengths and inside each block, so no task holds more
than a block of lengths or the list of blocks. Limits that no document's length equals join the
histogram as lengths of no documents; so limits and quantiles need no join of their own.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_texts, materialize, slices

#: Lengths of one block of the suffix sums.
BLOCK = 128
#: Context limits and quantiles that the report answers.
LIMITS = tuple(1 << k for k in range(7, 21))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length.

    ``path`` names a file of byte-pair ranks on every executor, ``pattern`` its pre-tokeniser.
    Null counts as empty: length zero. Texts are encoded whole, however long. Repeated rows count
    each; an empty table gives no rows; columns other than text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = _encoding(path, pattern), Counter()
        for batch in slices(batches, "text"):
            counts.update(len(coder.encode_ordinary(t)) for t in as_texts(batch.column("text")))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["n_tokens", "n"])

    return docs.select("text").mapInArrow(run, "n_tokens bigint, n bigint").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs: documents and tokens of at least it, and truncated totals.

    n_tokens, n_docs, docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_total
    (tokens left if texts are cut at n_tokens), share_below (of documents that are shorter);
    further columns of ``hist`` stay.
    """
    part = hist.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = part.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    carried = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("bd").over(every).alias("docs_total"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = part.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(carried, "block")
    more = [c for c in hist.columns if c not in ("n_tokens", "n_docs")]
    out = summed.select("n_tokens", "n_docs", *more, (F.col("d") + F.col("docs_later")).alias("docs_at_least"), (F.col("t") + F.col("tokens_later")).alias("tokens_at_least"), "docs_total", "tokens_total")
    return out.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_at_least")) / F.col("docs_total")).alias("share_below"),
    )


def report(hist: DataFrame, limits: Iterable[int] = LIMITS, shares: Iterable[float] = SHARES) -> DataFrame:
    """Suffix sums at each length that occurs and at each of ``limits``, with quantiles.

    Beside the columns of ``suffix_sums``: docs_over and tokens_over (of documents that are longer
    than n_tokens), is_limit, and quantiles (those of ``shares`` whose least length, that at least
    the share of documents does not exceed, is n_tokens). A length that no document has has n_docs
    0. ``hist`` is written once, so documents are encoded once. An empty histogram gives no rows.
    """
    hist = materialize(hist, "lengths")
    asked = hist.limit(1).select(F.explode(F.array(*(F.lit(int(x)).cast("bigint") for x in limits))).alias("n_tokens"), F.lit(0).cast("bigint").alias("n_docs"), F.lit(True).alias("asked"))
    both = hist.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("is_limit"))
    sums = suffix_sums(both)
    below = F.col("docs_total") - F.col("docs_at_least")
    upto = below + F.col("n_docs")
    # The same comparison on both sides of a length, so that each share falls to one length.
    reached = F.filter(F.array(*(F.lit(float(x)) for x in shares)), lambda x: (upto >= x * F.col("docs_total")) & (below < x * F.col("docs_total")))
    return sums.select(
        "*",
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"),
        (F.col("tokens_at_least") - F.col("n_tokens") * F.col("n_docs")).alias("tokens_over"),
        reached.alias("quantiles"),
    )


def at_limits(hist: DataFrame, limits: Iterable[int]) -> DataFrame:
    """limit, docs_over and tokens_kept (if longer texts are cut there) for any context limits."""
    return report(hist, limits).where("is_limit").select(F.col("n_tokens").alias("limit"), "docs_over", F.col("truncated_total").alias("tokens_kept"))


def quantiles(hist: DataFrame, shares: Iterable[float]) -> DataFrame:
    """For each share, the least length that at least that share of documents does not exceed."""
    return report(hist, [0], shares).select(F.explode("quantiles").alias("share"), "n_tokens")
