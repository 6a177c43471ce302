"""Token counts from an exact length histogram.

Documents are counted by encoded length (combined before the shuffle: what moves is one row per
task and distinct length).  Suffix sums over the lengths then answer, for every context limit at
once, how many documents and tokens lie at or above it and how many tokens are left when each
document is cut at it.  The suffix sums run in blocks of lengths, so no task holds them all.

Defined cases: null and empty texts have length 0 and are counted there; an empty table has an
empty histogram; any limit, also one that no document has, is answered by ``at_limits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Lengths per block of the suffix sums.
BLOCK = 4096


def length_histogram(docs: DataFrame, n_tokens: Column) -> DataFrame:
    """(n_tokens, n_docs): one row per distinct encoded length."""
    return docs.select(n_tokens.cast("long").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """histogram + ``docs_from, tokens_from`` (documents and tokens of this length or more), ``docs_to`` (of this
    length or less), ``total_docs, total_tokens`` and ``truncated_tokens`` (tokens left at this limit)."""
    h = histogram.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("__tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    later = W.orderBy(F.col("__block").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    blocks = blocks.select(
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__docs_later"),
        F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__tokens_later"),
        F.sum("__d").over(everything).alias("total_docs"),
        F.sum("__t").over(everything).alias("total_tokens"),
    )
    inside = W.partitionBy("__block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("__docs", F.sum("n_docs").over(inside)).withColumn("__toks", F.sum("__tokens").over(inside))
    h = h.join(blocks, F.col("__block") == F.col("__b"))
    docs_from, tokens_from = F.col("__docs") + F.col("__docs_later"), F.col("__toks") + F.col("__tokens_later")
    return h.select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("total_docs") - docs_from + F.col("n_docs")).alias("docs_to"), "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_tokens"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_tokens) for any context limits, read off the suffix sums: the least length
    above a limit knows the documents and tokens beyond it."""
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    least = sums.select(wanted, "n_tokens", "n_docs", "docs_from", "tokens_from", "total_tokens")
    above = least.groupBy("limit").agg(
        F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > F.col("limit"), F.col("n_tokens"))).alias("__a"),
        F.max("total_tokens").alias("__total"),
    )
    docs, tokens = F.coalesce(F.col("__a.docs_from"), F.lit(0)), F.coalesce(F.col("__a.tokens_from"), F.lit(0))
    return above.select("limit", docs.alias("docs_over"), (F.col("__total") - tokens + docs * F.col("limit")).alias("truncated_tokens"))


def quantiles(sums: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, n_tokens): the least length that this fraction of all documents does not exceed (exact)."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("fraction")
    return sums.select(wanted, "*").filter("docs_to >= fraction * total_docs").groupBy("fraction").agg(F.min("n_tokens").alias("n_tokens"))
