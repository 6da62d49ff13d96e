"""Exact token counts: a length histogram and its suffix sums.

Documents are aggregated by encoded length once. From the histogram, suffix sums (documents,
and tokens, of at least a length) answer totals, quantiles and truncated totals for every
context limit, without reading a text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs): one row per distinct length; null lengths count as 0. Partial sums come
    before the shuffle, so a common length is no hot key. Empty table: no rows."""
    return (lengths.select(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length"))
            .groupBy("length").agg(F.count("*").alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(length, n_docs, docs_from, tokens_from): documents and tokens of at least that length.

    Lengths are cut into blocks; sums run inside each block, and the sums of the later blocks
    (one row per ``BLOCK`` lengths) are added.
    """
    h = hist.withColumn("block", F.floor(F.col("length") / BLOCK).cast("long"))
    inner = Window.partitionBy("block").orderBy(F.desc("length"))
    outer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
              .select("block", F.coalesce(F.sum("d").over(outer), F.lit(0)).alias("later_docs"),
                      F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("later_tokens")))
    return (h.join(blocks, "block")
            .select("length", "n_docs",
                    (F.col("later_docs") + F.sum("n_docs").over(inner)).alias("docs_from"),
                    (F.col("later_tokens") + F.sum(F.col("n_docs") * F.col("length")).over(inner)).alias("tokens_from")))


def totals(hist: DataFrame) -> tuple[int, int]:
    """(documents, tokens) of a histogram; one row to the driver."""
    r = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_docs") * F.col("length")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def context_report(hist: DataFrame) -> DataFrame:
    """One row per distinct length L taken as context limit: documents of length L, documents and
    tokens of at least L, the tokens left when texts are truncated to L, all documents and tokens,
    and the share of documents that fit (the quantile at which L stands)."""
    docs, tokens = (F.lit(x).cast("long") for x in totals(hist))
    return suffix_sums(hist).select(
        F.col("length").alias("context_limit"), "n_docs", "docs_from", "tokens_from",
        (tokens - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        docs.alias("all_docs"), tokens.alias("all_tokens"),
        (1 - (F.col("docs_from") - F.col("n_docs")) / docs).alias("share_fitting"))


def answer_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_over) for any limits, from the suffix sums.

    A limit between two lengths takes the sums of the next longer length; beyond the longest
    nothing is cut. One aggregation over the histogram, with a column per limit.
    """
    all_tokens = totals(hist)[1]
    sums = F.struct("length", "docs_from", "tokens_from")
    next_longer = [F.min(F.when(F.col("length") > x, sums)) for x in limits]
    rows = suffix_sums(hist).agg(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context_limit"), s.alias("s"))
                                           for x, s in zip(limits, next_longer)]).alias("all"))
    rows = rows.select(F.explode("all").alias("r")).select("r.*")
    over = F.coalesce(F.col("s.docs_from"), F.lit(0))
    return rows.select("context_limit", (F.lit(all_tokens).cast("long") - F.coalesce(F.col("s.tokens_from"), F.lit(0))
                                         + F.col("context_limit") * over).alias("truncated_tokens"), over.alias("docs_over"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the documents do not exceed."""
    least = [F.min(F.when(F.col("share_fitting") >= x - 1e-12, F.col("context_limit"))) for x in shares]
    rows = context_report(hist).agg(F.array(*[F.struct(F.lit(float(x)).alias("share"), c.alias("length"))
                                              for x, c in zip(shares, least)]).alias("all"))
    return rows.select(F.explode("all").alias("r")).select("r.*")
