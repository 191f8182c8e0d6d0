"""Token counts (operator 9).

Method: exact length histogram.  Documents are summed up by encoded length
before anything is shuffled; suffix sums over the histogram then answer, for
every context limit, how many documents reach it, how many tokens lie below
and above, what truncation to it leaves, and every quantile of the length.

Suffix sums are taken in two levels (within ranges of ``SPAN`` lengths, then
over the ranges), so no task holds the whole histogram.  Null texts have length
0; an empty table gives an empty histogram; repeated rows count each time;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.bpe import count_tokens, default_vocabulary
from wayfold.llm.store import documents, materialise

SPAN = 1024


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """length and docs."""
    return counted.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens at least that long, below it, and the total truncated to L.

    ``share_upto`` is the share of documents of length L or less: the smallest
    L where it reaches p is the exact p-quantile.
    """
    h = materialise(lengths.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / SPAN).alias("range")), "lengths")
    ranges = h.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select("range", zero(F.sum("d").over(above)).alias("docs_above"), zero(F.sum("t").over(above)).alias("tokens_above"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.join(ranges, "range").select(
        "length", "docs", "tokens",
        (F.col("docs_above") + F.sum("docs").over(within)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum("tokens").over(within)).alias("tokens_at_least"),
        "all_docs", "all_tokens",
    )
    upto = F.col("all_docs") - F.col("docs_at_least") + F.col("docs")
    return out.select(
        F.col("length").alias("n_tokens"), "docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least")).alias("tokens_below"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        (upto / F.col("all_docs")).alias("share_upto"),
    )


def totals_at(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``limit``: documents over it, and the tokens left when all are cut to it.

    The next occurring length above a limit holds its answer; limits beyond all lengths leave everything.
    """
    joined = limits.select(F.col("limit").cast("long")).distinct().join(sums, F.col("n_tokens") > F.col("limit"), "left")
    least = joined.groupBy("limit").agg(F.min_by(F.struct("docs_at_least", "tokens_below"), "n_tokens").alias("a"))
    total = sums.agg(F.max(F.col("tokens_below") + F.col("tokens_at_least")).alias("total"))
    over = F.coalesce("a.docs_at_least", F.lit(0))
    return least.join(F.broadcast(total)).select("limit", over.alias("docs_over"), F.coalesce(F.col("a.tokens_below") + F.col("limit") * over, F.col("total"), F.lit(0)).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the smallest length that this share of all documents does not exceed."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    return sums.select("n_tokens", "share_upto", F.explode(wanted).alias("share")).where(F.col("share_upto") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(count_tokens(documents(spark, sf_dir), default_vocabulary())))
