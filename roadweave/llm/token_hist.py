"""Operator 4: token counts by an exact length histogram.

Documents are encoded and counted once; the histogram of encoded lengths, not the documents,
answers the rest. For each length that occurs, and for every other context limit asked for, running
sums give the documents and tokens below, and the tokens that stay if every document is cut there.

The histogram is summed in two steps, so no task sees all of it: within blocks of ``BLOCK``
lengths, and over the totals of the blocks.

Defined results: null and empty texts have length 0; very long texts are encoded as a whole;
repeated rows count as often as they are there; documents of equal length share a row; an empty
table gives an empty histogram, and only the limits asked for, with nothing to count (quantile
null); other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import counted, with_text
from .common import materialize, small

BLOCK = 256


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens and documents: how many documents have each encoded length."""
    return counted(with_text(docs).select("text"), path, pattern).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))


def limits(lengths: DataFrame, asked: Sequence[int] = ()) -> DataFrame:
    """For each context limit that occurs as a length in ``lengths`` (n_tokens, documents) or is ``asked`` for:

    documents and tokens of just this length, documents_fitting (at most as long), tokens_fitting,
    documents_cut (longer), tokens_kept (the total if longer ones are cut at the limit), tokens
    in all (tokens_total) and quantile, the share of documents at most as long.
    """
    if asked:
        also = lengths.sparkSession.createDataFrame([(int(n), 0) for n in asked], "n_tokens long, documents long")
        lengths = lengths.select("n_tokens", "documents").unionByName(also).groupBy("n_tokens").agg(F.sum("documents").alias("documents"))
    h = lengths.withColumns({"tokens": F.col("n_tokens") * F.col("documents"), "_block": F.floor(F.col("n_tokens") / F.lit(BLOCK))})
    h = materialize(h)
    blocks = h.groupBy("_block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    up = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = materialize(
        blocks.select("_block", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"_{c}_before") for c in "dt"], *[F.sum(c).over(every).alias(f"_{c}_all") for c in "dt"])
    )
    within = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(small(blocks), "_block")
        .withColumns({"documents_fitting": F.col("_d_before") + F.sum("documents").over(within), "tokens_fitting": F.col("_t_before") + F.sum("tokens").over(within)})
        .withColumn("documents_cut", F.col("_d_all") - F.col("documents_fitting"))
        .select(
            F.col("n_tokens").alias("context_limit"), "documents", "tokens", "documents_fitting", "tokens_fitting", "documents_cut",
            (F.col("tokens_fitting") + F.col("documents_cut") * F.col("n_tokens")).alias("tokens_kept"), F.col("_t_all").alias("tokens_total"), F.try_divide("documents_fitting", "_d_all").alias("quantile"),
        )
    )


def quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least this share of documents don't exceed."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return answers.select("context_limit", "quantile", asked).where("quantile >= share").groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
