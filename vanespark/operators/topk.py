"""Ranked top-k: score descending, then id ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores are ranked at this many decimals, so that the order of a sum doesn't decide between equals.
RANK_DECIMALS = 9


def top_k(scored: DataFrame, k: int, by: str = "qid", id_col: str = "vec_id") -> DataFrame:
    """The k best rows of each ``by``, with rk from 1. NaN scores are left out; null ones too.

    Catalyst limits each group in every task before the shuffle (WindowGroupLimit), so a query's rows never meet as a whole.
    """
    order = W.partitionBy(by).orderBy(F.round("score", RANK_DECIMALS).desc(), F.col(id_col).asc())
    ranked = scored.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("rk", F.row_number().over(order))
    return ranked.where(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("long"))


def top_k_single(scored: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k best rows of one query: planned as TakeOrderedAndProject, without a shuffle."""
    rows = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.orderBy(F.round("score", RANK_DECIMALS).desc(), F.col(id_col).asc()).limit(k)
