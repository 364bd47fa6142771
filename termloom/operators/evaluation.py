"""Ranking quality against graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """One row: precision at k, recall at k and nDCG at k. ``ranked(doc_id, rank)``, ``judged(doc_id, grade)``."""
    top = ranked.where(F.col("rank") <= k).join(judged, "doc_id", "left").select("rank", F.coalesce("grade", F.lit(0)).alias("grade"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    got = top.agg(F.sum((F.col("grade") > 0).cast("double")).alias("hits"), F.sum(gain).alias("dcg"))
    relevant = judged.agg(F.sum((F.col("grade") > 0).cast("double")).alias("relevant"))
    grades = judged.orderBy(F.desc("grade")).limit(k).agg(F.sort_array(F.collect_list("grade"), asc=False).alias("g"))  # k values
    best = grades.select(
        F.aggregate(F.transform("g", lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x).alias("ideal")
    )
    return got.crossJoin(relevant).crossJoin(best).select(
        F.round(F.col("hits") / k, 9).alias("precision"),
        F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")), 9).alias("recall"),
        F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), 9).alias("ndcg"),
    )
