"""Relevance feedback: the positive part of Rocchio's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .search import weights_of


def feedback_weights(arrays: DataFrame, slots: list, ranked: list[int], marks: list[bool], config: EngineConfig | None = None, strict: bool = False) -> DataFrame:
    """``(term, weight)`` of the expanded query. ``ranked``: document ids in result order, ``marks``: which are relevant.

    Only marks among the first ``feedback_depth`` results give terms, but all marks count in the divisor. Every term of
    such a document gets beta / marks x tf / length; a term already asked gets alpha on top of its weight.
    ``strict``: asked terms are not recognised and stand beside the new ones.
    """
    config = config or EngineConfig()
    n = sum(map(bool, marks))
    chosen = [d for d, m in list(zip(ranked, marks, strict=False))[: config.feedback_depth] if m]
    spark = arrays.sparkSession
    asked = spark.createDataFrame([(s, float(w)) for s, w in weights_of(slots)], "term string, weight double")
    if not chosen:
        return asked if strict else asked.groupBy("term").agg(F.sum("weight").alias("weight"))
    terms = arrays.where(F.col("doc_id").isin(*chosen)).select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    new = terms.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum(F.lit(config.beta / n) * F.col("tf") / F.col("len")).alias("weight"))
    if strict:
        return asked.unionByName(new)
    old = asked.groupBy("term").agg(F.sum("weight").alias("old"))
    both = old.join(new, "term", "full_outer")
    return both.select("term", F.when(F.col("old").isNull(), F.col("weight")).when(F.col("weight").isNull(), F.col("old")).otherwise(F.col("old") + config.alpha).alias("weight"))
