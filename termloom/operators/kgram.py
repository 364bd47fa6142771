"""K-gram index of a vocabulary, and wildcard expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import kgrams
from ..functions.text import glob_regex


def kgram_index(vocabulary: DataFrame, k: int = 2) -> DataFrame:
    """``(gram, term)`` of the distinct k-grams of every padded term."""
    if k <= 0:
        raise ValueError("k must be positive")
    return vocabulary.select("term", F.explode(kgrams(F.col("term"), k, padded=True, distinct=True)).alias("gram")).select("gram", "term")


def lookup(index: DataFrame, gram: str) -> DataFrame:
    return index.where(F.col("gram") == gram).select("term")


def lookup_all(index: DataFrame, grams: list[str], k: int = 2) -> DataFrame:
    """Terms that hold every gram; grams of another length than ``k`` are refused."""
    if any(len(g) != k for g in grams):
        raise ValueError(f"every gram must have {k} letters")
    wanted = list(dict.fromkeys(grams))
    return index.where(F.col("gram").isin(*wanted)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("term")


def expand(vocabulary: DataFrame, glob: str) -> DataFrame:
    """Terms that a word with ``*`` stands for."""
    return vocabulary.where(F.col("term").rlike(glob_regex(glob))).select("term")
