"""Corpus preparation from ``documents`` to token ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.decontaminate import drop_leaks
from termloom.llm.langid import identify
from termloom.llm.line_dedup import dedup_lines
from termloom.llm.queries import ACCEPT, tokenizer_file
from termloom.llm.scratch import Scratch
from termloom.llm.simhash import keep_one
from termloom.llm.token_codec import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with a posterior of ACCEPT or more; those without letters go."""
    found = identify(docs, F.col("lang"), F.col("source"), "lang", "doc_id", name="stage-language")
    return found.where(F.col("_confidence") >= ACCEPT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays once; a document all of whose lines are repeats of earlier ones goes."""
    found = dedup_lines(docs, name="stage-lines").where("n_lines = 0 or n_dropped < n_lines")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more, proposed by SimHashes within two bits."""
    return keep_one(docs.select(*COLUMNS), name="stage-simhash")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document left."""
    return encode_documents(docs, tokenizer_file("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: Not expressible in SQL: fuzzy lines, XXH64 fingerprints and merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        new = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
