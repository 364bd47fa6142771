"""The positional inverted index as tables, and its statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions.postings import letter_bits, to_grams, to_lengths, to_postings
from ..functions.text import glob_regex, prepared, token_array


def token_arrays(docs: DataFrame, config: TokenizerConfig | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, terms)``: one row a document, empty ones too."""
    return docs.select(F.col(key).alias("doc_id"), token_array(F.col(text), config).alias("terms"))


def tokens(docs: DataFrame, config: TokenizerConfig | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, off, term)``: one row an occurrence, offsets from 0."""
    return token_arrays(docs, config, key, text).select("doc_id", F.posexplode("terms").alias("off", "term"))


def doc_lengths(docs: DataFrame, config: TokenizerConfig | None = None) -> DataFrame:
    return token_arrays(docs, config).select("doc_id", F.size("terms").alias("len"))


def term_freq(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def coll_freq(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term").agg(F.count("*").alias("cf"))


def corpus_stats(docs: DataFrame, config: TokenizerConfig | None = None) -> DataFrame:
    """One row: documents, tokens, distinct terms. Terms are counted after a grouping, so no set is gathered."""
    arrays = token_arrays(docs, config)
    sizes = arrays.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n_tokens"))
    terms = arrays.select(F.explode("terms").alias("term")).groupBy("term").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n_terms"))
    return sizes.crossJoin(terms)  # one row each


def postings_lists(toks: DataFrame, keep: Column) -> DataFrame:
    """``(term, postings)``: occurrences as ``doc offset`` pairs in order, for the terms that ``keep`` selects.
    A list is as long as its term is frequent: meant for export of chosen terms."""
    pair = F.sort_array(F.collect_list(F.struct("doc_id", "off")))
    text = F.array_join(F.transform(pair, lambda p: F.concat_ws(" ", p["doc_id"].cast("string"), p["off"].cast("string"))), ";")
    return toks.where(keep).groupBy("term").agg(text.alias("postings"))


class Index:
    """The stored tables of a collection: written once, then every query reads the buckets and row groups it needs.

    ``postings(term, n, total, docs, tfs, lens, offs)`` lies in buckets by term, sorted by term within files; a row has
    up to 1,024 documents of a term that one task read, with the term's number and offsets in each and their lengths.
    ``tokens(term, doc_id, off)`` and ``counts(term, doc_id, tf, len)`` are views of it that read their columns only.
    ``terms(term, df, cf)`` is sorted by term within files; ``grams(gram, term, n, cf)``, the k-grams of the padded terms
    with the number of a term's distinct unpadded ones and its frequency, by gram; ``docs(doc_id, name, len)`` has every
    document, empty ones too.
    """

    #: Bytes of text for each bucket, and the most buckets.
    BUCKET_BYTES, MOST = 64 << 20, 4096
    #: A wildcard that stands for more terms than this is matched on the occurrences instead of by a list of terms.
    LISTED = 1000

    def __init__(self, spark: SparkSession, path: str, buckets: int, k: int = 2, pending: dict[str, Callable[[], None]] | None = None) -> None:
        self.spark, self.path, self.buckets, self.k = spark, path, buckets, k
        self._pending, self._tables = pending or {}, {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in self._pending:
                self._pending[name]()
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._tables[name]

    @property
    def rows(self) -> DataFrame:
        return self._table("postings")

    @property
    def terms(self) -> DataFrame:
        return self._table("terms")

    @property
    def grams(self) -> DataFrame:
        return self._table("grams")

    @property
    def docs(self) -> DataFrame:
        return self._table("docs")

    @property
    def tokens(self) -> DataFrame:
        return self.as_tokens(self.rows)

    @property
    def counts(self) -> DataFrame:
        return self.as_counts(self.rows)

    @classmethod
    def of(cls, docs: DataFrame, path: str, config: TokenizerConfig | None = None, name: str | None = None, k: int = 2) -> Index:
        """The index of ``docs(doc_id, text)``, each of whose tables is written when it is first asked for. Tasks group
        their documents' tokens by term, so that rows of postings are shuffled, once, instead of tokens. Hot terms are
        spread by document."""
        spark = docs.sparkSession
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        buckets = max(8, min(cls.MOST, size // cls.BUCKET_BYTES))
        text, bits = prepared(F.col("text"), config), None
        if text is None:
            text = token_array(F.col("text"), config)
        else:
            bits = letter_bits(spark)
        key = docs.schema["doc_id"].dataType.simpleString()
        named = docs.select("doc_id", (F.col(name) if name else F.col("doc_id").cast("string")).alias("name"), text.alias("text"))

        def store(table: DataFrame, where: str, *by: str) -> None:
            writer = table.write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{where}")

        def postings() -> None:
            found = named.select("doc_id", "text").mapInArrow(to_postings(bits), f"term string, n int, total bigint, docs array<{key}>, tfs array<int>, lens array<int>, offs array<array<int>>")
            dealt = found.withColumn("bucket", cls.bucket(F.col("term"), buckets))
            # the parts of a bucket, which tasks take, are about as large at any size
            parts = max(2, min(8, size // (buckets * (cls.BUCKET_BYTES // 8))))
            part = F.pmod(F.xxhash64(F.col("docs")[0]), F.lit(parts))
            store(dealt.repartition("bucket", part).sortWithinPartitions("bucket", "term"), "postings", "bucket")

        def terms() -> None:
            store(found.rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("cf")).sortWithinPartitions("term"), "terms")

        def grams() -> None:
            each = found.terms.select("term", "cf").mapInArrow(to_grams(k), "gram string, term string, n int, cf bigint")
            # a common k-gram is spread by term
            store(each.repartition("gram", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("gram", "term"), "grams")

        def documents() -> None:
            store(named.mapInArrow(to_lengths(bits), f"doc_id {key}, name string, len int"), "docs")

        found = cls(spark, path, buckets, k, {"postings": postings, "terms": terms, "grams": grams, "docs": documents})
        return found

    @classmethod
    def write(cls, docs: DataFrame, path: str, config: TokenizerConfig | None = None, name: str | None = None, k: int = 2) -> None:
        """Store all tables of ``docs(doc_id, text)``."""
        index = cls.of(docs, path, config, name, k)
        for table in index._pending:
            index._table(table)
        index.spark.createDataFrame([(index.buckets, k)], "buckets int, k int").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark, path, meta["buckets"], meta["k"])

    @classmethod
    def build(cls, docs: DataFrame, path: str, config: TokenizerConfig | None = None, name: str | None = None, k: int = 2) -> Index:
        cls.write(docs, path, config, name, k)
        return cls.load(docs.sparkSession, path)

    @staticmethod
    def as_tokens(rows: DataFrame) -> DataFrame:
        each = rows.select("bucket", "term", F.inline(F.arrays_zip("docs", "offs")).alias("doc_id", "offs"))
        return each.select("bucket", "term", "doc_id", F.explode("offs").alias("off"))

    @staticmethod
    def as_counts(rows: DataFrame, *more: str) -> DataFrame:
        each = rows.select("bucket", "term", *more, F.inline(F.arrays_zip("docs", "tfs", "lens")).alias("doc_id", "tf", "len"))
        return each.withColumn("tf", F.col("tf").cast("long"))

    def expand(self, glob: str) -> DataFrame:
        """``(term)``: the terms that a word with ``*`` stands for. Those with all of its k-grams come from the gram table
        and are then matched whole; a word without any k-gram is matched on the vocabulary."""
        padded = f"^{glob}$".split("*")
        wanted = list(dict.fromkeys(piece[i : i + self.k] for piece in padded for i in range(len(piece) - self.k + 1)))
        found = self.terms
        if wanted:
            found = self.grams.where(F.col("gram").isin(*wanted)).groupBy("term").agg(F.count("*").alias("hits")).where(F.col("hits") == len(wanted))
        return found.where(F.col("term").rlike(glob_regex(glob))).select("term")

    def _asked(self, table: DataFrame, slots: list[str]) -> DataFrame:
        """The rows of a bucketed table whose term a slot stands for; the filter names the buckets where it can."""
        words, wide = {s for s in slots if "*" not in s}, []
        for glob in (s for s in slots if "*" in s):
            some = [r["term"] for r in self.expand(glob).limit(self.LISTED + 1).collect()]
            if len(some) > self.LISTED:
                wide.append(F.col("term").rlike(glob_regex(glob)))
            else:
                words.update(some)
        listed = F.col("term").isin(*sorted(words)) if words else F.lit(False)
        if wide:
            return table.where(reduce(lambda a, b: a | b, wide, listed))
        spark = table.sparkSession
        rows = spark.createDataFrame([(w,) for w in sorted(words)], "term string").select(self.bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()
        return table.where(listed).where(F.col("bucket").isin(*sorted(r["b"] for r in rows)) if rows else F.lit(False))

    def occurrences(self, slots: list[str]) -> DataFrame:
        """``(term, doc_id, off)`` of the slots' terms."""
        return self.as_tokens(self._asked(self.rows, slots)).select("term", "doc_id", "off")

    def frequencies(self, slots: list[str]) -> DataFrame:
        """``(term, doc_id, tf, len)`` of the slots' terms."""
        return self.as_counts(self._asked(self.rows, slots)).select("term", "doc_id", "tf", "len")

    def weighted(self, weights: DataFrame) -> DataFrame:
        """``(term, doc_id, tf, len, df, w)`` of the terms of ``weights(term, w)``, a table that a query holds. Rows of
        postings are matched before their documents are told apart."""
        known = self.terms.join(F.broadcast(weights), "term").select("term", "df", "w")
        return self.as_counts(self.rows.join(F.broadcast(known), "term"), "df", "w").drop("bucket")  # known: no more rows than weights

    def postings(self, term: str) -> DataFrame:
        """Occurrences of one term."""
        return self.occurrences([term]).select("doc_id", "off")
