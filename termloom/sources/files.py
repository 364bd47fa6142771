"""Readers and writers of the text formats: collections, links, titles, ranks, judgments, document info."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators.links import top


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, name, text)``: one document a file, in all folders below ``path``. Ids are hashes of the path, so they
    need no order among the tasks; unreadable files are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    return files.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("name"), F.col("value").alias("text"))


def read_patterns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Regular expressions, one a line, in file order; blank lines and ``//`` comments are left out."""
    text = spark.read.text(path, wholetext=True).first()
    lines = [line.strip() for line in (text["value"] if text else "").splitlines()]
    return tuple(line for line in lines if line and not line.startswith("//"))


def parse_links(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(src, dst)`` of lines ``src;d1,d2,...,``, each link once; a source without targets comes with a null one."""
    parts = lines.select(F.split(F.trim(value), ";").alias("p")).where(F.col("p")[0] != "")
    targets = F.filter(F.split(F.coalesce(F.get("p", F.lit(1)), F.lit("")), ","), lambda t: F.trim(t) != "")
    rows = parts.select(F.col("p")[0].cast("long").alias("src"), F.explode_outer(targets).alias("dst"))
    return rows.select("src", F.trim("dst").cast("long").alias("dst")).distinct()


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return parse_links(spark.read.text(path))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``(id, title)`` of lines ``id;title``; a title may hold further semicolons."""
    parts = F.split("value", ";", 2)
    return spark.read.text(path).where(F.col("value").contains(";")).select(parts[0].cast("long").alias("id"), parts[1].alias("title"))


def rank_lines(ranks: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines ``title=score;id`` of every ranked id that has a title."""
    return ranks.join(titles, "id").select(_rank_line())


def _rank_line() -> Column:
    return F.concat(F.col("title"), F.lit("="), F.col("score").cast("string"), F.lit(";"), F.col("id").cast("string")).alias("value")


def write_ranks(ranks: DataFrame, titles: DataFrame, path: str) -> None:
    """Lines in descending order of score, over as many files as the sort has partitions."""
    # the sort comes after the join, which would not keep it
    titled = ranks.join(titles, "id").orderBy(F.desc("score"), "id")
    titled.select(_rank_line()).write.mode("overwrite").text(path)


def parse_ranks(lines: DataFrame) -> DataFrame:
    """``(title, score, id)`` of lines ``title=score;id``."""
    form = r"^(.*)=([^=;]*);([^;]*)$"
    return lines.where(F.col("value").rlike(form)).select(
        F.regexp_extract("value", form, 1).alias("title"), F.regexp_extract("value", form, 2).cast("double").alias("score"), F.regexp_extract("value", form, 3).alias("id")
    )


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    return parse_ranks(spark.read.text(path))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """``(id, score)`` of lines ``id: score``."""
    parts = F.split("value", ":")
    return spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(parts[0]).cast("long").alias("id"), F.trim(parts[1]).cast("double").alias("score"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, grade)`` of lines ``file grade``."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value").rlike(r"\s")).select(parts[0].alias("doc"), parts[1].cast("int").alias("grade"))


def read_link_to_doc(spark: SparkSession, path: str) -> DataFrame:
    """``(node_id, doc_id)`` of lines ``node;doc``."""
    parts = F.split("value", ";")
    return spark.read.text(path).where(F.col("value").contains(";")).select(parts[0].cast("long").alias("node_id"), parts[1].cast("long").alias("doc_id"))


def link_to_doc(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node_id, doc_id)`` where a document's base name is a node's title, and the documents without such a node."""
    named = docs.select("doc_id", basename(F.col("name")).alias("title"))
    return nodes.join(named, "title").select(F.col("id").alias("node_id"), "doc_id"), named.join(nodes, "title", "left_anti")


def write_link_to_doc(pairs: DataFrame, path: str) -> None:
    """Lines ``node;doc`` of ``(node_id, doc_id)``."""
    pairs.select(F.concat_ws(";", F.col("node_id").cast("string"), F.col("doc_id").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_doc_info(docs: DataFrame, path: str) -> None:
    """Lines ``doc;name;length``."""
    docs.select(F.concat_ws(";", "doc_id", "name", "len").alias("value")).write.mode("overwrite").text(path)


def read_doc_info(spark: SparkSession, path: str) -> DataFrame:
    """The name may hold semicolons: the first field is the document, the last the length."""
    form = r"^([^;]*);(.*);([^;]*)$"
    lines = spark.read.text(path)
    return lines.where(F.col("value").rlike(form)).select(
        F.regexp_extract("value", form, 1).cast("long").alias("doc_id"), F.regexp_extract("value", form, 2).alias("name"), F.regexp_extract("value", form, 3).cast("int").alias("len")
    )


def append_error(spark: SparkSession, n: int, error: float, path: str) -> None:
    """One more line ``n;error``."""
    spark.createDataFrame([(f"{n};{error!r}",)], "value string").write.mode("append").text(path)


def top_lines(scores: DataFrame, k: int = 30, form: str | None = "%.5f") -> list[str]:
    """The best ``k`` as ``id: score`` for printing, in the given form, or with all digits where it is None."""
    rows = top(scores, k).orderBy(F.desc("score"), "id").collect()
    return [f"{r['id']}: {r['score']!r}" if form is None else f"{r['id']}: {form % r['score']}" for r in rows]


def write_top(scores: DataFrame, path: str, k: int = 30) -> None:
    """The best ``k`` as ``id: score`` with five significant digits; k lines, so one file."""
    best = top(scores, k)
    best.coalesce(1).orderBy(F.desc("score"), "id").select(F.format_string("%s: %.5g", F.col("id").cast("string"), "score").alias("value")).write.mode("overwrite").text(path)
