"""Registered queries that write the text formats from the driver's tables and read them again, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import Scratch
from ..functions.text import parse_query
from ..operators import index
from ..sources import files

_QUERY = "  Money TRANSFER\tmoney Überall "


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(spark: SparkSession) -> str:
    return f"{Scratch(spark, 'formats').root}/lines"


def _written(df: DataFrame, line: Column) -> str:
    path = _path(df.sparkSession)
    df.select(line.alias("value")).write.text(path)
    return path


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _collection(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    _table(spark, d, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    found = files.read_collection(spark, path)
    return found.select(F.regexp_extract("name", r"n_nationkey=(\d+)", 1).cast("int").alias("folder"), "text")


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    lines = F.explode(F.array(F.lit("// next"), F.lit(""), _joined("  ", F.col("r_name"), r"\d+")))
    path = _path(spark)
    # one file: its lines' order is what is read
    _table(spark, d, "region").coalesce(1).orderBy("r_regionkey").select(lines.alias("value")).write.text(path)
    return spark.createDataFrame(list(enumerate(files.read_patterns(spark, path))), "ord int, pattern string")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return files.read_titles(spark, _written(_table(spark, d, "part"), _joined(F.col("p_partkey"), ";", F.col("p_name"), ";x")))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer; the line of one without orders has no targets."""
    by = _table(spark, d, "customer").join(_table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    lists = by.groupBy("c_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("t"))
    return files.read_links(spark, _written(lists, _joined(F.col("c_custkey"), ";", F.array_join("t", ","), ",")))


def _golden(spark: SparkSession, d: str) -> DataFrame:
    return files.read_golden(spark, _written(_table(spark, d, "customer"), _joined(F.col("c_custkey"), ": ", F.col("c_acctbal"))))


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    return files.read_judgments(spark, _written(_table(spark, d, "labels"), _joined("d", F.col("doc_id"), ".txt ", F.col("quality"))))


def _link_map(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes for the documents in one language only, so that others have none."""
    docs = _table(spark, d, "documents")
    named = docs.select("doc_id", _joined("corpus/", F.col("source"), "/d", F.col("doc_id"), ".txt").alias("name"))
    nodes = docs.where("lang = 'en'").select((F.col("doc_id") * 3).alias("id"), _joined("d", F.col("doc_id"), ".txt").alias("title"))
    return files.link_to_doc(nodes, named)


def _link_map_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    files.write_link_to_doc(_link_map(spark, d)[0], path)
    return files.read_link_to_doc(spark, path)


def _doc_info(spark: SparkSession, d: str) -> DataFrame:
    docs, path = _table(spark, d, "documents"), _path(spark)
    named = docs.select("doc_id", _joined("a;b/", F.col("doc_id"), ".txt").alias("name"))
    files.write_doc_info(index.doc_lengths(docs).join(named, "doc_id"), path)
    return files.read_doc_info(spark, path)


def _ranks_file(spark: SparkSession, d: str) -> DataFrame:
    c, path = _table(spark, d, "customer"), _path(spark)
    scores = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    files.write_ranks(scores, c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("a=b;"), "c_name").alias("title")), path)
    return files.read_ranks(spark, path)


def _error_log(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    for (n,) in _table(spark, d, "region").select("r_regionkey").collect():  # five rows at every scale
        files.append_error(spark, n, n + 0.5, path)
    return spark.read.text(path)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("score"))


def _top_file(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    files.write_top(_customers(spark, d), path)
    return spark.read.text(path)


def _top_print(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in files.top_lines(_customers(spark, d))], "value string")


def _query_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(parse_query(_QUERY))), "slot int, word string")


QUERIES = {
    "collection_read": _collection,
    "patterns_read": _patterns,
    "titles_read": _titles,
    "links_read": _links,
    "golden_read": _golden,
    "judgments_read": _judgments,
    "link_map_roundtrip": _link_map_roundtrip,
    "link_map_missing": lambda s, d: _link_map(s, d)[1].select("doc_id", "title"),
    "doc_info_roundtrip": _doc_info,
    "ranks_file": _ranks_file,
    "error_log": _error_log,
    "top_file": _top_file,
    "top_print": _top_print,
    "query_words": _query_words,
}

_BEST = "SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS score FROM customer ORDER BY score DESC, id LIMIT 30"

ORACLES = {
    "collection_read": "SELECT CAST(n_nationkey AS INTEGER) AS folder, n_name || chr(10) AS text FROM nation",
    "patterns_read": r"SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS ord, r_name || '\d+' AS pattern FROM region",
    "titles_read": "SELECT CAST(p_partkey AS BIGINT) AS id, p_name || ';x' AS title FROM part",
    "links_read": "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS src, CAST(o_orderkey AS BIGINT) AS dst FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "golden_read": "SELECT CAST(c_custkey AS BIGINT) AS id, c_acctbal AS score FROM customer",
    "judgments_read": "SELECT 'd' || doc_id || '.txt' AS doc, CAST(quality AS INTEGER) AS grade FROM labels",
    "link_map_roundtrip": "SELECT doc_id * 3 AS node_id, doc_id FROM documents WHERE lang = 'en'",
    "link_map_missing": "SELECT doc_id, 'd' || doc_id || '.txt' AS title FROM documents WHERE lang IS DISTINCT FROM 'en'",
    "ranks_file": "SELECT 'a=b;' || c_name AS title, c_acctbal AS score, CAST(c_custkey AS VARCHAR) AS id FROM customer",
    "error_log": "SELECT r_regionkey || ';' || r_regionkey || '.5' AS value FROM region",
    "top_file": f"WITH best AS ({_BEST}) SELECT id || ': ' || printf('%.' || CAST(4 - floor(log10(score)) AS INTEGER) || 'f', score) AS value FROM best",
    "top_print": f"WITH best AS ({_BEST}) SELECT id || ': ' || printf('%.5f', score) AS value FROM best",
    "query_words": "SELECT CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS slot, unnest(w) AS word FROM (SELECT ['money', 'transfer', 'money', 'überall'] AS w)",
}
