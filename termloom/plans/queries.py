"""The registered queries over the driver's tables. Oracles in SQL stand in ``oracles.py`` under the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, TokenizerConfig
from ..durable import Scratch
from ..functions.distance import indel_distance
from ..functions.text import STANDARD_PATTERNS, basename, shorten
from ..operators import evaluation, feedback, index, kgram, links, search, spelling
from ..sources import files
from . import formats
from .engine import hits_ranking

# The words that the queries ask for.
RANKED = ["der", "la", "und"]
PAIR = ["de", "la"]
TRIPLE = ["of", "the", "and"]
WILD = "th*ing"
MISSPELT = "tthe"
MARKS = [True, False, True, True, False, False, False, False, False, True, False, True]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _tokens(spark: SparkSession, d: str, config: TokenizerConfig | None = None) -> DataFrame:
    return index.tokens(_docs(spark, d), config)


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    return index.token_arrays(_docs(spark, d))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names or ("score",)})


def _token_counts(config: TokenizerConfig):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _tokens(spark, d, config).groupBy("term").agg(F.count("*").alias("n"), F.sum(F.col("off").cast("long")).alias("offsets"))

    return run


_stored: dict[tuple[str, str], index.Index] = {}


def _index(spark: SparkSession, d: str) -> index.Index:
    """The stored index of the documents; the session's first query of each of its tables writes it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        _stored[key] = index.Index.of(_docs(spark, d), Scratch(spark, "index").root)
    return _stored[key]


def _counts(spark: SparkSession, d: str, slots: list[str]) -> DataFrame:
    return _index(spark, d).frequencies(slots)


def doc_links(docs: DataFrame) -> DataFrame:
    """A link graph over document ids: two computed targets from every document but each fifth."""
    n = docs.agg(F.count("*").alias("n"))
    ids = docs.select("doc_id").crossJoin(F.broadcast(n)).where("doc_id % 5 <> 0")  # n: one row
    targets = F.array(F.pmod(F.col("doc_id") * 7 + 3, F.col("n")), F.pmod(F.col("doc_id") * F.col("doc_id") + 1, F.col("n")))
    return ids.select(F.col("doc_id").alias("src"), F.explode(targets).alias("dst")).distinct()


def doc_nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"))


def user_links(spark: SparkSession, d: str) -> DataFrame:
    """Users of neighbouring events."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    return e.withColumnRenamed("user_id", "src").join(after, "event_id").select("src", "dst").distinct()


def order_links(spark: SparkSession, d: str) -> DataFrame:
    """Customers (even ids) to the parts they ordered (odd ids)."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return links.pagerank(doc_links(docs), doc_nodes(docs), fixed=10).withColumnRenamed("id", "doc_id")


def _tfidf(spark: SparkSession, d: str, slots: list | None = None, integer: bool = True) -> DataFrame:
    stored, slots = _index(spark, d), slots or RANKED
    return search.tf_idf_of(stored.frequencies(slots), stored.docs.agg(F.count("*").alias("n")), slots, integer)


def _corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus_stats(_docs(spark, d))


def _index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "index").root
    index.Index.write(_docs(spark, d), path)
    loaded = index.Index.load(spark, path)
    return loaded.postings("keit").join(loaded.docs, "doc_id").select("doc_id", "off", "name", "len")


def _kgrams(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).grams.select("gram", "term")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "cf")


def _spell_best(spark: SparkSession, d: str) -> DataFrame:
    return spelling.suggest_stored(_index(spark, d).grams, MISSPELT).orderBy(F.desc("cf"), "term").limit(10)


def _spell_phrase(spark: SparkSession, d: str) -> DataFrame:
    found = spelling.suggest_query(_index(spark, d).counts, _frequencies(spark, d), ["keeit", "und"], 5, grams=_index(spark, d).grams)
    return spark.createDataFrame([(i, p) for i, p in enumerate(found)], "place int, phrase string")


def _edit_distance(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_name", "p_type").distinct()
    return parts.select("p_name", "p_type", indel_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


def _first_results(spark: SparkSession, d: str) -> list[int]:
    return [r["doc_id"] for r in search.page(_tfidf(spark, d), 1, len(MARKS)).orderBy("rank").collect()]


def _feedback(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    return feedback.feedback_weights(_arrays(spark, d), RANKED, _first_results(spark, d), MARKS, strict=strict)


def _feedback_rank(strict: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        terms = _feedback(spark, d, strict)
        stored = _index(spark, d)
        # the expanded query is a table: its terms are those of ten documents, joined by term
        weights = (terms.select("term", F.lit(1.0).alias("weight")) if strict else terms).groupBy("term").agg(F.sum("weight").alias("w"))
        tf = stored.weighted(weights)
        n = stored.docs.agg(F.count("*").alias("n"))
        share = search.idf(F.col("n"), F.col("df")) * F.col("w") * F.col("tf") / F.col("len")
        scored = tf.crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.sum(share).alias("score"))  # n: one row
        return _rounded(scored)

    return run


def _walks(method: int, walks: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d)
        # walks from random nodes are as many in all as from every node
        total = walks * docs.count() if method in (1, 5) else walks
        return _rounded(links.monte_carlo(doc_links(docs), total, method, doc_nodes(docs)))

    return run


def _mc_error(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    golden = links.top(links.pagerank(doc_links(docs), doc_nodes(docs), fixed=10))
    return _rounded(links.walk_error(golden, links.monte_carlo(doc_links(docs), 2, 4, doc_nodes(docs))), "error")


def _links_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = doc_links(_docs(spark, d)).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("t")).select(F.concat(F.col("src"), F.lit(";"), F.array_join("t", ","), F.lit(",")).alias("value"))
    return files.parse_links(lines)


def _rank_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    titles = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id")).alias("title"))
    written = files.rank_lines(links.pagerank(doc_links(docs), doc_nodes(docs), fixed=3).withColumn("score", F.round("score", 9)), titles)
    return files.parse_ranks(written)


def _result_format(spark: SparkSession, d: str) -> DataFrame:
    names = _docs(spark, d).select("doc_id", basename(F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))).alias("name"))
    return search.result_lines(search.page(_tfidf(spark, d)), names)


def _short_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", shorten(F.col("text")).alias("short"))


def _eval(spark: SparkSession, d: str) -> DataFrame:
    judged = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("grade"))
    return evaluation.quality(search.page(_tfidf(spark, d)).select("doc_id", "rank"), judged)


def _hits_top(spark: SparkSession, d: str) -> DataFrame:
    scores = links.hits(order_links(spark, d), fixed=5)
    return _rounded(links.top(scores.select("id", F.col("authority").alias("score"))))


def _hits_base(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    root = search.boolean_or(_counts(spark, d, ["keit"]), ["keit"]).select(F.col("doc_id").alias("id"))
    return links.base_set(doc_links(docs), root)


def _rank_hits(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(hits_ranking(search.boolean_or(_counts(spark, d, ["keit"]), ["keit"]), doc_links(_docs(spark, d)), fixed=5))


def _pagerank(fixed: int | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d)
        return _rounded(links.pagerank(doc_links(docs), doc_nodes(docs), fixed=fixed))

    return run


QUERIES = {
    "tok_standard": _token_counts(TokenizerConfig()),
    "tok_keep_punct": _token_counts(TokenizerConfig(remove_punctuation=False)),
    "tok_nocase": _token_counts(TokenizerConfig(case_folding=False)),
    "tok_diacritics": _token_counts(TokenizerConfig(remove_diacritics=True)),
    "tok_eof_strict": _token_counts(TokenizerConfig(flush_last=False)),
    "tok_patterns": _token_counts(TokenizerConfig(patterns=STANDARD_PATTERNS)),
    "doc_lengths": lambda s, d: index.doc_lengths(_docs(s, d)),
    "term_freq": lambda s, d: index.term_freq(_tokens(s, d)),
    "doc_freq": lambda s, d: index.doc_freq(index.term_freq(_tokens(s, d))),
    "coll_freq": lambda s, d: index.coll_freq(_tokens(s, d)),
    "corpus_stats": _corpus_stats,
    "postings": lambda s, d: index.postings_lists(_index(s, d).occurrences(["keit", "und", "thatin"]), F.col("term").isin("keit", "und", "thatin")),
    "index_roundtrip": _index_roundtrip,
    "missing_terms": lambda s, d: search.missing_terms(_index(s, d).terms, ["und", "qqq", "xyzzy"]),
    "boolean_and": lambda s, d: search.boolean_and(_counts(s, d, PAIR), PAIR),
    "boolean_and_wildcard": lambda s, d: search.boolean_and(_counts(s, d, [WILD, "of"]), [WILD, "of"]),
    "boolean_and_strict": lambda s, d: search.boolean_and_strict(_counts(s, d, ["und", "éire", "keit"]), ["und", "éire", "keit"]),
    "boolean_or": lambda s, d: search.boolean_or(_counts(s, d, RANKED), RANKED),
    "phrase2": lambda s, d: search.phrase(_index(s, d).occurrences(PAIR), PAIR),
    "phrase3": lambda s, d: search.phrase(_index(s, d).occurrences(["of", "the", "to"]), ["of", "the", "to"]),
    "phrase_wildcard": lambda s, d: search.phrase(_index(s, d).occurrences(["of", "th*"]), ["of", "th*"]),
    "tfidf": lambda s, d: _rounded(_tfidf(s, d)),
    "tfidf_real_idf": lambda s, d: _rounded(_tfidf(s, d, integer=False)),
    "tfidf_wildcard": lambda s, d: _rounded(_tfidf(s, d, ["und", WILD])),
    "tfidf_topk": lambda s, d: _rounded(search.page(_tfidf(s, d))),
    "tfidf_page2": lambda s, d: _rounded(search.page(_tfidf(s, d), 11, 20)),
    "rank_pagerank": lambda s, d: _rounded(search.by_rank(search.boolean_or(_counts(s, d, RANKED), RANKED), _ranks(s, d))),
    "rank_combination": lambda s, d: _rounded(search.combined(_tfidf(s, d), _ranks(s, d))),
    "rank_hits": _rank_hits,
    "kgrams": _kgrams,
    "kgram_lookup": lambda s, d: kgram.lookup(_kgrams(s, d), "^q"),
    "kgram_and": lambda s, d: kgram.lookup_all(_kgrams(s, d), ["^t", "th", "g$"]),
    "wildcard_expand": lambda s, d: _index(s, d).expand(WILD),
    "spell_candidates": lambda s, d: spelling.candidates(_vocabulary(s, d), MISSPELT).select("term", "n_word", "n_term", "overlap"),
    "spell_jaccard": lambda s, d: spelling.suggest(_frequencies(s, d), MISSPELT),
    "spell_jaccard_strict": lambda s, d: spelling.suggest(_frequencies(s, d), "keeit", EngineConfig(max_edit=3), strict=True),
    "spell_suggest": _spell_best,
    "spell_suggest_phrase": _spell_phrase,
    "edit_distance": _edit_distance,
    "feedback_weights": lambda s, d: _rounded(_feedback(s, d), "weight"),
    "feedback_rank": _feedback_rank(False),
    "feedback_rank_strict": _feedback_rank(True),
    "graph_outdegree": lambda s, d: links.out_degree(user_links(s, d)),
    "graph_dangling": lambda s, d: links.dangling(doc_links(_docs(s, d)), doc_nodes(_docs(s, d))),
    "links_parse": _links_parse,
    "rank_lines": _rank_lines,
    "pagerank": _pagerank(None),
    "pagerank_fixed10": _pagerank(10),
    "pagerank_top30": lambda s, d: _rounded(links.top(links.pagerank(doc_links(_docs(s, d)), doc_nodes(_docs(s, d)), fixed=10))),
    "mc1": _walks(1, 2),
    "mc2": _walks(2, 2),
    "mc4": _walks(4, 2),
    "mc5": _walks(5, 2),
    "mc_error": _mc_error,
    "hits_base_set": _hits_base,
    "hits_global": lambda s, d: _rounded(links.hits(order_links(s, d), fixed=5), "hub", "authority"),
    "hits_top30": _hits_top,
    "doc_fetch": lambda s, d: _docs(s, d).where("doc_id = 42").select("doc_id", "text"),
    "result_format": _result_format,
    "short_texts": _short_texts,
    "eval_metrics": _eval,
    **formats.QUERIES,
}
