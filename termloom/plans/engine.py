"""The facade: one object that answers queries of every type over an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, QueryType, Ranking
from ..durable import Scratch
from ..functions.text import parse_query
from ..operators import feedback as fb
from ..operators import links, search, spelling
from ..operators.index import Index, token_arrays


class SearchEngine:
    """Answers queries from a stored ``Index``, optionally with a link graph between documents and precomputed ranks
    ``(doc_id, score)``. ``docs(doc_id, text)`` is read only to show a document and for the terms of feedback."""

    def __init__(self, index: Index, docs: DataFrame, config: EngineConfig | None = None, ranks: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        self.index, self.docs, self.config, self.ranks, self.edges = index, docs, config or EngineConfig(), ranks, edges

    @classmethod
    def over(cls, docs: DataFrame, path: str | None = None, config: EngineConfig | None = None, **more) -> SearchEngine:
        """Index ``docs`` first, at ``path`` or in a folder of the session's shared store."""
        config = config or EngineConfig()
        built = Index.build(docs, path or Scratch(docs.sparkSession, "index").root, config.tokenizer, k=config.k)
        return cls(built, docs, config, **more)

    def missing(self, text: str) -> list[str]:
        return sorted(r["term"] for r in search.missing_terms(self.index.terms, parse_query(text)).collect())

    def search(self, text: str | list[tuple[str, float]], kind: QueryType = QueryType.INTERSECTION, ranking: Ranking = Ranking.TF_IDF, gate: bool = True) -> DataFrame:
        """``(doc_id, score)``. With ``gate``, a word that no document has makes the result empty."""
        slots = search.weights_of(parse_query(text) if isinstance(text, str) else text)
        words = [s for s, _ in slots]
        empty = self.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        if not words or gate and search.missing_terms(self.index.terms, words).limit(1).count():
            return empty
        if kind is QueryType.PHRASE:
            return search.phrase(self.index.occurrences(words), words).select("doc_id", F.lit(1.0).alias("score"))
        counts = self.index.frequencies(words)
        if kind is QueryType.INTERSECTION:
            return search.boolean_and(counts, words).select("doc_id", F.lit(1.0).alias("score"))
        if ranking is Ranking.TF_IDF:
            return self._tf_idf(counts, slots)
        if ranking is Ranking.HITS:
            if self.edges is None:
                raise ValueError("this ranking needs links between documents")
            return hits_ranking(search.boolean_or(counts, words), self.edges)
        if self.ranks is None:
            raise ValueError("this ranking needs ranks")
        if ranking is Ranking.PAGERANK:
            return search.by_rank(search.boolean_or(counts, words), self.ranks)
        return search.combined(self._tf_idf(counts, slots), self.ranks, self.config.pagerank_weight)

    def _tf_idf(self, counts: DataFrame, slots: list[tuple[str, float]]) -> DataFrame:
        return search.tf_idf_of(counts, self.index.docs.agg(F.count("*").alias("n")), slots, self.config.integer_idf)

    def suggest(self, text: str, limit: int = 10) -> list[str]:
        words = parse_query(text)
        stored = self.config.k == self.index.k
        return spelling.suggest_query(self.index.counts, self.index.terms, words, limit, self.config, self.index.grams if stored else None)

    def feedback(self, text: str, ranked: list[int], marks: list[bool]) -> list[tuple[str, float]]:
        """The expanded query, to be searched like any other."""
        found = fb.feedback_weights(token_arrays(self.docs, self.config.tokenizer), parse_query(text), ranked, marks, self.config)
        return [(r["term"], r["weight"]) for r in found.orderBy("term").collect()]  # terms of ten documents at most

    def page(self, result: DataFrame, first: int = 1, last: int = 10) -> DataFrame:
        return search.page(result, first, last)

    def document(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)


def hits_ranking(root: DataFrame, edges: DataFrame, fixed: int | None = None) -> DataFrame:
    """Documents of the root's neighbourhood by half hub and half authority; documents outside the graph have none."""
    known = links.nodes_of(links.clean(edges))
    ids = root.select(F.col("doc_id").alias("id")).join(known, "id", "left_semi")
    scores = links.hits(edges, links.base_set(edges, ids), fixed=fixed)
    return links.hits_score(scores).withColumnRenamed("id", "doc_id")
