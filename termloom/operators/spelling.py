"""Spelling suggestions: shared k-grams, likeness, edit distance, collection frequency; phrases by a beam."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.distance import indel_distance, jaccard, kgrams


def grams_of(word: str, k: int) -> list[str]:
    """K-grams of a word as asked, without padding, in order and with repeats."""
    return [word[i : i + k] for i in range(len(word) - k + 1)]


def candidates(vocabulary: DataFrame, word: str, k: int = 2) -> DataFrame:
    """The rows of ``vocabulary(term, ...)`` that share at least one of the word's k-grams, with the sizes of both words'
    sets of k-grams and of their intersection, and ``jaccard``. Neither word is padded, so a word is wholly like itself."""
    own = list(dict.fromkeys(grams_of(word, k)))
    mine = F.array(*[F.lit(g) for g in own]) if own else F.array().cast("array<string>")
    theirs = kgrams(F.col("term"), k, padded=False, distinct=True)
    found = vocabulary.withColumns({"mine": mine, "theirs": theirs}).where(F.arrays_overlap("mine", "theirs"))
    overlap = F.size(F.array_intersect("mine", "theirs"))
    return found.select(*vocabulary.columns, F.size("mine").alias("n_word"), F.size("theirs").alias("n_term"), overlap.alias("overlap"), jaccard(F.col("mine"), F.col("theirs")).alias("jaccard"))


def suggest(frequencies: DataFrame, word: str, config: EngineConfig | None = None, strict: bool = False) -> DataFrame:
    """``(term, cf)`` of the accepted candidates. ``frequencies``: ``(term, cf)``, read once.

    ``strict`` takes the likeness formula as first written, which compares sizes only, repeats included, and sets the
    term's size for the intersection's: size / (asked + 2 x size). The edit distance is worked out last, for terms whose
    length and likeness allow them.
    """
    config = config or EngineConfig()
    asked, size = len(grams_of(word, config.k)), F.length("term") - (config.k - 1)
    score = F.when(size >= 1, size / (asked + 2 * size)) if strict else F.col("jaccard")
    likely = candidates(frequencies, word, config.k).where(score >= config.jaccard)
    near = likely.where(F.abs(F.length("term") - len(word)) <= config.max_edit).where(indel_distance(F.lit(word), F.col("term")) <= config.max_edit)
    return near.select("term", "cf")


def suggest_stored(grams: DataFrame, word: str, config: EngineConfig | None = None) -> DataFrame:
    """``suggest`` over a stored index's ``grams(gram, term, n, cf)``: only the word's k-grams are read."""
    config = config or EngineConfig()
    own = list(dict.fromkeys(grams_of(word, config.k)))
    shared = grams.where(F.col("gram").isin(*own) if own else F.lit(False)).where(F.abs(F.length("term") - len(word)) <= config.max_edit)
    likely = shared.groupBy("term", "n", "cf").agg(F.count("*").alias("overlap")).where(F.col("overlap") / (len(own) + F.col("n") - F.col("overlap")) >= config.jaccard)
    return likely.where(indel_distance(F.lit(word), F.col("term")) <= config.max_edit).select("term", "cf")


def best(suggested: DataFrame, limit: int = 10) -> list[str]:
    """The ``limit`` most frequent suggestions."""
    return [r["term"] for r in suggested.orderBy(F.desc("cf"), "term").limit(limit).collect()]


def suggest_query(toks: DataFrame, frequencies: DataFrame, words: list[str], limit: int = 10, config: EngineConfig | None = None, grams: DataFrame | None = None) -> list[str]:
    """Corrections of a whole query, best first: known words stay, unknown ones are replaced; prefixes are extended slot
    by slot and cut to the ``limit`` that most documents hold. With ``grams`` of a stored index, suggestions come from there."""
    known = {r["term"] for r in frequencies.where(F.col("term").isin(*words)).select("term").collect()} if words else set()
    slots = [[w] if w in known else best(suggest(frequencies, w, config) if grams is None else suggest_stored(grams, w, config), limit) for w in words]
    if not slots or any(not s for s in slots):
        return []
    beam: list[tuple[str, ...]] = [(t,) for t in slots[0][:limit]]
    for i, slot in enumerate(slots[1:], 1):
        beam = [p + (t,) for p in beam for t in slot]
        if len(slot) > 1 or i == len(slots) - 1:
            counts = _documents_with(toks, beam)
            beam = sorted(beam, key=lambda p: (-counts[p], p))[:limit]
    return [" ".join(p) for p in beam]


def _documents_with(toks: DataFrame, phrases: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Documents that hold all words of each phrase, for all phrases (at most the square of the limit) in one scan."""
    words = sorted({w for p in phrases for w in p})
    flags = toks.where(F.col("term").isin(*words)).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(f"w{i}") for i, w in enumerate(words)])
    at = {w: i for i, w in enumerate(words)}
    every = []
    for n, p in enumerate(phrases):
        both = F.lit(True)
        for w in p:
            both = both & F.col(f"w{at[w]}")
        every.append(F.count(F.when(both, 1)).alias(f"p{n}"))
    row = flags.agg(*every).first()
    return {p: row[f"p{n}"] for n, p in enumerate(phrases)}


__all__ = ["best", "candidates", "grams_of", "suggest", "suggest_query"]
