"""Boolean, phrase and ranked evaluation. A query slot is a condition on the term, so neither vocabulary nor postings
are ever gathered: a scan of the occurrences, one partial aggregate by document, and no join but to small results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def slot_condition(slot: str, term: Column | None = None) -> Column:
    """Occurrences that a query word stands for: the term itself, or all terms that its wildcards match."""
    term = F.col("term") if term is None else term
    return term.rlike(glob_regex(slot)) if "*" in slot else term == slot


def any_slot(slots: list[str]) -> Column:
    plain = [s for s in slots if "*" not in s]
    parts = ([F.col("term").isin(*plain)] if plain else []) + [slot_condition(s) for s in slots if "*" in s]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def missing_terms(toks: DataFrame, slots: list[str]) -> DataFrame:
    """Query words without wildcards that no document has; any of them makes a search end empty."""
    words = list(dict.fromkeys(s for s in slots if "*" not in s))
    spark = toks.sparkSession
    asked = spark.sql("SELECT explode(array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")) AS term") if words else spark.createDataFrame([], "term string")
    there = toks.where(F.col("term").isin(*words)).select("term").distinct() if words else toks.select("term").limit(0)
    return asked.join(there, "term", "left_anti")


def boolean_and(toks: DataFrame, slots: list[str]) -> DataFrame:
    """Documents with every slot, by one aggregate of flags."""
    flags = [F.max(slot_condition(s)).alias(f"s{i}") for i, s in enumerate(slots)]
    found = toks.where(any_slot(slots)).groupBy("doc_id").agg(*flags)
    return found.where(reduce(lambda a, b: a & b, [F.col(f"s{i}") for i in range(len(slots))], F.lit(True))).select("doc_id")


def boolean_and_strict(toks: DataFrame, slots: list[str]) -> DataFrame:
    """As ``boolean_and``, but an intersection that has run empty is replaced by the next slot's documents."""
    flags = [F.max(slot_condition(s)).alias(f"s{i}") for i, s in enumerate(slots)]
    docs = toks.where(any_slot(slots)).groupBy("doc_id").agg(*flags)
    start = 0
    if len(slots) > 1:
        # for every run of slots from i to j: is there a document with all of them?
        runs = {(i, j): reduce(lambda a, b: a & b, [F.col(f"s{k}") for k in range(i, j + 1)]) for i in range(len(slots)) for j in range(i, len(slots))}
        some = docs.agg(*[F.max(c).alias(f"r{i}_{j}") for (i, j), c in runs.items()]).first()
        for j in range(1, len(slots)):
            if not some[f"r{start}_{j - 1}"]:
                start = j
    keep = reduce(lambda a, b: a & b, [F.col(f"s{k}") for k in range(start, len(slots))], F.lit(True))
    return docs.where(keep).select("doc_id")


def boolean_or(toks: DataFrame, slots: list[str]) -> DataFrame:
    return toks.where(any_slot(slots)).select("doc_id").distinct()


def phrase(toks: DataFrame, slots: list[str]) -> DataFrame:
    """Documents in which the slots occur at consecutive offsets: occurrences agree on offset minus slot number."""
    if len(slots) > 63:
        raise ValueError("a phrase has 63 words at most")
    numbers = F.array_compact(F.array(*[F.when(slot_condition(s), i) for i, s in enumerate(slots)]))
    hits = toks.where(any_slot(slots)).select("doc_id", "off", F.explode(numbers).alias("slot"))
    # a bit for each slot seen at this start; a slot can be seen but once there
    whole = (1 << len(slots)) - 1
    starts = hits.groupBy("doc_id", (F.col("off") - F.col("slot")).alias("start")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))).alias("seen"))
    return starts.where(F.col("seen") == whole).select("doc_id").distinct()


def weights_of(slots: list[str] | list[tuple[str, float]]) -> list[tuple[str, float]]:
    return [s if isinstance(s, tuple) else (s, 1.0) for s in slots]


def term_weight(slots: list[tuple[str, float]]) -> Column:
    """Summed weight of a term over all slots that stand for it; a word asked twice counts twice."""
    plain: dict[str, float] = {}
    for s, w in slots:
        if "*" not in s:
            plain[s] = plain.get(s, 0.0) + w
    total = F.lit(0.0)
    for s, w in plain.items():
        total = total + F.when(F.col("term") == s, w).otherwise(0.0)
    for s, _ in (x for x in slots if "*" in x[0]):
        total = total + F.when(slot_condition(s), 1.0).otherwise(0.0)
    return total


def idf(n: Column, df: Column, integer: bool = True) -> Column:
    return F.log10(F.floor(n / df).cast("double")) if integer else F.log10(n / df)


def tf_idf(arrays: DataFrame, slots: list, integer: bool = True) -> DataFrame:
    """``(doc_id, score)`` from ``(doc_id, terms)``, without a stored index; see ``tf_idf_of``."""
    words = [s for s, _ in weights_of(slots)]
    exploded = arrays.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).where(any_slot(words))
    return tf_idf_of(exploded.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")), arrays.agg(F.count("*").alias("n")), slots, integer)


def tf_idf_of(tf: DataFrame, n: DataFrame, slots: list, integer: bool = True) -> DataFrame:
    """``(doc_id, score)`` of every document with at least one slot: sum of idf x weight x tf / length. ``tf``: the counts
    of the slots' terms with their documents' lengths; ``n``: one row, the number of documents."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    share = idf(F.col("n"), F.col("df"), integer) * term_weight(weights_of(slots)) * F.col("tf") / F.col("len")
    return tf.join(df, "term").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.sum(share).alias("score"))  # n: one row


def by_rank(candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """Candidates scored by a precomputed rank; a document without one has rank 0."""
    return candidates.join(ranks.select("doc_id", F.col("score").alias("_r")), "doc_id", "left").select("doc_id", F.coalesce("_r", F.lit(0.0)).alias("score"))


def combined(scored: DataFrame, ranks: DataFrame, weight: float = 0.007) -> DataFrame:
    """``weight`` x rank + (1 - ``weight``) x text score."""
    r = ranks.select("doc_id", F.col("score").alias("_r"))
    return scored.join(r, "doc_id", "left").select("doc_id", (F.lit(weight) * F.coalesce("_r", F.lit(0.0)) + (1 - weight) * F.col("score")).alias("score"))


def page(scored: DataFrame, first: int = 1, last: int = 10) -> DataFrame:
    """Results ``first`` to ``last`` by descending score (to nine digits), ties by document; only the best are kept by
    each task before they meet."""
    top = scored.withColumn("_o", F.round("score", 9)).orderBy(F.desc("_o"), "doc_id").limit(last).drop("_o")
    place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id"))  # over `last` rows at most
    return top.withColumn("rank", place).where(F.col("rank") >= first)


def result_lines(page_: DataFrame, names: DataFrame) -> DataFrame:
    """Numbered result lines with name and five-digit score."""
    return page_.join(names.select("doc_id", "name"), "doc_id").select("rank", F.format_string("%d. %s   %.5f", "rank", "name", "score").alias("line"))
