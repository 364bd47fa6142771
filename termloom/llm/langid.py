"""Language identification by Bayesian fusion of text, declared language, address suffix and host evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rows import pieces
from .scratch import Scratch

BUCKETS = 1 << 14
#: At most about so many labelled rows fit the text model, dealt out evenly to the languages, but LEAST to each (a
#: documented bound; everything else, the set of languages too, covers all rows).
SAMPLE, LEAST = 20_000, 200
#: A text counts as at most so many independent trigrams, as neighbouring ones repeat each other.
EVIDENCE = 40.0
#: Probability that a declared language is the true one.
DECLARED = 0.9
#: Probability that a text is in none of the fitted languages; its trigrams are then equally likely in all buckets.
UNKNOWN = 0.01
#: Weight, in documents, of the suffix's share within a host's, and of the global share within a suffix's.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
_CHUNK = 1 << 17
_ASCII_LETTER = np.array([chr(c).isalpha() for c in range(128)])


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's letter trigrams, lower-cased, with runs of anything else as one blank; in chunks."""
    for start in range(0, len(text), _CHUNK):
        part = f" {text[start : start + _CHUNK]} ".lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = c >= 128
        low = ~letter
        letter[low] = _ASCII_LETTER[c[low]]
        c = np.where(letter, c, 32).astype(np.uint64)
        keep = letter | np.concatenate([[True], letter[:-1]])
        c = c[keep]
        if len(c) < 3:
            continue
        h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA6B) + c[2:]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        yield h.astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log probability of every trigram bucket in every language; languages x BUCKETS, whatever the corpus."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def evidence(self, text: str) -> np.ndarray | None:
        """Tempered log likelihood of each language and, last, of none of them; None where the text has no letters."""
        total, n = np.zeros(len(self.languages)), 0
        for h in trigrams(text):
            total += np.bincount(h, minlength=BUCKETS).astype(np.float32) @ self.log_p.T if len(h) > BUCKETS else self.log_p[:, h].sum(axis=1)
            n += len(h)
        return np.append(total, -n * np.log(BUCKETS)) * min(1.0, EVIDENCE / n) if n else None


def fit(docs: DataFrame, label: str, key: str, text: str = "text", sample: int = SAMPLE) -> TextModel:
    """Naive Bayes over hashed trigrams, fitted on the labelled rows whose hash falls below a threshold of their
    language, which makes them about ``sample`` over the number of languages, or LEAST, at most; every language whose
    label stands at a text with letters has a model. Labels are read like declarations: ``fr-CA`` and ``FR`` are ``fr``;
    those that are not two letters name no language, so there are 676 at most. Counts are summed by the cluster;
    languages x BUCKETS sums reach the driver."""
    code = _declared_code(F.col(label))
    labelled = docs.where(code.rlike("^[a-z]{2}$") & F.col(text).rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")).select(code.alias("l"), F.col(text).alias("t"), F.xxhash64(key, label, text).alias("h"))
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}  # one value a language
    bound = max(LEAST, sample // max(1, len(sizes)))
    cuts = {name: int((1 << 30) * bound / n) for name, n in sizes.items() if n > bound}
    if cuts:
        cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])[F.col("l")]
        labelled = labelled.where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(cut, F.lit(1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                into = tables.setdefault(name.as_py(), np.zeros(BUCKETS, np.int64))
                for h in trigrams(value.as_py()):
                    into += np.bincount(h, minlength=BUCKETS)
        for name, counts in tables.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(at), pa.string()), "b": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    sums = labelled.select("l", "t").mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sums["l"].unique()))
    counts = np.zeros((len(languages), BUCKETS))
    for i, name in enumerate(languages):
        own = sums[sums["l"] == name]
        counts[i, own["b"].to_numpy(np.int64)] = own["n"].to_numpy(np.float64)
    counts += 0.5
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host name; a name without dots has the empty suffix."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1))).otherwise("")


def _declared_code(declared: Column) -> Column:
    """``fr-CA`` and ``FR`` declare ``fr``."""
    return F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]+)", 1))


def _score(model: Broadcast, kept: list[str], out: StructType, with_prior: bool, text: str = "", voting: bool = False):
    """Adds language and confidence to a batch's rows. The text is the column ``_text`` or, so that it is not moved
    twice, the field ``text`` of the caller's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        languages = model.value.languages
        index = {name: i for i, name in enumerate(languages)}
        known = len(languages)
        agree, differ = np.log(DECLARED), np.log((1 - DECLARED) / max(1, known - 1))
        # a text in no fitted language may declare any of them or another
        said_by = [np.append(np.where(np.arange(known) == i, agree, differ), -np.log(known + 1)) for i in range(known)]
        for batch in pieces(batches):
            texts = batch.column("_row").field(text) if "_row" in kept else batch.column("_text")
            declared = batch.column("_declared")
            priors = batch.column("_prior") if with_prior else [None] * batch.num_rows
            found: list[tuple] = []
            for value, said, prior in zip(texts, declared, priors, strict=True):
                seen = model.value.evidence(value.as_py() or "") if languages else None
                if seen is None:
                    found.append((None, 0.0))
                    continue
                i = index.get(said.as_py())
                if i is not None:
                    seen = seen + said_by[i]
                if prior is not None:
                    p = np.asarray(prior.as_py())
                    # the row's own vote does not count for itself
                    vote = int(np.argmax(seen))
                    counts, back = p[:known].copy(), p[known:]
                    if vote < known:
                        counts[vote] = max(0.0, counts[vote] - 1)
                    shares = (counts + HOST_WEIGHT * back) / (counts.sum() + HOST_WEIGHT)
                    seen = seen + np.log(np.append((1 - UNKNOWN) * shares, UNKNOWN))
                q = np.exp(seen - seen.max())
                best = int(np.argmax(q[:known]))
                # a vote for none of the languages is no vote
                none = voting and q[known] > q[best]
                found.append((None if none else languages[best], float(q[best] / q.sum())))
            arrays = [x for n in kept for x in (batch.column(n).flatten() if n == "_row" else [batch.column(n)])]
            arrays = [x.cast(schema.field(i).type) for i, x in enumerate(arrays)]
            arrays += [pa.array(c, schema.field(len(arrays) + i).type) for i, c in enumerate(zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def identify(
    docs: DataFrame, declared: Column, host: Column, label: str, key: str, text: str = "text", model: TextModel | None = None, sample: int = SAMPLE, name: str = "langid"
) -> DataFrame:
    """All columns of ``docs`` and ``_language``, ``_confidence``: the most probable language of every row's whole text
    and its posterior probability, beside the other languages' and that of a text in none of them (see UNKNOWN).

    The evidence multiplied per language: the likelihood of the letter trigrams (tempered, see EVIDENCE), the declared
    language (right with probability DECLARED; null or unknown: no evidence), and the host's prior, which is smoothed
    towards that of the address suffix, and that towards the whole corpus. The priors are grouped counts over all rows
    of each row's vote (text and declared language alone; a text in none of the languages has none); a row's own vote is
    taken out of its host's counts.

    Texts of any length are read whole, a piece at a time. A text without letters, null or empty, has no language (null) and confidence 0. A null host shares one prior.
    Ties go to the language first in the alphabet. Repeated rows and null keys stay; an empty table stays empty. Other
    columns pass through, except ones named ``_language`` or ``_confidence``, which are replaced.

    Two passes over the texts: votes, then the fusion. Host counts are partial aggregates, so a hot host is reduced
    before the exchange; the prior table is written, so the planner knows its size and broadcasts it only if small;
    else it is joined by an exchange whose hot hosts adaptive execution splits.
    """
    spark = docs.sparkSession
    docs = docs.drop("_language", "_confidence")
    if model is None:
        model = fit(docs, label, key, text, sample)
    shared = spark.sparkContext.broadcast(model)
    n = len(model.languages)
    # the caller's columns travel in one struct, so that none of their names can clash with those used here
    base = docs.select(F.struct("*").alias("_row"), F.coalesce(host, F.lit("")).alias("_host"), _declared_code(declared).alias("_declared"))
    text_of_row = F.coalesce(F.col("_row")[text], F.lit(""))
    vote_type = StructType().add("_host", "string").add("_language", "string").add("_confidence", "double")
    votes = base.select("_host", "_declared", text_of_row.alias("_text")).mapInArrow(_score(shared, ["_host"], vote_type, False, voting=True), vote_type)
    sums = [F.count(F.when(F.col("_language") == name, 1)).cast("double").alias(f"n{i}") for i, name in enumerate(model.languages)]
    scratch = Scratch(spark, name)
    if n:
        names = [f"n{i}" for i in range(n)]
        hosts = scratch.save(votes.groupBy("_host").agg(*sums).withColumn("_suffix", suffix_of(F.col("_host"))))
        whole = hosts.agg(*[F.sum(c).alias(c) for c in names]).first()
        counts = np.array([whole[c] or 0.0 for c in names]) + 1.0
        everywhere = counts / counts.sum()
        suffix = hosts.groupBy("_suffix").agg(*[F.sum(c).alias(f"s{c}") for c in names])
        size = sum((F.col(f"s{c}") for c in names), F.lit(0.0))
        back = [((F.col(f"s{c}") + float(SUFFIX_WEIGHT * everywhere[i])) / (size + SUFFIX_WEIGHT)).alias(f"b{i}") for i, c in enumerate(names)]
        suffix = suffix.select("_suffix", *back)
        prior = hosts.join(suffix, "_suffix").select("_host", F.array(*names, *[f"b{i}" for i in range(n)]).alias("_prior"))
        base = base.join(scratch.save(prior), "_host", "left")
    out = StructType([*docs.schema.fields]).add("_language", "string").add("_confidence", "double")
    return base.mapInArrow(_score(shared, ["_row"], out, bool(n), text), out)
