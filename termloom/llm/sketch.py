"""Document fingerprints by a threshold-scaled sketch: every shingle hash below a fixed fraction is retained."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .rows import PIECE, text_of
from .scratch import Scratch

WIDTH = 5  # words of a shingle
FRACTION = 1  # one in so many shingle hashes is retained; beyond one, short texts would have few or none
_KEPT = 300_000
#: Odd multipliers of the word positions and of the mixing step, fixed values.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHash(dict):
    """64-bit hash of a word; a bounded memory of two generations."""

    old: dict = {}

    def __missing__(self, word: str) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = h
        return h


_words = _WordHash()


def retained(text: str, width: int = WIDTH, fraction: int = FRACTION) -> np.ndarray:
    """The distinct hashes, sorted, of the text's shingles that fall below 1/``fraction`` of the hash range.

    Words are split at white space and lower-cased; fewer words than ``width`` make one shingle; no words make none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h += w[i : i + n] * _PLACE[i]
    h ^= h >> np.uint64(30)
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return np.unique(h if fraction == 1 else h[h < np.uint64(2**64 // fraction)])


def render(text: str, hashes: np.ndarray) -> str:
    """``<hash of the whole text>:<retained hashes, sorted, 16 hex digits each>``; equal texts give equal strings."""
    return f"{xxhash.xxh3_64_hexdigest(text)}:{hashes.astype('>u8').tobytes().hex()}"


def hashes_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.partition(":")[2]), ">u8").astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two texts' shingle sets from their fingerprints, 0 to 1.

    Fingerprints of the same text are 1 alike. Where neither retained a hash, nothing but that is known: else 0.
    """
    return _likeness(a, hashes_of(a), b, hashes_of(b))


def _likeness(a: str, ha: np.ndarray, b: str, hb: np.ndarray) -> float:
    if a == b:
        return 1.0
    both = _shared(ha, hb)
    return both / (len(ha) + len(hb) - both) if len(ha) + len(hb) else 0.0


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b has too; sound for texts of very unequal length, as the fraction is fixed."""
    ha, hb = hashes_of(a), hashes_of(b)
    return _shared(ha, hb) / len(ha) if len(ha) else float(a == b)


def merge(a: str, b: str) -> str:
    """The sketch of both texts' shingles together: the union of the retained hashes (the text hash is that of the parts)."""
    return render("\0".join(sorted((a, b))), np.union1d(hashes_of(a), hashes_of(b)))


def edited(text: str, following: str) -> str:
    """The last third (floor) of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """Key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Every text is compared with its edited text and with the next document in descending order of the key; after the
    last comes the first again, so a single document is its own next one. A null text counts as empty; rows with a null
    key come last; rows that share a key are put in order by their text; other columns are not read. An empty table
    gives an empty result.

    One exchange moves each text once. Cut points of the key (as many as the session has shuffle partitions; an
    approximate percentile, of bounded size) deal the rows out in order; the first key of each part, one value a part,
    tells which rows must also be copied to the part before, so every task has the document that follows its last one.
    Tasks then stream over sorted rows, two documents at a time.
    """
    spark = docs.sparkSession
    Scratch(spark, "fingerprint")  # sets the size of Arrow batches
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = -(2**63)
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).withColumn("_order", F.coalesce(F.col("_key").cast("long"), F.lit(least)))
    cuts = rows.agg(F.percentile_approx("_order", [i / parts for i in range(1, parts)] or [0.5], max(1000, 20 * parts)).alias("c")).first()["c"] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def part_of(order):  # part 0 has the largest keys; a binary search, as the cut points may be many
        return order.__class__(len(bounds) - np.searchsorted(bounds, order.to_numpy(), side="right"))

    rows = rows.withColumn("_part", part_of("_order"))
    heads = sorted((r["_part"], r["h"]) for r in rows.groupBy("_part").agg(F.max("_order").alias("h")).collect())  # one value a part
    own = F.struct(F.col("_part").alias("_at"), F.lit(0).alias("_ghost"))
    if heads:
        before = [heads[i - 1][0] for i in range(len(heads))]
        first = spark.createDataFrame([(p, h, b) for (p, h), b in zip(heads, before, strict=True)], "_part int, _head long, _before int")
        # broadcast: never more rows than parts
        rows = rows.join(F.broadcast(first), "_part")
        copy = F.struct(F.col("_before").alias("_at"), F.lit(1).alias("_ghost"))
        copies = F.when(F.col("_order") == F.col("_head"), F.array(own, copy)).otherwise(F.array(own))
    else:
        copies = F.array(own)
    dealt = rows.withColumn("_c", F.explode(copies)).select("_key", "_text", "_order", "_c._at", "_c._ghost")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("_at")).sortWithinPartitions("_at", "_ghost", F.col("_order").desc(), "_text")
    out = StructType([StructField(key, docs.schema[key].dataType)]).add("n_chars", "long").add("edited_sha256", "string")
    out = out.add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    return dealt.mapInArrow(_compare(out, width, fraction), out)


def _compare(out: StructType, width: int, fraction: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        made: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made.clear()
            nonlocal held
            held = 0
            return batch

        def close(now: tuple, following: tuple) -> None:
            key, text, hashes, print_ = now
            changed = edited(text, following[1])
            ch = retained(changed, width, fraction)
            cp = render(changed, ch)
            nonlocal held
            held += len(print_) + len(cp)
            made.append((key, len(text), sha256(changed.encode()).hexdigest(), print_, cp, _likeness(print_, hashes, cp, ch), _likeness(print_, hashes, following[3], following[2])))

        now, at, closed = None, None, True
        for batch in batches:
            for key, text, where, ghost in zip(*(batch.column(n) for n in ("_key", "_text", "_at", "_ghost")), strict=True):
                if ghost.as_py() and (closed or where.as_py() != at):
                    continue  # a later copy of the first row, or a part without rows of its own
                value = text.as_py()
                hashes = retained(value, width, fraction)
                here = (key.as_py(), value, hashes, render(value, hashes))
                if not closed and where.as_py() == at:
                    close(now, here)
                closed = bool(ghost.as_py())
                now, at = here, where.as_py()
                if len(made) >= 500 or held >= PIECE:
                    yield flush()
        if made:
            yield flush()

    return run
