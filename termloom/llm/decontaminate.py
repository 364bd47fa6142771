"""Benchmark decontamination: every passage queries a BM25 index of the test items by block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rows import text_of

K1, B = 1.2, 0.75
#: A passage is a candidate for an item if it covers the least share of the item's own BM25 score that any passage can
#: have which the overlap rule accepts (a bound for each item, see ``_least``); weights are in units of that bound.
THRESHOLD = 1 - 1e-9
#: Word n-grams of the overlap test, and the share of them that must be in the passage.
GRAM, OVERLAP = 5, 0.5
BLOCK = 16  # postings of a block
CELL = 64  # least words of half a passage
#: Items and characters of one index that travels with the tasks; more items are queried in several such blocks.
SHARD_ITEMS, SHARD_CHARS = 50_000, 16_000_000
_CELLS = 2_000_000  # cell sums held at once

_words = re.compile(r"\w+").findall
_sentence = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item in one text: the last sentence is the answer; a single sentence has none."""
    parts = _sentence.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _share(wanted: set, words: list[str]) -> float | None:
    """Share of the wanted n-grams in the passage; None where there are none to look for."""
    if not wanted:
        return None
    n = len(next(iter(wanted)))
    return len(wanted & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(wanted)


def _half(n: int) -> int:
    """Least number of n-grams that makes OVERLAP of ``n``."""
    return math.ceil(OVERLAP * n - 1e-9)


def _least(found: list[tuple[str, ...]], weight: dict[str, float]) -> float:
    """No passage with OVERLAP of these n-grams weighs less: a word's weight is dealt out to the n-grams that hold it,
    so any n-grams' words weigh at least those n-grams' parts, and these at least the smallest ones."""
    held = Counter(t for g in found for t in set(g))
    return sum(sorted(sum(weight[t] / held[t] for t in set(g)) for g in found)[: _half(len(found))])


class ItemIndex:
    """Inverted index of test items. A posting's weight is its BM25 contribution over the item's own score, so that a
    passage's score is the share of the item that it covers, in units of the item's bound (``limits``)."""

    def __init__(self, items: list[tuple], total: int, average: float, frequency: dict[str, int]) -> None:
        self.ids = [i for i, _ in items]
        words = [_words(text.lower()) for _, text in items]
        self.longest = max(map(len, words), default=0)
        self.parts = []
        for _, text in items:
            q, a = (_words(x.lower()) for x in split_item(text))
            self.parts.append((grams(q), grams(a)))
        self.alone = [len(_words(split_item(text)[0].lower())) >= GRAM for _, text in items]
        postings: dict[str, list[tuple[int, float]]] = {}
        self.limits = []
        for n, own in enumerate(words):
            weight = {}
            for term, tf in Counter(own).items():
                idf = math.log(1 + (total - frequency[term] + 0.5) / (frequency[term] + 0.5))
                weight[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / average))
            whole = sum(weight.values())
            q, a = self.parts[n]
            bounds = [_least([*q, *a], weight)] + ([_least([*q], weight)] if self.alone[n] else [])
            limit = min(bounds) / whole if whole else 1.0
            self.limits.append(limit)
            for term, w in weight.items():
                postings.setdefault(term, []).append((n, w / whole / limit))
        self.terms = {t: k for k, t in enumerate(postings)}
        self.items = [np.array([n for n, _ in p]) for p in postings.values()]
        self.weights = [np.array([w for _, w in p]) for p in postings.values()]
        self.top = np.array([w.max() for w in self.weights]) if postings else np.zeros(0)
        self.blocks = [(p[BLOCK - 1 :: BLOCK].tolist() + ([] if len(p) % BLOCK == 0 else [int(p[-1])]), [float(w[i : i + BLOCK].max()) for i in range(0, len(w), BLOCK)]) for p, w in zip(self.items, self.weights, strict=True)]
        # for the bulk bound: lists over a tenth of the items are summed up per item beforehand
        self.common = np.array([len(p) > max(8, len(items) // 10) for p in self.items], bool) if postings else np.zeros(0, bool)
        self.base = np.zeros(len(items))
        for p, w, c in zip(self.items, self.weights, self.common, strict=True):
            if c:
                self.base[p] += w
        self.sizes = np.array([len(p) for p in self.items], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.flat_items = np.concatenate(self.items) if postings else np.zeros(0, np.int64)
        self.flat_weights = np.concatenate(self.weights) if postings else np.zeros(0)
        self.cell = max(CELL, self.longest)
        self.grams = self._needed()

    def _needed(self) -> dict[int, np.ndarray]:
        """Keys, by length, of n-grams of which a passage must hold one or more to be accepted for any item."""
        keys: dict[int, set[int]] = {}
        for n, (q, a) in enumerate(self.parts):
            half = _half(len(q) + len(a))
            # where one part alone is too small for half, an n-gram of the other is needed
            wanted = [q] if half > len(a) else [a] if half > len(q) and not self.alone[n] else [q, a]
            for part in wanted:
                for g in part:
                    keys.setdefault(len(g), set()).add(int(_keys(np.array([self.terms[w] for w in g]), len(g))[0]))
        return {n: np.array(sorted(k), np.uint64) for n, k in keys.items()}

    def _holding(self, ids: np.ndarray) -> np.ndarray:
        """Whether the passage at each cell may hold a needed n-gram."""
        out = np.zeros(-(-len(ids) // self.cell), bool)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, wanted in self.grams.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.zeros(0, np.int64)
            if len(at):
                key = _keys(ids, n)[at]
                k = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                cell = at[wanted[k] == key] // self.cell
                out[cell] = True
                out[np.maximum(cell - 1, 0)] = True
        return out

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms is at least the threshold, by block-max WAND."""
        found = []
        end = len(self.ids)
        # a cursor: [current item, position, term]
        cursors = [[int(self.items[t][0]), 0, t] for t in terms]

        def seek(cursor: list, item: int) -> None:
            own = self.items[cursor[2]]
            cursor[1] += int(np.searchsorted(own[cursor[1] :], item))
            cursor[0] = int(own[cursor[1]]) if cursor[1] < len(own) else end

        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.top[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the pivot item
            bound, next_item = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for c in cursors[: pivot + 1]:
                last, top = self.blocks[c[2]]
                k = c[1] // BLOCK
                while k < len(last) and last[k] < item:
                    k += 1
                if k < len(last):
                    bound += top[k]
                    next_item = min(next_item, last[k] + 1)
            if bound < threshold:
                for c in cursors[: pivot + 1]:
                    if c[0] < next_item:
                        seek(c, max(next_item, item + 1) if next_item <= item else next_item)
            elif cursors[0][0] == item:
                score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, float(score)))
                for c in cursors[: pivot + 1]:
                    seek(c, item + 1)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        seek(c, item)

    def passages(self, ids: np.ndarray) -> list[int]:
        """Cells at which a passage (two neighbouring cells) may be accepted for some item: it holds a needed n-gram,
        and may reach the threshold by an upper bound in bulk, the summed list weights of each cell's distinct terms,
        with common terms counted as present."""
        holding = self._holding(ids)
        if not holding.any():
            return []
        n, items = -(-len(ids) // self.cell), len(self.ids)
        at = np.flatnonzero(ids >= 0)
        term = ids[at]
        rare = ~self.common[term]
        at, term = at[rare], term[rare]
        key = np.unique((at // self.cell) * len(self.top) + term)
        cell, term = key // len(self.top), key % len(self.top)
        out = []
        step = max(1, _CELLS // max(1, items))
        for lo in range(0, n, step):  # one cell more, for the passage across the cut
            k = (cell >= lo) & (cell <= lo + step)
            c, t = cell[k] - lo, term[k]
            count = self.sizes[t]
            index = np.repeat(self.starts[t] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            sums = np.bincount(np.repeat(c, count) * items + self.flat_items[index], self.flat_weights[index], (step + 1) * items if n > step else (n + 1) * items).reshape(-1, items)
            reach = (sums[:-1] + sums[1:] + self.base >= THRESHOLD - 1e-9).any(axis=1)
            out += [lo + int(i) for i in np.flatnonzero(reach) if lo + i < min(n, lo + step) and holding[lo + i]]
        return out

    def matches(self, text: str) -> list[tuple[int, float, float, float]]:
        """Items that the text holds: number, best score, question and answer overlap."""
        words = _words(text.lower())
        if not words or not self.terms:
            return []
        ids = np.fromiter((self.terms.get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple] = {}
        for cell in self.passages(ids):
            lo, hi = cell * self.cell, (cell + 2) * self.cell
            passage = words[lo:hi]
            for item, score in self.retrieve(sorted({int(t) for t in ids[lo:hi] if t >= 0}), THRESHOLD):
                q, a = (_share(g, passage) for g in self.parts[item])
                sizes = [len(g) for g in self.parts[item]]
                whole = ((q or 0.0) * sizes[0] + (a or 0.0) * sizes[1]) / max(1, sum(sizes))
                # halves of both parts are half of the whole, too
                if whole >= OVERLAP or (self.alone[item] and q is not None and q >= OVERLAP):
                    best[item] = max(best.get(item, (0.0,)), (score * self.limits[item], q or 0.0, a or 0.0))
        return [(item, *rest) for item, rest in sorted(best.items())]


def _keys(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of all runs of n ids."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(h)].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def build_indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[ItemIndex]:
    """Indexes of at most SHARD_ITEMS items and about SHARD_CHARS characters each, longest items last.

    Item counts, lengths and document frequencies cover all items, whatever the number of indexes. Null and blank
    items, and repeated ones, are left out.
    """
    rows = items.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).first()
    if not size["n"]:
        return
    terms = rows.select(F.lit(0).alias("x"), "t").mapInArrow(_terms, "x int, term string, n int")
    average = terms.where("term is null").agg(F.avg("n")).first()[0]
    frequency = terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-size["c"] // SHARD_CHARS))
    if shards > 1:
        cuts = rows.agg(F.percentile_approx(F.length("t"), [i / shards for i in range(1, shards)], 10_000)).first()[0]
        rows = rows.withColumn("s", sum((F.when(F.length("t") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    else:
        rows = rows.withColumn("s", F.lit(0))
    # a shard is cut once more by a hash where lengths are tied or its items are long
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).orderBy("s").collect()  # a row a shard
    for s, n, chars in sizes:
        more = max(1, -(-n // (2 * SHARD_ITEMS)), -(-chars // (2 * SHARD_CHARS)))
        for part in range(more):
            own = rows.where((F.col("s") == s) & (F.pmod(F.xxhash64("k", "t"), F.lit(more)) == part))
            known = own.select(F.lit(0).alias("x"), "t").mapInArrow(_terms, "x int, term string, n int").where("term is not null").select("term").distinct()
            df = {r["term"]: r["df"] for r in frequency.join(known, "term").collect()}
            own_items = sorted(((r["k"], r["t"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
            if own_items:
                yield ItemIndex(own_items, size["n"], average, df)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item's distinct terms, and a row with its length."""
    for batch in batches:
        terms, sizes = [], []
        for text in batch.column("t"):
            words = _words(text.as_py().lower())
            distinct = [*set(words), None]
            terms += distinct
            sizes += [len(words)] * len(distinct)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(terms), pa.int32()), pa.array(terms, pa.string()), pa.array(sizes, pa.int32())], ["x", "term", "n"])


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs ``(key, item, score, question_overlap, answer_overlap)`` of documents and the test items they hold.

    Every document is cut into overlapping passages, twice as long as the longest item (two cells of at least CELL
    words), so that an item lies within one passage whole. A passage that holds
    any of the items' n-grams retrieves all items of whose own BM25 score it covers as much as the overlap rule implies,
    and a pair is kept if half of the item's word five-grams are in the passage, or half of the question's alone, where
    the question has GRAM words or more. The best passage counts.

    Of equal scores the earlier passage counts; texts of any length are read whole. Null and empty texts and items match
    nothing; repeated documents are each reported; a null key is reported as
    null. Empty tables give an empty result. Other columns are not read.

    A map over the documents without an exchange. The index travels with the tasks: its size is checked and bounded,
    and further items go into further indexes, each a pass of its own.
    """
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    out = StructType().add(key, kind).add("item_id", item_kind).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
    read = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    found = None
    for index in build_indexes(items, item_key, item_text):
        one = read.mapInArrow(_pairs(docs.sparkSession.sparkContext.broadcast(index), out), out)
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], out) if found is None else found


def _pairs(shared, out: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, index = to_arrow_schema(out), shared.value
        for batch in batches:
            rows = [(key.as_py(), index.ids[item], *rest) for key, text in zip(batch.column("_key"), batch.column("_text"), strict=True) for item, *rest in index.matches(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item by the rule of ``find_leaks``, each with all its columns."""
    for index in build_indexes(items, item_key, item_text):
        docs = docs.where(~_holds(docs.sparkSession.sparkContext.broadcast(index))(text_of(text)))
    return docs


def _holds(shared) -> Column:
    @F.pandas_udf("boolean")
    def holds(texts):
        return texts.map(lambda t: bool(shared.value.matches(t)))

    return holds
