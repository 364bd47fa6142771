"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, forest
from .rows import map_columns, text_of
from .scratch import Scratch
from .settle import settle

_CHUNK = 1 << 16  # hashes unpacked at once


def _words(text: str) -> list[bytes]:
    """Words in UTF-8: there, ``lower`` changes A-Z only, and ``split`` cuts at blanks and the characters 9 to 13 only."""
    return text.encode().lower().split()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle in order: ``width`` words joined by blanks, all words where there are fewer."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i : j - 1], 42) for i, j in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash: bit b is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of all shingles, repeats included: A-Z is lower-cased; words are split at blanks and the control
    characters 9 to 13; a text without words has fingerprint zero.
    """
    return majority(shingle_hashes(text, width))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def trie_pairs(x: np.ndarray, starts: np.ndarray, mids: np.ndarray, ends: np.ndarray, used: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Traverse many pairs of trie nodes together; returns positions (i, j) in ``x`` of the leaves that pair up.

    ``x`` holds 64-bit strings; a node is a run of sorted strings with a common prefix. Pair k stands for node
    ``x[starts[k]:mids[k]]`` with node ``x[mids[k]:ends[k]]``, or for a node with itself where mids[k] == ends[k]; its
    strings already differ in ``used[k]`` of the first ``depth`` bits. Each step descends one bit, adds one to the
    differences of the crossed children and drops every pair beyond ``budget``.
    """
    itself = mids == ends
    la, ha = starts, mids
    lb, hb = np.where(itself, starts, mids), np.where(itself, mids, ends)
    found_a, found_b = [], []
    for bit in range(depth, 65):
        # leaves against leaves are decided at once by counting the bits in which they differ
        single = ~itself & (ha - la == 1) & (hb - lb == 1)
        if single.any():
            i, j = la[single], lb[single]
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            found_a.append(i[near])
            found_b.append(j[near])
            keep = ~single
            la, ha, lb, hb, used, itself = la[keep], ha[keep], lb[keep], hb[keep], used[keep], itself[keep]
        if not len(la) or bit == 64:
            break
        ones = np.concatenate([[0], np.cumsum((x >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])  # where the ones begin
        cross_used = used + 1
        child = [
            (la, ma, lb, mb, used, itself),
            (ma, ha, mb, hb, used, itself),
            (la, ma, mb, hb, cross_used, np.zeros_like(itself)),
            (ma, ha, lb, mb, cross_used, itself),  # of a node with itself this repeats the former: dropped below
        ]
        cols = [np.concatenate([c[k] for c in child]) for k in range(6)]
        again = np.concatenate([np.zeros(3 * len(la), bool), itself])
        la, ha, lb, hb, used, itself = cols
        keep = (used <= budget) & ~again & (ha > la) & (hb > lb) & (~itself | (ha - la > 1))
        la, ha, lb, hb, used, itself = la[keep], ha[keep], lb[keep], hb[keep], used[keep], itself[keep]
    empty = np.zeros(0, np.int64)
    return np.concatenate(found_a or [empty]), np.concatenate(found_b or [empty])


#: Bits of the three blocks: with at most two differing bits, one block agrees, so each pair meets in a rotation.
_BLOCKS = ((0, 22), (22, 21), (43, 21))
_STEP = 8
#: Strings that one group may hold in a task's memory; larger groups go down the trie as rows first.
GROUP = 2048


def _rotate(x, by: int):
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _bits(x, start: int, width: int):
    return F.shiftrightunsigned(x, 64 - start - width).bitwiseAND((1 << width) - 1)


def near_pairs(prints: DataFrame, scratch: Scratch, budget: int = 2, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` between distinct 64-bit values ``prints(fp)`` that keep every component of the relation
    "differs in at most ``budget`` (0 to 2) bits".

    The binary trie over the bit strings is joined with itself. Its top is dealt out over the cluster: the strings are
    rotated so that each of three blocks comes first once; a pair within the budget agrees in one block, so it meets
    below one node of one rotation. A node pair of at most ``group`` strings is traversed in one task, many pairs of
    nodes at a time in numpy, and pruned at the budget. A larger node pair descends eight bits as rows: every child
    pair within the remaining budget becomes a group of its own, again measured, until all fit; at the full depth a
    node holds one string, so every group comes to fit. Strings that meet nothing drop out by the count of their group.
    """
    width = dict(_BLOCKS)
    level = prints.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("turn"), _rotate(F.col("fp"), n).alias("x"), F.lit(width[n]).alias("depth")) for n in width])).alias("r")
    ).select("r.*")
    level = level.select("turn", "depth", F.when(F.col("turn") == 0, _bits(F.col("x"), 0, 22)).otherwise(_bits(F.col("x"), 0, 21)).alias("p"), "x")
    level = level.withColumns({"q": F.col("p"), "side": F.lit(0), "used": F.lit(0)})
    key = ["turn", "depth", "p", "q"]
    links: DataFrame | None = None
    while True:
        counts = level.groupBy(*key).agg(F.sum(1 - F.col("side")).alias("left"), F.sum("side").alias("right"))
        viable = F.when(F.col("p") == F.col("q"), F.col("left") > 1).otherwise((F.col("left") > 0) & (F.col("right") > 0))
        sizes = scratch.save(counts.where(viable).withColumn("big", F.col("left") + F.col("right") > group).drop("left", "right"))
        here = level.join(sizes, key)
        small = here.where(~F.col("big")).drop("big")
        dealt = small.repartition(*key).sortWithinPartitions(*key, "side", F.col("x").bitwiseXOR(F.lit(-(1 << 63))))
        found = dealt.mapInPandas(_traverse(budget), "a long, b long")
        links = scratch.save(found if links is None else found.unionByName(links))
        if not sizes.where("big").limit(1).count():
            return links.distinct()
        level = scratch.save(_descend(here.where("big").drop("big"), budget))


def _descend(rows: DataFrame, budget: int) -> DataFrame:
    """Eight bits down: a string joins every child pair whose accumulated difference is within the budget."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << _STEP) if m.bit_count() <= budget])
    step = F.least(F.lit(_STEP), 64 - F.col("depth"))
    own = F.expr(f"shiftrightunsigned(x, 64 - depth - least({_STEP}, 64 - depth)) & (shiftleft(1L, least({_STEP}, 64 - depth)) - 1)")
    wide = rows.withColumn("own", own).withColumn("step", step).withColumn("m", F.explode(masks))
    wide = wide.where("used + bit_count(m) <= " + str(budget)).where("m < shiftleft(1L, step)")
    mine = F.expr("shiftleft(p, step) | own")
    # a node with itself: its child pairs are unordered, the smaller child on the left
    same = F.col("p") == F.col("q")
    other = F.expr("own ^ m")
    left = F.when(same, F.least("own", other)).otherwise(F.when(F.col("side") == 0, F.col("own")).otherwise(other))
    right = F.when(same, F.greatest("own", other)).otherwise(F.when(F.col("side") == 0, other).otherwise(F.col("own")))
    side = F.when(same, F.when(F.col("own") > other, 1).otherwise(0)).otherwise(F.col("side"))
    return wide.withColumns({"_l": left, "_r": right, "_s": side}).select(
        "turn",
        (F.col("depth") + F.col("step")).cast("int").alias("depth"),
        F.expr("shiftleft(p, step) | _l").alias("p"),
        F.expr("shiftleft(q, step) | _r").alias("q"),
        "x",
        F.col("_s").cast("int").alias("side"),
        F.expr("cast(used + bit_count(m) as int)").alias("used"),
    )


def _traverse(budget: int):
    """Traverses the groups of a partition, some ten thousand strings at a time; groups arrive sorted and whole."""

    def solve(turn, depth, p, q, side, used, x) -> Iterator:
        import pandas as pd

        order = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (depth[1:] != depth[:-1])]))
        ends = np.append(order[1:], len(x))
        ones = np.concatenate([[0], np.cumsum(side, dtype=np.int64)])
        mids = ends - (ones[ends] - ones[order])
        for d in np.unique(depth[order]):
            k = depth[order] == d
            i, j = trie_pairs(x, order[k], mids[k], ends[k], used[order[k]].astype(np.int64), int(d), budget)
            if len(i):
                by = turn[i].astype(np.uint64)
                back = lambda v: (v >> by) | (v << ((np.uint64(64) - by) % np.uint64(64)))
                a, b = forest(_signed(back(x[i])), _signed(back(x[j])))
                yield pd.DataFrame({"a": a, "b": b})

    def run(batches: Iterator) -> Iterator:
        names = ["turn", "depth", "p", "q", "side", "used", "x"]
        held: list = []
        rows = 0
        for batch in batches:
            held.append([batch[n].to_numpy() for n in names])
            rows += len(batch)
            if rows < 20_000:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            key = columns[:4]
            # the last group may go on in the next batch
            last = np.ones(rows, bool)
            for c in key:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            held = [[c[cut:] for c in columns]]
            if cut:
                columns = [c[:cut] for c in columns]
                yield from solve(*columns[:6], columns[6].view(np.uint64))
            rows -= cut
        if rows:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from solve(*columns[:6], columns[6].view(np.uint64))

    return run


def fingerprints(docs: DataFrame, width: int = 3, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Key columns and ``fp``, the fingerprint of the whole text as a signed long; a null text counts as empty."""

    def make(texts: pa.Array) -> dict[str, list]:
        values = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return {"fp": pa.array(_signed(values))}

    return map_columns(docs, list(keys), text_of(text), make, "fp long")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, key: str = "doc_id", text: str = "text", name: str = "simhash") -> DataFrame:
    """One row for each row of ``docs``: its key, ``fp`` and ``component_id``, the smallest key reachable over links
    between fingerprints that differ in at most ``budget`` bits.

    Texts of any length are read whole, their hashes counted a chunk at a time. Texts without words (null and empty ones
    too) have fingerprint zero and are linked like any other. Rows with equal
    fingerprints are one node of the join, so copies are never paired; repeated rows come out as often as they went in.
    A null key is kept; it is a component's id only where the component has no other key. Other columns are not read.
    An empty table gives an empty result. Nothing but counts reaches the driver.
    """
    scratch = Scratch(docs.sparkSession, name)
    prints = scratch.save(fingerprints(docs, width, (key,), text))
    nodes = scratch.save(prints.groupBy("fp").agg(F.min(key).alias("least")))
    links = near_pairs(nodes.select("fp"), scratch, budget)
    roots = connected_components(links, scratch)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = scratch.save(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(component, "fp").select(key, "fp", "component_id")


#: Samples of SAMPLED shingles each that stand for a text: a pair of likeness 0.8 shares none with probability 0.3 %.
SAMPLES, SAMPLED = 8, 3
LIKENESS = 0.8
_rng = np.random.default_rng(31)
_MULTIPLY = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)


def sample_prints(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of SAMPLES min-wise samples of a set of shingle hashes: each of the SAMPLED that come first in an order
    of its own. A pair of texts takes the same sample with about the third power of its likeness."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    out = np.empty(SAMPLES, np.uint64)
    n = min(SAMPLED, len(hashes))
    for i, m in enumerate(_MULTIPLY):
        order = hashes * m
        order ^= order >> np.uint64(32)
        order *= np.uint64(0x9E3779B97F4A7C15)
        if n < len(order):
            order = np.argpartition(order, n - 1)[:n]
        else:
            order = np.argsort(order)
        a, b, c = (hashes[order[k % n]] for k in range(SAMPLED))
        out[i] = (a & b) | (a & c) | (b & c)
    return out


def _identity(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(_words(text)))
    return h - (1 << 64) if h >> 63 else h


def _shingler(width: int):
    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [shingle_hashes(t, width) for t in texts]
        return np.concatenate([np.zeros(0, np.uint64), *found]), np.array([len(h) for h in found], np.int64)

    return run


def keep_one(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text", name: str = "keep-one") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one is kept for each group of near-duplicates: the row with the
    least key, once where it is repeated. Rows with a null key stay only where their group has no other key, then one.

    Texts are linked where their sets of ``width``-word shingles have a Jaccard likeness of LIKENESS or more. Two kinds
    of SimHash propose, and the exact likeness decides, so that no text goes for a chance match or a shared passage:
    those of all shingles, within two bits (the trie's self-join), and those of min-wise samples of the shingles, where
    they are equal. The first alone would not do: texts of likeness 0.8 differ in ten bits on average, and ten bits do
    not prune a trie. The others take no part in the trie, as different samples differ in far more than two bits.

    Texts of the same words are one node, so copies are not compared; nodes are known by a 64-bit hash. Texts without
    words (null and empty ones too) are copies of each other. Texts of any length are read whole; a text takes some tens of bytes a character while
    it is compared. An empty table stays empty. Counts reach the driver only.
    """
    scratch = Scratch(docs.sparkSession, name)

    def make(texts: pa.Array) -> dict[str, list]:
        nodes, wholes, samples = [], [], []
        for t in texts:
            one = t.as_py()
            nodes.append(_identity(one))
            hashes = shingle_hashes(one, width)
            wholes.append(majority(hashes))
            samples.append(_signed(np.unique(sample_prints(np.unique(hashes)))))
        return {"node": nodes, "whole": pa.array(_signed(np.array(wholes, np.uint64))), "samples": pa.array(samples, pa.list_(pa.int64()))}

    known = scratch.save(map_columns(docs, [key], text_of(text), make, "node long, whole long, samples array<long>"))
    nodes = scratch.save(known.groupBy("node").agg(F.min(key).alias("least"), F.first("whole").alias("whole"), F.first("samples").alias("samples")))
    scratch.drop(known)
    roots = connected_components(near_pairs(nodes.select(F.col("whole").alias("fp")).distinct(), scratch), scratch)
    rooted = nodes.select("node", "whole").join(roots.withColumnRenamed("node", "_fp"), F.col("whole") == F.col("_fp"), "left")
    keyed = rooted.select(F.coalesce("root", "whole").alias("key"), "node").unionByName(nodes.select(F.explode("samples").alias("key"), "node")).distinct()
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = scratch.save(keyed.join(leaders, "key").select("key", "node", "leader"))
    wanted = groups.select("node").distinct()

    @F.pandas_udf("long")
    def identity(texts):
        return texts.map(_identity).astype("int64")

    read = docs.select(identity(text_of(text)).alias("node"), text_of(text).alias("text"))
    texts = scratch.save(read.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    components = settle(groups, texts, _shingler(width), LIKENESS, scratch)
    placed = nodes.select("node", "least").join(components, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("last"), "least", "node")).alias("k"))
    kept = scratch.save(kept.select(F.col("k.node").alias("_kept"), F.col("k.least").alias("_key")))
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), identity(text_of(text)).alias("_node"))
    one = rows.join(kept, (F.col("_node") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_key")), "left_semi").dropDuplicates(["_node"])
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
