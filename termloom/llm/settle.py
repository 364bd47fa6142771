"""Components over verified links, from groups of candidates: no pair inside a group is lost, few are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .rows import pieces
from .scratch import Scratch

BLOCK = 1024  # members of a block of a large group
BLOCK_CHARS = 4 << 20  # and the characters that it holds on average at most
SALTED = 5000  # a leader's nodes are dealt out over one key for so many pairs in all
_DENSE = 64  # members of a block whose pairs are all compared at once
_HASH = 48  # bits of a shingle's hash, below the number of its text
_CHUNK = 1 << 16  # characters compared at once: their shingles stay in the processor's cache

#: Texts to the 64-bit hashes of all their shingles, one text after the other and with repeats, and each text's number.
Shingler = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _numbered(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``number of the text << 48 | 48 bits of the hash``: two of a pair of texts' shingles collide once in 10^9 pairs."""
    return np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(_HASH), counts) | (hashes >> np.uint64(64 - _HASH))


def _once(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct(sets: Shingler, texts: list[str]) -> np.ndarray:
    """The texts' numbered distinct shingles, in order."""
    hashes, counts = sets(texts)
    return _once(_numbered(counts, hashes))


def _verify(sets: Shingler, likeness: float):
    """``(a, b, ta, tb)`` to ``(a, b, alike)``, many pairs at a time: a shingle of both texts is found twice, once for
    each side, which is the lowest bit."""
    one = np.uint64(1)

    def compare(ta: list[str], tb: list[str]) -> np.ndarray:
        n = len(ta)
        a, b = (_numbered(counts, hashes) for hashes, counts in (sets(ta), sets(tb)))
        x = _once(np.concatenate([a & ~one, b | one]))
        twice = (x[1:] ^ x[:-1]) == one
        number = (x >> np.uint64(_HASH)).astype(np.int64)
        shared = np.bincount(number[1:][twice], minlength=n)
        either = np.bincount(number, minlength=n) - shared
        return shared >= likeness * either - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            out, start, held = [], 0, 0
            for i in range(len(ta)):
                held += len(ta[i]) + len(tb[i])
                if held >= _CHUNK or i - start >= 30_000 or i == len(ta) - 1:
                    out.append(compare(ta[start : i + 1], tb[start : i + 1]))
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.concatenate(out), pa.bool_())], ["a", "b", "alike"])

    return run


def block_links(c: np.ndarray, shingles: np.ndarray, likeness: float) -> list[tuple[int, int]]:
    """Links between components that join all members alike by ``likeness`` or more. ``c``: each member's component so
    far, ``shingles``: the members' numbered shingles."""
    names, label = np.unique(c, return_inverse=True)
    if len(names) < 2 or not len(shingles):
        return []
    found = _all_pairs(label, shingles, likeness) if len(c) <= _DENSE else _grown(label, shingles, likeness)
    return [(int(names[a]), int(names[b])) for a, b in found]


def _all_pairs(label: np.ndarray, shingles: np.ndarray, likeness: float) -> list[tuple[int, int]]:
    """For a few members: all intersections are one product of matrices."""
    x = np.sort((shingles << np.uint64(64 - _HASH)) | (shingles >> np.uint64(_HASH)))
    word = np.concatenate([[0], np.cumsum((x[1:] ^ x[:-1]) >> np.uint64(64 - _HASH) != 0)])
    has = np.zeros((len(label), word[-1] + 1), np.float32)
    has[(x & np.uint64((1 << (64 - _HASH)) - 1)).astype(np.int64), word] = 1
    shared = (has @ has.T).astype(np.float64)
    size = shared.diagonal()
    a, b = np.nonzero((shared >= likeness * (size[:, None] + size - shared) - 1e-9) & (shared > 0) & (label[:, None] < label))
    root = list(range(int(label.max()) + 1))
    links = []
    for i, j in zip(label[a].tolist(), label[b].tolist(), strict=True):
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)
            links.append((i, j))
    return links


def _grown(label: np.ndarray, shingles: np.ndarray, likeness: float) -> list[tuple[int, int]]:
    """A component grows until none of the other members is alike to one of its own; members already in it are never
    compared with each other, so a group of variants of one text costs little more than a comparison each."""
    member = (shingles >> np.uint64(_HASH)).astype(np.int64)
    size = np.bincount(member, minlength=len(label))
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    _, word = np.unique(shingles & np.uint64((1 << _HASH) - 1), return_inverse=True)
    mark = np.zeros(word.max() + 1, np.uint8)
    count = int(label.max()) + 1
    members = [np.flatnonzero(label == k) for k in range(count)]
    links = []
    open_ = np.ones(count, bool)
    for k in np.argsort([-len(m) for m in members], kind="stable"):
        if not open_[k]:
            continue
        open_[k] = False
        rest = np.flatnonzero(open_[label] & (size > 0))
        at, words = _gather(rest, first, size, word)
        queue = list(members[k])
        while queue and len(rest):
            x = queue.pop()
            own = word[first[x] : first[x] + size[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[words], at, dtype=np.int64)
            mark[own] = 0
            alike = shared >= likeness * (size[rest] + size[x] - shared) - 1e-9
            if alike.any():
                for other in np.unique(label[rest[alike]]):
                    links.append((k, other))
                    open_[other] = False
                    queue.extend(members[other])
                rest = rest[open_[label[rest]]]
                at, words = _gather(rest, first, size, word)
    return links


def _gather(rest: np.ndarray, first: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members' shingles one after the other, and where each member's begin."""
    sizes = size[rest]
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(rest) else np.zeros(0, np.int64)
    return at, word[np.repeat(first[rest] - at, sizes) + np.arange(sizes.sum())]


def _solve(sets: Shingler, likeness: float):
    """Sorted rows ``(key, i, j, node, c, text)`` to links ``(a, b)`` between components, one block at a time."""

    def links(nodes: list, c: list, texts: list) -> list[tuple[int, int]]:
        c = np.concatenate(c)
        if (c == c[0]).all():
            return []
        order = np.argsort(np.concatenate(nodes), kind="stable")
        flat = [t for part in texts for t in part.to_pylist()]
        return block_links(c[order], distinct(sets, [flat[i] for i in order]), likeness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])
        for batch in pieces(batches):
            found = []
            key = np.stack([batch.column(n).to_numpy() for n in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(key)], strict=True):
                now = tuple(key[start])
                if now != last and last is not None:
                    found += links(*held)
                    held = ([], [], [])
                last = now
                part = batch.slice(start, stop - start)
                held[0].append(part.column("node").to_numpy())
                held[1].append(part.column("c").to_numpy())
                held[2].append(part.column("text"))
            yield from _pairs(found)
        if last is not None:
            yield from _pairs(links(*held))

    return run


def _pairs(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = zip(*set(found), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def settle(groups: DataFrame, texts: DataFrame, sets: Shingler, likeness: float, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of nodes that hang together over links of ``likeness`` (Jaccard) or more.

    ``groups(key, node, leader)`` holds every member of every group, with a member that leads it (a member may stand there
    twice, in a group of three or more), in a written table;
    ``texts(node, text)`` the texts of all of them, likewise. Every pair that shares a group is decided:

    First each node with its leader. A leader's text travels once for each SALTED pairs of the whole table, so a hot
    leader is dealt out. Then groups whose members are still in several components go to tasks with their texts, where a
    component meets the members of all others (``block_links``); groups of the same members go once. A group of more
    than 2 x BLOCK members, or of long texts, goes in blocks: the members of its largest component, a block at a time,
    with those outside, a block at a time. The links' components are then joined.

    Rows grow with the groups' members, not with their pairs, unless more than BLOCK members lie outside the largest
    component of one group: then with members x blocks outside. Nothing but counts reaches the driver.
    """
    pairs = scratch.save(groups.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    ways = max(1, pairs.count() // SALTED)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(ways)))
    leaders = salted.select("b", "salt").distinct().join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = salted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(leaders, ["b", "salt"])
    decided = scratch.save(both.select("a", "b", "ta", "tb").mapInArrow(_verify(sets, likeness), "a long, b long, alike boolean"))
    roots = scratch.save(connected_components(decided.where("alike").select("a", "b"), scratch))

    placed = groups.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("c"))
    by_key = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(F.xxhash64("node").bitwiseAND((1 << 40) - 1)).alias("h"))
    # groups of the same members are one; of two members the first step has decided
    open_keys = by_key.where("lo < hi and n > 2").groupBy("n", "h", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    sized = texts.select("node", F.length("text").cast("long").alias("chars"))
    members = scratch.save(placed.join(open_keys, "key").join(sized, "node"))
    top = members.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    top = top.groupBy("key").agg(F.max(F.struct("n", "c", "chars")).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    blocks = lambda n, chars: F.greatest(F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")
    whole = (F.col("n") <= 2 * BLOCK) & (F.col("chars") <= 2 * BLOCK_CHARS)
    inside = F.when(whole, 1).otherwise(blocks(F.col("top.n"), F.col("top.chars"))).alias("inside")
    outside = F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars"))).alias("outside")
    dealt = members.join(top.select("key", F.col("top.c").alias("most"), inside, outside), "key")
    h = F.xxhash64("node")
    own_in, own_out = F.pmod(h, "inside").cast("int"), F.pmod(h, "outside").cast("int")
    block = lambda i, j: F.struct(F.lit(i).alias("i") if isinstance(i, int) else i.alias("i"), j.alias("j"))
    # i: the block outside, j >= 0: the block inside; j < 0: -1 - the other block outside
    of_most = F.transform(F.sequence(F.lit(0), F.col("outside") - 1), lambda i: block(i, own_in))
    with_most = F.transform(F.sequence(F.lit(0), F.col("inside") - 1), lambda j: block(own_out, j))
    with_others = F.transform(F.sequence(F.lit(0), F.col("outside") - 1), lambda o: block(F.least(own_out, o), -1 - F.greatest(own_out, o)))
    of_others = F.when(F.col("outside") > 1, F.concat(with_most, with_others)).otherwise(with_most)
    spread = dealt.select("key", "node", "c", F.explode(F.when(F.col("c") == F.col("most"), of_most).otherwise(of_others)).alias("x"))
    spread = spread.select("key", "x.i", "x.j", "node", "c").join(texts.select("node", "text"), "node")
    ordered = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = scratch.save(ordered.select("key", "i", "j", "node", "c", "text").mapInArrow(_solve(sets, likeness), "a long, b long").distinct())
    scratch.drop(members)
    if not links.limit(1).count():
        return roots
    joined = scratch.save(connected_components(links, scratch).withColumnsRenamed({"node": "c", "root": "top"}))
    # a component of one node is not among the roots of the first step
    known = roots.unionByName(joined.select(F.col("c").alias("node"), F.col("c").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return scratch.save(known.join(joined, known["root"] == joined["c"], "left").select("node", F.coalesce("top", "root").alias("root")))
