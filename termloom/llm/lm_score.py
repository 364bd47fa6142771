"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides and scores documents."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rows import pieces, text_of
from .scratch import Scratch

#: A token is a word or a mark of the lower-cased text, as r"\w+|[^\w\s]" finds them.
#: A token's id is 60 bits of its hash and 4 bits of its last two letters' hash, so distinct tokens keep distinct ids.
ENDINGS = 16
OWN = 48  # most frequent tokens with a class of their own
CLASSES = OWN + ENDINGS
SIDE = 2  # tokens of context on each side
SLOTS = 2 * (CLASSES + 1)  # classes of the left neighbour, then of the right one, each with "beyond the text"
HIDDEN = 16
ROUNDS = 1  # passes of training, each followed by averaging over all partitions
HEAD = 1 << 15  # most frequent tokens whose counts travel with the tasks; all others' are joined
DISCOUNT = 0.75  # taken from each count of a token beside a neighbour, and dealt out by the tokens' shares of the class
UNSEEN = 0.5  # count of all tokens of a class that the corpus does not have
_BATCH = 2048
_SCORE = 1 << 12
_RATE = 0.2
_KEPT = 300_000
_FLUSH = 1 << 20  # tokens counted at once
_SPACE, _MARK, _WORD = range(3)
_LOOK = 1 << 17  # characters cut into tokens at once
_LOW = 512  # letters below have a table of their pairs' classes
_HALF = np.uint64(0xFFFFFFFF)


class _Endings(dict):
    """Class of a token's last two letters; a bounded memory."""

    def __missing__(self, ending: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[ending] = e = xxhash.xxh3_64_intdigest(ending, 1) % ENDINGS
        return e


_endings = _Endings()
_not_word = re.compile(r"\W").search


@cache
def _kinds() -> np.ndarray:
    """Of every code point, what it is to a token: _SPACE, _MARK or _WORD, as the regular expressions have it."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.full(len(every), _MARK, np.uint8)
    for kind, like in ((_SPACE, r"\s+"), (_WORD, r"\w+")):
        for found in re.finditer(like, every):
            out[found.start() : found.end()] = kind
    return out


@cache
def _known() -> np.ndarray:
    """Class of every pair of last letters below _LOW that has been met; ENDINGS: not yet."""
    return np.full(_LOW * _LOW, ENDINGS, np.uint8)


def _ending(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Class of each pair of last letters; ``before`` is 0 for a token of one letter."""
    known, low = _known(), (before | last) < _LOW
    out = known.take(np.where(low, before * _LOW + last, 0))
    new = np.flatnonzero(~low | (out == ENDINGS))
    if len(new):
        pairs, at = np.unique(before[new] << 21 | last[new], return_inverse=True)
        made = np.array([_endings[(chr(k >> 21) if k >> 21 else "") + chr(k & 0x1FFFFF)] for k in pairs.tolist()], np.uint8)
        out[new] = made[at]
        new = new[low[new]]
        known[before[new] * _LOW + last[new]] = out[new]
    return out


def _hashes(raw: bytes, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxh3_64 of the pieces of ``raw`` from ``lo`` on; those of 16 bytes or less, which most tokens have, all together by
    that function's rules for such lengths."""
    eight = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    out = np.empty(len(lo), np.uint64)
    n = size.astype(np.uint64)
    u = np.uint64
    at = np.flatnonzero(size <= 3)
    if len(at):
        w, k = eight[lo[at]], n[at]
        letter = lambda place: w >> place * u(8) & u(0xFF)
        h = (letter(u(0)) << u(16) | letter(k >> u(1)) << u(24) | letter(k - u(1)) | k << u(8)) ^ u(0x87275A9B)
        h = (h ^ h >> u(33)) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> u(29)) * u(0x165667B19E3779F9)
        out[at] = h ^ h >> u(32)
    at = np.flatnonzero((size > 3) & (size <= 8))
    if len(at):
        w, k = eight[lo[at]], n[at]
        h = ((w << u(32)) + (eight[lo[at] + size[at] - 4] & _HALF)) ^ u(0xC73AB174C5ECD5A2)
        h = (h ^ (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))) * u(0x9FB21C651E98DF25)
        h = (h ^ (h >> u(35)) + k) * u(0x9FB21C651E98DF25)
        out[at] = h ^ h >> u(28)
    at = np.flatnonzero((size > 8) & (size <= 16))
    if len(at):
        a, b = eight[lo[at]] ^ u(0x6782737BEA4239B9), eight[lo[at] + size[at] - 8] ^ u(0xAF56BC3B0996523A)
        # the halves of the 128 bits of a * b, put together
        a0, a1, b0, b1 = a & _HALF, a >> u(32), b & _HALF, b >> u(32)
        middle = a1 * b0 + (a0 * b0 >> u(32))
        cross = a0 * b1 + (middle & _HALF)
        h = n[at] + a.byteswap() + b + (a1 * b1 + (middle >> u(32)) + (cross >> u(32)) ^ a * b)
        h = (h ^ h >> u(37)) * u(0x165667919E3779F9)
        out[at] = h ^ h >> u(32)
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[lo[i] : lo[i] + size[i]])
    return out


def _cut(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a lower-cased line's tokens, and the places where they start, in characters."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    kind = _kinds().take(codes)
    word, mark = kind == _WORD, kind == _MARK
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = np.flatnonzero(first | mark), np.flatnonzero(last | mark)
    if not len(starts):
        return np.zeros(0, np.int64), starts
    raw = line.encode()
    lo, size = starts, ends - starts + 1
    if len(raw) > len(line):
        beyond = np.zeros(len(codes) + 1, np.int64)  # bytes beyond one a character
        np.cumsum((codes > 0x7F).view(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF), out=beyond[1:])
        lo = starts + beyond[starts]
        size = ends + 1 + beyond[ends + 1] - lo
    h = _hashes(raw, lo, size)
    codes = codes.astype(np.int64)
    before = np.where(ends > starts, codes.take(np.maximum(ends - 1, 0)), 0)
    h &= ~np.uint64(ENDINGS - 1)
    h |= _ending(before, codes.take(ends))
    return h.view(np.int64), starts


def _bits(texts: Iterable[str]) -> Iterator[list[tuple[int, str]]]:
    """The lower-cased texts with their numbers, about _LOOK characters together; longer ones are cut beside a character
    that is in no word."""
    held, size = [], 0
    for n, text in enumerate(texts):
        text, start = text.lower(), 0
        while len(text) - start > _LOOK and (gap := _not_word(text, start + _LOOK)):
            yield [(n, text[start : gap.start()])]
            start = gap.start()
        held.append((n, text[start:]))
        size += len(text) - start
        if size >= _LOOK:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokens_of(texts: list[str]) -> list[np.ndarray]:
    """Ids of each text's tokens."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for bits in _bits(texts):
        ids, starts = _cut("\n".join(bit for _, bit in bits))  # white space: no token goes across
        cuts = np.searchsorted(starts, np.cumsum([len(bit) + 1 for _, bit in bits]))
        for (n, _), lo, hi in zip(bits, [0, *cuts[:-1]], cuts, strict=True):
            out[n].append(ids[lo:hi])
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]


def token_ids(text: str) -> np.ndarray:
    return tokens_of([text])[0]


class _Places:
    """Where ids stand in an ordered array of ids, which are hashes: their first bits lead to the place or just before."""

    def __init__(self, ordered: np.ndarray) -> None:
        self.ordered = np.append(ordered, np.iinfo(np.int64).max)
        bits = min(18, max(1, len(ordered).bit_length() + 3))
        self.shift, half = 64 - bits, 1 << bits - 1
        self.firsts = np.searchsorted(ordered, np.arange(-half, half) << self.shift)
        self.size, self.half = len(ordered), half

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ids in the ordered array, and whether they are there."""
        at = self.firsts.take((ids >> self.shift) + self.half)
        here = self.ordered.take(at)
        behind = np.flatnonzero(here < ids)
        while len(behind):
            at[behind] += 1
            here[behind] = self.ordered[at[behind]]
            behind = behind[here[behind] < ids[behind]]
        there = here == ids
        there &= at < self.size
        return at, there


@dataclass(frozen=True)
class Classes:
    """Class of every id: its own for the most frequent tokens, else that of its ending."""

    own: np.ndarray  # sorted ids; an id's place is its class

    @cached_property
    def places(self) -> _Places:
        return _Places(self.own)

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        at, there = self.places.find(ids)
        return np.where(there, at, OWN + (ids & (ENDINGS - 1)))


@dataclass
class Net:
    """Window network: the context's class vectors are summed by position, squashed, and give the class of the token."""

    slots: np.ndarray  # 2*SIDE x CLASSES+1 x HIDDEN; the last class stands for "beyond the text"
    bias: np.ndarray
    out: np.ndarray  # HIDDEN x CLASSES
    out_bias: np.ndarray

    @classmethod
    def start(cls) -> Net:
        r = np.random.default_rng(7)
        return cls(r.normal(0, 0.1, (2 * SIDE, CLASSES + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.slots, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Net:
        shapes = [p.shape for p in cls.start().parts]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(values, cuts), shapes, strict=True)))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.slots[0].take(context[0], axis=0)
        for s in range(1, 2 * SIDE):
            z += self.slots[s].take(context[s], axis=0)
        z += self.bias
        return np.tanh(z, out=z)

    def scores(self, hidden: np.ndarray) -> np.ndarray:
        """Unnormalised log probabilities, classes x positions: sums over classes then run along rows."""
        z = self.out.T @ hidden.T
        z += self.out_bias[:, None]
        z -= z.max(axis=0)
        return z

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each position's class; ``context``: slots x positions."""
        z = self.scores(self.hidden(context))
        own = z[target, np.arange(len(target))]
        return own - np.log(np.exp(z, out=z).sum(axis=0))

    def step(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray]) -> None:
        """One step of gradient descent with per-parameter rates."""
        n = len(target)
        h = self.hidden(context)
        p = self.scores(h)
        np.exp(p, out=p)
        p *= np.float32(1 / n) / p.sum(axis=0)
        p[target, np.arange(n)] -= np.float32(1 / n)
        dh = (p.T @ self.out.T) * (1 - h * h)
        # a class's gradient is the sum over its positions, which stand together once ordered by slot and class
        keys = (context + np.arange(0, self.slots[..., 0].size, CLASSES + 1)[:, None]).ravel()
        ordered = np.tile(np.arange(n), 2 * SIDE)[np.argsort(keys.astype(np.uint16), kind="stable")]
        sizes = np.bincount(keys, minlength=self.slots[..., 0].size)
        there = np.flatnonzero(sizes)
        firsts = (np.cumsum(sizes) - sizes)[there]
        g_slots = np.zeros_like(self.slots)
        g_slots.reshape(-1, HIDDEN)[there] = np.add.reduceat(dh.take(ordered, axis=0), firsts, axis=0)
        for part, g, m in zip(self.parts, (g_slots, dh.sum(axis=0), (p @ h).T, p.sum(axis=1)), memory, strict=True):
            m += g * g
            part -= (_RATE * g / np.sqrt(m + 1e-8)).astype(np.float32)


def windows(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (slots x positions) and targets of several texts; beyond a text's ends stands the class CLASSES."""
    return _windows(np.concatenate(classes), [len(c) for c in classes])


def _windows(target: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts that follow one another in ``target``."""
    line = np.full(len(target) + SIDE * (len(sizes) + 1), CLASSES, np.int64)
    at = np.arange(len(target)) + np.repeat(np.arange(SIDE, SIDE * (len(sizes) + 1), SIDE), sizes)
    line[at] = target
    return np.stack([line[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]), target


@dataclass(frozen=True)
class Inner:
    """Probability of a token within its ending's class, given the classes of its two neighbours.

    It is the mean of two distributions, one a side: the counts of the class's tokens beside that neighbour, with
    absolute discounting towards the tokens' shares of the whole class. Each sums to one over the class's tokens and
    the event of a token that the corpus does not have.
    """

    total: np.ndarray  # ENDINGS x SLOTS: tokens of the class beside that neighbour
    kinds: np.ndarray  # the same, distinct tokens

    def log_p(self, ending: np.ndarray, n: np.ndarray, beside: tuple[np.ndarray, np.ndarray], slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """``n``: the tokens' counts, 0 for ones not in the corpus; ``beside``: their counts beside each neighbour."""
        whole = self.total[:, : CLASSES + 1].sum(axis=1)
        share = np.where(n > 0, n, UNSEEN) / (whole[ending] + UNSEEN)
        p = np.zeros(len(n))
        for k, slot in zip(beside, slots, strict=True):
            total, kinds = self.total[ending, slot], self.kinds[ending, slot]
            p += np.where(total > 0, (np.maximum(k - DISCOUNT, 0) + DISCOUNT * kinds * share) / np.maximum(total, 1), share)
        return np.log(p / 2)


class Share:
    """Log share, within its class, of a token with a class of its own; the others' depend on the context."""

    def __getitem__(self, ids):
        return np.zeros(np.shape(ids))


@dataclass(frozen=True)
class Scorer:
    class_of: Classes
    net: Net
    inner: Inner
    head: np.ndarray  # sorted ids of the most frequent tokens without a class of their own
    counts: np.ndarray  # their counts
    beside: np.ndarray  # head x SLOTS: their counts beside each neighbour
    tail: DataFrame | None = None  # the same of all other tokens: ``id``, ``n`` and ``by``, a map from slot to count
    share: Share = field(default_factory=Share)

    @cached_property
    def places(self) -> _Places:
        return _Places(self.head)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum over each text's tokens of log P(class | both sides) + log P(token | class, both neighbours)."""
        out, rare = self.measure(texts)
        wanted = np.unique(np.concatenate([r[0] for r in rare])) if rare else np.zeros(0, np.int64)
        found = {}
        if len(wanted) and self.tail is not None:
            found = {r["id"]: (r["n"], r["by"]) for r in self.tail.where(F.col("id").isin(wanted.tolist())).collect()}
        for i, (ids, left, right) in enumerate(rare):
            if len(ids):
                own = [found.get(t, (0.0, {})) for t in ids.tolist()]
                out[i] += self.inner.log_p(*_places(ids, [n for n, _ in own], [b for _, b in own], left, right)).sum()
        return out

    def measure(self, texts: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The sums without the inner terms of tokens beyond the head, and those: ids and both neighbours' slots."""
        out = np.zeros(len(texts))
        rare = [(np.zeros(0, np.int64),) * 3] * len(texts)
        pending: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            sizes = [len(i) for _, i in pending]
            ids = np.concatenate([i for _, i in pending])
            log_p, far = self._log_p(ids, *_windows(self.class_of[ids], sizes))
            ends = np.cumsum(sizes)
            out[[n for n, _ in pending]] = np.add.reduceat(log_p, np.concatenate([[0], ends[:-1]]))
            cuts = np.searchsorted(far[3], ends)
            for (n, _), lo, hi in zip(pending, [0, *cuts[:-1]], cuts, strict=True):
                rare[n] = tuple(x[lo:hi] for x in far[:3])
            pending.clear()

        for n, ids in enumerate(texts):
            # a long text is scored in parts; the parts' edges see their neighbours, as below
            if len(ids) > _SCORE:
                out[n], rare[n] = self._parts(ids)
                continue
            if len(ids):
                pending.append((n, ids))
                size += len(ids)
            if size >= _SCORE:
                flush()
                size = 0
        if pending:
            flush()
        return out, rare

    def _log_p(self, ids: np.ndarray, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log probability of each position, and ids, slots and positions of the tokens beyond the head."""
        log_p = self.net.log_p(context, target).astype(np.float64)
        left, right = context[SIDE - 1], context[SIDE] + CLASSES + 1
        inner = np.flatnonzero(target >= OWN)
        at, there = self.places.find(ids[inner])
        near, far, at = inner[there], inner[~there], at[there]
        slots = (left[near], right[near])
        log_p[near] += self.inner.log_p(target[near] - OWN, self.counts[at], tuple(self.beside[at, s] for s in slots), slots)
        return log_p, (ids[far], left[far], right[far], far)

    def _parts(self, ids: np.ndarray) -> tuple[float, tuple]:
        gap = np.full(SIDE, CLASSES, np.int64)
        line = np.concatenate([gap, self.class_of[ids], gap])
        total, rare = 0.0, []
        for start in range(0, len(ids), _SCORE):
            at = np.arange(start, min(len(ids), start + _SCORE)) + SIDE
            context = np.stack([line[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))])
            log_p, far = self._log_p(ids[start : start + _SCORE], context, line[at])
            total += float(log_p.sum())
            rare.append(far[:3])
        return total, tuple(np.concatenate(x) for x in zip(*rare, strict=True))

    def _long(self, ids: np.ndarray) -> float:
        return self._parts(ids)[0]


def _places(ids: np.ndarray, n: list, by: list[dict], left: np.ndarray, right: np.ndarray) -> tuple:
    """Arguments of ``Inner.log_p`` for tokens whose counts are given one by one."""
    beside = tuple(np.array([b.get(s, 0.0) for b, s in zip(by, slot.tolist(), strict=True)]) for slot in (left, right))
    return ids & (ENDINGS - 1), np.array(n, np.float64), beside, (left, right)


def _tokenised(docs: DataFrame, keys: tuple[str, ...], text: str, scratch: Scratch) -> DataFrame:
    """``_row``, ``_keys`` (where there are any) and ``_ids``, the token ids of each text (eight bytes each), written:
    three passes read them, and the rows' numbers stay whatever is run again."""
    kept = [F.struct(*keys).alias("_keys")] if keys else []
    read = docs.select(*kept, text_of(text).alias("_text"))
    row, ids = StructType.fromDDL("_row long, _ids binary")
    out = StructType([row, *read.schema.fields[:-1], ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, row = to_arrow_schema(out), TaskContext.get().partitionId() << 36
        for batch in pieces(batches):
            ids = [i.tobytes() for i in tokens_of(batch.column("_text").to_pylist())]
            arrays = [pa.array(np.arange(row, row + len(ids)))]
            arrays += [batch.column("_keys").cast(schema.field("_keys").type)] if keys else []
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, schema.field("_ids").type)], schema=schema)
            row += len(ids)

    return scratch.save(read.mapInArrow(run, out))


def _split(column: pa.Array) -> list[np.ndarray]:
    """The ids of each row."""
    return [np.frombuffer(v.as_buffer(), np.int64) for v in column]


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, name: str = "lm", tokens: DataFrame | None = None) -> Scorer:
    """Counts of every token over all documents, then a network trained on every token of every document, and the
    counts of every token without a class of its own beside the classes of its neighbours.

    All counts are sums by token over the cluster, in tables that grow with the vocabulary and are written. Training is
    local descent from a common start with averaging: each partition goes through its tokens once a round, and the
    partitions' nets are averaged, weighted by their tokens, as sums by parameter. The driver gets the counts of the
    HEAD most frequent tokens, at most SLOTS each, and one net; the tokens beyond stay in a table. ``tokens``: the
    documents' token ids, where they are written already.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    read = (_tokenised(docs, (), text, scratch) if tokens is None else tokens).select("_ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _gather(batches):
            values, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["id", "n"])

    vocabulary = scratch.save(read.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    frequent = [r["id"] for r in vocabulary.orderBy(F.desc("n"), "id").limit(OWN).collect()]
    best = vocabulary.where(~F.col("id").isin(frequent)).orderBy(F.desc("n"), "id").limit(HEAD).toArrow()
    last = (-best["n"][-1].as_py(), best["id"][-1].as_py()) if best.num_rows else None
    class_of = Classes(np.array(sorted(frequent), np.int64))
    context = spark.sparkContext
    classes, heads = context.broadcast(class_of), context.broadcast(np.sort(best["id"].to_numpy()))
    net = Net.start()
    table = None
    for turn in range(max(1, rounds)):
        start = context.broadcast(net.flat())

        def train(batches: Iterator[pa.RecordBatch], start=start, counting=turn == 0, training=turn < rounds) -> Iterator[pa.RecordBatch]:
            own = Net.from_flat(start.value)
            memory = [np.full(p.shape, 1e-6) for p in own.parts]
            class_of, seen = classes.value, 0
            shuffle = np.random.default_rng(11)
            held: list[np.ndarray] = []
            size = 0
            tally = _Tally(heads.value)
            for texts in _groups(batches):
                line = np.concatenate(texts)
                near, target = _windows(class_of[line], [len(i) for i in texts])
                order = shuffle.permutation(len(target))
                dealt = np.concatenate([near, target[None]]).astype(np.uint8).take(order, axis=1)
                for k in range(0, len(order) if training else 0, _BATCH):
                    *context, of = dealt[:, k : k + _BATCH].astype(np.int64)
                    own.step(np.stack(context), of, memory)
                seen += len(target)
                if counting:
                    at = np.flatnonzero(target >= OWN)
                    held.append(np.stack([line[at], near[SIDE - 1][at], near[SIDE][at] + CLASSES + 1]))
                    size += len(at)
                    if size >= _FLUSH:
                        yield tally.add(held)
                        held, size = [], 0
            if held:
                yield tally.add(held)
            if counting:
                yield from tally.rest()
            if seen:
                flat = own.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), -1, np.int32)), pa.array(flat)], ["id", "slot", "v"])

        # dealt by token once, which serves both sums
        made = read.mapInArrow(train, "id long, slot int, v double").withColumn("net", F.col("slot") < 0).repartition("id", "net")
        made = made.groupBy("id", "net", "slot").agg(F.sum("v").alias("v"))
            # a map has SLOTS entries at most
        made = scratch.save(made.groupBy("id", "net").agg(F.sum(F.when(F.col("slot") <= CLASSES, F.col("v"))).alias("n"), F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("by")))
        if turn == 0:
            table = made.where("not net").drop("net")
        trained = made.where("net").select("id", "n").toArrow()
        if not trained.num_rows:
            break
        flat = np.zeros(len(net.flat()))
        flat[trained["id"].to_numpy()] = trained["n"].to_numpy() / total
        net = Net.from_flat(flat)
    sums = table.select((F.col("id").bitwiseAND(ENDINGS - 1)).alias("c"), F.explode("by").alias("slot", "v")).groupBy("c", "slot").agg(F.sum("v").alias("v"), F.count("*").alias("m")).collect()
    inner = Inner(np.zeros((ENDINGS, SLOTS)), np.zeros((ENDINGS, SLOTS)))
    for r in sums:
        inner.total[r["c"], r["slot"]], inner.kinds[r["c"], r["slot"]] = r["v"], r["m"]
    first = F.lit(False) if last is None else F.struct((-F.col("n")).cast("long").alias("n"), "id") <= F.struct(F.lit(last[0]).cast("long").alias("n"), F.lit(last[1]).alias("id"))
    near = table.where(first).select("id", "n", F.map_keys("by").alias("slot"), F.map_values("by").alias("v")).orderBy("id").toArrow().combine_chunks()
    head = near["id"].to_numpy()
    beside = np.zeros((len(head), SLOTS), np.float32)
    if len(head):
        lists = near["slot"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        beside[np.repeat(np.arange(len(head)), sizes), lists.flatten().to_numpy()] = near["v"].combine_chunks().flatten().to_numpy()
    return Scorer(class_of, net, inner, head, near["n"].to_numpy(), beside, table.where(~first))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Ids of a few texts at a time, of 32 steps' tokens or more but at the end."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for ids in _split(batch.column(0)):
            if len(ids):
                held.append(ids)
                size += len(ids)
            if size >= 32 * _BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The same in arrays of about _FLUSH ids."""
    held: list[np.ndarray] = []
    size = 0
    for texts in _groups(batches):
        held += texts
        size += sum(map(len, texts))
        if size >= _FLUSH:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


class _Tally:
    """Counts of (id, slot) for both neighbours of positions: a table over all positions seen for the HEAD most frequent
    ids, and rows at once for all others, which seldom come twice in a task."""

    def __init__(self, head: np.ndarray) -> None:
        self.head = head
        self.places = _Places(head)
        self.counts = np.zeros(0, np.int32)

    def add(self, held: list[np.ndarray]) -> pa.RecordBatch:
        """Counts the held positions (ids, left slots, right slots); returns the rows of the ids beyond the head."""
        line = np.concatenate(held, axis=1)
        at, there = self.places.find(line[0])
        if there.any():
            if not len(self.counts):
                self.counts = np.zeros(len(self.head) * SLOTS, np.int32)
            place = at[there] * SLOTS
            for side in (1, 2):
                self.counts += np.bincount(place + line[side, there], minlength=len(self.counts)).astype(np.int32)
        line = line[:, ~there]
        ids, at = np.unique(line[0], return_inverse=True)
        keys, n = np.unique(np.concatenate([at * SLOTS + line[1], at * SLOTS + line[2]]), return_counts=True)
        return _rows(ids[keys // SLOTS], keys % SLOTS, n)

    def rest(self) -> Iterator[pa.RecordBatch]:
        keys = np.flatnonzero(self.counts)
        for start in range(0, len(keys), _FLUSH):
            part = keys[start : start + _FLUSH]
            yield _rows(self.head[part // SLOTS], part % SLOTS, self.counts[part])


def _rows(ids: np.ndarray, slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(slots.astype(np.int32)), pa.array(n.astype(np.float64))], ["id", "slot", "v"])


def score_documents(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", scorer: Scorer | None = None, name: str = "lm") -> DataFrame:
    """Key columns, ``n_tokens``, ``log_likelihood`` (the summed conditional log-probabilities of all tokens of the
    whole text, each given its neighbours on both sides) and ``mean_log_likelihood`` (per token).

    A token is a word or a mark; its probability is that of its class by the network times its own within the class,
    given both neighbours' classes, by the corpus counts. Counts of the HEAD most frequent tokens travel with the tasks;
    the other tokens' occurrences meet theirs by a join. The texts are cut into tokens once, and their ids written. A long text is scored in parts that see their neighbours. A null or empty text has no tokens, likelihood 0 and a null
    mean. One row comes out for each row that goes in; other columns are not read; an empty table stays empty. Scores
    depend in their last digits on how the rows were partitioned when the network was trained.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    tokens = _tokenised(docs, keys, text, scratch)
    scorer = fit(docs, text, name=name, tokens=tokens) if scorer is None else scorer
    shared = spark.sparkContext.broadcast(replace(scorer, tail=None))
    out = StructType().add("_row", "long").add(tokens.schema["_keys"]).add("n_tokens", "integer").add("_sum", "double")
    rare = StructType.fromDDL("_rare array<struct<id: long, left: int, right: int>>")
    out = StructType([*out.fields, *rare.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _split(batch.column("_ids"))
            sums, far = shared.value.measure(ids)
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in far])])
            columns = [np.concatenate(x) for x in zip(*far, strict=True)]
            kind = schema.field("_rare").type
            values = pa.StructArray.from_arrays([pa.array(c, kind.value_type.field(i).type) for i, c in enumerate(columns)], fields=list(kind.value_type))
            arrays = [batch.column("_row"), batch.column("_keys").cast(schema.field("_keys").type)]
            arrays += [pa.array([len(i) for i in ids], pa.int32()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind)], schema=schema)

    rows = scratch.save(tokens.mapInArrow(run, out))
    scratch.drop(tokens)
    far = rows.select("_row", F.explode("_rare").alias("o")).select("_row", "o.*")
    known = scorer.tail
    if known is None:
        known = spark.createDataFrame([], "id long, n double, by map<int, double>")
    at = lambda side: F.coalesce(F.try_element_at("by", F.col(side)), F.lit(0.0))
    met = far.join(known, "id", "left").select("_row", "id", F.coalesce("n", F.lit(0.0)).alias("n"), "left", "right", at("left").alias("nl"), at("right").alias("nr"))
    inner = spark.sparkContext.broadcast(scorer.inner)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, n, left, right, nl, nr = (batch.column(c).to_numpy() for c in ("id", "n", "left", "right", "nl", "nr"))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(inner.value.log_p(ids & (ENDINGS - 1), n, (nl, nr), (left, right)))], ["_row", "v"])

    more = met.mapInArrow(add, "_row long, v double").groupBy("_row").agg(F.sum("v").alias("_more"))
    joined = rows.drop("_rare").join(more, "_row", "left").withColumn("log_likelihood", F.col("_sum") + F.coalesce("_more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return joined.select(*[F.col("_keys")[k].alias(k) for k in keys], F.col("n_tokens").cast("long").alias("n_tokens"), "log_likelihood", mean.alias("mean_log_likelihood"))
