"""Connected components: a union-find in every task, then alternating large-star and small-star steps as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


PART = 1 << 21  # links that a task puts together in its memory


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest one of its component, roots left out: as connected as the links, and no longer than
    the nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hangs = label != np.arange(len(nodes))
    return nodes[hangs], nodes[label[hangs]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += len(batch)
        if held > 2 * PART:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            if held > PART:  # nothing more to gain: these stars go on as they are
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                a, b, held = [], [], 0
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``, the root being the smallest node of the component.

    Only nodes that have an edge to another node are returned. First the links are put together within tasks, about PART
    at a time; where one task held them all, that is the result. Else the stars that come out are joined by rounds of
    large-star and small-star steps. Each round is written to the shared folder, so that lineage stays short and a lost
    executor costs no earlier round. A node's smallest neighbour comes from a partial aggregate and goes back by an
    equi-join, whose hot keys the engine can split: no neighbour list is ever gathered. The loop ends when a round
    changes no edge.
    """
    now = scratch.save(edges.where("a <> b").select("a", "b"))
    n = now.count()
    parts = -(-n // PART)
    together = now.coalesce(1) if parts <= 1 else now.repartition(parts, F.least("a", "b"))
    stars = scratch.save(together.mapInArrow(_contract, "a long, b long"))
    scratch.drop(now)
    now = stars
    if parts <= 1:
        return _stars(now)
    mark = _mark(now)
    while mark[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour is hung below the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours are hung below the least of them
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smaller, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = scratch.save(small)
        new_mark = _mark(new)
        scratch.drop(now)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    return _stars(now)


def _stars(now: DataFrame) -> DataFrame:
    """Every node hangs directly below its root."""
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """A count and two order-free hashes of the edge set."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(0x7FFFFFFF)).alias("s")).first()
    return row["n"], row["x"], row["s"]
