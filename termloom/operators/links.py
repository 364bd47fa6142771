"""Link graphs: degrees, PageRank by power iteration and by random walks, HITS. All steps are joins and aggregates."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch

PRIME = 2**31 - 1


def clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null").distinct()


def nodes_of(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Every id that is a source or a target, and those of ``more``."""
    found = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (found if more is None else found.unionByName(more.select("id"))).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return clean(edges).groupBy("src").agg(F.count("*").alias("outdeg"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges, nodes["id"] == edges["src"], "left_anti")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, bored: float = 0.15, epsilon: float = 1e-4, most: int = 1000, fixed: int | None = None, start: int | None = None) -> DataFrame:
    """``(id, score)``; scores sum to 1. Stops when the summed change falls below ``epsilon``, or after ``fixed`` steps.

    All mass starts on ``start``, by default the least id. A step sends 1 - bored of a node's mass along its links; the
    rest of it, and all mass of nodes without links, is spread evenly, which needs no dense matrix but two sums. Links
    stay partitioned by source over all steps; each step's scores are written, so lineage stays short and a lost
    executor costs one step.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    edges = clean(edges)
    ids = scratch.save(nodes_of(edges, nodes))
    degree = edges.groupBy("src").agg(F.count("*").alias("outdeg"))
    links = edges.join(degree, "src").repartition("src").persist()
    first = ids.agg(F.count("*").alias("n"), F.min("id").alias("m")).first()
    n = first["n"]
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    begin = first["m"] if start is None else start
    has = scratch.save(ids.join(degree, ids["id"] == degree["src"], "left").select("id", F.col("outdeg").isNotNull().alias("has_links")))
    ranks = scratch.save(has.select("id", "has_links", F.when(F.col("id") == begin, 1.0).otherwise(0.0).alias("score")))
    for _ in range(most if fixed is None else fixed):
        mass = ranks.agg(F.sum(F.when(F.col("has_links"), bored * F.col("score")).otherwise(F.col("score"))).alias("m")).first()["m"]
        sent = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("score") / F.col("outdeg")).alias("got"))
        new = ranks.join(sent, ranks["id"] == sent["dst"], "left").select(
            "id", "has_links", ((1 - bored) * F.coalesce("got", F.lit(0.0)) + mass / n).alias("score"), F.col("score").alias("before")
        )
        new = scratch.save(new)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("c")).first()["c"] if fixed is None else None
        scratch.drop(ranks)
        ranks = new
        if change is not None and change < epsilon:
            break
    links.unpersist()
    return ranks.select("id", "score")


def top(scores: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` best, or fewer where there are fewer; ties (to twelve digits) by id."""
    return scores.orderBy(F.desc(F.round("score", 12)), "id").limit(k)


# ---- Monte Carlo ----


def draw(walk: Column, step: Column, salt: int) -> Column:
    """A pseudo-random number below PRIME that depends on walk, step and salt alone: squarings and products modulo a
    prime, exact in 64 bits, so walks are the same on any engine and after any retry."""
    x = F.pmod(walk * 48271 + step * 69621 + (salt * 16807 + 12345), F.lit(PRIME))
    for add, factor in ((40692, 62089911), (39373, 742938285), (48217, 1226874159), (16807, 630360016)):
        # a one-element array names the number, so that the expression stays short
        x = F.transform(F.array(x), lambda z: F.pmod(F.pmod(z * z, F.lit(PRIME)) + F.pmod(z * factor, F.lit(PRIME)) + add, F.lit(PRIME)))[0]
    return x


def uniform(walk: Column, step: Column, salt: int) -> Column:
    return draw(walk, step, salt) / float(PRIME)


def monte_carlo(edges: DataFrame, walks: int, method: int, nodes: DataFrame | None = None, bored: float = 0.15) -> DataFrame:
    """``(id, score)`` estimated by random walks.

    Method 1: ``walks`` walks from random nodes, the share that ends at a node. Method 2: ``walks`` walks from every
    node, likewise. Method 4: ``walks`` from every node, the share of visits, walks stopping at nodes without links.
    Method 5: as 4 from random nodes. In 1 and 2 a walk jumps anywhere from a node without links.

    All walks that go on take a step together, one join with the table of links, until none does; those at rest stay in
    the table that was written when they stopped.
    """
    if method not in (1, 2, 4, 5):
        raise ValueError("method must be 1, 2, 4 or 5")
    spark = edges.sparkSession
    scratch = Scratch(spark, "walks")
    edges = clean(edges)
    degree = edges.groupBy("src").agg(F.count("*").alias("outdeg"))
    ids = nodes_of(edges, nodes)
    numbered = scratch.save(_number(ids.join(degree, ids["id"] == degree["src"], "left").select("id", F.coalesce("outdeg", F.lit(0)).alias("outdeg")), "id", "number"))
    n = numbered.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    # where a walk can go: by a node's place among its links, or by number from anywhere
    order = Window.partitionBy("src").orderBy("dst")
    links = edges.withColumn("place", (F.row_number().over(order) - 1).cast("long")).join(numbered, F.col("dst") == F.col("id"))
    moves = links.select(F.lit(False).alias("jump"), F.col("src").alias("at"), "place", F.col("dst").alias("to"), F.col("outdeg").alias("to_outdeg"))
    if method in (1, 2):
        moves = moves.unionByName(numbered.select(F.lit(True).alias("jump"), F.lit(0).cast("long").alias("at"), F.col("number").alias("place"), F.col("id").alias("to"), F.col("outdeg").alias("to_outdeg")))
    moves = scratch.save(moves)
    if method in (1, 5):
        begun = spark.range(walks).select(F.col("id").alias("walk"), F.pmod(draw(F.col("id"), F.lit(0).cast("long"), 3), F.lit(n)).alias("number")).join(numbered, "number")
    else:
        begun = numbered.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("walk", F.col("number") * walks + F.col("u"))
    path = F.array().cast("array<bigint>")
    now = begun.select("walk", F.col("id").alias("node"), "outdeg", path.alias("path"))
    ends, rested = method in (1, 2), []
    for step in count(1):
        s = F.lit(step).cast("long")
        on = uniform(F.col("walk"), s, 1) > bored
        now = now.withColumn("alive", on if ends else on & (F.col("outdeg") > 0))
        if not ends:
            now = now.withColumn("path", F.when(on, F.array_append("path", F.col("node"))).otherwise(F.col("path")))
        now = scratch.save(now)
        rested.append(now.where("not alive").select("node", "path"))
        now = now.where("alive")
        if not now.limit(1).count():
            break
        # only those that go on meet the links, and each of them has a place there
        pick = F.pmod(draw(F.col("walk"), s, 2), F.when(F.col("outdeg") > 0, F.col("outdeg")).otherwise(F.lit(n)))
        now = now.select("walk", "path", (F.col("outdeg") == 0).alias("jump"), F.when(F.col("outdeg") == 0, 0).otherwise(F.col("node")).alias("at"), pick.alias("place"))
        now = now.join(moves, ["jump", "at", "place"]).select("walk", F.col("to").alias("node"), F.col("to_outdeg").alias("outdeg"), "path")
    now = reduce(DataFrame.unionByName, rested)
    seen = now.select("node") if ends else now.select(F.explode("path").alias("node"))
    total = seen.groupBy("node").agg(F.count("*").alias("c"))
    size = {1: float(walks), 2: float(walks * n)}.get(method) or float(total.agg(F.sum("c")).first()[0] or 1)
    return numbered.join(total, numbered["id"] == total["node"], "left").select("id", (F.coalesce("c", F.lit(0)) / size).alias("score"))


def _number(df: DataFrame, by: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``by``: a range partition, its counts (one a partition), an offset."""

    parts = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id())
    parts = Scratch(df.sparkSession, "number").save(parts)
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return parts.join(F.broadcast(table), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_part", "_before")  # one row a partition


def walk_error(golden: DataFrame, estimate: DataFrame, k: int = 30) -> DataFrame:
    """Summed squared error over the golden ``(id, score)`` rows; an id outside the estimate's best ``k`` counts as 0."""
    best = top(estimate, k).select("id", F.col("score").alias("mc"))
    return golden.join(best, "id", "left").agg(F.sum(F.pow(F.col("score") - F.coalesce("mc", F.lit(0.0)), 2)).alias("error"))


# ---- HITS ----


def base_set(edges: DataFrame, root: DataFrame) -> DataFrame:
    """The root ids with all they link to and all that link to them."""
    edges = clean(edges)
    ids = root.select("id").distinct()
    out = edges.join(ids, edges["src"] == ids["id"], "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(ids, edges["dst"] == ids["id"], "left_semi").select(F.col("src").alias("id"))
    return ids.unionByName(out).unionByName(into).distinct()


def hits(edges: DataFrame, ids: DataFrame | None = None, epsilon: float = 1e-4, most: int = 1000, fixed: int | None = None) -> DataFrame:
    """``(id, hub, authority)`` with unit lengths, over the links within ``ids`` (default: all).

    Both are computed from the step before. Stops when the hubs' summed change is at most epsilon x nodes.
    """
    scratch = Scratch(edges.sparkSession, "hits")
    edges = clean(edges)
    if ids is None:
        ids = nodes_of(edges)
    else:
        ids = ids.select("id").distinct()
        edges = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    edges = scratch.save(edges)
    now = scratch.save(ids.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))
    n = now.count()
    for _ in range(most if fixed is None else fixed):
        hub = edges.join(now, edges["dst"] == now["id"]).groupBy("src").agg(F.sum("authority").alias("h"))
        authority = edges.join(now, edges["src"] == now["id"]).groupBy("dst").agg(F.sum("hub").alias("a"))
        raw = now.select("id", F.col("hub").alias("before")).join(hub, F.col("id") == F.col("src"), "left").join(authority, F.col("id") == F.col("dst"), "left")
        raw = scratch.save(raw.select("id", "before", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a")))
        norm = raw.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("a")).first()
        h, a = norm["h"] or 1.0, norm["a"] or 1.0  # no links: all zero
        new = raw.select("id", (F.col("h") / h).alias("hub"), (F.col("a") / a).alias("authority"), "before")
        change = None if fixed is not None else (new.agg(F.sum(F.abs(F.col("hub") - F.col("before")))).first()[0] or 0.0)
        saved = scratch.save(new.select("id", "hub", "authority"))
        scratch.drop(raw)
        scratch.drop(now)
        now = saved
        if change is not None and change <= epsilon * n:
            break
    return now


def hits_score(scores: DataFrame) -> DataFrame:
    return scores.select("id", (0.5 * F.col("hub") + 0.5 * F.col("authority")).alias("score"))
