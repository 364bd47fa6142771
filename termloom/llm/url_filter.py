"""URL filtering by host-suffix and path-prefix expressions, matched on short digests first. Built-in functions only.

Main path: every distinct URL is expanded into (host suffix + path prefix) expressions, an equi-join on the first
eight hex digits of their SHA-256 finds candidate rules, the full digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", keys: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """Judge every row of ``pages`` by ``rules(host, path, verdict)``.

    Returns the key columns, ``host``, ``path``, ``rule`` (the winning rule's host and path, else null) and
    ``verdict`` (the rule's, else ``default``). A rule fits its host and all of its subdomains if the URL's path
    starts with the rule's path. The longest rule (host and path together) wins; ties go to the longer host, then to
    ``block``. Duplicate rules count once; a rule with a null host or path counts as having an empty one.

    Null and malformed URLs have an empty host and path, so that only a rule with an empty host could fit them.
    Repeated rows are judged once and returned as often as they occur; null keys are values like any other; other
    columns, whatever their names, are not read. Empty tables give empty results or the default verdict.

    A page's row is never joined while it is wide: only keys and URL are read. Rows that agree are counted together
    first, so hot URLs shrink before the exchange, and the expansion is limited to suffix and prefix lengths that
    occur among the rules (a few integers, gathered from the rule table alone). Whether the digest join is a
    broadcast is left to the planner, which knows the rules' size; a larger table is joined by an exchange whose
    skewed keys adaptive execution splits.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = (
        rules.select(F.translate(text("host"), _UPPER, _LOWER).alias("rule_host"), text("path").alias("rule_path"), F.lower("verdict").alias("rule_verdict"))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
    )
    shape = known.agg(
        F.collect_set(F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    digest = known.withColumn("digest", F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)).withColumn("short", F.substring("digest", 1, 8))

    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    # one row for each distinct (keys, url), with its number of copies
    rows = pages.select(*key, F.col(url).alias("_url")).groupBy(*names, "_url").agg(F.count("*").alias("_n"))
    parts = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))

    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    pieces = F.split("_host", r"\.")
    suffix = [
        F.when(F.size(pieces) >= n, F.array_join(F.slice(pieces, -n, n), ".")) if n else F.lit("")
        for n in labels
    ]
    prefix = [F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths]
    none = F.array().cast("array<string>")
    expressions = F.explode(
        F.flatten(
            F.transform(
                F.array_compact(F.array(*suffix)) if suffix else none,
                lambda h: F.transform(F.array_compact(F.array(*prefix)) if prefix else none, lambda p: F.concat(h, F.lit("\n"), p)),
            )
        )
    )
    wanted = parts.select(*names, "_url", "_n", expressions.alias("_e")).withColumn("_d", F.sha2("_e", 256))
    hits = wanted.withColumn("short", F.substring("_d", 1, 8)).join(digest, "short").where(F.col("_d") == F.col("digest"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        F.col("rule_verdict").alias("verdict"),
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    # the rows without a hit come along with a null rank, so that no second join is needed
    best = (
        hits.select(*names, "_url", "_n", rank.alias("_r"))
        .unionByName(rows.select(*names, "_url", "_n", F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>").alias("_r")))
        .groupBy(*names, "_url", "_n")
        .agg(F.max("_r").alias("_r"))
    )
    return (
        best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .select(
            *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
            host_of(F.col("_url")).alias("host"),
            path_of(F.col("_url")).alias("path"),
            F.col("_r.rule").alias("rule"),
            F.coalesce(F.col("_r.verdict"), F.lit(default)).alias("verdict"),
        )
    )
