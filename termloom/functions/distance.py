"""Edit distance and k-gram likeness as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(word: Column) -> Column:
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def indel_distance(a: Column, b: Column) -> Column:
    """Edit distance with insertions and deletions at 1 and substitutions at 2.

    A row of the dynamic programme is an array; each letter of ``a`` folds it into the next one."""
    first = F.sequence(F.lit(0), F.length(b))
    other = F.transform(letters(b), lambda y, j: F.struct(y.alias("y"), j.alias("j")))

    def row(old: Column, x: Column) -> Column:
        start = F.array(F.element_at(old, 1) + 1)
        return F.aggregate(
            other,
            start,
            lambda new, c: F.concat(
                new,
                F.array(
                    F.least(
                        F.element_at(new, -1) + 1,
                        F.element_at(old, c["j"] + 2) + 1,
                        F.element_at(old, c["j"] + 1) + F.when(c["y"] == x, 0).otherwise(2),
                    )
                ),
            ),
        )

    return F.element_at(F.aggregate(letters(a), first, row), -1)


def kgrams(word: Column, k: int, padded: bool, distinct: bool) -> Column:
    """The word's k-grams; ``padded`` puts ``^`` before and ``$`` after it first. Shorter words have none."""
    w = F.concat(F.lit("^"), word, F.lit("$")) if padded else word
    grams = F.when(F.length(w) >= k, F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: F.substr(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(grams) if distinct else grams


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
