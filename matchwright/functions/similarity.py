"""Similarities of two columns. All but Jaro-Winkler are built-in expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro similarity; 0 for two empty texts."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(n, m) // 2 - 1)
    used = bytearray(m)
    left = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), min(m, i + reach + 1))
        while j >= 0 and used[j]:
            j = b.find(c, j + 1, min(m, i + reach + 1))
        if j >= 0:
            used[j] = 1
            left.append(c)
    if not left:
        return 0.0
    k = len(left)
    right = [b[j] for j in range(m) if used[j]]
    half = sum(x != y for x, y in zip(left, right)) // 2
    return (k / n + k / m + (k - half) / k) / 3


def jaro_winkler_text(a: str, b: str, scale: float = 0.1, above: float = 0.7) -> float:
    """Jaro-Winkler; the prefix counts only where Jaro exceeds ``above``."""
    j = jaro(a, b)
    if j <= above:
        return j
    p = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        p += 1
    return j + p * scale * (1 - j)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two texts, null if either is null. Python in Arrow batches:
    use it on distinct pairs of values (``with_jaro_winkler``)."""

    @F.arrow_udf(T.DoubleType())
    def apply(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if u is None or v is None else jaro_winkler_text(u, v) for u, v in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return apply(a, b)


def jaro_winkler_bound(a: Column, b: Column) -> Column:
    """No pair scores above this: min(length) characters can agree at best. Built-in,
    so a filter on it runs before any Python."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    j = (F.lit(1.0) + F.try_divide(short.cast("double"), long) + 1.0) / 3
    return F.when(short == 0, F.lit(0.0)).otherwise(F.when(j <= 0.7, j).otherwise(j + 0.4 * (1 - j)))


def with_jaro_winkler(pairs: DataFrame, left: str, right: str, to: str, least: float = 0.0) -> DataFrame:
    """``pairs`` with ``to``, the Jaro-Winkler similarity of two of its columns.

    Equal values score 1 (empty ones 0), pairs whose lengths cannot reach
    ``least`` score 0, and only the other distinct pairs of values go through
    Python, each once."""
    a, b = F.col(left), F.col(right)
    hard = a.isNotNull() & b.isNotNull() & (a != b) & (jaro_winkler_bound(a, b) >= least)
    distinct = pairs.where(hard).select(a.alias("__a"), b.alias("__b")).distinct()
    scored = distinct.withColumn("__s", jaro_winkler(F.col("__a"), F.col("__b")))
    known = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.when(a == "", F.lit(0.0)).otherwise(F.lit(1.0)))
    joined = pairs.join(scored, hard & (a == F.col("__a")) & (b == F.col("__b")), "left")
    return joined.withColumn(to, F.when(hard, F.coalesce("__s", F.lit(0.0))).otherwise(F.coalesce(known, F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0))))).drop("__a", "__b", "__s")


def on_distinct_pairs(pairs: DataFrame, left: str, right: str, measures: dict[str, Column]) -> DataFrame:
    """``pairs`` with each measure of two of its columns, computed once for each distinct
    pair of values and joined back. The measures are written over columns ``l`` and
    ``r``; they are null where a value is."""
    a, b = F.col(left), F.col(right)
    distinct = pairs.where(a.isNotNull() & b.isNotNull()).select(a.alias("l"), b.alias("r")).distinct()
    scored = distinct.select(F.col("l").alias("__l"), F.col("r").alias("__r"), *[m.alias(n) for n, m in measures.items()])
    return pairs.join(scored, (a == F.col("__l")) & (b == F.col("__r")), "left").drop("__l", "__r")


def jaro_winkler_thresholds(strictness: float) -> list[float]:
    """Ordinal levels: the strictness, .07 and .15 below it, none above .98."""
    # fixed values: the steps and the cap
    return sorted({t for x in (strictness, strictness - 0.07, strictness - 0.15) if (t := round(min(x, 0.98), 3)) > 0}, reverse=True)


def qgrams(x: Column, q: int = 2) -> Column:
    """The q-grams of a text in order; a shorter text is its own only one, an empty one has none."""
    n = F.length(x)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (q - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(q)))
    return F.when(n > 0, many).when(n == 0, F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), both), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), small), F.lit(0.0))


def multiset_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays' counts (q-grams or words); 0 if either is empty."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v)).cast("double")
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    dot = total(F.array_intersect(a, b), lambda v: count(a, v) * count(b, v))
    norm = lambda xs: F.sqrt(total(F.array_distinct(xs), lambda v: count(xs, v) * count(xs, v)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0)))


def string_cosine(a: Column, b: Column, q: int = 2) -> Column:
    return multiset_cosine(qgrams(a, q), qgrams(b, q))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / long)


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Whether the edit distance is at most ``most``; the bounded form gives -1 beyond."""
    return F.levenshtein(a, b, most) >= 0


def exact(a: Column, b: Column, missing: float | None = None) -> Column:
    """1.0 or 0.0; ``missing`` (null by default) where either side is null."""
    return F.when(a.isNull() | b.isNull(), F.lit(missing).cast("double")).otherwise((a == b).cast("double"))


def numeric_features(a: Column, b: Column) -> dict[str, Column]:
    """abs and rel difference with missing as 0, and whether both are known."""
    x, y = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    gap, top = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    return {"abs": gap, "rel": gap / F.when(top == 0, F.lit(1.0)).otherwise(top), "known": (a.isNotNull() & b.isNotNull()).cast("double")}


def price_similarity(a: Column, b: Column) -> Column:
    """Absolute log ratio of two positive numbers; null where either is not."""
    return F.when((a > 0) & (b > 0), F.abs(F.ln(a) - F.ln(b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null, zero or of another length."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def vector_euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), 1.0 / (1.0 + F.sqrt(dot(gap, gap))))
