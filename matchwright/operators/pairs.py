"""Filters, samples, lookups and set operations on pairs of records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topn import sample_exact

#: Rows that one task makes distinct.
PART = 1_000_000


def by_label(pairs: DataFrame, label: int) -> DataFrame:
    return pairs.where(F.col("label") == label)


class ReferentialError(ValueError):
    """Too many pairs name records that are not there."""


def referential(pairs: DataFrame, left: DataFrame, right: DataFrame, tolerance: float | None = 0.0) -> tuple[DataFrame, dict[str, int]]:
    """The pairs whose ids both tables have, and counts of the others. More than the
    ``tolerance`` share of lost pairs raises (swapped sides lose pairs silently
    otherwise); None only counts."""
    lids = left.select(F.col("id").alias("left_id")).distinct().withColumn("__l", F.lit(True))
    rids = right.select(F.col("id").alias("right_id")).distinct().withColumn("__r", F.lit(True))
    marked = pairs.join(lids, "left_id", "left").join(rids, "right_id", "left")
    n = marked.agg(F.count("*").alias("pairs"), F.count_if(F.col("__l").isNull()).alias("left_missing"), F.count_if(F.col("__r").isNull()).alias("right_missing"), F.count_if(F.col("__l").isNull() | F.col("__r").isNull()).alias("dropped")).first().asDict()
    if tolerance is not None and n["dropped"] > tolerance * n["pairs"]:
        raise ReferentialError(f"{n['dropped']} of {n['pairs']} pairs name missing records ({n['left_missing']} left, {n['right_missing']} right)")
    return marked.where("__l AND __r").select(*pairs.columns), n


def downsample(pairs: DataFrame, ratio: float, seed: int = 42, cap: int | None = None) -> DataFrame:
    """All matches and ``ratio`` times as many others."""
    matches = by_label(pairs, 1)
    want = int(matches.count() * ratio)
    others = sample_exact(by_label(pairs, 0), min(want, cap) if cap is not None else want, "left_id", "right_id", seed=seed)
    return matches.unionByName(others)


def capped_training(pairs: DataFrame, matches: int = 2500, others: int = 7500, seed: int = 42) -> DataFrame:
    """A training sample of bounded size."""
    return sample_exact(by_label(pairs, 1), matches, "left_id", "right_id", seed=seed).unionByName(sample_exact(by_label(pairs, 0), others, "left_id", "right_id", seed=seed))


def above(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return pairs.where(F.col(score) >= threshold)


def without_id_features(df: DataFrame, prefixes: tuple[str, ...] = ("id_", "_id")) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(prefixes)])


def unordered(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Each pair with the smaller id on the left, once. The rows are counted first and dealt to
    parts of about ``PART`` rows, so what a task holds does not grow with the table."""
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs.count() / PART))
    return pairs.withColumns({left: F.least(left, right), right: F.greatest(left, right)}).repartition(parts, left, right).distinct()


def lookup(pairs: DataFrame, left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs with both records' columns, as ``<name>_l`` and ``<name>_r``."""
    l = left.select(*[F.col(f"`{c}`").alias("left_id" if c == "id" else f"{c}_l") for c in left.columns])  # noqa: E741
    r = right.select(*[F.col(f"`{c}`").alias("right_id" if c == "id" else f"{c}_r") for c in right.columns])
    return pairs.join(l, "left_id", how).join(r, "right_id", how)


def scores_for(split: DataFrame, scored: DataFrame, missing: float = 0.0, symmetric: bool = False) -> DataFrame:
    """A split's pairs with their score, ``missing`` where there is none. With
    ``symmetric``, for one source only, a pair is found in either direction."""
    s = scored.select("left_id", "right_id", F.col("score"))
    if not symmetric:
        best = s.groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
        return split.join(best, ["left_id", "right_id"], "left").withColumn("score", F.coalesce("score", F.lit(missing)))
    best = s.groupBy(F.least("left_id", "right_id").alias("__a"), F.greatest("left_id", "right_id").alias("__b")).agg(F.max("score").alias("score"))
    keyed = split.withColumns({"__a": F.least("left_id", "right_id"), "__b": F.greatest("left_id", "right_id")})
    return keyed.join(best, ["__a", "__b"], "left").withColumn("score", F.coalesce("score", F.lit(missing))).drop("__a", "__b")


def same_cluster(split: DataFrame, clusters: DataFrame) -> DataFrame:
    """A split's pairs with ``score`` 1 if both records are in one cluster, else 0;
    a record without a cluster matches nothing."""
    a = clusters.select(F.col("node").alias("left_id"), F.col("cluster_id").alias("__a"))
    b = clusters.select(F.col("node").alias("right_id"), F.col("cluster_id").alias("__b"))
    joined = split.join(a, "left_id", "left").join(b, "right_id", "left")
    return joined.withColumn("score", F.coalesce((F.col("__a") == F.col("__b")).cast("double"), F.lit(0.0))).drop("__a", "__b")


def within_clusters(clusters: DataFrame, cross_source: bool = False) -> DataFrame:
    """(left_id, right_id) pairs inside clusters: each unordered pair once, or each
    pair of a record of source a with one of source b. The number of pairs is that
    of the answer itself; for scores of a given split use ``same_cluster``."""
    a = clusters.select("cluster_id", F.col("node").alias("left_id"), *([F.col("src").alias("__s")] if cross_source else []))
    b = clusters.select("cluster_id", F.col("node").alias("right_id"), *([F.col("src").alias("__t")] if cross_source else []))
    rule = (F.col("__s") < F.col("__t")) if cross_source else (F.col("left_id") < F.col("right_id"))
    return a.join(b, "cluster_id").where(rule).select("left_id", "right_id", "cluster_id")


def disjoint(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    """Whether two tables share no key."""
    return a.select(*keys).join(b.select(*keys), list(keys), "left_semi").isEmpty()


def without(pairs: DataFrame, known: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """The pairs that are not among ``known`` ones."""
    return pairs.join(known.select(left, right), [left, right], "left_anti")


def null_safe_key(*keys: Column) -> Column:
    """One comparable key of several; null if any part is, so it never meets another."""
    return F.when(~F.greatest(*[k.isNull().cast("int") for k in keys], F.lit(0)).cast("boolean"), F.struct(*keys))
