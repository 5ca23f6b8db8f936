"""Ranks, Friedman and Nemenyi tests, Pareto fronts over result tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chi2

#: Nemenyi's q at alpha 0.05 for 2 to 10 systems (Demsar, 2006).
NEMENYI_Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def family_means(results: DataFrame, metrics: list[str]) -> DataFrame:
    return results.groupBy("framework").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def score_matrix(results: DataFrame, metric: str, frameworks: list[str] | None = None) -> DataFrame:
    """dataset by framework."""
    pivot = results.groupBy("dataset").pivot("framework", frameworks) if frameworks else results.groupBy("dataset").pivot("framework")
    return pivot.agg(F.first(metric, ignorenulls=True))


def average_ranks(results: DataFrame, metric: str) -> DataFrame:
    """``results`` with ``avg_rank`` inside its data set: 1 is best, ties share the mean
    of their places."""
    in_set = Window.partitionBy("dataset")
    tied = F.count("*").over(Window.partitionBy("dataset", metric))
    return results.withColumn("avg_rank", F.rank().over(in_set.orderBy(F.desc(metric))) + (tied - 1) / 2.0)


def mean_ranks(results: DataFrame, metric: str) -> DataFrame:
    """(framework, mean_rank, n), best first."""
    return average_ranks(results, metric).groupBy("framework").agg(F.avg("avg_rank").alias("mean_rank"), F.count("*").alias("n")).orderBy("mean_rank", "framework")


def friedman(results: DataFrame, metric: str) -> dict[str, float]:
    """chi2 with correction for ties, its p-value, k systems and n data sets. Data sets
    that lack a system are left out."""
    k = results.select("framework").distinct().count()
    sized = results.where(F.col(metric).isNotNull()).withColumn("__n", F.count("*").over(Window.partitionBy("dataset"))).where(F.col("__n") == k).drop("__n")
    ranks = average_ranks(sized, metric)
    n = sized.select("dataset").distinct().count()
    sums = [r["s"] for r in ranks.groupBy("framework").agg(F.sum("avg_rank").alias("s")).collect()]
    ties = ranks.groupBy("dataset", metric).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("c")).first()["c"] or 0
    if n == 0 or k < 2:
        return {"chi2": float("nan"), "p": float("nan"), "k": k, "n": n}
    base = 12.0 / (n * k * (k + 1)) * sum(s * s for s in sums) - 3.0 * n * (k + 1)
    correction = 1.0 - ties / (n * k * (k * k - 1.0))
    value = base / correction if correction else float("nan")
    return {"chi2": value, "p": chi2.survival(value, k - 1), "k": k, "n": n}


def critical_difference(k: int, n: int) -> float:
    """Mean ranks of ``k`` systems over ``n`` data sets differ significantly beyond this."""
    return NEMENYI_Q05[k] * math.sqrt(k * (k + 1) / (6.0 * n))


def cliques(ranks: dict[str, float], cd: float) -> list[list[str]]:
    """Maximal runs of systems, by rank, that differ by ``cd`` at most; of two or more."""
    order = sorted(ranks, key=lambda s: (ranks[s], s))
    out: list[list[str]] = []
    reach = -1
    for i, a in enumerate(order):
        j = max(k for k in range(i, len(order)) if ranks[order[k]] - ranks[a] <= cd)
        if j > i and j > reach:
            out.append(order[i : j + 1])
            reach = j
    return out


def pareto_front(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """The rows that no other beats: another is at least as cheap and as good, and
    better in one. In order of cost, a row stays if its quality exceeds all before."""
    best_at = points.groupBy(F.col(cost).alias("__c")).agg(F.max(quality).alias("__q"))
    before = best_at.withColumn("__b", F.max("__q").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)))
    kept = before.where(F.col("__b").isNull() | (F.col("__q") > F.col("__b"))).select("__c", "__q")
    return points.join(kept, (F.col(cost) == F.col("__c")) & (F.col(quality) == F.col("__q"))).drop("__c", "__q")


def largest_size(results: DataFrame) -> DataFrame:
    """(framework, reached): the largest size that each completed."""
    return results.where("status = 'OK'").groupBy("framework").agg(F.max("size").alias("reached"))
