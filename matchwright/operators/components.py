"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored


def _star(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node that
    its links reach. Nodes may have any type that can be ordered.

    Links with a null end and loops add nothing; repeated links and both
    directions of one link count once; an empty table gives an empty one. Each
    round is two aggregations and two joins on the links, which shrink to a star
    for each component in a number of rounds that is logarithmic in the nodes.
    Smallest neighbours are aggregated before they are joined back, so the
    links of one much-linked node can be dealt to several tasks."""
    kind = edges.schema[left].dataType
    pairs = edges.select(F.col(left).cast(kind).alias("a"), F.col(right).cast(kind).alias("b")).where("a <> b")
    links = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(_star(both), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        small = stored(_star(large), "small")
        joined = large.join(small, "a")
        after = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = stored(after.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        # a star for each component: no node is both an end and a centre, and each end has one centre
        state = after.agg(F.count("*").alias("n"), F.countDistinct("a").alias("ends")).first()
        chained = state["n"] != state["ends"] or not after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        for old in (links, least, large, small):
            dropped(old)
        links = after
        if not chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
