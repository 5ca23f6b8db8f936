"""Train, validation and test splits that share no record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .clustering import components_over
from .pairs import unordered, without
from .topn import sample_exact


def component_splits(universe: DataFrame, positives: DataFrame, train: float = 0.70, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """(node, component, split): whole components, in an order by hash, fill train, then
    valid, then test; a component belongs where the running total before it falls.

    The running total is summed in two levels (hash buckets, then components inside
    a bucket), so no single task orders all components."""
    comps = components_over(universe, positives).withColumnRenamed("cluster_id", "component")
    sizes = comps.groupBy("component").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("component", F.lit(seed))).withColumn("b", F.shiftright("h", 52).cast("int"))
    per = sizes.groupBy("b").agg(F.sum("n").alias("m"))
    before = per.select("b", (F.sum("m").over(Window.orderBy("b")) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = sizes.withColumn("run", inside).join(before, "b").withColumn("at", F.col("base") + F.col("run"))
    name = F.when(F.col("at") < train * F.col("total"), "train").when(F.col("at") < (train + valid) * F.col("total"), "valid").otherwise("test")
    return comps.join(placed.select("component", name.alias("split")), "component").select("node", "component", "split")


def pairs_in_split(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the split of both their records; pairs across splits are left out."""
    a = nodes.select(F.col("node").alias("left_id"), F.col("split"))
    b = nodes.select(F.col("node").alias("right_id"), F.col("split").alias("__s"))
    return pairs.join(a, "left_id").join(b, "right_id").where("split = __s").drop("__s")


def hard_negatives(records: DataFrame, key: str, positives: DataFrame, target: int, seed: int = 42, tries: int = 3) -> DataFrame:
    """``target`` pairs that agree on ``key`` and are no match; all there are, if fewer.
    Inside a block, ordered by hash, a record meets the next ``tries`` records, and ever
    more of them while pairs are wanting: no more pairs are formed than that takes."""
    order = Window.partitionBy(key).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    placed = stored(records.where(F.col(key).isNotNull()).select("id", F.col(key).alias("k"), F.row_number().over(order).alias("place")), "placed")
    largest = placed.agg(F.max("place")).first()[0] or 0
    known = unordered(positives.select("left_id", "right_id")).hint("merge")
    while True:
        ahead = placed.select(F.col("id").alias("left_id"), "k", F.explode(F.sequence(F.col("place") + 1, F.col("place") + tries)).alias("place"))
        pairs = ahead.join(placed.select(F.col("id").alias("right_id"), "k", "place").hint("merge"), ["k", "place"]).where("left_id <> right_id").select("left_id", "right_id")
        fresh = stored(without(unordered(pairs), known), "negatives")
        if tries >= largest - 1 or fresh.count() >= target:
            return sample_exact(fresh, target, "left_id", "right_id", seed=seed)
        dropped(fresh)
        tries *= 4


def random_negatives(records: DataFrame, positives: DataFrame, target: int, seed: int = 42, known: DataFrame | None = None) -> DataFrame:
    """``target`` pairs drawn at random that are no match and not among ``known``; all
    there are, if fewer. Each record draws places in a hashed order of all records, and
    ever more of them, up to each place once, while pairs are wanting."""
    n = max(1, records.count())
    draws = min(n, -(-max(2 * target, 64) // n) + 1)
    slots = F.lit(n)
    taken = unordered(positives.select("left_id", "right_id"))
    taken = (taken if known is None else unordered(taken.unionByName(known.select("left_id", "right_id")))).hint("merge")
    other = stored(records.select(F.col("id").alias("b"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), slots).alias("slot")), "slots").hint("merge")
    while True:
        drawn = records.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
        drawn = drawn.select("a", F.pmod(F.pmod(F.xxhash64("a", F.lit(seed)), slots) + F.col("d"), slots).alias("slot"))
        pairs = unordered(drawn.join(other, "slot").where("a <> b").select(F.col("a").alias("left_id"), F.col("b").alias("right_id")))
        fresh = stored(without(pairs, taken), "negatives")
        if draws >= n or fresh.count() >= target:
            return sample_exact(fresh, max(0, target), "left_id", "right_id", seed=seed)
        dropped(fresh)
        draws = min(n, 4 * draws)


def labelled_split(records: DataFrame, positives: DataFrame, key: str, per_positive: float = 3.0, hard_share: float = 0.3, seed: int = 42) -> DataFrame:
    """(left_id, right_id, label): a split's matches, and others at ``per_positive`` each:
    first hard ones, then random ones. Matches are found once. No table goes to the driver: what a
    file of records or pairs takes in memory does not show in its size, so the joins are merged."""
    pos = stored(unordered(positives.select("left_id", "right_id")), "positives")
    want = int(pos.count() * per_positive)
    hard = stored(hard_negatives(records, key, pos, int(want * hard_share), seed), "hard")
    rand = random_negatives(records, pos, want - hard.count(), seed, hard)
    return pos.withColumn("label", F.lit(1)).unionByName(hard.unionByName(rand).withColumn("label", F.lit(0)))
