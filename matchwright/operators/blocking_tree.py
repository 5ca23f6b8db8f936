"""Blocking by a learned tree of functions.

A function is a predicate of the lattice that gives a record one key. Each node of the
tree splits its records by the function that removes the most comparisons for the known
matches it parts; records go down the tree and those that end in one leaf are compared.
A level of the tree is one pass: all its nodes are weighed at once, from counts of
(node, function, key) that are added up before they are shuffled. A function that has
been used above a node cannot split it again, so there are at most as many levels as
functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .predicates import SEPARATOR, Predicate, key_pairs, lattice

#: A node's row is laid out for so many tasks, since one node may hold most records.
SALTS = 32
ROOT = ""


@dataclass
class BlockingTree:
    """splits: (level, node, f, function, n, comparisons, lost), a row for each inner node; f numbers
    ``functions``. levels: how many the tree has."""

    functions: list[Predicate]
    splits: DataFrame
    levels: int

    def leaves(self, records: DataFrame) -> DataFrame:
        """(id, node) of records, also of others than those learned from. A key that the tree
        has not seen leads to a leaf of its own."""
        at = _keyed(records, self.functions)
        for level in range(self.levels):
            split = self.splits.where(F.col("level") == level)
            at = _beside(at, split.select("node", "f", "function"), "id", "left").select("id", "keys", F.when(F.col("f").isNull(), F.col("node")).otherwise(_child()).alias("node"))
        return at.select("id", "node")

    def pairs(self, left: DataFrame, right: DataFrame | None = None, most: int = 2000) -> DataFrame:
        """(left_id, right_id) of the records that share a leaf. Leaves of more than ``most``
        records are dealt to (part, part) tasks."""
        return key_pairs(self.leaves(left), None if right is None else self.leaves(right), ["node"], most).select("left_id", "right_id")


def _keyed(records: DataFrame, functions: list[Predicate]) -> DataFrame:
    """Records at the root with their key under each function; a missing value's is empty, which no value's is."""
    keys = F.array(*[F.coalesce(F.get(p.keys(), F.lit(0)), F.lit("")) for p in functions]).cast("array<string>")
    return records.select("id", keys.alias("keys"), F.lit(ROOT).alias("node"))


def _child(keys: str = "keys") -> Column:
    return F.md5(F.concat_ws(SEPARATOR, "node", "function", F.get(keys, F.col("f"))))


def _beside(rows: DataFrame, nodes: DataFrame, salt: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to the one row of their node."""
    salted = nodes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, ["node", "__salt"], how).drop("__salt")


def learn_tree(records: DataFrame, matches: DataFrame, columns: list[str], most: int) -> BlockingTree:
    """A tree for ``records`` (id, columns) from the known ``matches`` (left_id, right_id) among them.

    A node of more than ``most`` records is split by the function with the largest
    removed comparisons / (1 + matches parted), of equals by the one that parts
    fewer, then by the first. A node that no function splits stays a leaf, whatever its
    size. Matches of absent records count for nothing."""
    functions = [p for p in lattice(records, columns) if not p.many]
    names = F.array(*[F.lit(p.name) for p in functions])
    state = stored(_keyed(records, functions), "tree")
    side = lambda s: state.select(F.col("id").alias(f"{s}_id"), F.col("keys").alias(s))
    known = matches.select("left_id", "right_id").distinct().join(side("left"), "left_id").join(side("right"), "right_id")
    known = stored(known.withColumn("node", F.lit(ROOT)), "matches")
    splits, level = None, 0
    while True:
        counts = stored(state.select("node", F.posexplode("keys").alias("f", "key")).groupBy("node", "f", "key").agg(F.count("*").alias("n")), "counts")
        kept = F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long"))
        cost = counts.groupBy("node", "f").agg(F.sum("n").alias("n"), kept.alias("comparisons"))
        parted = known.select("node", F.posexplode(F.zip_with("left", "right", lambda x, y: (x != y).cast("long"))).alias("f", "parts"))
        lost = parted.groupBy("node", "f").agg(F.sum("parts").alias("lost"))
        removed = (F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.col("comparisons")
        weighed = cost.join(lost, ["node", "f"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long")).where((F.col("n") > most) & (removed > 0))
        best = Window.partitionBy("node").orderBy(F.desc(removed / (1.0 + F.col("lost"))), "lost", "f")
        chosen = weighed.withColumn("__r", F.row_number().over(best)).where("__r = 1")
        chosen = stored(chosen.select(F.lit(level).alias("level"), "node", "f", F.get(names, F.col("f")).alias("function"), "n", "comparisons", "lost"), "splits")
        splits = chosen if splits is None else splits.unionByName(chosen)
        if chosen.isEmpty():
            return BlockingTree(functions, splits, level)
        how = chosen.select("node", "f", "function")
        # Only children that are still too large go on, with the matches inside them.
        large = stored(counts.where(F.col("n") > most).join(how, ["node", "f"]).select(F.md5(F.concat_ws(SEPARATOR, "node", "function", "key")).alias("node")), "large")
        state = stored(_beside(_beside(state, how, "id").select("id", "keys", _child().alias("node")), large, "id"), "tree")
        together = _beside(known, how, "left_id").where(F.get("left", F.col("f")) == F.get("right", F.col("f")))
        known = stored(_beside(together.select("left_id", "right_id", "left", "right", _child("left").alias("node")), large, "left_id"), "matches")
        level += 1
