"""A training sample of pairs, most of them from blocks, without forming the pairs.

Random pairs are hardly ever alike, and pairs of blocks hardly ever unlike: a learner needs
both. The stated share of the draws goes to the blocks of some predicates, in proportion to
their pairs, the rest to all pairs alike; a draw is two positions in a block. How often a
pair is to be expected follows from the blocks that its records share, so each drawn pair
carries the weight that undoes the bias (Hansen and Hurwitz, 1943): weighted sums estimate
those over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .predicates import Predicate, posted

BLOCK = ["predicate", "key"]


def _ranked(posts: DataFrame, most: int) -> DataFrame:
    """(predicate, key, id, at, n): members of each block numbered from 0. Numbers are given
    in parts of about ``most``, so that a block of very many records is no single task."""
    sizes = posts.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id", F.lit(-3)), F.ceil(F.col("n") / most)).alias("part")
    dealt = stored(posts.join(sizes, BLOCK).select(*BLOCK, "id", "n", part), "dealt")
    parts = dealt.groupBy(*BLOCK, "part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*BLOCK).orderBy("part")) - F.col("held")
    own = F.row_number().over(Window.partitionBy(*BLOCK, "part").orderBy("id")) - 1
    return dealt.withColumn("own", own).join(parts.select(*BLOCK, "part", before.alias("before")), [*BLOCK, "part"]).select(*BLOCK, "id", (F.col("before") + F.col("own")).alias("at"), "n")


def _draw(seed: int, which: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(which), *BLOCK, "draw")


def blocked_sample(left: DataFrame, right: DataFrame | None, predicates: list[Predicate], size: int, blocked: float = 0.9, seed: int = 1, most: int = 100_000) -> DataFrame:
    """(left_id, right_id, draws, weight): about ``size`` draws, the share ``blocked`` from the
    blocks, with replacement; without ``right`` left_id < right_id. The weights sum to about the
    number of all pairs. Ids are distinct on a side. The same seed draws the same pairs."""
    every = lambda df: df.select("id", F.lit(-1).alias("predicate"), F.lit("").alias("key"))
    posts = lambda df: (posted(df, predicates).unionByName(every(df)) if predicates else every(df)).distinct()
    a = stored(_ranked(posts(left), most), "left")
    b = a if right is None else stored(_ranked(posts(right), most), "right")
    blocks = a.groupBy(*BLOCK).agg(F.first("n").alias("n"))
    if right is None:
        blocks = blocks.select(*BLOCK, "n", (F.col("n") - 1).alias("m"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    else:
        blocks = blocks.join(b.groupBy(*BLOCK).agg(F.first("n").alias("m")), BLOCK).select(*BLOCK, "n", "m", (F.col("n").cast("double") * F.col("m")).alias("pairs"))
    blocks = stored(blocks.where("pairs > 0"), "blocks")
    total = {r["random"]: r["pairs"] for r in blocks.groupBy((F.col("predicate") < 0).alias("random")).agg(F.sum("pairs").alias("pairs")).collect()}
    in_blocks = total.get(False, 0.0)
    share = blocked if in_blocks else 0.0
    rate_blocked, rate_random = (share * size / in_blocks if in_blocks else 0.0), ((1 - share) * size / total[True] if total.get(True) else 0.0)

    rate = F.when(F.col("predicate") < 0, F.lit(rate_random)).otherwise(F.lit(rate_blocked))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(7), *BLOCK), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.floor(rate * F.col("pairs") + chance).cast("long")
    draws = blocks.withColumn("k", wanted).where("k > 0").select(*BLOCK, "n", "m", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("draw"))
    i, j = F.pmod(_draw(seed, 1), F.col("n")), F.pmod(_draw(seed, 2), F.col("m"))
    placed = draws.select(*BLOCK, i.alias("i"), (j if right is not None else F.when(j >= i, j + 1).otherwise(j)).alias("j"))
    met = placed.join(a.select(*BLOCK, F.col("at").alias("i"), F.col("id").alias("x")), [*BLOCK, "i"]).join(b.select(*BLOCK, F.col("at").alias("j"), F.col("id").alias("y")), [*BLOCK, "j"])
    ends = (F.col("x"), F.col("y")) if right is not None else (F.least("x", "y"), F.greatest("x", "y"))
    drawn = stored(met.select(ends[0].alias("left_id"), ends[1].alias("right_id")).groupBy("left_id", "right_id").agg(F.count("*").alias("draws")), "drawn")

    keys = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.array(*[p.keys() for p in predicates]).alias(side)) if predicates else df.select(F.col("id").alias(f"{side}_id"), F.array().cast("array<array<string>>").alias(side))
    both = drawn.join(keys(left, "left").hint("merge"), "left_id").join(keys(left if right is None else right, "right").hint("merge"), "right_id")
    shared = F.aggregate(F.zip_with("left", "right", lambda x, y: F.size(F.array_intersect(x, y))), F.lit(0), lambda s, n: s + n)
    return both.select("left_id", "right_id", "draws", (F.col("draws") / (shared * F.lit(rate_blocked) + F.lit(rate_random))).alias("weight"))
