"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in an order that a hash of their id sets, form blocks. With
weights in whole slots of a period (they sum to the period), block ``j`` of a
source of weight ``w`` is released at slot floor(j * period / w) and due by
slot ceil((j + 1) * period / w). Earliest deadline first among released blocks
fills every slot and meets every deadline (Baruah et al., Algorithmica 1996), so
before any slot each source has had its weight's share of blocks to within less
than one. The schedule repeats with the period, so one period is computed and
block ``j`` of a source stands in slot  (j div w) * period + slot(j mod w).

Every row comes out once. When a source has no rows left its slots stay empty
and the others go on in their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """period: slots; at least one is given to each source. block: rows of a
    block. temper: without stated weights, a source of n rows weighs n ** temper."""

    period: int = 1000
    block: int = 32
    temper: float = 0.7


def source_key(source: Column) -> Column:
    """Sources as strings that keep null apart from every name."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def weights(docs: DataFrame, source: str, p: Params, target: dict[str | None, float] | None = None) -> DataFrame:
    """(src, idx, n, w): for each source its rows and whole slots of the period, by
    largest remainder. Without ``target``, shares follow the tempered row counts;
    a source missing from ``target`` gets the least, one slot."""
    counts = docs.groupBy(source_key(F.col(source)).alias("src")).agg(F.count("*").alias("n"))
    if target is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(p.temper))
    else:
        raw = F.lit(0.0)
        for name, value in target.items():
            raw = F.when(F.col("src") == ("" if name is None else "=" + name), F.lit(float(value))).otherwise(raw)
    every = Window.partitionBy()
    counted = counts.withColumn("raw", raw).withColumn("k", F.count("*").over(every))
    period = F.greatest(F.lit(p.period), F.col("k") * 4)
    share = (period - F.col("k")) * F.col("raw") / F.greatest(F.sum("raw").over(every), F.lit(1e-300))
    parts = counted.select("src", "n", period.alias("period"), F.floor(share).alias("whole"), (share - F.floor(share)).alias("rest"), "k")
    spare = F.col("period") - F.col("k") - F.sum("whole").over(every)
    order = F.row_number().over(Window.orderBy(F.desc("rest"), "src"))
    first = F.row_number().over(Window.orderBy("src")) - 1
    # With k sources fewer than k slots are spare, but for weights that are all zero.
    w = F.lit(1) + F.col("whole") + F.floor(F.col("spare") / F.col("k")) + F.when(F.col("place") <= F.pmod(F.col("spare"), F.col("k")), 1).otherwise(0)
    return parts.withColumns({"spare": spare, "place": order, "idx": first}).select("src", F.col("idx").cast("int").alias("idx"), "n", w.cast("long").alias("w"), F.col("period").cast("long").alias("period"))


def one_period(shares: DataFrame) -> DataFrame:
    """(src, j, w, period, release, deadline, slot) for each slot of one period."""
    listed = shares.agg(F.array_sort(F.collect_list(F.struct("idx", "src", "w"))).alias("s"), F.max("period").alias("period"))

    def step(state: Column, t: Column) -> Column:
        due = F.transform(state["done"], lambda d, i: F.struct(F.ceil((d + 1) * F.col("period") / F.col("s")[i]["w"]).alias("deadline"), i.alias("i"), F.floor(d * F.col("period") / F.col("s")[i]["w"]).alias("release")))
        pick = F.array_min(F.filter(due, lambda c: c["release"] <= t))
        return _advance(state, pick)

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<i:int,j:bigint>>").alias("out"))
    slots = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step, lambda s: s["out"])
    at = listed.where("period > 0").select("s", "period", F.posexplode(slots).alias("slot", "x"))
    chosen = F.col("s")[F.col("x.i")]
    j, w = F.col("x.j"), chosen["w"]
    return at.select(chosen["src"].alias("src"), j.alias("j"), F.floor(j * F.col("period") / w).alias("release"), F.ceil((j + 1) * F.col("period") / w).alias("deadline"), F.col("slot").cast("long").alias("slot"))


def _advance(state: Column, pick: Column) -> Column:
    """The state after the picked source's next block takes the slot."""
    done = F.transform(state["done"], lambda d, i: F.when(i == pick["i"], d + 1).otherwise(d))
    taken = F.struct(pick["i"].cast("int").alias("i"), F.element_at(state["done"], pick["i"] + 1).alias("j"))
    return F.struct(done.alias("done"), F.concat(state["out"], F.array(taken)).alias("out"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", target: dict[str | None, float] | None = None, p: Params = Params()) -> DataFrame:
    """``docs`` with a struct column ``mix`` (underscores are appended if the name is
    taken): block (its number in the source), weight (slots of a period), release,
    deadline, slot, place (0 ... block - 1 inside the block). Order by slot and
    place to get the mixture.

    Null sources are a source of their own. Rows that repeat a key stay, in any
    order among themselves; a null key sorts by the hash of an empty text."""
    from .common import temp_name

    out = temp_name(docs, "mix")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    shares = weights(docs, source, p, target)
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    packed = docs.select(F.struct(*cols).alias("row"), source_key(F.col(source)).alias("src"), hashed.alias("h"), F.substring(hashed, 1, 3).alias("bucket"))
    # A row's number in its source: rows in earlier buckets of the hash, and its number in its bucket.
    ids = docs.select(source_key(F.col(source)).alias("src"), F.substring(hashed, 1, 3).alias("bucket"))
    sizes = ids.groupBy("src", "bucket").agg(F.count("*").alias("m"))
    before = sizes.select(F.col("src").alias("src_"), F.col("bucket").alias("bucket_"), (F.sum("m").over(Window.partitionBy("src").orderBy("bucket")) - F.col("m")).alias("before"))
    numbered = packed.withColumn("r", F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", F.col("row")[key])) - 1)
    placed = numbered.join(before, (F.col("src") == F.col("src_")) & (F.col("bucket") == F.col("bucket_"))).withColumn("g", F.col("before") + F.col("r")).drop("src_", "bucket_")
    known = shares.select(F.col("src").alias("src_"), "w", "period")
    cycle = one_period(shares).select(F.col("src").alias("of"), F.col("j").alias("in_period"), F.col("slot").alias("in_slot"))
    plan = known.join(cycle, F.col("src_") == F.col("of")).select("src_", "w", "period", "in_period", "in_slot")
    plan = plan.groupBy("src_", "w", "period").agg(F.transform(F.array_sort(F.collect_list(F.struct("in_period", "in_slot"))), lambda x: x["in_slot"]).alias("slots"))
    b = F.floor(F.col("g") / p.block).cast("long")
    joined = placed.join(plan, F.col("src") == F.col("src_")).withColumn("b", b)
    turn = F.floor(F.col("b") / F.col("w")).cast("long")
    slot = turn * F.col("period") + F.element_at("slots", (F.col("b") % F.col("w") + 1).cast("int"))
    mark = F.struct(
        F.col("b").alias("block"),
        F.col("w").alias("weight"),
        F.floor(F.col("b") * F.col("period") / F.col("w")).cast("long").alias("release"),
        F.ceil((F.col("b") + 1) * F.col("period") / F.col("w")).cast("long").alias("deadline"),
        slot.cast("long").alias("slot"),
        (F.col("g") % p.block).cast("int").alias("place"),
    )
    return joined.select("row.*", mark.alias(out))


def in_order(mixed: DataFrame, column: str = "mix") -> DataFrame:
    """The rows in the order of their slots, dealt by range, without the column."""
    return mixed.orderBy(F.col(column)["slot"], F.col(column)["place"]).drop(column)
