"""Candidate pairs of values: what depends on values alone is computed once for all records that share them.

Records that agree on all compared columns and rule keys are one class. Rules join classes,
measures are taken on pairs of classes, and only what is kept of them is expanded into pairs
of records, as rows, or counted from the classes' ids without making the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import BlockingRule
from ..storage import stored

#: Ids of one class that travel together; a pair of such lots is at most 2 ** 20 pairs of records.
LOT = 1024
#: Pairs of records that one task makes.
TASK = 2_000_000


@dataclass(frozen=True)
class ValuePairs:
    """rows: (left_class, right_class, pairs, match_key, <c>_l, <c>_r); pairs is the product of the
    classes' sizes, an upper bound. members: (class, ids), a class in lots of bounded size."""

    rows: DataFrame
    members: DataFrame

    def _lots(self, scored: DataFrame, parts: int) -> DataFrame:
        side = lambda name, to: self.members.select(F.col("class").alias(name), F.col("ids").alias(to)).hint("merge")
        both = scored.join(side("left_class", "__l"), "left_class").join(side("right_class", "__r"), "right_class")
        # by the first ids of the lots, so that two large classes are dealt to many tasks
        return both.repartition(parts, F.get("__l", F.lit(0)), F.get("__r", F.lit(0)))

    def expand(self, scored: DataFrame) -> DataFrame:
        """(left_id, right_id, and the other columns of ``scored``): the pairs of records, the
        smaller id on the left, of the pairs of classes in ``scored`` (left_class, right_class, pairs, ...)."""
        scored = stored(scored, "values")
        total = scored.agg(F.sum("pairs")).first()[0] or 0
        parts = max(scored.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK))
        kept = [c for c in scored.columns if c not in ("left_class", "right_class", "pairs")]
        lots = self._lots(scored.drop("pairs"), parts).select(*kept, F.explode("__l").alias("left_id"), "__r")
        return lots.select("left_id", F.explode("__r").alias("right_id"), *kept).where("left_id < right_id")

    def counted(self, scored: DataFrame) -> DataFrame:
        """``scored`` with ``pairs``, how many pairs of records with the smaller id on the left each
        row stands for (one row for each two lots). Linear in the ids, no pair is made."""
        kept = [c for c in scored.columns if c not in ("left_class", "right_class", "pairs")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = batch.column("__l"), batch.column("__r")
                n = [int((len(b) - np.searchsorted(b, a, side="right")).sum()) for a, b in zip(map(_ids, left), map(_ids, right))]
                rest = batch.select(kept)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64())], names=[*kept, "pairs"])

        scored = stored(scored, "values")
        parts = max(scored.sparkSession.sparkContext.defaultParallelism, math.ceil(scored.count() / 20_000))
        lots = self._lots(scored.drop("pairs"), parts).select(*kept, "__l", "__r")
        kinds = ", ".join(f"`{c}` {k}" for c, k in scored.select(*kept).dtypes)
        return lots.mapInArrow(run, f"{kinds}, pairs bigint").where("pairs > 0")

    def stars(self, scored: DataFrame) -> DataFrame:
        """(left_id, right_id): some of the pairs of records that ``scored`` stands for, with the same
        records and components: the outer ids of each two lots, and each id of a lot with the
        farthest id that it meets. As many rows as there are ids and pairs of lots."""
        ends = lambda s: self.members.select(F.col("class").alias(f"{s}_class"), F.get("ids", F.lit(0)).alias(f"{s}_lo"), F.element_at("ids", -1).alias(f"{s}_hi")).hint("merge")
        pairs = scored.select("left_class", "right_class").join(ends("left"), "left_class").join(ends("right"), "right_class")
        pairs = stored(pairs.where("left_lo < right_hi"), "lots")
        lots = self.members.select("class", "ids", F.get("ids", F.lit(0)).alias("lo"))
        far = pairs.groupBy(F.col("left_class").alias("class"), F.col("left_lo").alias("lo")).agg(F.max("right_hi").alias("right_id"))
        left = lots.join(far.hint("merge"), ["class", "lo"]).select(F.explode("ids").alias("left_id"), "right_id")
        far = pairs.groupBy(F.col("right_class").alias("class"), F.col("right_lo").alias("lo")).agg(F.min("left_lo").alias("left_id"))
        right = lots.join(far.hint("merge"), ["class", "lo"]).select("left_id", F.explode("ids").alias("right_id"))
        links = pairs.select(F.col("left_lo").alias("left_id"), F.col("right_hi").alias("right_id")).unionByName(left).unionByName(right)
        return stored(links.where("left_id < right_id").distinct(), "stars")

    def sides(self, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(class, n) twice: how many records of each class stand on the left, and on the right, of
        some pair of records that ``scored`` stands for. No pair is made."""
        ends = self.members.groupBy("class").agg(F.min(F.get("ids", F.lit(0))).alias("lo"), F.max(F.element_at("ids", -1)).alias("hi"))
        rows = scored.select("left_class", "right_class")
        far = rows.join(ends.select(F.col("class").alias("right_class"), "hi").hint("merge"), "right_class").groupBy(F.col("left_class").alias("class")).agg(F.max("hi").alias("end"))
        near = rows.join(ends.select(F.col("class").alias("left_class"), "lo").hint("merge"), "left_class").groupBy(F.col("right_class").alias("class")).agg(F.min("lo").alias("end"))
        count = lambda end, fits: self.members.join(end.hint("merge"), "class").groupBy("class").agg(F.sum(F.size(F.filter("ids", fits))).alias("n")).where("n > 0")
        return count(far, lambda x: x < F.col("end")), count(near, lambda x: x > F.col("end"))


def _ids(x: pa.ListScalar) -> np.ndarray:
    return np.asarray(x.values)


def value_pairs(records: DataFrame, rules: list[BlockingRule], columns: list[str]) -> ValuePairs:
    """The pairs of ``blocking.dedupe_only(records, rules)``, as pairs of classes with equal
    ``columns``. A pair of classes stands both ways round where both hold pairs with the
    smaller id on the left, so a measure may depend on the side. Null columns are one value;
    null keys agree with nothing."""
    keys = {(i, j): F.expr(k).alias(f"__k{i}_{j}") for i, r in enumerate(rules) for j, k in enumerate(r.keys)}
    rows = records.select("id", F.struct(*columns, *keys.values()).alias("v"))
    classes = rows.groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    lot = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(LOT)).cast("long"))
    placed = rows.where("id is not null").join(classes.select("v", "class", "n").hint("merge"), "v")
    members = placed.groupBy("class", lot.alias("lot")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = stored(members.select("class", "ids"), "members")

    def side(name: str, end: str):
        named = [F.col(f"v.`{c}`").alias(f"{c}_{end}") for c in columns]
        return classes.select(F.col("class").alias(f"{name}_class"), *[F.col(c).alias(f"__{end}_{c}") for c in ("n", "lo", "hi")], *named, *[F.col(f"v.__k{i}_{j}").alias(f"__{end}{i}_{j}") for i, j in keys])

    def agree(i: int):
        out = F.lit(True)
        for j in range(len(rules[i].keys)):
            out = out & (F.col(f"__l{i}_{j}") == F.col(f"__r{i}_{j}"))
        return out

    a, b, out = side("left", "l"), side("right", "r").hint("merge"), None
    shown = [F.col(f"{c}_{end}") for end in "lr" for c in columns]
    for i in range(len(rules)):
        on = agree(i) & (F.col("__l_lo") < F.col("__r_hi"))
        for k in range(i):
            on = on & ~F.coalesce(agree(k), F.lit(False))
        found = a.join(b, on).select("left_class", "right_class", (F.col("__l_n") * F.col("__r_n")).alias("pairs"), F.lit(i).alias("match_key"), *shown)
        out = found if out is None else out.unionByName(found)
    return ValuePairs(out, members)
