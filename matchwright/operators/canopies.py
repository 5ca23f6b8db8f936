"""TF-IDF cosines as a blocking predicate: similar pairs and canopies.

Records are dealt to groups and two groups meet in one tile. There the terms that a good part
of the records hold are a matrix product, the others are added up from their postings, and
only pairs that reach the threshold become rows: candidates are no table.

A canopy is a centre and the records near it. In the order of their ids, each record that
no centre is near becomes one. Distributed: of the records that are still open those
without a smaller open neighbour become centres at once, and their neighbours close; that
gives the very centres of the one-by-one order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .predicates import key_pairs
from .tiles import runs, whole

#: Sums are compared with the threshold less this, so that rounding loses no pair.
SLACK = 1e-9
#: Entries, and records, of a group; cells of a block of sums; entries added up at once.
HELD = 4_000_000
RECORDS = 16_384
CELLS = 4_000_000
SLICE = 2_000_000
#: A term that more than this share of a tile's records hold goes through the product; at most so many do.
COMMON = 0.05
WIDTH = 256


def indexed_terms(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, term, w) of the terms that have to be posted: ``vectors`` (id, term, w), of length 1,
    without each record's common end that cannot reach the threshold. Terms of one record only
    meet nothing and are left out, though they count for the order."""
    terms = vectors.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("top"))
    common = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    bounded = vectors.join(terms, "term").withColumn("reach", F.sum(F.col("w") * F.col("top")).over(common))
    return bounded.where((F.col("reach") >= threshold - SLACK) & (F.col("df") > 1)).select("id", "term", "w")


class _Rows:
    """Vectors of a tile as lists of (term, weight), one after another."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, edges: np.ndarray):
        self.number, self.weight, self.edges = number, weight, edges

    def part(self, places: np.ndarray) -> _Rows:
        n = self.edges[places + 1] - self.edges[places]
        ends = np.cumsum(n)
        at = np.repeat(self.edges[places] - (ends - n), n) + np.arange(int(n.sum()))
        return _Rows(self.number[at], self.weight[at], np.concatenate([[0], ends]))

    def __len__(self) -> int:
        return len(self.edges) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.edges))


def _sums(a: _Rows, b: _Rows, terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, products of rows of ``a`` with all of ``b``), some rows at a time."""
    held = np.bincount(b.number, minlength=terms)
    often = np.flatnonzero(held > COMMON * max(1, len(b)))
    often = often[np.argsort(-held[often], kind="stable")[:WIDTH]]
    column = np.full(terms, -1)
    column[often] = np.arange(len(often))

    def laid(rows: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, at = rows.owner(), column[rows.number]
        dense, fine = np.zeros((len(rows), len(often))), at >= 0
        dense[own[fine], at[fine]] = rows.weight[fine]
        return dense, own[~fine], rows.number[~fine], rows.weight[~fine]

    matrix, member, number, weight = laid(b)
    order = np.argsort(number, kind="stable")
    member, weight = member[order], weight[order]
    begin = np.searchsorted(number[order], np.arange(terms + 1))
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        some = a.part(np.arange(at, min(len(a), at + step)))
        dense, own, term, mine = laid(some)
        sums = dense @ matrix.T
        flat = sums.reshape(-1)
        many = begin[term + 1] - begin[term]
        work, k = np.concatenate([[0], np.cumsum(many)]), 0
        while k < len(many):
            upto = max(k + 1, int(np.searchsorted(work, work[k] + SLICE, "right")) - 1)
            n = many[k:upto]
            ends = np.cumsum(n)
            post = np.repeat(begin[term[k:upto]] - (ends - n), n) + np.arange(int(ends[-1]))
            first, last = own[k], own[upto - 1] + 1
            cell = np.repeat((own[k:upto] - first) * len(b), n) + member[post]
            flat[first * len(b) : last * len(b)] += np.bincount(cell, np.repeat(mine[k:upto], n) * weight[post], (last - first) * len(b))
            k = upto
        yield at, sums


def _similar(rows: pa.Table, threshold: float, itself: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile that reach the threshold; their cosines are added up anew, term by term."""
    lists = whole(rows, "no")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    number = np.unique(np.asarray(lists.values)[offsets[0] : offsets[-1]], return_inverse=True)[1]
    every = _Rows(number, np.asarray(whole(rows, "w").flatten()), offsets - offsets[0])
    terms = int(number.max()) + 1 if len(number) else 0
    side, ids = np.asarray(whole(rows, "side")), whole(rows, "id")
    code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    left = np.flatnonzero(side == 0)
    right = left if itself else np.flatnonzero(side == 1)
    if not len(left) or not len(right) or not terms:
        return
    own = every.owner()
    places = own * np.int64(terms) + number  # ascending: terms are sorted in each row
    for at, sums in _sums(every.part(left), every.part(right), terms):
        i, j = np.nonzero(sums >= threshold - 2 * SLACK)
        i, j = left[at + i], right[j]
        fine = code[i] < code[j] if itself else code[i] != code[j]
        i, j = i[fine], j[fine]
        step = max(1, SLICE // max(1, int(np.diff(every.edges).max())))
        for k in range(0, len(i), step):
            l, r = i[k : k + step], j[k : k + step]
            met = every.part(l)
            wanted = np.repeat(r, np.diff(met.edges)) * np.int64(terms) + met.number
            found = np.searchsorted(places, wanted)
            found[found == len(places)] = 0
            other = np.where(places[found] == wanted, every.weight[found], 0.0)
            cosine = np.bincount(met.owner(), met.weight * other, len(l))
            l, r, cosine = (x[cosine >= threshold - SLACK] for x in (l, r, cosine))
            swap = code[l] > code[r]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(swap, r, l))), ids.take(pa.array(np.where(swap, l, r))), pa.array(cosine)], names=["left_id", "right_id", "cosine"])


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs with at least the threshold, left_id < right_id.
    ``vectors`` are L2-normalised (id, term, w) with weights above 0; the threshold is above 0.

    A record that none of its terms can bring to the threshold (``indexed_terms``) has no pair
    and does not travel; the others are one row and travel once for each group. Work grows with
    the square of the records, some nanoseconds a pair."""
    kept = stored(vectors.where("id is not null"), "vectors")
    live = indexed_terms(kept, threshold).select("id").distinct()
    terms = kept.groupBy("term").agg(F.count("*").alias("df")).where("df > 1").select("term", F.monotonically_increasing_id().alias("no"))
    entries = F.array_sort(F.collect_list(F.struct("no", "w")))
    listed = kept.join(live.hint("merge"), "id").join(stored(terms, "terms"), "term").groupBy("id").agg(entries.alias("e"))
    records = stored(listed.select("id", F.col("e.no").alias("no"), F.col("e.w").alias("w")), "records")
    many, held = records.agg(F.count("*"), F.coalesce(F.sum(F.size("no")), F.lit(0))).first()
    cores = records.sparkSession.sparkContext.defaultParallelism
    n = max(math.ceil(math.sqrt(4 * cores + 0.25) - 0.5), math.ceil(held / HELD), math.ceil(many / RECORDS))
    place = lambda i, j, side: F.struct((i * n + j).cast("int").alias("tile"), F.lit(side).alias("side"))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.when(o >= F.col("g"), place(F.col("g"), o, 0)).otherwise(place(o, F.col("g"), 1)))
    dealt = records.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("p", F.explode(places)).select("p.tile", "p.side", "id", "no", "w")
    dealt = dealt.repartition(min(n * (n + 1) // 2, 16 * cores), "tile").sortWithinPartitions("tile")

    def run(batches):
        for number, rows in runs(batches, "tile"):
            yield from _similar(rows, threshold, number // n == number % n)

    kind = dict(records.dtypes)["id"]
    return dealt.mapInArrow(run, f"left_id {kind}, right_id {kind}, cosine double")


def canopies(records: DataFrame, near: DataFrame) -> DataFrame:
    """(id, canopy): the first centre, in the order of ids, that each record is near, or the
    record itself where it is one. ``near`` holds pairs (left_id, right_id); repeated ones
    count once, and ids that ``records`` lacks are left out. Rounds are as many as the longest
    falling chain of neighbours, some few where similarity is not transitive by much."""
    nodes = records.select("id").where("id is not null").distinct()
    pairs = near.select("left_id", "right_id").where("left_id <> right_id")
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    both = stored(both.select(F.col("left_id").alias("id"), F.col("right_id").alias("other")).distinct().join(nodes, "id", "left_semi").join(nodes.withColumnRenamed("id", "other"), "other", "left_semi"), "near")
    open_, centres = stored(nodes.join(both.select("id").distinct(), "id", "left_semi"), "open"), None
    while not open_.isEmpty():
        links = both.join(open_, "id", "left_semi").join(open_.withColumnRenamed("id", "other"), "other", "left_semi")
        smaller = links.where("other < id").select("id").distinct()
        found = stored(open_.join(smaller, "id", "left_anti"), "centres")
        centres = found if centres is None else centres.unionByName(found)
        closed = both.join(found.withColumnRenamed("id", "other"), "other", "left_semi").select("id")
        after = stored(open_.join(found, "id", "left_anti").join(closed.distinct(), "id", "left_anti"), "open")
        dropped(open_)
        open_ = after
    if centres is None:
        return nodes.select("id", F.col("id").alias("canopy"))
    own = both.join(centres.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("other").alias("canopy"))
    alone = F.when(F.col("centre"), F.col("id")).otherwise(F.coalesce("canopy", "id"))
    return nodes.join(centres.withColumn("centre", F.lit(True)), "id", "left").join(own, "id", "left").select("id", alone.alias("canopy"))


def canopy_pairs(found: DataFrame, most: int = 2000) -> DataFrame:
    """(left_id, right_id): pairs of records of one canopy."""
    return key_pairs(found, None, ["canopy"], most).select("left_id", "right_id")
