"""A graph of nearest neighbours by descent: the neighbours of a record's neighbours are
likely its own (Dong, Moses and Li, WWW 2011).

Each record keeps a list of ``k``. In a round the records of each list, and those in whose
list it stands, meet each other where at least one of the two is new there; what is nearer
than the lists' last enters. It ends when few entries change. Nothing meets all of the rest:
the work of a round follows the lists, not the square of the table. Approximate: recall is
to be measured against ``neighbours.knn``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, stored


def unit_vectors(records: DataFrame, vector: str) -> DataFrame:
    """(id, u): vectors of length 1; null, empty and zero ones and those with a null or
    non-finite component are left out."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    rows = records.where("id is not null").select("id", x.alias("x")).withColumn("n", norm)
    fine = F.col("n").isNotNull() & ~F.isnan("n") & (F.col("n") > 0) & (F.col("n") < float("inf"))
    return rows.where(fine).select("id", F.transform("x", lambda v: v / F.col("n")).alias("u")).dropDuplicates(["id"])


def _met(k: int):
    """Rows (group, id, fresh, u), sorted by group: each record's ``k`` nearest of its group
    that it meets, as (id, other, score)."""

    def nearest(rows: pa.Table):
        ids = rows.column(1).combine_chunks()
        fresh = np.asarray(rows.column(2).to_numpy(zero_copy_only=False), dtype=bool)
        u = rows.column(3).combine_chunks()
        u = pa.concat_arrays(u.chunks) if isinstance(u, pa.ChunkedArray) else u
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        x = np.asarray(u.flatten()).reshape(len(ids), -1)
        for a in range(0, len(ids), 512):
            s = x[a : a + 512] @ x.T
            s[~(fresh[a : a + 512, None] | fresh[None, :])] = -np.inf
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            m = min(k, s.shape[1])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            score = np.take_along_axis(s, top, axis=1)
            i, j = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + i)), ids.take(pa.array(top[i, j])), pa.array(score[i, j])], names=["id", "other", "score"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)
            change = np.flatnonzero(np.asarray(pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False), dtype=bool)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            if held and held[-1].column(0)[-1].as_py() != group[0].as_py():
                yield from nearest(pa.Table.from_batches(held))
                held = []
            for s, e in zip(edges, edges[1:]):
                if s:
                    yield from nearest(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from nearest(pa.Table.from_batches(held))

    return run


def nearest_neighbours(records: DataFrame, k: int = 10, vector: str = "embedding", reverse: int | None = None, starts: int = 3, rounds: int = 20, least: float = 0.001) -> DataFrame:
    """(left_id, right_id, rank, score): about the ``k`` nearest of each record by cosine; ties to
    the smaller id. Vectors are of one length; those without a direction take no part.

    reverse: how many records that list a record meet there at most (2 k by default), chosen by a
    hash: a record that very many list is no hot group. starts: random groups the lists come
    from at first. It ends after ``rounds``, or when less than the share ``least`` of all
    entries is new."""
    vectors = stored(unit_vectors(records, vector), "vectors")
    n = vectors.count()
    kind = dict(vectors.dtypes)["id"]
    groups = max(1, n // (2 * k + 2))

    def meet(rows: DataFrame) -> DataFrame:
        """rows: (group, id, fresh)."""
        with_vectors = rows.join(vectors, "id").select("group", "id", "fresh", "u")
        return with_vectors.repartition("group").sortWithinPartitions("group").mapInArrow(_met(k), f"id {kind}, other {kind}, score double")

    def merged(old: DataFrame | None, found: DataFrame) -> DataFrame:
        rows = found.withColumn("fresh", F.lit(True))
        rows = rows if old is None else rows.unionByName(old.withColumn("fresh", F.lit(False)))
        once = rows.groupBy("id", "other").agg(F.max("score").alias("score"), F.bool_and("fresh").alias("fresh"))
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
        return stored(once.withColumn("place", place).where(F.col("place") <= k), "lists")

    start = [vectors.select(F.concat(F.lit(f"{s}:"), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(groups)).cast("string")).alias("group"), "id", F.lit(True).alias("fresh")) for s in range(starts)]
    first = start[0]
    for other in start[1:]:
        first = first.unionByName(other)
    lists = merged(None, meet(first))
    for _ in range(rounds):
        if lists.where("fresh").count() <= least * n * k:
            break
        forward = lists.select(F.col("id").alias("group"), F.col("other").alias("id"), "fresh")
        listed = lists.select(F.col("other").alias("group"), "id", "fresh")
        chosen = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("fresh"), F.xxhash64("group", "id")))
        back = listed.withColumn("r", chosen).where(F.col("r") <= (reverse or 2 * k)).drop("r")
        both = forward.unionByName(back).groupBy("group", "id").agg(F.bool_or("fresh").alias("fresh"))
        after = merged(lists.select("id", "other", "score"), meet(both))
        dropped(lists)
        lists = after
    return lists.select(F.col("id").alias("left_id"), F.col("other").alias("right_id"), F.col("place").alias("rank"), "score")
