"""Nearest-neighbour blocking over embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .tiles import runs, whole

#: Vectors of one side of a tile at most; queries compared at once.
HELD = 8192
ROWS = 512
#: Pairs scored at once, about.
PAIRS = 100_000
#: Buckets are joined where so many times the pairs that share one are less than all pairs.
SPARSE = 20


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up in the order of the components: equal vectors score equal."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total = total + a[:, k] * b[:, k]
    return total


def _near(rows: pa.Table, k: int, measure: str, exclude_self: bool):
    """Each query's ``k`` best of a tile, ties to the smaller id. Products of whole blocks
    choose, with room for their rounding; what they choose is scored anew."""
    ids, vectors = whole(rows, "id"), whole(rows, "vector")
    code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    query = np.asarray(whole(rows, "query").to_numpy(zero_copy_only=False), dtype=bool)
    length = np.diff(np.asarray(vectors.offsets))
    edges, values = np.asarray(vectors.offsets), np.asarray(vectors.values)
    for n in np.unique(length):
        same = np.flatnonzero(length == n)
        x = values[edges[same][:, None] + np.arange(n)]
        square = _dots(x, x)
        fine = square != 0 if measure == "cosine" else np.ones(len(same), bool)
        q, r = np.flatnonzero(query[same] & fine), np.flatnonzero(~query[same] & fine)
        if not len(q) or not len(r):
            continue
        u = x / np.sqrt(square)[:, None] if measure == "cosine" else x
        room = 1e-9 if measure == "cosine" else 1e-11 * (1 + square[r].max())
        for at in range(0, len(q), ROWS):
            some = q[at : at + ROWS]
            about = u[some] @ u[r].T if measure == "cosine" else 2 * (u[some] @ u[r].T) - square[r]
            about[~np.isfinite(about)] = np.inf  # nothing is known: these are scored
            if exclude_self:
                about[code[same[some]][:, None] == code[same[r]][None, :]] = -np.inf
            most = min(k, len(r))
            bar = np.partition(about, len(r) - most, axis=1)[:, len(r) - most]
            i, j = np.nonzero((about >= bar[:, None] - room * (1 + (square[some][:, None] if measure == "euclidean" else 0))) & (about > -np.inf))
            # equal vectors may be very many: they are scored in parts
            cuts = np.searchsorted(i, np.unique(i[:: max(1, PAIRS // 2)]))
            for i, j in zip(np.split(some[i], cuts[1:]), np.split(r[j], cuts[1:])):
                if measure == "cosine":
                    score = _dots(x[i], x[j]) / (np.sqrt(square[i]) * np.sqrt(square[j]))
                else:
                    gap = x[i] - x[j]
                    score = 1.0 / (1.0 + np.sqrt(_dots(gap, gap)))
                order = np.lexsort((code[same[j]], -np.where(np.isnan(score), np.inf, score), i))
                first = np.searchsorted(i[order], i[order], "left")
                top = order[np.arange(len(order)) - first < k]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(same[i[top]])), ids.take(pa.array(same[j[top]])), pa.array(score[top])], names=["left_id", "right_id", "score"])


def knn(queries: DataFrame, records: DataFrame, k: int, measure: str = "cosine", vector: str = "embedding", exclude_self: bool = True, buckets: int = 0) -> DataFrame:
    """(left_id, right_id, rank, score): each query's ``k`` most similar records, exact.

    All queries meet all records, in tiles: both are dealt to groups of some thousand (the
    records to ``buckets``, where given), each two groups are one block product, a query keeps
    its best ``k`` of a tile, and the tiles' winners are merged: no pair but these is a row.
    Vectors that are null, that hold a null or, for the cosine, are zero take no part. Ties go
    to the smaller id. Work grows with queries times records."""
    spark = queries.sparkSession
    kind = dict(records.dtypes)["id"]
    fine = lambda df: df.where(F.col("id").isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull()))
    rows = lambda df, n, g: df.select("id", F.transform(vector, lambda v: v.cast("double")).alias("vector"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("met"))
    a, b = fine(queries), fine(records)
    least = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    n, m = max(least, -(-a.count() // HELD)), buckets or max(least, -(-b.count() // HELD))
    q = rows(a, n, m).select((F.col("own") * m + F.col("met")).alias("tile"), F.lit(True).alias("query"), F.col("id").cast(kind).alias("id"), "vector")
    r = rows(b, m, n).select((F.col("met") * m + F.col("own")).alias("tile"), F.lit(False).alias("query"), "id", "vector")

    def run(batches):
        for _, tile in runs(batches, "tile"):
            yield from _near(tile, k, measure, exclude_self)

    met = q.unionByName(r).repartition(min(n * m, 16 * spark.sparkContext.defaultParallelism), "tile").sortWithinPartitions("tile")
    scored = met.mapInArrow(run, f"left_id {kind}, right_id {kind}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), F.asc("right_id"))))
    return ranked.where(F.col("rank") <= k).select("left_id", "right_id", "rank", "score")


def lsh_pairs(left: DataFrame, right: DataFrame | None, distance: float, vector: str = "embedding", bucket: float = 0.5, tables: int = 8, seed: int = 3) -> DataFrame:
    """(left_id, right_id, distance): approximate join within a Euclidean distance of
    L2-normalised vectors, so that it follows cosine order.

    A pair is found if its vectors share a bucket of some table. Where buckets part the vectors,
    Spark joins them; where they are so wide that most pairs share one, which then are as many
    rows as there are tables, vectors meet in tiles, and only pairs within the distance are rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(df: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return df.select("id", F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0))).alias("u"), norm.alias("norm")).where("norm > 0").select("id", array_to_vector("u").alias("features"))

    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    a = unit(left)
    fitted = model.fit(a)
    sides = [a] if right is None else [a, unit(right)]
    hashed = [stored(fitted.transform(x).select("id", vector_to_array("features").alias("vector"), F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0))).alias("hashes")), "hashed") for x in sides]
    counts = [x.select(F.posexplode("hashes")).groupBy("pos", "col").agg(F.count("*").alias(f"n{k}")) for k, x in enumerate(hashed)]
    shared = (counts[0].withColumn("n1", F.col("n0")) if right is None else counts[0].join(counts[1], ["pos", "col"])).agg(F.sum(F.col("n0").cast("double") * F.col("n1"))).first()[0] or 0.0
    sizes = [x.count() for x in hashed]
    if shared * SPARSE < sizes[0] * sizes[-1]:
        read = [x.select("id", array_to_vector("vector").alias("features")) for x in hashed]
        out = fitted.approxSimilarityJoin(read[0], read[-1], distance, "distance")
        out = out.select(F.col("datasetA.id").alias("left_id"), F.col("datasetB.id").alias("right_id"), "distance")
    else:
        out = _within(hashed, sizes, distance)
    return out.where("left_id < right_id") if right is None else out


def _within(hashed: list[DataFrame], sizes: list[int], distance: float) -> DataFrame:
    """(left_id, right_id, distance) of rows (id, vector, hashes) that are nearer than ``distance``
    and agree in one of their hashes; of one table each pair once or both ways round. Equal
    rows count once."""
    kinds = [dict(x.dtypes)["id"] for x in hashed]
    itself = len(hashed) == 1
    least = math.ceil(math.sqrt(2 * hashed[0].sparkSession.sparkContext.defaultParallelism))
    groups = [max(least, -(-n // HELD)) for n in sizes]
    n, m = groups[0], groups[-1]
    place = lambda i, j, side: F.struct((i * m + j).cast("int").alias("tile"), F.lit(side).alias("side"))
    own, every = lambda g: F.pmod(F.xxhash64("id"), F.lit(g)).cast("int"), lambda g: F.sequence(F.lit(0), F.lit(g - 1))
    if itself:
        met = [F.transform(every(n), lambda o: F.when(o >= F.col("own"), place(F.col("own"), o, 0)).otherwise(place(o, F.col("own"), 1)))]
    else:
        met = [F.transform(every(m), lambda j: place(F.col("own"), j, 0)), F.transform(every(n), lambda i: place(i, F.col("own"), 1))]
    dealt = [x.dropDuplicates().withColumn("own", own(g)).withColumn("p", F.explode(p)).select("p.tile", "p.side", F.col("id").alias(f"id{k}"), "vector", "hashes") for k, (x, g, p) in enumerate(zip(hashed, groups, met))]
    both = dealt[0] if itself else dealt[0].unionByName(dealt[1], allowMissingColumns=True)

    def run(batches):
        for number, rows in runs(batches, "tile"):
            yield from _near_enough(rows, distance, itself, itself and number // m == number % m)

    tiles = n * (n + 1) // 2 if itself else n * m
    dealt = both.repartition(min(tiles, 16 * both.sparkSession.sparkContext.defaultParallelism), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, f"left_id {kinds[0]}, right_id {kinds[-1]}, distance double")


def _near_enough(rows: pa.Table, distance: float, itself: bool, one_group: bool):
    """The pairs of a tile: of block products those that may be near enough, which are measured anew."""
    side = np.asarray(whole(rows, "side"))
    first = np.flatnonzero(side == 0)
    second = first if one_group else np.flatnonzero(side == 1)
    left, right = whole(rows, "id0"), whole(rows, "id0" if itself else "id1")
    code = np.unique(left.to_numpy(zero_copy_only=False), return_inverse=True)[1] if itself else None
    if not len(first) or not len(second):
        return
    square = lambda name: np.asarray(whole(rows, name).flatten()).reshape(len(side), -1)
    x, hashes = square("vector"), square("hashes")
    length = _dots(x, x)
    for at in range(0, len(first), ROWS):
        some = first[at : at + ROWS]
        about = length[some][:, None] + length[second] - 2 * (x[some] @ x[second].T)
        near = ~(about > distance * distance + 1e-9)
        if one_group:
            near &= code[some][:, None] < code[second]
        i, j = np.nonzero(near)
        for k in range(0, len(i), PAIRS):
            l, r = some[i[k : k + PAIRS]], second[j[k : k + PAIRS]]
            gap = x[l] - x[r]
            far = np.sqrt(_dots(gap, gap))
            fine = (far < distance) & (hashes[l] == hashes[r]).any(1)
            l, r, far = l[fine], r[fine], far[fine]
            if itself:
                l, r = np.where(code[l] > code[r], r, l), np.where(code[l] > code[r], l, r)
            yield pa.RecordBatch.from_arrays([left.take(pa.array(l)), right.take(pa.array(r)), pa.array(far)], names=["left_id", "right_id", "distance"])


def hashed_embedding(records: DataFrame, text: str, size: int = 256, q: int = 3) -> DataFrame:
    """(id, embedding): hashed q-gram counts in place of a neural encoder. Precomputed
    embeddings of any encoder can be used in its stead."""
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.substring(F.lower(text), i, F.lit(q))))
    counts = records.select("id", grams.alias("g")).select("id", F.pmod(F.xxhash64("g"), F.lit(size)).cast("int").alias("h"))
    sums = counts.groupBy("id", "h").agg(F.count("*").cast("double").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    return sums.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))
