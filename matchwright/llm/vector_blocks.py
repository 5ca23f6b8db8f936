"""Vectors in shards and query blocks, as rows that hold whole matrices.

Both searches of this subpackage work alike: candidates are dealt by a hash to
shards of bounded size, each shard is indexed once and kept as a blob; the
stated queries are dealt to blocks; every block meets every shard, first the
one that promises most to set a bar for the rest, then the others with the
best kth score so far. A task holds one shard and a few blocks."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 16384
BLOCK_ROWS = 512
#: Bytes of the vectors of a shard or block at most, where one vector does not exceed it.
PART_BYTES = 64 << 20
#: The bar of a query that has no kth score yet, where scores are whole numbers.
NONE = -(2**63)
#: Query blocks that meet a shard in one task.
BLOCKS = 8


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>, dim): no null id, no null or empty vector, only finite components."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))).withColumn("dim", F.size("v"))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def gathered(rows: DataFrame, group_rows: int, name: str, build) -> DataFrame:
    """(dim, part, blob): the rows of each dimension, dealt to parts of about
    ``group_rows``, or ``PART_BYTES``, by a hash of the whole row, each made into one blob by
    ``build(ids, matrix)``. The parts' number follows from a count."""
    sizes = {r["dim"]: max(1, math.ceil(r["n"] / max(1, min(group_rows, PART_BYTES // (8 * r["dim"]))))) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), n[F.col("dim")]).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        dim, part = t.column("dim")[0].as_py(), t.column("part")[0].as_py()
        v = t.column("v").combine_chunks()
        flat = np.asarray((v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten(), dtype=np.float64).reshape(-1, dim)
        ids = np.asarray(t.column("vec_id"), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32()), "blob": pa.array([build(ids[order], flat[order])], pa.binary()), "ids": pa.array([ids[order]], pa.list_(pa.int64()))})

    return dealt.groupBy("dim", "part").applyInArrow(run, "dim int, part int, blob binary, ids array<long>")


def runs(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each distinct value with the positions that hold it."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return [(int(values[g[0]]), g) for g in np.split(order, cuts) if len(g)]


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int, build, search, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from usable rows (vec_id, v, dim).

    build(ids, matrix): a shard's blob. search(shard, own ids, queries, bar, k):
    (query row, id, score) of the hits that reach the queries' bars."""
    kinds = {"long": pa.int64(), "double": pa.float64()}
    empty = np.int64(NONE) if score == "long" else np.float64(-np.inf)

    def run(places: pa.Table, shard: pa.Table) -> pa.Table:
        rows, ids, scores = [], [], []
        if shard.num_rows and places.num_rows:
            tree = unpack(shard.column("tree")[0].as_buffer())
            for block, bars in zip(places.column("block"), places.column("bar").to_pylist()):
                b = unpack(block.as_buffer())
                bar = np.array(bars, dtype=empty.dtype) if bars else np.full(len(b["ids"]), empty)
                row, found, value = search(tree, b["ids"], b["x"], bar, k)
                rows.append(b["ids"][row]), ids.append(found), scores.append(value)
        join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
        return pa.table({"query_id": join(rows, pa.int64()), "vec_id": join(ids, pa.int64()), "score": join(scores, kinds[score])})

    shards = stored(gathered(vectors, shard_rows, "shards", build).select("dim", "part", F.col("blob").alias("tree")), "shards")
    blocks = gathered(queries, BLOCK_ROWS, "blocks", lambda ids, x: pack(ids=ids, x=x))
    blocks = stored(blocks.select("dim", F.col("part").alias("block_no"), F.col("blob").alias("block"), "ids"), "blocks")
    parts = shards.groupBy("dim").agg(F.count("*").alias("parts"))
    places = blocks.join(parts, "dim").withColumn("g", F.floor(F.col("block_no") / BLOCKS).cast("int"))
    home = F.pmod(F.col("g"), F.col("parts")).cast("int")
    keys = ["dim", "part", "g"]

    def meet(p: DataFrame) -> DataFrame:
        met = p.select(*keys).distinct().toDF("d", "s", "g_")
        trees = shards.join(met, (F.col("d") == F.col("dim")) & (F.col("s") == F.col("part"))).select("dim", "part", F.col("g_").alias("g"), "tree")
        return p.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score}")

    none = F.lit(None).cast(f"array<{score}>")
    seen = stored(meet(places.select("dim", "g", "block", home.alias("part"), none.alias("bar"))), "first")
    # The kth score in the first shard is the bar in all others.
    bars = _ranked(seen, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    members = blocks.select("dim", "block_no", F.posexplode("ids").alias("pos", "query_id")).join(bars, "query_id", "left")
    bar = members.groupBy("dim", "block_no").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("kth", F.lit(empty.item())).alias("kth")))).alias("b"))
    bar = stored(bar.select("dim", "block_no", F.transform("b", lambda s: s["kth"]).alias("bar")), "bars")
    every = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    rest = places.join(bar, ["dim", "block_no"]).select("dim", "g", "block", "bar", every.alias("part"), home.alias("home")).where("part <> home").drop("home")
    return _ranked(seen.unionByName(meet(rest)), k).select("query_id", "rank", "vec_id", "score")
