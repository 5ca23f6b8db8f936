"""Clusters from scored pairs."""

from __future__ import annotations

import hashlib
import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .components import connected_components


def components_over(universe: DataFrame, links: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(node, cluster_id) for every node of ``universe``; one without links is alone.
    The cluster is named by its smallest node."""
    comps = connected_components(links, left, right)
    return universe.select("node").distinct().join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("cluster_id"))


def threshold_components(scored: DataFrame, threshold: float, universe: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Connected components of the pairs at (or, strict, above) a threshold."""
    kept = scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)
    nodes = universe if universe is not None else kept.select(F.explode(F.array("left_id", "right_id")).alias("node"))
    return components_over(nodes, kept)


def _greedy(rest: pd.DataFrame) -> pd.DataFrame:
    """The pairs that are free as they come, best first."""
    rest = rest.sort_values(["score", "left_id", "right_id"], ascending=[False, True, True], kind="stable")
    left, right, keep = set(), set(), []
    for a, b in zip(rest["left_id"], rest["right_id"]):
        free = a not in left and b not in right
        keep.append(free)
        if free:
            left.add(a), right.add(b)
    return rest.loc[keep, ["left_id", "right_id", "score"]]


def unique_mapping(scored: DataFrame, threshold: float = 0.0, rounds: int = 3, local: int = 1_000_000) -> DataFrame:
    """One-to-one matching of two sources: pairs in falling order of (score, then
    smaller left, then smaller right id), each taken if both records are free.

    A pair that comes first at both its ends is in that matching whatever else
    is; all such pairs are taken at once, their records leave, and the rest goes
    on. Each round aggregates before it joins. After some ``rounds`` what is left falls
    into components: pairs of different ones never compete, so each component of at most
    ``local`` pairs is gone through in order by one task, and larger ones go on in rounds. A
    chain of falling scores thus takes no round for each link."""
    rest = stored(scored.where(F.col("score") >= threshold).select("left_id", "right_id", "score").groupBy("left_id", "right_id").agg(F.max("score").alias("score")), "open")
    kinds = ", ".join(f"{c} {k}" for c, k in rest.dtypes)
    taken = None

    def add(found: DataFrame) -> None:
        nonlocal taken
        taken = found if taken is None else taken.unionByName(found)

    while True:
        for _ in range(rounds):
            key = F.struct((-F.col("score")).alias("s"), "left_id", "right_id")
            best_l = rest.groupBy("left_id").agg(F.min(key).alias("k")).select("k.left_id", "k.right_id", (-F.col("k.s")).alias("score"))
            best_r = rest.groupBy("right_id").agg(F.min(key).alias("k")).select("k.left_id", "k.right_id")
            both = stored(best_l.join(best_r, ["left_id", "right_id"]), "taken")
            add(both)
            after = stored(rest.join(both.select("left_id"), "left_id", "left_anti").join(both.select("right_id"), "right_id", "left_anti"), "open")
            dropped(rest)
            rest = after
            if rest.isEmpty():
                return taken
        left = F.concat(F.lit("l"), F.col("left_id").cast("string")).alias("l")
        links = stored(rest.select("*", left, F.concat(F.lit("r"), F.col("right_id").cast("string")).alias("r")), "links")
        comps = connected_components(links, "l", "r")
        placed = stored(links.join(comps, F.col("l") == F.col("node")).select("left_id", "right_id", "score", "component"), "placed")
        large = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > local).select("component")
        add(stored(placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(_greedy, kinds), "taken"))
        rest = stored(placed.join(large, "component", "left_semi").drop("component"), "open")
        if rest.isEmpty():
            return taken


def weighted_edges(scored: DataFrame) -> DataFrame:
    """(a, b, s, na, nb): each scored pair once, a < b, with its highest score and how many records
    each end stands for: 1, or ``left_n`` and ``right_n`` where ``scored`` has them. Each record of
    one end is then scored alike against each of the other."""
    one = F.lit(1).cast("long")
    n = [F.col(f"{s}_n") if f"{s}_n" in scored.columns else one for s in ("left", "right")]
    first = F.col("left_id") < F.col("right_id")
    ends = [F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.col("score").cast("double").alias("s")]
    edges = scored.where("left_id <> right_id").select(*ends, F.when(first, n[0]).otherwise(n[1]).alias("na"), F.when(first, n[1]).otherwise(n[0]).alias("nb"))
    return edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def average_linkage(scored: DataFrame, threshold: float, universe: DataFrame | None = None, max_component: int | None = None, local: int = 5000) -> DataFrame:
    """(node, cluster_id): average-linkage clusters inside the components of the pairs
    at the threshold. Averages are over all pairs between two clusters: scores below the
    threshold count as they are, pairs without a score as 0. Equal averages go by a hash
    of the two clusters' smallest nodes.

    A component of at most ``local`` nodes is worked on as a whole in one task. In larger
    ones, all pairs of clusters that are each other's best merge at once, which gives the
    same clusters, as no merger brings a cluster nearer to a third than its nearer part
    was. For the same reason what pairs below the threshold alone hold together falls
    apart, so the rest of a component becomes small in the end. Each round is a few
    aggregations and joins; averages that rise along a chain take many rounds. With
    ``max_component``, larger components stay single-linkage clusters. Nodes may stand for several
    records (see ``weighted_edges``)."""
    edges = stored(weighted_edges(scored).withColumn("s", F.greatest("s", F.lit(0.0)) * F.col("na") * F.col("nb")), "edges")
    kind = dict(edges.dtypes)["a"]

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = {**dict(zip(pdf["a"], pdf["na"])), **dict(zip(pdf["b"], pdf["nb"]))}
        clusters = {n: [n] for n in sorted(size)}
        near: dict = {n: {} for n in size}
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["s"]):
            near[a][b] = near[b][a] = s
        heap: list[tuple] = []

        def push(x, y) -> None:
            a, b = min(x, y), max(x, y)
            average = near[a][b] / (size[a] * size[b])
            if average >= threshold:
                heapq.heappush(heap, (-average, hashlib.md5(f"{a} {b}".encode()).hexdigest(), a, b, size[a], size[b]))

        for a in near:
            for b in near[a]:
                if a < b:
                    push(a, b)
        while heap:
            *_, a, b, na, nb = heapq.heappop(heap)
            if size.get(a) != na or size.get(b) != nb:  # one of the two has grown or gone
                continue
            clusters[a] += clusters.pop(b)
            size[a] += size.pop(b)
            others = near.pop(b)
            near[a].pop(b, None)
            others.pop(a, None)
            for x, s in others.items():
                near[x].pop(b)
                near[a][x] = near[x][a] = near[a].get(x, 0.0) + s
            for x in near[a]:
                push(a, x)
        return pd.DataFrame([(n, min(c)) for c in clusters.values() for n in c], columns=["cluster", "cluster_id"])

    average = F.col("s") / (F.col("na") * F.col("nb"))
    comps = stored(connected_components(edges.where(average >= threshold), "a", "b"), "components")
    names = comps.select("node", F.col("node").alias("cluster"))
    ended, single = None, None
    if max_component is not None:
        large = comps.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > max_component).select("component")
        single = comps.join(large, "component", "left_semi").select("node", F.col("component").alias("cluster_id"))
        comps = comps.join(large, "component", "left_anti")
        names = comps.select("node", F.col("node").alias("cluster"))
    while True:
        # Pairs between components of the pairs at the threshold are below it for good.
        sized = stored(comps.join(comps.groupBy("component").agg(F.count("*").alias("n")), "component"), "sized")
        inside = edges.join(sized.select(F.col("node").alias("a"), "component", "n"), "a").join(sized.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other").drop("other")
        fine = inside.where(F.col("n") <= local).drop("n").groupBy("component").applyInPandas(link, f"cluster {kind}, cluster_id {kind}")
        fine = stored(fine, "fine")
        ended = fine if ended is None else ended.unionByName(fine)
        if sized.where(F.col("n") > local).isEmpty():
            break
        edges = stored(inside.where(F.col("n") > local).drop("component", "n"), "edges")
        for _ in range(3):
            tie = F.md5(F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"))
            near = edges.where(average >= threshold).select(F.struct((-average).alias("r"), tie.alias("t"), "a", "b", "na", "nb").alias("k"))
            best = near.select(F.explode(F.array("k.a", "k.b")).alias("end"), "k").groupBy("end").agg(F.min("k").alias("k"))
            pairs = stored(best.groupBy("k").agg(F.count("*").alias("ends")).where("ends = 2").select("k.*"), "pairs")
            whole = F.col("na") + F.col("nb")
            moved = stored(pairs.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), whole.alias("size")), "moved")
            names = stored(names.join(moved.select(F.col("old").alias("cluster"), "new"), "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "names")
            for end, n in (("a", "na"), ("b", "nb")):
                edges = edges.join(moved.withColumnRenamed("old", end), end, "left").withColumns({end: F.coalesce("new", end), n: F.coalesce("size", n)}).drop("new", "size")
            first = F.col("a") < F.col("b")
            edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"))
            # At most four sums meet, added in one order in every run.
            total = F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda x, y: x + y)
            edges = stored(edges.groupBy("a", "b", "na", "nb").agg(total.alias("s")).select("a", "b", "s", "na", "nb"), "edges")
        comps = stored(connected_components(edges.where(average >= threshold), "a", "b"), "components")
    out = names.join(ended, "cluster", "left").select("node", F.coalesce("cluster_id", "cluster").alias("cluster_id"))
    if single is not None:
        out = out.unionByName(single)
    if universe is None:
        return out
    return universe.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("cluster_id", "node").alias("cluster_id"))


def cluster_pair_scores(split: DataFrame, members: DataFrame, how: str = "max") -> DataFrame:
    """A split's pairs with a score from cluster membership (node, src, cluster_id,
    score): 0 in different clusters, else the larger ("max", two sources) or the
    smaller ("min", one source) of both records' scores, over all their rows."""
    a = members.select(F.col("node").alias("left_id"), F.col("cluster_id").alias("__a"), F.col("score").alias("__s"), *(["src"] if "src" in members.columns else []))
    b = members.select(F.col("node").alias("right_id"), F.col("cluster_id").alias("__b"), F.col("score").alias("__t"), *(["src"] if "src" in members.columns else []))
    if "src" in members.columns and how == "max":
        a, b = a.where("src = 'a'"), b.where("src <> 'a'")
    a, b = a.drop("src"), b.drop("src")
    pick = F.greatest("__s", "__t") if how == "max" else F.least("__s", "__t")
    hits = split.select("left_id", "right_id").distinct().join(a, "left_id").join(b, "right_id").where("__a = __b").groupBy("left_id", "right_id").agg(F.max(pick).alias("score"))
    return split.join(hits, ["left_id", "right_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _score_together(how: str, same: Column, s: Column, t: Column) -> Column:
    return F.coalesce(F.when(same, F.greatest(s, t) if how == "max" else F.least(s, t)), F.lit(0.0))


def cluster_scores_of_values(rows: DataFrame, cluster: str, score: str, how: str = "max") -> DataFrame:
    """Pairs of values (<column>_l, <column>_r) with the ``score`` that ``cluster_pair_scores`` gives their
    pairs of records, each of which is one member."""
    same = F.col(f"{cluster}_l") == F.col(f"{cluster}_r")
    return rows.withColumn("score", _score_together(how, same, F.col(f"{score}_l"), F.col(f"{score}_r")))


def cluster_scores_where(left: DataFrame, right: DataFrame, on: str, how: str = "max", task: int = 20_000_000) -> DataFrame:
    """(left_id, right_id, score): the ``cluster_pair_scores`` of all pairs of a left and a right member
    (node, cluster_id, score) that agree on the column ``on``. Each node is one member, so none is
    looked up for its pairs. The left members of a value are dealt to lots, so that about
    ``task`` pairs are made in one task, however many agree on it."""
    sizes = left.groupBy(on).agg(F.count("*").alias("n")).join(right.groupBy(on).agg(F.count("*").alias("m")), on)
    made = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("all"), F.coalesce(F.max(F.col("n") * F.col("m")), F.lit(0)).alias("one")).first()
    lots, parts = max(1, math.ceil(made["one"] / task)), max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(made["all"] / task))
    a = left.select(on, F.pmod(F.xxhash64("node"), F.lit(lots)).cast("int").alias("__lot"), F.col("node").alias("left_id"), F.col("cluster_id").alias("__a"), F.col("score").alias("__s"))
    b = right.select(on, F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("__lot"), F.col("node").alias("right_id"), F.col("cluster_id").alias("__b"), F.col("score").alias("__t"))
    both = a.repartition(parts, on, "__lot").join(b.repartition(parts, on, "__lot").hint("merge"), [on, "__lot"])
    return both.select("left_id", "right_id", _score_together(how, F.col("__a") == F.col("__b"), F.col("__s"), F.col("__t")).alias("score"))


def linker_columns(df: DataFrame) -> tuple[str, str]:
    """(score column, id column) of a learned linker's output: the first names that it has."""
    has = {c.lower(): c for c in df.columns}
    score = next((has[c] for c in ("z_maxscore", "z_score") if c in has), None)
    ident = next((has[c] for c in ("id", "entity id", "entity_id", "z_id") if c in has), None)
    if score is None or ident is None:
        raise KeyError(f"no score or id column among {df.columns}")
    return score, ident


def best_of_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """The row with the largest value of each group; ties by the smallest row."""
    order = Window.partitionBy(group).orderBy(F.desc(value), *[c for c in df.columns if c not in (group, value)])
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
