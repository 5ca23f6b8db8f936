"""Exact top-k by inner product: a ball tree per shard, branch and bound.

A shard's vectors are split at the median along the direction between two far
points until a ball holds at most ``LEAF`` of them. For a query q, no vector of
a ball (centre c, radius r) scores above q.c + |q| r. From the root down, a
ball is open to a query while the least bound on its path reaches the query's
bar; the leaves that remain are visited in the order of that bound, the next best leaf of every
query of a block in one turn, and a query rests once its next bound falls
below its kth score. That score is shared: all leaves of a shard work on it,
each query first meets one shard, and the score reached there is the bar for all others.

Scores are whole numbers and compared exactly; equal scores go to the smaller
id, so a ball whose bound equals the bar is opened too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import NONE, SHARD_ROWS, pack, runs, top_k, usable

LEAF = 256
SCALE = 64


def build_tree(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A blob with the vectors in leaf order and, for each node, centre, radius,
    children (-1: leaf) and the vectors' range."""
    order = np.arange(len(x))
    nodes: list[list] = []
    todo = [(0, len(x))]
    at = 0
    while at < len(todo):
        a, b = todo[at]
        part = x[order[a:b]]
        centre = part.mean(axis=0)
        far = np.sqrt(((part - centre) ** 2).sum(axis=1))
        children = (-1, -1)
        if b - a > LEAF and far.max() > 0:
            one = part[far.argmax()]
            two = part[((part - one) ** 2).sum(axis=1).argmax()]
            side = part @ (two - one)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argsort(side, kind="stable")]
            children = (len(todo), len(todo) + 1)
            todo += [(a, a + half), (a + half, b)]
        elif b - a > LEAF:  # one point many times: leaves of bounded size need no split plane
            half = (b - a) // 2
            children = (len(todo), len(todo) + 1)
            todo += [(a, a + half), (a + half, b)]
        nodes.append([centre, far.max(), children, (a, b)])
        at += 1
    return pack(
        ids=ids[order], x=x[order], centre=np.stack([n[0] for n in nodes]), radius=np.array([n[1] for n in nodes]),
        child=np.array([n[2] for n in nodes], dtype=np.int64), span=np.array([n[3] for n in nodes], dtype=np.int64),
    )


def search(tree: dict[str, np.ndarray], own: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's ``k`` best of a shard that reach its
    ``bar``. ``own`` are the queries' ids, which are no candidates for themselves."""
    ids, x = tree["ids"], tree["x"]
    most = float(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1])
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else object
    whole = lambda m: m.astype(kind) if kind is not object else np.vectorize(int, otypes=[object])(m)
    xs, qs = whole(x), whole(q)
    rank = np.empty(len(ids), dtype=np.int64)
    by_id = np.argsort(ids, kind="stable")
    rank[by_id] = np.arange(len(ids))
    bits = max(1, int(len(ids)).bit_length())
    # One whole number orders a score and then the smaller id.
    exact = kind is object or most >= 2 ** (62 - bits)
    low = -(1 << 62)
    norm = np.sqrt((q * q).sum(axis=1))
    bound = lambda nodes: (q @ tree["centre"][nodes].T + norm[:, None] * tree["radius"][nodes][None, :]) + 1e-6 * (1 + norm[:, None] * (np.abs(tree["centre"][nodes]).max() + tree["radius"][nodes][None, :]))
    # From the root down: for each query a ball's bound is the least of its own and those
    # above it; a ball below a query's bar is closed to that query, and goes if it is to all.
    floor = np.where(bar == NONE, -np.inf, bar.astype(np.float64) * (1 - np.sign(bar) * 1e-15))
    level, leaves, bounds = np.array([0]), [], []
    ub = bound(level)
    while len(level):
        ub[ub < floor[:, None]] = -np.inf
        alive = np.isfinite(ub).any(axis=0)
        level, ub = level[alive], ub[:, alive]
        leaf = tree["child"][level, 0] < 0
        leaves.append(level[leaf]), bounds.append(ub[:, leaf])
        above = np.repeat(ub[:, ~leaf], 2, axis=1)
        level = tree["child"][level[~leaf]].reshape(-1)
        ub = np.minimum(above, bound(level)) if len(level) else above
    leaves = np.concatenate(leaves)
    if not len(leaves):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if exact:
        return _search_wide(ids, xs, own, qs, bar, k)
    ub = np.concatenate(bounds, axis=1)
    order = np.argsort(-ub, axis=1)
    best = np.full((len(q), k), low, dtype=np.int64)
    active = np.arange(len(q))
    for turn in range(len(leaves)):
        nxt = order[active, turn]
        kth = best[active, -1]
        kth_score = np.where(kth == low, -np.inf, (kth >> bits).astype(np.float64))
        going = np.isfinite(ub[active, nxt]) & (ub[active, nxt] >= np.maximum(floor[active], kth_score))
        active, nxt = active[going], nxt[going]
        if not len(active):
            break
        for leaf, where in runs(nxt):
            a, b = tree["span"][leaves[leaf]]
            rows = active[where]
            score = (qs[rows] @ xs[a:b].T).astype(np.int64)
            code = (score << bits) | ((1 << bits) - 1 - rank[a:b])[None, :]
            code[own[rows][:, None] == ids[a:b][None, :]] = low
            both = np.concatenate([best[rows], code], axis=1)
            best[rows] = -np.partition(-both, k - 1, axis=1)[:, :k]
            best[rows] = -np.sort(-best[rows], axis=1)
    row, col = np.nonzero(best != low)
    code = best[row, col]
    score = code >> bits
    keep = score >= bar[row]
    found = ids[by_id[(1 << bits) - 1 - (code & ((1 << bits) - 1))]]
    return row[keep], found[keep], score[keep]


def _search_wide(ids, xs, own, qs, bar, k):
    """Scores too large for 64 bits beside an id: whole numbers of any size."""
    rows, found, scores = [], [], []
    for i in range(len(qs)):
        s = (xs.astype(object) * qs[i].astype(object)).sum(axis=1)
        mine = [(-int(v), int(n)) for v, n in zip(s, ids) if n != own[i] and v >= bar[i]]
        for v, n in sorted(mine)[:k]:
            rows.append(i), found.append(n), scores.append(max(-(2**63), min(2**63 - 1, -v)))
    return np.array(rows, np.int64), np.array(found, np.int64), np.array(scores, np.int64)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of
    ``vectors`` with the largest inner product of floor(64 * x), all if there are fewer.

    Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part. A query meets vectors of its own length only, and no row with its
    own id. Rows that repeat an id are candidates each for themselves. A score
    beyond 64 bits is held at their end. Extra columns are not read."""
    scaled = lambda df: usable(df, key, vector).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    return top_k(scaled(vectors), scaled(queries), k, shard_rows, build_tree, search, "long")
