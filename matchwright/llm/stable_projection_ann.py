"""Approximate nearest neighbours by stable projections in a kd-tree.

The largest inner products become the smallest distances when each vector of a
shard gets one more component that brings it to the shard's largest norm, and
the query a zero. A few Gaussian (2-stable) projections then map a distance d to
one whose square over d^2 follows a chi-square law. A kd-tree holds the
projected points. A query goes through them from the nearest on: leaves are
opened as far as the next neighbours can lie in them, and neighbours are verified
one after another on the original vectors until the chi-square test holds: a
point nearer than ``1 / ratio`` times the current kth distance would, with
probability ``confidence``, have been projected nearer than all that is still to come.

Vectors that are equal are verified once; of their ids the k + 1 smallest
suffice, for equal scores go to the smaller id and one may be the query's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chi2
from .vector_blocks import SHARD_ROWS, pack, top_k, usable

DIMENSIONS = 24
LEAF = 128
CONFIDENCE = 0.95
RATIO = 1.05
#: Neighbours that are verified between two looks at the test: at first, and at most.
STEP, MOST = 64, 512


def build_index(dimensions: int, keep: int, seed: int = 5):
    def build(ids: np.ndarray, x: np.ndarray) -> bytes:
        x = np.ascontiguousarray(x) + 0.0
        rows = x.view([("", x.dtype)] * x.shape[1])[:, 0]
        _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        x = x[first]
        order = np.lexsort((ids, inverse))
        starts = np.searchsorted(inverse[order], np.arange(len(x)))
        ends = np.append(starts[1:], len(order))
        members = np.full((len(x), keep), -1, dtype=np.int64)
        counts = np.minimum(ends - starts, keep)
        for c in range(keep):
            have = counts > c
            if not have.any():
                members = members[:, : max(1, c)]
                break
            members[have, c] = ids[order[starts[have] + c]]
        top = np.sqrt((x * x).sum(axis=1).max())
        lift = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
        gauss = np.random.default_rng(seed).normal(size=(x.shape[1] + 1, dimensions))
        y = x @ gauss[:-1] + lift[:, None] * gauss[-1]
        place, todo, leaves = np.arange(len(x)), [(0, len(x))], []
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            part = y[place[a:b]]
            axis = (part.max(axis=0) - part.min(axis=0)).argmax()
            half = (b - a) // 2
            place[a:b] = place[a:b][np.argpartition(part[:, axis], half)]
            todo += [(a, a + half), (a + half, b)]
        span = np.array(sorted(leaves), dtype=np.int64)
        y = y[place]
        return pack(
            x=x[place], y=y, norm=(y * y).sum(axis=1), count=counts[place], members=members[place], span=span, gauss=gauss, top=np.array([top]),
            low=np.stack([y[a:b].min(axis=0) for a, b in span]), high=np.stack([y[a:b].max(axis=0) for a, b in span]),
        )

    return build


def verified(tree: dict[str, np.ndarray], q: np.ndarray, bar: float, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the neighbours of one query that were verified. limit: the
    chi-square quantile over the squared ratio. bar: a score that k others reach."""
    x, y, top = tree["x"], tree["y"], float(tree["top"][0])
    scale = top / np.sqrt(q @ q)  # a query's length changes no order; the shard's norm keeps distances small
    z = (q * scale) @ tree["gauss"][:-1]
    gap = np.maximum(np.maximum(tree["low"] - z, z - tree["high"]), 0.0)
    bound = (gap * gap).sum(axis=1)
    order = np.argsort(bound, kind="stable")
    bound = np.append(bound[order], np.inf)
    farthest = lambda score: limit * max(2 * top * top - 2 * score * scale, 0.0) if np.isfinite(score) else np.inf
    still, opened, want = farthest(bar), 0, STEP
    places, far = np.empty(0, np.int64), np.empty(0)
    done, seen, scores = 0, [], []
    best = np.empty(0)  # the k + 1 best scores: the query itself may be among them
    while True:
        # The next neighbours in order of projected distance, from all leaves in which they can lie.
        while opened < len(order) and bound[opened] <= still and (len(far) < done + want or bound[opened] <= far[done + want - 1]):
            reach = far[done + want - 1] if len(far) >= done + want else bound[opened]
            until = min(max(opened + 1, int(np.searchsorted(bound, reach, "right"))), len(order))
            more = np.concatenate([np.arange(*tree["span"][leaf]) for leaf in order[opened:until]])
            off = np.maximum(tree["norm"][more] - 2.0 * (y[more] @ z) + z @ z, 0.0)
            near = off <= still
            places, far, opened = np.concatenate([places[done:], more[near]]), np.concatenate([far[done:], off[near]]), until
            sort = np.argsort(far)
            places, far, done = places[sort], far[sort], 0
        batch = places[done : done + want][far[done : done + want] <= still]
        if not len(batch):
            break
        got = x[batch] @ q
        seen.append(batch), scores.append(got)
        done += len(batch)
        best = np.concatenate([best, got])
        if len(best) > k:
            best = np.partition(best, len(best) - k - 1)[len(best) - k - 1 :]
            still = farthest(max(best[0], bar))
        want = min(2 * want, MOST)
    return (np.concatenate(seen), np.concatenate(scores)) if seen else (np.empty(0, np.int64), np.empty(0))


def searcher(dimensions: int, confidence: float, ratio: float):
    limit = chi2.quantile(confidence, dimensions) / ratio**2

    def search(tree: dict[str, np.ndarray], own: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int):
        rows, found, values = [], [], []
        for i in range(len(q)):
            places, score = verified(tree, q[i], bar[i], k, limit)
            if len(score) > k + 1:  # what is near the best k + 1, rounding aside, and no less
                least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                places = places[score >= least - 1e-9 * max(1.0, abs(least))]
            score = (tree["x"][places] * q[i]).sum(axis=1)  # summed alike for every pair, so equal vectors score the same
            score, ids = np.repeat(score, tree["count"][places]), tree["members"][places]
            ids = ids[np.arange(ids.shape[1])[None, :] < tree["count"][places][:, None]]
            keep = (ids != own[i]) & (score >= bar[i])
            score, ids = score[keep], ids[keep]
            if len(score) > k:  # all that tie with the kth stay until ids decide
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, ids = score[keep], ids[keep]
            sort = np.lexsort((ids, -score))[:k]
            rows.append(np.full(len(sort), i)), found.append(ids[sort]), values.append(score[sort])
        return np.concatenate(rows), np.concatenate(found), np.concatenate(values)

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, ratio: float = RATIO, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of
    ``vectors`` with the largest inner product that the search finds.

    Rows with a null id, a null, empty or zero vector, or a null or non-finite
    component take no part. A query meets vectors of its own length only, and no
    row with its own id. Of rows that repeat id and vector, each counts. Equal scores
    go to the smaller id. Extra columns are not read; empty tables give an empty one."""
    nonzero = lambda df: usable(df, key, vector).where(F.exists("v", lambda x: x != 0.0))
    return top_k(nonzero(vectors), nonzero(queries), k, shard_rows, build_index(dimensions, k + 1), searcher(dimensions, confidence, ratio), "double")
