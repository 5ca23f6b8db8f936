"""The learned tree of functions against one that splits node by node in Python."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

from matchwright.operators import blocking_tree

COLUMNS = ["name", "city"]


def rows_of(n, seed=5):
    """A third of the rows share one city, names repeat, some values are missing or blank."""
    rng = random.Random(seed)
    first, last = ["anna", "anton", "bert", "berta", "carla"], ["stone", "stonefield", "lee", "moss"]
    out = []
    for i in range(n):
        name = rng.choice([f"{rng.choice(first)} {rng.choice(last)}", f"{rng.choice(first)} {rng.choice(last)}", None, "  "]) if i % 5 else "anna stone"
        out.append((i, name, "harbour" if i % 3 == 0 else rng.choice(["hill", "hillside", "vale", None])))
    return out


def key(function, row):
    (column, kind), = function.parts
    text = (row[1 + COLUMNS.index(column)] or "").strip().lower()
    if kind == "whole":
        return text
    n = int(kind.split()[1])
    return text[:n] if len(text) >= n else ""


def brute(rows, functions, matches, most):
    """(sizes, comparisons, lost of each inner node; sorted leaves)."""
    by_id = {r[0]: r for r in rows}
    inner, leaves, open_ = [], [], [sorted(by_id)]
    while open_:
        node = open_.pop()
        best = None
        if len(node) > most:
            inside = [(a, b) for a, b in matches if a in node and b in node]
            for f, function in enumerate(functions):
                keys = {i: key(function, by_id[i]) for i in node}
                c = sum(n * (n - 1) // 2 for n in Counter(keys.values()).values())
                removed = len(node) * (len(node) - 1) // 2 - c
                lost = sum(keys[a] != keys[b] for a, b in inside)
                if removed:
                    best = min(x for x in (best, (-removed / (1 + lost), lost, f, c)) if x)
        if best is None:
            leaves.append(tuple(node))
            continue
        inner.append((len(node), best[3], best[1], functions[best[2]].name))
        parts = defaultdict(list)
        for i in node:
            parts[key(functions[best[2]], by_id[i])].append(i)
        open_ += parts.values()
    return sorted(inner), sorted(leaves)


def leaves_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["node"]].append(r["id"])
    return sorted(tuple(sorted(x)) for x in out.values())


def test_tree_against_brute_force(spark):
    rows = rows_of(120)
    records = spark.createDataFrame(rows, "id long, name string, city string")
    rng = random.Random(1)
    matches = [tuple(sorted(rng.sample(range(120), 2))) for _ in range(40)] + [(0, 5), (0, 5), (3, 9999)]
    labelled = spark.createDataFrame(matches, "left_id long, right_id long")
    tree = blocking_tree.learn_tree(records, labelled, COLUMNS, 6)
    inner, leaves = brute(rows, tree.functions, [m for m in set(matches) if m[1] < 120], 6)
    assert sorted((r["n"], r["comparisons"], r["lost"], r["function"]) for r in tree.splits.collect()) == inner and tree.levels >= 2
    assert leaves_of(tree.leaves(records)) == leaves
    want = {p for leaf in leaves for p in itertools.combinations(leaf, 2)}
    for most in (3, 2000):
        got = [(r["left_id"], r["right_id"]) for r in tree.pairs(records, None, most).collect()]
        assert set(got) == want and len(got) == len(want)
    # Other records go the same way: a copy meets what its original meets, a new value meets nothing.
    other = spark.createDataFrame([(1000, *rows[7][1:]), (1001, "zed quux", "nowhere at all")], "id long, name string, city string")
    met = {r["left_id"] for r in tree.pairs(records, other).collect()}
    assert met == set(next(leaf for leaf in leaves if 7 in leaf))


def test_tree_of_odd_tables(spark):
    schema = "id long, name string, city string"
    none = spark.createDataFrame([], "left_id long, right_id long")
    empty = blocking_tree.learn_tree(spark.createDataFrame([], schema), none, COLUMNS, 2)
    assert empty.levels == 0 and empty.pairs(spark.createDataFrame([], schema)).count() == 0
    # Equal records cannot be split: one leaf, however large.
    same = spark.createDataFrame([(i, None, "x") for i in range(9)], schema)
    alike = blocking_tree.learn_tree(same, none, COLUMNS, 2)
    assert alike.levels == 0 and alike.pairs(same, None, 4).count() == 36
