"""Learned blocking, pruning in place, hierarchical clusters, alignments and neighbour graphs,
against brute force, with hot keys and odd rows."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchwright import catalogue_learned, shipping
from matchwright.functions import alignment
from matchwright.operators import canopies, clustering, compare, merge_tree, neighbourhoods, nn_descent, predicates, sampling, token_blocking
from matchwright.operators.predicates import Predicate
from matchwright.plans import pipelines

# ---------------------------------------------------------------- generated predicates

PEOPLE = [(1, "Ann Lee", 10.0), (2, "ann  lee", 10.4), (3, "Bob Stone", None), (4, None, 999.0), (5, "", 10.2), (6, "Lee Ann", 55.0), (7, "bob stone jr", 11.0), (8, "Ann Lee", float("nan"))]


def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, name string, x double")


def pairs_of(df):
    return {(r["left_id"], r["right_id"]) for r in df.collect()}


def test_lattice_follows_the_columns(spark):
    names = [p.name for p in predicates.lattice(people(spark), ["name", "x"])]
    assert names[:3] == ["whole of name", "prefix 3 of name", "prefix 5 of name"] and "tokens of name" in names and "grams 4 of name" in names and "whole of x" in names
    assert predicates.lattice(spark.createDataFrame([], "id long, name string, x double"), ["name", "x"]) == [Predicate((("name", "whole"),)), Predicate((("x", "whole"),))]


def test_predicate_pairs_by_hand(spark):
    by = lambda *parts: pairs_of(predicates.predicate_pairs(people(spark), None, [Predicate(parts)]))
    assert by(("name", "whole")) == {(1, 8)}
    assert by(("name", "tokens")) == {(a, b) for a, b in itertools.combinations((1, 2, 6, 8), 2)} | {(3, 7)}
    assert by(("x", "bucket 1")) == {(1, 2), (1, 5), (2, 5)}
    assert by(("name", "tokens"), ("x", "bucket 1")) == {(1, 2)}
    assert predicates.predicate_pairs(people(spark), None, []).count() == 0


@pytest.mark.parametrize("most", [2, 3, 2000])
def test_hot_keys_in_parts_lose_no_pair(spark, most):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"w{i % 7}") for i in range(60)], "id long, key string")
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if ("same" if a % 3 else f"w{a % 7}") == ("same" if b % 3 else f"w{b % 7}")}
    got = predicates.key_pairs(rows, None, ["key"], most).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == want and len(got) == len(want)
    other = spark.createDataFrame([(100 + i, "same") for i in range(9)], "id long, key string")
    across = predicates.key_pairs(rows, other, ["key"], most).collect()
    assert {(r["left_id"], r["right_id"]) for r in across} == {(a, 100 + b) for a in range(60) if a % 3 for b in range(9)} and len(across) == 40 * 9


def test_covers_are_bits_and_conjunctions_are_both(spark):
    singles = [Predicate((("name", k),)) for k in ("whole", "tokens", "prefix 3")] + [Predicate((("x", "bucket 1"),))] * 63
    labelled = spark.createDataFrame([(a, b, 1) for a, b in itertools.combinations(range(1, 9), 2)] + [(1, 99, 1)], "left_id long, right_id long, label int")
    rows = predicates.covers(people(spark), None, labelled, singles).collect()
    assert len(rows) == 28 and all(len(r["cover"]) == 2 for r in rows)
    has = lambda r, i: bool(r["cover"][i // 62] >> (i % 62) & 1)
    for i in (0, 1, 2, 3, 65):
        assert {(r["left_id"], r["right_id"]) for r in rows if has(r, i)} == pairs_of(predicates.predicate_pairs(people(spark), None, [singles[i]]))
    both = Predicate(singles[1].parts + singles[65].parts)
    assert {(r["left_id"], r["right_id"]) for r in rows if has(r, 1) and has(r, 65)} == pairs_of(predicates.predicate_pairs(people(spark), None, [both]))


def test_learned_predicates_keep_the_budget_and_cover(spark):
    """Keys that agree by chance are refined by a second column; without matches nothing is chosen."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        name = f"{rng.choice(['ann', 'bob', 'cat'])} {rng.choice('xyz')}{rng.randrange(20)}"
        rows += [(2 * i, name, f"city{i % 9}", "a"), (2 * i + 1, name[::-1] if i % 10 == 0 else name, f"city{i % 9}", "a")]
    records = spark.createDataFrame(rows, "id long, name string, city string, same string")
    labelled = spark.createDataFrame([(2 * i, 2 * i + 1, 1) for i in range(400)] + [(2 * i, 2 * i + 3, 0) for i in range(399)], "left_id long, right_id long, label int")
    chosen = predicates.learn_predicates(records, None, labelled, ["name", "city", "same"], budget=4000, recall=0.85)
    assert chosen and sum(c.comparisons for c in chosen) <= 4000 and any(len(c.predicate.parts) == 2 for c in chosen)
    found = pairs_of(predicates.predicate_pairs(records, None, [c.predicate for c in chosen]))
    assert sum((2 * i, 2 * i + 1) in found for i in range(400)) >= 0.85 * 400
    assert sum(c.gain for c in chosen) == sum((2 * i, 2 * i + 1) in found for i in range(400))
    assert predicates.learn_predicates(records, None, labelled.where("label = 0"), ["name"], 1000) == []
    assert predicates.learn_predicates(records, None, labelled, ["same"], 10) == []


def test_learned_predicates_across_two_sources(spark):
    a = spark.createDataFrame([(i, f"name number {i}") for i in range(50)], "id long, name string")
    b = spark.createDataFrame([(i, f"name number {i}") for i in range(50)], "id long, name string")
    labelled = spark.createDataFrame([(i, i, 1) for i in range(50)], "left_id long, right_id long, label int")
    chosen = predicates.learn_predicates(a, b, labelled, ["name"], budget=60)
    assert [c.predicate.name for c in chosen] == ["whole of name"] and chosen[0].comparisons == 50
    assert pairs_of(predicates.predicate_pairs(a, b, [chosen[0].predicate])) == {(i, i) for i in range(50)}


# ---------------------------------------------------------------- canopies


def random_vectors(rng, n, terms=30):
    out = []
    for i in range(n):
        w = {t: rng.random() for t in rng.sample(range(terms), rng.randint(1, 6))}
        z = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / z for t, x in w.items()})
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_index_cut_by_the_bound_loses_no_pair(spark, threshold):
    vs = random_vectors(random.Random(3), 120)
    df = spark.createDataFrame([(i, f"t{t}", w) for i, v in enumerate(vs) for t, w in v.items()], "id long, term string, w double")
    got = {(r["left_id"], r["right_id"]): r["cosine"] for r in canopies.similar_pairs(df, threshold).collect()}
    want = {(a, b): s for a, b in itertools.combinations(range(120), 2) if (s := sum(w * vs[b].get(t, 0) for t, w in vs[a].items())) >= threshold}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert canopies.indexed_terms(df, threshold).count() < df.count()


def test_canopies_equal_the_one_by_one_order(spark):
    rng = random.Random(7)
    ids = [f"r{i:03d}" for i in range(80)]
    near = {tuple(sorted(rng.sample(ids, 2))) for _ in range(120)} | {("r000", i) for i in ids[40:]}  # a hub
    near |= {(a, b) for a, b in zip(ids, ids[1:])}  # and a chain
    other = defaultdict(set)
    for a, b in near:
        other[a].add(b), other[b].add(a)
    centres = []
    for i in ids:
        if not other[i] & set(centres):
            centres.append(i)
    want = {i: i if i in centres else min(other[i] & set(centres)) for i in ids} | {"alone": "alone"}
    records = spark.createDataFrame([(i,) for i in [*ids, "alone", None]], "id string")
    pairs = spark.createDataFrame([*near, *list(near)[:9], ("r001", "r001"), ("r001", "unknown"), (None, "r001")], "left_id string, right_id string")
    assert {r["id"]: r["canopy"] for r in canopies.canopies(records, pairs).collect()} == want
    assert {r["id"]: r["canopy"] for r in canopies.canopies(records, pairs.limit(0)).collect()} == {i: i for i in want}


# ---------------------------------------------------------------- pruning in place


def random_blocks(rng, two, n=60):
    rows = {(f"b{rng.randrange(25)}", rng.choice("ab") if two else "a", rng.randrange(n)) for _ in range(500)} | {("hot", s, i) for s in ("ab" if two else "a") for i in range(0, n, 2)}
    return sorted(rows)


@pytest.mark.parametrize("two, small, kind", [(False, False, "long"), (False, True, "string"), (True, False, "string"), (True, True, "long")])
def test_neighbourhoods_equal_the_graph(spark, monkeypatch, two, small, kind):
    """All columns of the graph, and each pruning against the pruned graph; with chunks, portions
    and slices of any size, ids that two sources share, and a hot block."""
    if small:
        for name, value in (("CHUNK", 7), ("HELD", 50), ("SLICE", 20)):
            monkeypatch.setattr(neighbourhoods, name, value)
    rows = [(b, s, i if kind == "long" else f"n{i}") for b, s, i in random_blocks(random.Random(two), two)]
    blocks = spark.createDataFrame(rows, f"block string, src string, id {kind}")
    graph = token_blocking.edges(blocks, two)
    order = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()])
    names = [f.split()[0] for f in neighbourhoods.GRAPH.split(", ")]
    assert order(neighbourhoods.graph_of(blocks, two).select("left_id", "right_id", *names)) == order(graph.select("left_id", "right_id", *names))
    plain = ["left_id", "right_id", "weight"]
    for scheme in ("JS", "ARCS"):
        weighted = token_blocking.weigh(graph, scheme)
        assert order(neighbourhoods.node_pruning(blocks, 3, scheme, two).select(plain)) == order(token_blocking.cardinality_node_pruning(weighted, 3, two).select(plain))
    weighted = token_blocking.weigh(graph, "CBS")
    assert order(neighbourhoods.edge_pruning(blocks, 40, "CBS", two).select(plain)) == order(token_blocking.cardinality_edge_pruning(weighted, 40).select(plain))
    assert order(neighbourhoods.mean_edge_pruning(blocks, "CBS", two).select(plain)) == order(token_blocking.weighted_edge_pruning(weighted).select(plain))


def test_weights_in_place_equal_those_of_the_graph(spark):
    blocks = spark.createDataFrame(random_blocks(random.Random(5), False), "block string, src string, id long")
    graph = token_blocking.edges(blocks).cache()
    n = graph.count()
    for scheme in ("CBS", "ECBS", "COSINE", "DICE", "X2"):
        want = {(r["left_id"], r["right_id"]): r["weight"] for r in token_blocking.weigh(graph, scheme).collect()}
        got = {(r["left_id"], r["right_id"]): r["weight"] for r in neighbourhoods.edge_pruning(blocks, n, scheme).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in want)
    for by in ("comparisons", "members"):
        for how in ("sum", "cosine", "dice", "jaccard"):
            want = {(r["left_id"], r["right_id"]): r["weight"] for r in token_blocking.weigh_normalised(graph, by, how).collect()}
            got = {(r["left_id"], r["right_id"]): r["weight"] for r in neighbourhoods.edge_pruning(blocks, n, f"{by}-{how}").collect()}
            assert all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


def test_copies_of_postings_follow_the_postings_not_the_pairs(spark, monkeypatch):
    """Full blocks: 24 x 120 postings hold 345,600 neighbours, and travel six times, not 346."""
    monkeypatch.setattr(neighbourhoods, "HELD", 1000)
    blocks = spark.createDataFrame([(f"b{b}", "a", i) for b in range(24) for i in range(120)], "block string, src string, id long")
    assert neighbourhoods.entity_index(blocks).groups == 6
    rows = neighbourhoods.graph_of(blocks, columns=("common",)).collect()
    assert len(rows) == 120 * 119 // 2 and {r["common"] for r in rows} == {24}


def test_degree_weights_in_place_equal_those_of_the_graph(spark):
    blocks = spark.createDataFrame(random_blocks(random.Random(6), False), "block string, src string, id long")
    want = {(r["left_id"], r["right_id"]): r["weight"] for r in token_blocking.weigh(token_blocking.edges(blocks).cache(), "EJS").collect()}
    got = {(r["left_id"], r["right_id"]): r["weight"] for r in neighbourhoods.weighted_graph(blocks, "EJS").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in want)


def test_pruning_of_no_blocks(spark):
    empty = spark.createDataFrame([], "block string, src string, id long")
    for found in (neighbourhoods.node_pruning(empty, 3), neighbourhoods.edge_pruning(empty, 3), neighbourhoods.mean_edge_pruning(empty), neighbourhoods.graph_of(empty), neighbourhoods.mean_node_pruning(empty)):
        assert found.count() == 0


# ---------------------------------------------------------------- hierarchical clusters


def brute_clusters(nodes, scores, threshold, single):
    clusters = [frozenset([n]) for n in nodes]

    def near(x, y):
        found = [scores.get((min(a, b), max(a, b)), 0.0) for a in x for b in y]
        return max(found) if single else sum(found) / len(found)

    while len(clusters) > 1:
        height, x, y = max(((near(x, y), x, y) for x, y in itertools.combinations(clusters, 2)), key=lambda c: c[0])
        if height < threshold:
            break
        clusters = [c for c in clusters if c not in (x, y)] + [x | y]
    return {n: min(c) for c in clusters for n in c}


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("local", [3, 5000])
def test_cuts_of_the_tree_equal_brute_force(spark, single, local):
    """Distinct scores, so that no tie decides; small ``local``: distributed rounds as well."""
    rng = random.Random(2 + single)
    nodes = list(range(40))
    every = list(itertools.combinations(nodes, 2))
    scores = {p: s / 1000 for p, s in zip(rng.sample(every, 150), rng.sample(range(100, 1000), 150))}
    df = spark.createDataFrame([(b, a, s) for (a, b), s in scores.items()] + [(1, 1, 0.9), (2, 3, None)], "left_id long, right_id long, score double")
    tree = merge_tree.merge_tree(df, 0.2, "single" if single else "average", local)
    assert tree.groupBy("node").count().where("count > 1").isEmpty()
    steps = [0.2, 0.35, 0.5, 0.7, 0.9, 1.0]
    got = {(r["threshold"], r["node"]): r["cluster_id"] for r in merge_tree.cut(tree, steps).collect()}
    for step in steps:
        assert {n: got.get((step, n), n) for n in nodes} == brute_clusters(nodes, scores, step, single)
    if not single:
        same = {r["node"]: r["cluster_id"] for r in clustering.average_linkage(df.where("score is not null"), 0.35, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
        assert same == {n: got.get((0.35, n), n) for n in nodes}


def test_cut_of_a_long_chain_and_sweep(spark):
    tree = spark.createDataFrame([(i, i - 1, 1 - i / 1000) for i in range(1, 300)], "node long, parent long, height double")
    got = {(r["threshold"], r["node"]): r["cluster_id"] for r in merge_tree.cut(tree, [0.9, 0.5]).collect()}
    assert got == {(0.9, i): 0 for i in range(1, 101)} | {(0.5, i): 0 for i in range(1, 300)}
    labelled = spark.createDataFrame([(0, 50, 1), (0, 200, 1), (3, 250, 0), (777, 778, 1), (777, 777, 0)], "left_id long, right_id long, label int")
    rows = {r["threshold"]: (r["true_positives"], r["false_positives"], r["false_negatives"]) for r in merge_tree.sweep(labelled, tree, [0.9, 0.5, 1.0]).collect()}
    assert rows == {0.9: (1, 1, 2), 0.5: (2, 2, 1), 1.0: (0, 1, 3)}
    empty = merge_tree.merge_tree(spark.createDataFrame([], "left_id long, right_id long, score double"))
    assert empty.count() == 0 and merge_tree.cut(empty, [0.5]).count() == 0


# ---------------------------------------------------------------- one-to-one


def test_a_falling_chain_of_ten_thousand_links_ends(spark):
    n = 10_000
    links = [(i, i, 1 - 2 * i / (3 * n)) for i in range(n)] + [(i + 1, i, 1 - (2 * i + 1) / (3 * n)) for i in range(n - 1)]
    got = clustering.unique_mapping(spark.createDataFrame(links, "left_id long, right_id long, score double"))
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == {(i, i) for i in range(n)}


@pytest.mark.parametrize("local", [2, 1_000_000])
def test_one_to_one_equals_greedy(spark, local):
    rng = random.Random(local)
    rows = [(rng.randrange(40), rng.randrange(40), rng.randrange(30) / 30) for _ in range(400)]
    got = {(r["left_id"], r["right_id"]) for r in clustering.unique_mapping(spark.createDataFrame(rows, "left_id long, right_id long, score double"), 0.1, rounds=1, local=local).collect()}
    best = {}
    for a, b, s in rows:
        best[a, b] = max(best.get((a, b), s), s)
    left, right, want = set(), set(), set()
    for a, b in sorted((p for p in best if best[p] >= 0.1), key=lambda p: (-best[p], p)):
        if a not in left and b not in right:
            want.add((a, b)), left.add(a), right.add(b)
    assert got == want


# ---------------------------------------------------------------- alignments


def brute_alignment(a, b, s):
    """Three tables: both characters, a gap in one text, a gap in the other."""
    low = -math.inf
    m, x, y = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    m[0][0], best = 0.0, 0.0
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i and j:
            m[i][j] = max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + (s.match if a[i - 1] == b[j - 1] else s.mismatch)
        if s.local:
            m[i][j] = max(m[i][j], 0.0)
        if i:
            x[i][j] = max(max(m[i - 1][j], y[i - 1][j]) - s.open, x[i - 1][j] - s.extend)
        if j:
            y[i][j] = max(max(m[i][j - 1], x[i][j - 1]) - s.open, y[i][j - 1] - s.extend)
        best = max(best, m[i][j], x[i][j], y[i][j])
    return best if s.local else max(m[-1][-1], x[-1][-1], y[-1][-1])


def test_alignments_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "a", "日本", "😀a"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(15))) for _ in range(60)]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(300)] + [(None, "a"), ("a", None), (None, None)]
    schemes = {"nw": alignment.NEEDLEMAN_WUNSCH, "sw": alignment.SMITH_WATERMAN, "gap": alignment.AFFINE, "cost": alignment.AFFINE_COST, "edits": alignment.EDITS, "own": alignment.Scheme(2, -1, 3, 0.25, True)}
    got = alignment.with_alignment(spark.createDataFrame(rows, "l string, r string"), "l", "r", schemes).withColumn("lev", F.levenshtein("l", "r")).collect()
    assert len(got) == len(rows)
    for r in got:
        for n, s in schemes.items():
            assert (r[n] is None) if r["l"] is None or r["r"] is None else abs(r[n] - brute_alignment(r["l"], r["r"], s)) < 1e-9
        assert r["lev"] is None or -r["edits"] == r["lev"]
    with pytest.raises(ValueError):
        alignment.Scheme(open=1.0, extend=2.0)


def test_normalised_and_hybrid(spark):
    rows = [("abc", "abc"), ("", ""), ("abc", ""), ("paul johnson", "johson paule"), ("a b", "a"), (None, "a")]
    df = alignment.with_alignment(spark.createDataFrame(rows, "l string, r string"), "l", "r", {"s": alignment.NEEDLEMAN_WUNSCH})
    got = df.select("l", "r", alignment.normalised(F.col("s"), F.col("l"), F.col("r")).alias("n"), alignment.monge_elkan(F.col("l"), F.col("r")).alias("m"), alignment.monge_elkan(F.col("r"), F.col("l")).alias("w")).collect()
    by = {(r["l"], r["r"]): r for r in got}
    assert by["abc", "abc"]["n"] == by["abc", "abc"]["m"] == 1 and by["", ""]["n"] == 1 and by["", ""]["m"] == 0 and by["abc", ""]["n"] == 0
    assert abs(by["paul johnson", "johson paule"]["m"] - (0.8 + 6 / 7) / 2) < 1e-9
    assert by["a b", "a"]["m"] == 0.5 and by["a b", "a"]["w"] == 1 and by[None, "a"]["m"] is None


def test_aligned_features_of_typed_fields(spark):
    """A String field is compared with the affine gap; generated features have alignments on request."""
    rows = spark.createDataFrame([("ab cd", "ab"), (None, "x"), ("same", "same")], "n_l string, n_r string")
    feats = compare.typed_features({"n": "String"}) + [("n", "needleman_wunsch"), ("n", "smith_waterman"), ("n", "monge_elkan")]
    got = {r["n_l"]: r for r in compare.feature_table(rows, feats).collect()}
    assert (got["ab cd"]["f_n_affine_gap"], got["ab cd"]["f_n_needleman_wunsch"], got["ab cd"]["f_n_smith_waterman"], got["ab cd"]["f_n_monge_elkan"]) == (-2.0, -1.0, 2.0, 0.5)
    assert got["same"]["f_n_affine_gap"] == 0 and got["same"]["f_n_smith_waterman"] == 4 and got[None]["f_n_affine_gap"] is None
    few = spark.createDataFrame([("a b c",)], "n string")
    assert ("n", "smith_waterman") in compare.auto_features(few, few, ["n"], alignments=True) and ("n", "smith_waterman") not in compare.auto_features(few, few, ["n"])


# ---------------------------------------------------------------- neighbour graphs


def test_descent_finds_neighbours(spark):
    """Recall against all pairs, for clusters of vectors; a record that is near to all is no
    exception."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12))
    x = np.concatenate([centres[rng.integers(0, 30, 600)] + 0.4 * rng.normal(size=(600, 12)), centres.mean(axis=0)[None, :] * 9])
    odd = [(9001, None), (9002, []), (9003, [0.0] * 12), (9004, [float("nan")] * 12), (None, [1.0] * 12), (9005, [None] + [1.0] * 11)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + odd, "id long, embedding array<double>")
    got = defaultdict(list)
    for r in nn_descent.nearest_neighbours(df, 10).orderBy("left_id", "rank").collect():
        got[r["left_id"]].append((r["right_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :10]
    assert set(got) == set(range(601)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({o for o, _ in got[i]} & set(best[i].tolist())) / 10 for i in range(601)]) >= 0.9
    assert all(abs(score - s[i, o]) < 1e-9 for i in got for o, score in got[i])
    assert nn_descent.nearest_neighbours(df.limit(0), 10).count() == 0


# ---------------------------------------------------------------- whole flows


def test_learned_matcher_finds_most_masters(spark):
    """No rule is given; on another split most clients come together with their masters."""
    row = catalogue_learned.evaluate_learned_matcher(spark, "/root/testdata/sf0.01").first()
    assert row["precision"] > 0.8 and row["recall"] > 0.5 and 0.05 <= row["chosen_threshold"] <= 1


def test_embedding_flow_with_descent_equals_the_exact_one(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(5, 16)), 40, axis=0) + 0.05 * rng.normal(size=(200, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    found = [{r["node"]: r["cluster_id"] for r in pipelines.EmbeddingBlocking(10, 0.9, exact=e).clusters(df).collect()} for e in (True, False)]
    assert found[0] == found[1] == {i: i // 40 * 40 for i in range(200)} | {999: 999}


def test_package_is_shipped_to_workers(spark):
    """Every module is in the archive, and a worker can import from it."""
    import zipfile

    archive = shipping.ship(spark)
    assert {"matchwright/storage.py", "matchwright/operators/predicates.py"} <= set(zipfile.ZipFile(archive).namelist())

    def run(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([any(p.endswith("matchwright.zip") for p in sys.path)])], names=["found"])

    assert spark.range(1, numPartitions=1).mapInArrow(run, "found boolean").first()["found"]


# ---------------------------------------------------------------- training samples


@pytest.mark.parametrize("most", [5, 100_000])
@pytest.mark.parametrize("two", [False, True])
def test_weights_of_a_blocked_sample_undo_its_bias(spark, two, most):
    """Weighted counts of all pairs, and of those that agree in a column, near the true ones;
    most draws from blocks, though a block holds a third of the records; any number in parts."""
    rng = random.Random(12)
    rows = [(i, "hot" if i % 3 == 0 else f"w{rng.randrange(40)}", f"c{rng.randrange(6)}") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, name string, city string")
    kinds = [Predicate((("name", "whole"),)), Predicate((("name", "whole"), ("city", "whole")))]
    got = sampling.blocked_sample(df, df if two else None, kinds, 6000, 0.8, most=most).collect()
    by = {r[0]: r for r in rows}
    every = [(a, b) for a in by for b in by] if two else list(itertools.combinations(by, 2))
    assert all((r["left_id"], r["right_id"]) in set(every) for r in got[:50]) and len({(r["left_id"], r["right_id"]) for r in got}) == len(got)
    agree = lambda a, b: by[a][1] == by[b][1]
    inside = sum(r["draws"] for r in got if agree(r["left_id"], r["right_id"]))
    assert abs(sum(r["draws"] for r in got) - 6000) < 150 and inside >= 0.78 * 6000
    assert abs(sum(r["weight"] for r in got) / len(every) - 1) < 0.1
    assert abs(sum(r["weight"] for r in got if agree(r["left_id"], r["right_id"])) / sum(agree(*p) for p in every) - 1) < 0.1


def test_blocked_sample_without_blocks_or_records(spark):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(50)], "id long, name string")
    for kinds in ([], [Predicate((("name", "whole"),))]):
        got = sampling.blocked_sample(df, None, kinds, 500).collect()
        assert abs(sum(r["draws"] for r in got) - 500) < 20 and abs(sum(r["weight"] for r in got) - 1225) < 60
    assert sampling.blocked_sample(df.limit(0), None, [], 10).count() == 0
