"""Operators of entity resolution against brute force and in odd cases."""

import hashlib
import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from matchwright.operators import blocking, classifiers, clustering, compare, components, evaluate, fellegi_sunter, neighbours, pairs, ranking, search, set_join, splits, tfidf, token_blocking
from matchwright.spec import BlockingRule, Comparison


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- components and clusters


def brute_cc(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    got = {r["node"]: r["cluster_id"] for r in clustering.components_over(df(spark, [(i,) for i in range(270)], "node int"), df(spark, links, "left_id int, right_id int")).collect()}
    assert got == brute_cc(range(270), links)


def test_components_odd(spark):
    none = df(spark, [], "left string, right string")
    assert components.connected_components(none).count() == 0
    odd = df(spark, [("a", None), (None, None), ("b", "b"), ("d", "c"), ("c", "d"), ("d", "c")], "left string, right string")
    assert {tuple(r) for r in components.connected_components(odd).collect()} == {("c", "c"), ("d", "c")}


@pytest.mark.parametrize("seed", range(3))
def test_unique_mapping_is_greedy(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(15), rng.randrange(15)): rng.randrange(4) / 4 for _ in range(60)}.items())
    rows = [(a, b, s) for (a, b), s in edges]
    free_l, free_r, want = set(range(15)), set(range(15)), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s >= 0.25 and a in free_l and b in free_r:
            free_l.remove(a), free_r.remove(b), want.add((a, b))
    got = clustering.unique_mapping(df(spark, rows, "left_id int, right_id int, score double"), 0.25)
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == want
    assert clustering.unique_mapping(df(spark, [], "left_id int, right_id int, score double")).count() == 0


def test_average_linkage_and_thresholds(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.1), (4, 5, 0.7), (6, 7, 0.2)]
    scored = df(spark, rows, "left_id int, right_id int, score double")
    got = {r["node"]: r["cluster_id"] for r in clustering.average_linkage(scored, 0.6, df(spark, [(i,) for i in range(1, 8)], "node int")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    large = {r["node"]: r["cluster_id"] for r in clustering.average_linkage(scored, 0.6, max_component=2).collect()}
    assert large == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    strict = clustering.threshold_components(scored, 0.8, strict=True)
    assert {r["node"] for r in strict.collect()} == {1, 2}


def greedy_average_linkage(scores, threshold):
    clusters = [{n} for n in sorted({n for pair in scores for n in pair})]
    while True:
        found = []
        for x, y in itertools.combinations(clusters, 2):
            mean = sum(scores.get((min(a, b), max(a, b)), 0.0) for a in x for b in y) / (len(x) * len(y))
            low, high = sorted((min(x), min(y)))
            found.append((-mean, hashlib.md5(f"{low} {high}".encode()).hexdigest(), x, y))
        best = min(found, key=lambda f: f[:2], default=(0.0,))
        if len(best) == 1 or -best[0] < threshold:
            return {n: min(c) for c in clusters for n in c}
        clusters = [c for c in clusters if c is not best[2] and c is not best[3]] + [best[2] | best[3]]


def test_average_linkage_of_large_components(spark):
    """In rounds and in one task: the same clusters, equal averages included."""
    rng = random.Random(3)
    scores = {}
    while len(scores) < 80:
        a, b = sorted(rng.sample(range(40), 2))
        scores[a, b] = rng.choice([0.25, 0.5, 0.5, 0.75, 1.0])
    want = greedy_average_linkage(scores, 0.25)
    assert 3 < len(set(want.values())) < 30
    scored = df(spark, [(a, b, s) for (a, b), s in scores.items()], "left_id int, right_id int, score double")
    for local in (5000, 3):
        assert {r["node"]: r["cluster_id"] for r in clustering.average_linkage(scored, 0.25, local=local).collect()} == want


def test_average_linkage_has_no_bound_of_size(spark):
    n = 6000
    path = spark.range(n - 1).select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"), F.lit(0.75).alias("score"))
    sizes = clustering.average_linkage(path, 0.5).groupBy("cluster_id").count().collect()
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) == 2


def test_cluster_scores_and_pairs(spark):
    members = df(spark, [("5", "a", 1, 0.9), ("7", "b", 1, 0.5), ("5", "b", 2, 0.4)], "node string, src string, cluster_id int, score double")
    split = df(spark, [("5", "7"), ("7", "5"), ("5", "5")], "left_id string, right_id string")
    got = {(r["left_id"], r["right_id"]): r["score"] for r in clustering.cluster_pair_scores(split, members).collect()}
    assert got == {("5", "7"): 0.9, ("7", "5"): 0.0, ("5", "5"): 0.0}
    assert [(r["left_id"], r["right_id"]) for r in pairs.within_clusters(members, True).collect()] == [("5", "7")]
    assert clustering.linker_columns(df(spark, [(1, 2)], "id int, z_maxScore int")) == ("z_maxScore", "id")
    with pytest.raises(KeyError):
        clustering.linker_columns(df(spark, [(1,)], "x int"))


# ---------------------------------------------------------------- blocking


def people(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["ann", "bob", "cy", None, ""]), rng.choice(["rome", "oslo", None]), rng.randrange(4)) for i in range(60)]
    return rows, df(spark, rows, "id int, name string, city string, z int")


def test_rule_pairs_equal_brute_force(spark):
    rows, rec = people(spark)
    rules = [BlockingRule.of("name", "z"), BlockingRule.of("city", "substr(name, 1, 1)"), BlockingRule.of("city", "z")]
    keys = [lambda r: (r[1], r[3]), lambda r: (r[2], None if r[1] is None else r[1][:1]), lambda r: (r[2], r[3])]
    want = {}
    for a, b in itertools.combinations(rows, 2):
        for i, k in enumerate(keys):
            if None not in k(a) and k(a) == k(b):
                want.setdefault((a[0], b[0]), i)
    got = blocking.dedupe_only(rec, rules).collect()
    assert len(got) == len(want) and {(r["left_id"], r["right_id"]): r["match_key"] for r in got} == want
    sizes = {r["rule"]: r["comparisons"] for r in blocking.rule_sizes(rec, None, rules).collect()}
    assert sizes == {i: sum(1 for a, b in itertools.combinations(rows, 2) if None not in k(a) and k(a) == k(b)) for i, k in enumerate(keys)}


def test_null_never_blocks_and_empty_does(spark):
    rec = df(spark, [(1, None), (2, None), (3, ""), (4, "")], "id int, k string")
    assert [(r["left_id"], r["right_id"]) for r in blocking.dedupe_only(rec, [BlockingRule.of("k")]).collect()] == [(3, 4)]


def test_two_sources_with_equal_ids(spark):
    a, b = df(spark, [("5", "x"), ("7", "y")], "id string, k string"), df(spark, [("7", "x"), ("5", "y")], "id string, k string")
    assert {(r["left_id"], r["right_id"]) for r in blocking.link_only(a, b, [BlockingRule.of("k")]).collect()} == {("5", "7"), ("7", "5")}


def test_learned_rules_and_coverage(spark):
    rec = df(spark, [(i, i // 2, i % 2, 0) for i in range(40)], "id int, g int, h int, all int")
    labelled = df(spark, [(2 * i, 2 * i + 1, 1) for i in range(20)] + [(0, 5, 0)], "left_id int, right_id int, label int")
    rules = [BlockingRule.of("all"), BlockingRule.of("h"), BlockingRule.of("g")]
    assert blocking.learn_rules(rec, None, labelled, rules) == [rules[2]]
    cov = blocking.coverage(labelled, blocking.dedupe_only(rec, [rules[2]])).first()
    assert (cov["pairs"], cov["found"]) == (21, 20)


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.sample("abcdefghijkl", rng.randint(0, 9))) for i in range(70)]
    found, classes = set_join.jaccard_join(df(spark, rows, "id int, items array<string>"), "items", 0.7)
    rep = {r["id"]: r["rep"] for r in classes.collect()}
    sets = {i: set(x) for i, x in rows if x}
    assert rep == {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(set(rep.values())), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r["left_id"], r["right_id"]) for r in found.collect()} == want


def brute_graph(rows):
    blocks = {}
    for i, text in rows:
        for w in set(text.split()):
            blocks.setdefault(w, set()).add(i)
    return {w: m for w, m in blocks.items() if len(m) > 1}


def test_meta_blocking_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=4))) for i in range(14)]
    rec = df(spark, rows, "id int, text string")
    blocks = token_blocking.token_blocks(rec, ["text"])
    want = brute_graph(rows)
    assert {(r["block"], r["size"]) for r in token_blocking.block_sizes(blocks).collect()} == {(w, len(m)) for w, m in want.items()}
    graph = token_blocking.edges(blocks).collect()
    per = {i: sum(i in m for m in want.values()) for i, _ in rows}
    for r in graph:
        shared = [m for m in want.values() if r["left_id"] in m and r["right_id"] in m]
        assert (r["common"], r["bl"], r["br"], r["blocks"]) == (len(shared), per[r["left_id"]], per[r["right_id"]], len(want))
        assert abs(r["arcs"] - sum(2 / (len(m) * (len(m) - 1)) for m in shared)) < 1e-9
    assert len(graph) == len({(a, b) for m in want.values() for a, b in itertools.combinations(sorted(m), 2)})
    k, per_node = token_blocking.budget(blocks)
    total = sum(map(len, want.values()))
    assert (k, per_node) == (total // 2, max(1, total // len({i for m in want.values() for i in m}) - 1))
    with pytest.raises(NotImplementedError):
        token_blocking.weigh(token_blocking.edges(blocks), "CN-CBS")
    assert token_blocking.edges(token_blocking.token_blocks(rec.limit(0), ["text"])).count() == 0


def test_two_source_blocks_need_both(spark):
    rec = df(spark, [("a", 1, "x y"), ("a", 2, "x z"), ("b", 1, "y q")], "src string, id int, text string")
    blocks = token_blocking.token_blocks(rec, ["text"], two_sources=True)
    assert {r["block"] for r in blocks.collect()} == {"y"}
    e = token_blocking.weigh(token_blocking.edges(blocks, True), "JS")
    assert [(r["left_id"], r["right_id"], r["weight"]) for r in e.collect()] == [(1, 1, 1.0)]
    assert token_blocking.cardinality_node_pruning(e, 1, True).count() == 1


def test_filter_keeps_small_blocks_and_purge_drops_large(spark):
    rows = [(i, "all " + ("rare" if i < 2 else f"w{i // 3}")) for i in range(30)]
    blocks = token_blocking.token_blocks(df(spark, rows, "id int, text string"), ["text"])
    kept = token_blocking.filter_blocks(blocks, 0.5)
    assert "all" not in {r["block"] for r in kept.where("id < 2").collect()}
    purged = token_blocking.purge(blocks)
    assert "rare" in {r["block"] for r in purged.collect()} and purged.count() <= blocks.count()


def test_knn_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    v = df(spark, rows, "id int, embedding array<double>")
    got = {}
    for r in neighbours.knn(v, v, 3, buckets=3).orderBy("left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["right_id"])
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    assert got == {i: [j for _, j in sorted((-cos(a, b), j) for j, b in rows if j != i)[:3]] for i, a in rows}
    near = {(r["left_id"], r["right_id"]) for r in neighbours.lsh_pairs(v, None, 0.3, tables=20).collect()}
    assert near <= {(a, b) for a, b in itertools.combinations(range(40), 2)}
    e = neighbours.hashed_embedding(df(spark, [(1, "abcd"), (2, "abcd"), (3, "zzzz")], "id int, text string"), "text")
    assert len({tuple(r["embedding"]) for r in e.collect()}) == 2


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
def test_knn_of_copies_in_tiles_of_any_size(spark, monkeypatch, measure):
    """No pair is a row of a join; copies go by id; vectors without a direction, null ones and
    those with a null take no part."""
    for name, value in (("HELD", 9), ("ROWS", 4), ("PAIRS", 6)):
        monkeypatch.setattr(neighbours, name, value)
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = [(i, base[i % 12] if i < 60 else base[0]) for i in range(90)]
    v = df(spark, [*rows, (90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [1.0, 2.0])], "id int, embedding array<double>")
    found = neighbours.knn(v, v, 4, measure)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    near = {"cosine": lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))), "euclidean": lambda a, b: 1 / (1 + math.dist(a, b))}[measure]
    got = {}
    for r in found.orderBy("left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["right_id"])
    assert got == {i: [j for _, j in sorted((-round(near(a, b), 9), j) for j, b in rows if j != i)[:4]] for i, a in rows}


def test_group_links_are_no_more_than_records(spark):
    """One link for each further record of a group, where all pairs are the square of it."""
    rec = df(spark, [(i, "x" if i < 40 else "y", i % 2 if i != 7 else None) for i in range(60)], "id int, a string, b int")
    links = blocking.group_links(rec, ["a", "b"])
    assert links.count() == 55
    every = blocking.dedupe_only(rec, [BlockingRule.of("a", "b")])
    nodes = rec.select(F.col("id").alias("node"))
    of = lambda p: {r["node"]: r["cluster_id"] for r in clustering.components_over(nodes, p).collect()}
    assert of(links) == of(every)


def test_coverage_from_counts_equals_that_of_pairs(spark):
    rng = random.Random(12)
    rows = [(i, *[rng.choice(["u", "v", "w", None]) for _ in range(4)]) for i in range(120)]
    rec = df(spark, rows, "id int, a string, b string, c string, d string")
    split, rules = BlockingRule.of("a"), [BlockingRule.of("b", "c"), BlockingRule.of("c", "d"), BlockingRule.of("a", "substr(d, 1, 1)")]
    want = blocking.coverage(blocking.dedupe_only(rec, [split]).drop("match_key"), blocking.dedupe_only(rec, rules)).first()
    found = blocking.rule_coverage(rec, split, rules)
    assert found.first() == want and 0 < want["found"] < want["pairs"]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert blocking.rule_coverage(rec.limit(0), split, rules).first()["coverage"] == 0


def test_metrics_of_groups_equal_those_of_pairs(spark):
    rng = random.Random(13)
    rec = df(spark, [(i, *[rng.choice(["u", "v", "w"]) for _ in range(3)]) for i in range(120)], "id int, a string, b string, c string")
    labels = rec.select("id", "c")
    split = pairs.lookup(blocking.dedupe_only(rec, [BlockingRule.of("a")]).drop("match_key"), labels, labels)
    labelled = split.select("left_id", "right_id", (F.col("c_l") == F.col("c_r")).cast("int").alias("label"))
    want = evaluate.cluster_metrics(labelled, rec.select(F.col("id").alias("node"), F.col("b").alias("cluster_id"))).first()
    found = evaluate.group_metrics(rec, ["a"], ["b"], ["c"])
    assert found.first() == want and min(want["tp"], want["fp"], want["fn"]) > 0
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- comparing and scoring


def test_tfidf_by_hand(spark):
    texts = [(1, "red red bolt"), (2, "red nut"), (3, "")]
    t = df(spark, texts, "id int, text string")
    idf = tfidf.fit_idf(t, tfidf.word_ngrams)
    got = {r["term"]: r["idf"] for r in idf.collect()}
    assert abs(got["red"] - (math.log(4 / 3) + 1)) < 1e-12 and abs(got["red bolt"] - (math.log(4 / 2) + 1)) < 1e-12
    v = tfidf.vectors(t, tfidf.word_ngrams, idf)
    sims = {(r["left_id"], r["right_id"]): r["cosine"] for r in tfidf.pair_cosine(df(spark, [(1, 2), (1, 3), (1, 1)], "left_id int, right_id int"), v, v).collect()}
    assert abs(sims[1, 1] - 1) < 1e-12 and sims[1, 3] == 0 and 0 < sims[1, 2] < 1
    grams = t.where("id = 2").select(tfidf.char_ngrams(F.col("text"), 3, 4).alias("g")).first()["g"]
    assert sorted(grams) == sorted([" re", "red", "ed ", " red", "red ", " nu", "nut", "ut ", " nut", "nut "])


def test_fellegi_sunter_by_hand(spark):
    a = df(spark, [(1, "ann", "rome"), (2, "bob", None), (3, "cy", "oslo")], "id int, name string, city string")
    b = df(spark, [(1, "ann", "rome"), (2, "bob", "oslo"), (3, "dee", "oslo")], "id int, name string, city string")
    comps = [Comparison("name"), Comparison("city")]
    m = fellegi_sunter.Model(comps, {"name": {0: 0.1, 1: 0.9}, "city": {0: 0.2, 1: 0.8}}, {"name": {0: 0.9, 1: 0.1}, "city": {0: 0.5, 1: 0.5}}, 0.1)
    cand = df(spark, [(1, 1), (2, 2), (3, 3)], "left_id int, right_id int")
    got = {r["left_id"]: (r["match_weight"], r["score"]) for r in fellegi_sunter.predict(cand, a, b, m).collect()}
    prior = math.log2(0.1 / 0.9)
    want = {1: prior + math.log2(9) + math.log2(1.6), 2: prior + math.log2(9), 3: prior + math.log2(1 / 9) + math.log2(1.6)}
    for i, w in want.items():
        assert abs(got[i][0] - w) < 1e-9 and abs(got[i][1] - 2**w / (1 + 2**w)) < 1e-9
    assert fellegi_sunter.predict(cand, a, b, m, 0.5).count() == 2
    assert fellegi_sunter.Model.from_dict(m.as_dict()) == m
    trained = fellegi_sunter.estimate(a, b, df(spark, [(1, 1, 1), (2, 2, 1), (3, 3, 0)], "left_id int, right_id int, label int"), comps, 100)
    assert trained.m["name"][1] == 1.0 and abs(trained.prior - 2 / 9) < 1e-12


def test_features_and_classifiers(spark):
    rng = random.Random(5)
    left = [(i, f"name {i % 50} {'x' * (i % 3)}", float(i % 50) if i % 7 else None) for i in range(120)]
    a, b = df(spark, left, "id int, title string, price double"), df(spark, left, "id int, title string, price double")
    feats = compare.auto_features(a, b, ["title", "price"])
    assert ("price", "num_abs") in feats and any(c == "title" for c, _ in feats)
    rows = [(rng.randrange(120), rng.randrange(120)) for _ in range(300)] + [(i, (i + 50) % 120) for i in range(60)]
    labelled = df(spark, [(x, y, int(x % 50 == y % 50)) for x, y in set(rows)], "left_id int, right_id int, label int")
    table = compare.feature_table(pairs.lookup(labelled, a, b), feats).cache()
    names = [f"f_{c}_{k}" for c, k in feats]
    for kind in ("logistic", "forest", "boosting", "tree", "bayes", "svm", "rbf"):
        cfg = classifiers.Config(kind, trees=10, iterations=10, balanced=kind == "logistic", impute="zero" if kind == "tree" else "mean")
        scored = classifiers.score(table, classifiers.train(table.select("label", *names), names, cfg))
        f1 = evaluate.best_threshold(evaluate.sweep(scored)).first()["f1"]
        assert f1 > 0.8, kind
    assert compare.typed_features({"t": "Text", "p": "Price"}, ("p",)) == [("t", "cosine_words"), ("p", "price"), ("p", "known")]
    assert compare.match_type_features({"a": "EXACT", "b": "DONT_USE"}) == [("a", "exact")]
    made = classifiers.score_texts(df(spark, [("a", "a"), ("a", None)], "text_l string, text_r string"), lambda x, y: [float(u == v) for u, v in zip(x, y)])
    assert [r["score"] for r in made.collect()] == [1.0, 0.0]


# ---------------------------------------------------------------- evaluation


def test_sweep_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), s) for s in [i * 0.01 for i in range(101)] + [rng.random() for _ in range(200)] + [0.0] * 5]
    got = evaluate.sweep(df(spark, rows, "label int, score double")).orderBy("i").collect()
    best = (-1.0, None)
    for r in got:
        t = r["i"] * 0.01
        tp = sum(1 for y, s in rows if y and s >= t)
        fp = sum(1 for y, s in rows if not y and s >= t)
        fn = sum(1 for y, s in rows if y and s < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        assert abs(r["f1"] - f1) < 1e-12 and abs(r["recall"] - tp / (tp + fn)) < 1e-12
        if f1 > best[0]:
            best = (f1, r["i"])
    assert evaluate.best_threshold(evaluate.sweep(df(spark, rows, "label int, score double"))).first()["i"] == best[1]
    assert evaluate.pr_curve(evaluate.sweep(df(spark, [], "label int, score double"))).count() == 101
    assert evaluate.sweep(df(spark, rows, "label int, score double"), 1, 20, 0.05).count() == 20


def test_bcubed_equals_the_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(5), rng.randrange(4)) for i in range(60)]
    p = r = 0.0
    for _, c, g in rows:
        same_c, same_g = [x for x in rows if x[1] == c], [x for x in rows if x[2] == g]
        both = sum(1 for x in same_c if x[2] == g)
        p, r = p + both / len(same_c), r + both / len(same_g)
    got = evaluate.bcubed(df(spark, rows, "id int, pred int, gt int")).first()
    assert abs(got["precision"] - p / 60) < 1e-12 and abs(got["recall"] - r / 60) < 1e-12
    assert evaluate.bcubed(df(spark, [], "id int, pred int, gt int")).first()["f1"] == 0.0


def test_split_metrics_keep_sources_apart(spark):
    rows = [("5", "7", 1, 0.9), ("7", "5", 0, 0.1)]
    got = evaluate.test_metrics(df(spark, rows, "left_id string, right_id string, label int, score double"), 0.5).first()
    assert got["n_entities"] == 4 and got["pairwise_f1"] == 1.0 and got["bcubed_f1"] == 1.0 and got["n_pred_pairs"] == 1


def test_selection_is_on_validation(spark):
    rows = df(spark, [(1, "OK", 0.5), (2, "OK", 0.7), (3, "OK", 0.7), (4, "ERROR", 0.9)], "config_id int, status string, valid_f1 double")
    assert evaluate.best_config(rows).first()["config_id"] == 2
    with pytest.raises(ValueError):
        evaluate.best_config(rows, "test_f1")


def test_swapped_sides_are_noticed(spark):
    left, right = df(spark, [(i,) for i in range(5)], "id int"), df(spark, [(i,) for i in range(100)], "id int")
    split = df(spark, [(i, i + 50, 1) for i in range(5)], "left_id int, right_id int, label int")
    assert pairs.referential(split, left, right)[1]["dropped"] == 0
    with pytest.raises(pairs.ReferentialError):
        pairs.referential(split, right, left)


def test_samples_and_lookups(spark):
    rows = df(spark, [(i, -i, int(i % 5 == 0)) for i in range(100)], "left_id int, right_id int, label int")
    got = pairs.downsample(rows, 2.0)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {1: 20, 0: 40}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.downsample(rows.repartition(7), 2.0).collect()))
    assert pairs.capped_training(rows, 5, 7).count() == 12
    scored = df(spark, [(2, 1, 0.5), (1, 2, 0.7)], "left_id int, right_id int, score double")
    ask = df(spark, [(1, 2), (2, 1), (3, 4)], "left_id int, right_id int")
    assert {(r["left_id"], r["right_id"]): r["score"] for r in pairs.scores_for(ask, scored).collect()} == {(1, 2): 0.7, (2, 1): 0.5, (3, 4): 0.0}
    assert {(r["left_id"], r["right_id"]): r["score"] for r in pairs.scores_for(ask, scored, symmetric=True).collect()} == {(1, 2): 0.7, (2, 1): 0.7, (3, 4): 0.0}
    assert pairs.without_id_features(df(spark, [(1, 2)], "id_x int, y int")).columns == ["y"]


@pytest.mark.parametrize("n", [0, 1, 7, 25, 60, 100, 300])
def test_top_n_by_bins_equals_sorting(spark, n):
    from matchwright.operators.topn import sample_exact, top_n

    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.5, rng.random(), 1e9])) for i in range(120)]
    data = df(spark, rows, "id int, v double")
    want = [i for i, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))][:n]
    assert sorted(r["id"] for r in top_n(data, n, "v", "id", small=5).collect()) == sorted(want)
    got = {r["id"] for r in sample_exact(data, n, "id", small=5).collect()}
    assert got == {r["id"] for r in sample_exact(data.repartition(5), n, "id").collect()} and len(got) == min(n, 120)


# ---------------------------------------------------------------- splits, search, ranking


def test_splits_share_no_record(spark):
    rec = df(spark, [(i, i // 6) for i in range(120)], "id int, post int")
    pos = df(spark, [(3 * i, 3 * i + 1) for i in range(40)], "left_id int, right_id int")
    nodes = splits.component_splits(rec.select(F.col("id").alias("node")), pos)
    got = {r["node"]: r["split"] for r in nodes.collect()}
    assert len(got) == 120 and all(got[3 * i] == got[3 * i + 1] for i in range(40))
    share = {s: sum(v == s for v in got.values()) / 120 for s in ("train", "valid", "test")}
    assert abs(share["train"] - 0.7) < 0.05 and abs(share["valid"] - 0.15) < 0.05
    inside = splits.pairs_in_split(pos, nodes)
    assert inside.count() == 40
    made = splits.labelled_split(rec, pos, "post")
    rows = made.collect()
    neg = {(r["left_id"], r["right_id"]) for r in rows if r["label"] == 0}
    assert len(rows) == 160 and len(neg) == 120 and not neg & {(3 * i, 3 * i + 1) for i in range(40)} and all(a < b for a, b in neg)
    assert sum(a // 6 == b // 6 for a, b in neg) >= 36
    tiny = df(spark, [(1, 0), (2, 0), (3, 0)], "id int, post int")
    assert splits.labelled_split(tiny, df(spark, [(1, 2)], "left_id int, right_id int"), "post").where("label = 0").count() == 2


def test_search_outcomes(spark):
    space = {"c": search.LogUniform(0.1, 10), "n": search.LogUniform(1, 100, True), "k": search.Choice(("a", "b")), "d": search.Integer(1, 3), "u": search.Uniform(0, 1), "only_a": search.When("k", ("a",), search.Integer(5, 5))}
    configs = search.sample_configs(space, 6, 1)
    assert configs == search.sample_configs(space, 6, 1)
    assert all((c["only_a"] == 5) == (c["k"] == "a") for c in configs)
    seen = []

    def work(c):
        if c["config_id"] == 2:
            raise RuntimeError("java.lang.OutOfMemoryError: Java heap space")
        if c["config_id"] == 3:
            spark.range(3).select(F.expr("raise_error('no')")).collect()
        if c["config_id"] == 4:
            from pyspark.sql import types as T

            @F.udf(T.LongType())
            def slow(x):
                time.sleep(30)
                return x

            spark.range(1).select(slow("id")).collect()
        return {"valid_f1": 1.0}

    rows = search.search(spark, configs[:4], work, timeout_s=4.0, after_each=lambda r: seen.append(len(r)))
    assert [r["status"] for r in rows] == ["OK", "OOM", "ERROR", "TIMEOUT"] and seen == [1, 2, 3, 4]
    steps = search.ladder(spark, [10, 20], lambda n: spark.range(n) if n < 20 else None, lambda d: {"rows": d.count()})
    assert [(r["size"], r["status"]) for r in steps] == [(10, "OK"), (20, "SKIPPED")] and steps[0]["rows"] == 10


def test_ranking(spark):
    rows = [(s, d, v) for d, vs in {"x": (0.9, 0.8, 0.8), "y": (0.7, 0.9, 0.1), "z": (0.5, 0.4, 0.3)}.items() for s, v in zip("abc", vs)]
    r = df(spark, rows, "framework string, dataset string, f1 double")
    ranks = {(x["dataset"], x["framework"]): x["avg_rank"] for x in ranking.average_ranks(r, "f1").collect()}
    assert ranks["x", "b"] == ranks["x", "c"] == 2.5 and ranks["y", "b"] == 1.0
    f = ranking.friedman(r, "f1")
    sums = [1 + 2 + 1, 2.5 + 1 + 2, 2.5 + 3 + 3]
    base = 12 / (3 * 3 * 4) * sum(s * s for s in sums) - 3 * 3 * 4
    assert abs(f["chi2"] - base / (1 - 6 / (3 * 3 * 8))) < 1e-9 and 0 < f["p"] < 1
    assert abs(ranking.critical_difference(7, 8) - 3.185) < 5e-4
    assert ranking.cliques({"a": 1.0, "b": 1.5, "c": 3.0, "d": 3.2}, 1.0) == [["a", "b"], ["c", "d"]]
    pts = df(spark, [("a", 1.0, 0.5), ("b", 2.0, 0.5), ("c", 2.0, 0.9), ("d", 3.0, 0.9), ("e", 1.0, 0.5)], "framework string, cost double, f1 double")
    assert {x["framework"] for x in ranking.pareto_front(pts, "cost", "f1").collect()} == {"a", "c", "e"}


def brute_average_linkage(edges, threshold):
    """Clusters by merging the pair with the largest average until none reaches the threshold."""
    import hashlib

    score = {frozenset(e[:2]): e[2] for e in edges}
    clusters = [{n} for n in sorted({n for e in edges for n in e[:2]})]
    while True:
        best = None
        for i, x in enumerate(clusters):
            for y in clusters[i + 1 :]:
                mean = sum(score.get(frozenset((a, b)), 0.0) for a in x for b in y) / (len(x) * len(y))
                a, b = sorted((min(x), min(y)))
                rank = (-mean, hashlib.md5(f"{a} {b}".encode()).hexdigest())
                if mean >= threshold and (best is None or rank < best[0]):
                    best = rank, x, y
        if best is None:
            return {n: min(c) for c in clusters for n in c}
        clusters = [c for c in clusters if c not in best[1:]] + [best[1] | best[2]]


@pytest.mark.parametrize("local", [5000, 3])
def test_average_linkage_counts_scores_below_the_threshold(spark, local):
    rng = random.Random(3)
    edges = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.5)]
    edges += [(a, b, round(rng.random(), 3)) for a in range(10, 24) for b in range(a + 1, 24) if rng.random() < 0.7]
    scored = spark.createDataFrame(edges, "left_id long, right_id long, score double")
    got = {r["node"]: r["cluster_id"] for r in clustering.average_linkage(scored, 0.6, local=local).collect()}
    want = brute_average_linkage(edges, 0.6)
    assert got[3] == 1 and all(got.get(n, n) == c for n, c in want.items())


def test_cliques_hold_systems_exactly_the_difference_apart():
    assert ranking.cliques({"a": 1.0, "b": 2.0, "c": 3.5}, 1.0) == [["a", "b"]]
    assert ranking.cliques({"a": 1.0, "b": 1.5, "c": 2.0}, 1.0) == [["a", "b", "c"]]


def test_negatives_are_found_as_long_as_there_are_any(spark):
    rec = spark.createDataFrame([(i, "x" if i < 30 else "y") for i in range(40)], "id long, key string")
    pos = spark.createDataFrame([(0, 1), (30, 31)], "left_id long, right_id long")
    hard = splits.hard_negatives(rec, "key", pos, 400).collect()
    assert len({tuple(r) for r in hard}) == 400
    assert splits.hard_negatives(rec, "key", pos, 10**6).count() == 30 * 29 // 2 + 45 - 2
    rand = splits.random_negatives(rec, pos, 10**6).collect()
    assert len({tuple(r) for r in rand}) == len(rand) == 40 * 39 // 2 - 2
    assert splits.random_negatives(rec, pos, 300).count() == 300


def test_blocks_larger_than_a_part_give_the_same_graph(spark):
    rec = spark.createDataFrame([(i, f"common t{i % 7} u{i % 3}") for i in range(60)], "id long, text string")
    blocks = token_blocking.token_blocks(rec, ["text"])
    a, b = (sorted(map(tuple, token_blocking.edges(blocks, most=m).select("left_id", "right_id", "common", "bl", "br", F.round("arcs", 9), F.round("sizes", 9)).collect())) for m in (2000, 7))
    assert a == b and len(a) == 60 * 59 // 2
