"""Every preset reads, blocks and compares; one runs through all matchers."""

import random

import pytest
from pyspark.sql import functions as F

from matchwright.operators import blocking, compare, fellegi_sunter, pairs
from matchwright.plans.presets import PRESETS


def raw_columns(spec):
    return [f.source or f.name for f in (spec.id, *spec.fields)]


@pytest.mark.parametrize("name", sorted(PRESETS))
def test_preset_runs_on_given_files(spark, tmp_path, name):
    p = PRESETS[name]()
    paths = []
    for side, spec in (("l", p.left), ("r", p.right)):
        if spec is None:
            continue
        cols = raw_columns(spec)
        rows = [[str(i + 1) + ".0" if "id" == c.lower() or c == "Entity Id" else ("2004-01-01" if "year" in c.lower() or "date" in c.lower() else "12" if c in ("price", "shipweight", "episodeNumber", "seasonNumber") else f"Word{i % 3} alpha{i}") for c in cols] for i in range(6)]
        path = tmp_path / f"{side}.csv"
        path.write_text("\n".join(spec.sep.join(r) for r in [cols, *rows]) + "\n")
        paths.append(str(path))
    left, right = p.read(spark, *paths)
    assert left.count() == 6 and left.columns[:2] == ["src", "id"]
    if p.right is not None and name != "amazon_google":
        assert right.where("src = 'b' AND id = '1'").count() == 1
    cand = blocking.rule_pairs(left, right, list(p.rules))
    assert cand.count() > 0
    other = left if right is None else right
    levels = compare.with_levels(pairs.lookup(cand.drop("match_key"), left, other), p.comparisons(0.9))
    shares = fellegi_sunter.level_shares(levels, p.comparisons(0.9))
    assert set(shares) == {*p.fuzzy, *p.exact}
    assert {c for c, _ in p.features} | set(p.tfidf) | set(p.blocks) | set(p.typed) | set(p.match_types) | set(p.joined) <= set(left.columns)
    assert p.texts(left).where(F.length("text") > 0).count() == 6


def test_one_preset_through_all_matchers(spark, tmp_path):
    rng = random.Random(3)
    words = "red blue small large turbo silent garden kitchen mini ultra".split()
    rows_l, rows_r = ["id|name|description|price"], ["id|name|description|price"]
    for i in range(60):
        brand, model = rng.choice(["Acme", "Bolt", "Cento"]), f"X{i * 7}"
        name = f"{brand} {rng.choice(words)} {rng.choice(words)} - {model}"
        rows_l.append(f"{i}|{name}|a {rng.choice(words)} thing|${i + 1}.50")
        rows_r.append(f"{i}|{name.replace(' - ', ' ').upper()}|{rng.choice(words)} thing|{i + 1}.50")
    for n, rows in (("l", rows_l), ("r", rows_r)):
        (tmp_path / n).write_text("\n".join(rows) + "\n")
    p = PRESETS["abt_buy"]()
    left, right = p.read(spark, str(tmp_path / "l"), str(tmp_path / "r"))
    split = [(str(i), str(j), int(i == j), i % 3) for i in range(60) for j in (i, (i + 1) % 60, (i + 11) % 60)]
    df = spark.createDataFrame(split, "left_id string, right_id string, label int, part int")
    train, valid, test = (df.where(F.col("part") == k).drop("part") for k in range(3))
    assert p.probabilistic(max_pairs=2000).run(left, right, train, valid, test).first()["pairwise_f1"] > 0.9
    assert p.feature_classifier().run(left, right, train, valid, test).first()["pairwise_f1"] > 0.9
    assert p.trained_matcher().run(left, right, train, valid, test).first()["pairwise_f1"] > 0.8
    assert p.learned_linker().clusters(left, right, train).count() > 60
    assert p.meta_blocking(scheme="JS").scored(left.unionByName(right), True).count() > 30
