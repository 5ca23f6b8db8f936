"""Measures of pairs are taken once for each pair of values."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from matchwright.operators import blocking, fellegi_sunter, value_pairs
from matchwright.plans import pipelines
from matchwright.spec import BlockingRule, Comparison

RULES = [BlockingRule.of("g"), BlockingRule.of("x", "k")]


def records(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}", None if i % 11 == 0 else f"x{i % 5}", i % 2, None if i % 13 == 0 else f"name {i % 4}") for i in range(120)]
    return spark.createDataFrame(rows, "id long, g string, x string, k int, name string")


def test_value_pairs_expand_to_the_pairs_of_the_rules(spark, monkeypatch):
    """with null keys, null values and classes of several lots."""
    monkeypatch.setattr(value_pairs, "LOT", 3)
    rec = records(spark)
    want = sorted(tuple(r) for r in blocking.dedupe_only(rec, RULES).collect())
    got = value_pairs.value_pairs(rec, RULES, ["name"])
    shown = got.expand(got.rows).select("left_id", "right_id", "match_key", "name_l", "name_r").collect()
    assert sorted(tuple(r[:3]) for r in shown) == want
    names = {r["id"]: r["name"] for r in rec.collect()}
    assert all((r["name_l"], r["name_r"]) == (names[r["left_id"]], names[r["right_id"]]) for r in shown)
    counted = {r["match_key"]: r["n"] for r in got.counted(got.rows).groupBy("match_key").agg(F.sum("pairs").alias("n")).collect()}
    assert counted == {k: len(list(v)) for k, v in itertools.groupby(sorted(r[2] for r in want))}


def test_scores_are_taken_of_values_not_of_pairs(spark, monkeypatch):
    """300 copies of two records made 90,000 pairs that were scored one by one."""
    rows = spark.range(600).select("id", F.concat(F.lit("name "), F.col("id") % 2).alias("name"), F.lit("g").alias("g"))
    seen = []
    real = fellegi_sunter.with_levels
    monkeypatch.setattr(fellegi_sunter, "with_levels", lambda df, c: (seen.append(df.count()), real(df, c))[1])
    model = fellegi_sunter.Model([Comparison("name")], {"name": {0: 0.1, 1: 0.9}}, {"name": {0: 0.9, 1: 0.1}}, 0.5)
    found = fellegi_sunter.predict_values(value_pairs.value_pairs(rows, [BlockingRule.of("g")], ["name"]), model, 0.5)
    assert found.count() == 2 * 300 * 299 // 2 and seen == [4]


def test_a_model_of_counted_values_is_that_of_the_pairs(spark):
    """the labelled matches of a name were all looked up."""
    rec, comparisons = records(spark), [Comparison("name"), Comparison("x")]
    labelled = blocking.dedupe_only(rec, RULES).withColumn("label", F.lit(1))
    want = fellegi_sunter.estimate(rec, None, labelled, comparisons, 500)
    assert fellegi_sunter.estimate_values(rec, value_pairs.value_pairs(rec, RULES, ["name", "x"]), comparisons, 500) == want


def test_an_evaluation_of_counted_values_is_that_of_the_pairs(spark, monkeypatch):
    """every labelled pair was a row, three times over."""
    monkeypatch.setattr(value_pairs, "LOT", 3)
    rec = records(spark)
    plan = pipelines.Probabilistic(RULES, [Comparison("name"), Comparison("x")], 500)
    match = lambda a, b: (F.col(a) == F.col(b)).cast("int")
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    sides = [rec.select(F.col("id").alias(f"{s}_id"), F.col("x").alias(f"x_{s}"), part.alias(f"p_{s}")) for s in ("left", "right")]
    labelled = blocking.dedupe_only(rec, RULES).join(sides[0], "left_id").join(sides[1], "right_id").withColumn("label", match("x_left", "x_right"))
    splits = [labelled.where(F.col("p_left") == i).select("left_id", "right_id", "label") for i in range(3)]
    want = plan.run(rec, None, *splits).first().asDict()
    assert plan.run_values(rec, match("x_l", "x_r"), part).first().asDict() == pytest.approx(want, abs=1e-12)
