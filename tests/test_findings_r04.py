"""Findings of the fourth round: what would have failed before."""

from __future__ import annotations

import math
import random

import pytest

from matchwright.operators import neighbours


def test_wide_buckets_make_no_row_for_each_shared_one(spark, monkeypatch):
    """nearly all pairs share a bucket, and each was a row for each table before it was measured."""
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None), (62, [1.0, None] + [0.0] * 4)]
    rows += [(63, rows[3][1]), (3, rows[3][1])]
    data = spark.createDataFrame(rows, "id long, embedding array<double>")
    near = lambda out: {(r["left_id"], r["right_id"]): r["distance"] for r in out.collect()}
    monkeypatch.setattr(neighbours, "SPARSE", 1e9)  # the buckets' tiles
    a, b = data.where("id % 2 = 0"), data.where("id % 3 = 0")
    got = near(neighbours.lsh_pairs(data, None, 0.9, bucket=0.4, tables=2)), near(neighbours.lsh_pairs(a, b, 0.9, bucket=0.4, tables=2))
    monkeypatch.setattr(neighbours, "SPARSE", -1)  # Spark's join
    want = near(neighbours.lsh_pairs(data, None, 0.9, bucket=0.4, tables=2)), near(neighbours.lsh_pairs(a, b, 0.9, bucket=0.4, tables=2))
    monkeypatch.undo()
    for found, other in zip(got, want):
        assert len(found) > 20 and found == pytest.approx(other, abs=1e-12)

    def refuse(*_):
        raise AssertionError("buckets were joined")

    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", refuse)
    assert neighbours.lsh_pairs(data, None, 0.9, bucket=5.0).count() >= len(got[0])


def test_similar_pairs_make_no_table_of_candidates(spark, monkeypatch):
    """every pair that shared a posted term was a row, and carried both records' terms."""
    from pyspark.sql import functions as F

    from matchwright.operators import canopies

    for name, small in (("HELD", 60), ("CELLS", 70), ("SLICE", 50), ("WIDTH", 3), ("COMMON", 0.2)):
        monkeypatch.setattr(canopies, name, small)
    monkeypatch.setattr(canopies, "key_pairs", lambda *_, **__: pytest.fail("candidates were joined"))
    rng = random.Random(7)
    raw = {i: {f"t{int(rng.random() ** 2 * 30)}": rng.random() + 0.1 for _ in range(8)} for i in range(50)}
    raw |= {50: raw[3], 51: raw[3], 52: {"only": 1.0}}
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in raw.items()}
    rows = [(i, t, w) for i, v in unit.items() for t, w in v.items()] + [(None, "t1", 1.0)]
    out = canopies.similar_pairs(spark.createDataFrame(rows, "id long, term string, w double"), 0.5)
    dots = {(a, b): math.fsum(w * unit[b].get(t, 0.0) for t, w in unit[a].items()) for a in unit for b in unit if a < b}
    want = {k: x for k, x in dots.items() if x >= 0.5}
    got = out.collect()
    assert len(got) == len(want) > 20 and {(r["left_id"], r["right_id"]): r["cosine"] for r in got} == pytest.approx(want, abs=1e-12)
    assert out.where(F.col("left_id") >= F.col("right_id")).count() == 0


def test_kernel_machine_closes_its_gap_over_many_blocks(spark):
    """F16: blocks took steps one row at a time, and with several of them the gap stayed open; equal rows were all kept."""
    from pyspark.sql import functions as F

    from matchwright.operators import kernel_machine
    from matchwright.operators.kernel_machine import Settings
    from tests.test_kernel_machine import brute, rings

    rows = rings(60)
    one = spark.createDataFrame([(x, label, 3) for x, label in rows], "features array<double>, label int, n int")
    s = Settings(gamma=0.5, landmarks=100, block=4, tolerance=1e-3)
    counted = kernel_machine.fit(one, weight="n", s=s, each="n")
    assert 0 <= counted.gap <= 1e-3
    shown = lambda m: [r["m"] for r in one.select(m.margin(one.features).alias("m")).collect()]
    want = brute(rows, 0.5, 3.0)
    assert max(abs(a - b) for a, b in zip(shown(counted), want)) < math.sqrt(4 * counted.gap * counted.value)
    every = kernel_machine.fit(one.select("features", "label", F.explode(F.array_repeat(F.lit(1), 3)).alias("n")), s=s)
    assert shown(every) == pytest.approx(shown(counted), abs=1e-6)
    assert (every.slope, every.offset) == pytest.approx((counted.slope, counted.offset), abs=1e-3)


def test_heaviest_pairs_look_at_records_with_enough_blocks_only(spark, monkeypatch):
    """all pairs that share a block were counted."""
    from matchwright.operators import neighbourhoods

    rng = random.Random(11)
    members = {i: rng.sample(range(40), 25 if i % 10 == 0 else rng.randint(1, 6)) for i in range(120)}
    members |= {120: members[0], 121: members[10]}
    blocks = spark.createDataFrame([(f"b{b}", "a", i) for i, own in members.items() for b in own], "block string, src string, id long")
    want = sorted((-len(set(members[a]) & set(members[b])), a, b) for a in members for b in members if a < b)
    monkeypatch.setattr(neighbourhoods, "LARGEST", 8)
    seen, plain = [], neighbourhoods._heaviest_pairs
    monkeypatch.setattr(neighbourhoods, "_heaviest_pairs", lambda index, *a: seen.append(index.records.count()) or plain(index, *a))
    for k in (1, 20, 500):  # for the last, the largest records have too few pairs
        got = [(r["left_id"], r["right_id"], r["weight"]) for r in neighbourhoods.edge_pruning(blocks, k, "CBS").orderBy("weight", "left_id", "right_id").collect()]
        assert sorted(got) == sorted((a, b, -float(c)) for c, a, b in want[:k])
    assert seen[:4:2] == [8, 8] and all(n < 20 for n in seen[1:4:2]) and max(seen) == 122
