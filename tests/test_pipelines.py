"""Whole pipelines on a small set of persons, streaming, and the catalogue."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchwright import catalogue
from matchwright.operators import classifiers, evaluate, fellegi_sunter
from matchwright.plans import pipelines
from matchwright.spec import BlockingRule, Comparison
from matchwright.streaming import incremental

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def linked(spark):
    """Two sources of persons with shared ids, and labelled splits."""
    rng = random.Random(9)
    first, last, town = ["anna", "boris", "clara", "david", "elena", "felix"], ["smith", "jones", "brown", "taylor", "wilson", "moore", "clark"], ["rome", "oslo", "lima", "cairo"]
    a, b = [], []
    for i in range(150):
        f, l, t = rng.choice(first), rng.choice(last) + str(i % 29), rng.choice(town)  # noqa: E741
        a.append((str(i), "a", f, l, t, f"19{i % 90 + 10}"))
        typo = f[:-1] if rng.random() < 0.3 else f
        b.append((str(149 - i), "b", typo, l, t if rng.random() < 0.8 else None, f"19{i % 90 + 10}"))
    schema = "id string, src string, first string, last string, town string, year string"
    true = [(str(i), str(149 - i), 1) for i in range(150)]
    false = [(str(i), str(149 - (i + d) % 150), 0) for i in range(150) for d in (1, 7, 31)]
    rows = true + false
    rng.shuffle(rows)
    labelled = spark.createDataFrame(rows, "left_id string, right_id string, label int")
    part = F.pmod(F.xxhash64("left_id"), F.lit(10))
    of = lambda lo, hi: labelled.where((part >= lo) & (part < hi))
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), of(0, 6), of(6, 8), of(8, 10)


def test_probabilistic(linked):
    a, b, train, valid, test = linked
    p = pipelines.Probabilistic([BlockingRule.of("last"), BlockingRule.of("year", "first")], [Comparison("first", "jaro_winkler", (0.95, 0.88)), Comparison("last"), Comparison("town"), Comparison("year")], 5000)
    row = p.run(a, b, train, valid, test).first()
    assert row["pairwise_f1"] > 0.9 and 0 <= row["chosen_threshold"] <= 1


@pytest.mark.parametrize("clusterer", ["unique_mapping", "components"])
@pytest.mark.parametrize("pruning", ["cnp", "cep"])
def test_meta_blocking(linked, clusterer, pruning):
    a, b, *_, test = linked
    p = pipelines.MetaBlocking(["first", "last", "year"], scheme="JS", pruning=pruning, clusterer=clusterer)
    scored = p.scored(a.unionByName(b), True)
    found = p.matches(scored, 0.6, True).withColumn("score", F.lit(1.0))
    from matchwright.operators.pairs import scores_for

    assert evaluate.pairwise(scores_for(test, found)).first()["f1"] > 0.7


def test_feature_classifier(linked):
    a, b, train, valid, test = linked
    p = pipelines.FeatureClassifier([("first", "jaro_winkler"), ("first", "string_cosine"), ("last", "exact"), ("year", "num_abs")], ["last"], classifiers.Config("logistic"))
    assert p.run(a, b, train, valid, test).first()["pairwise_f1"] > 0.9


def test_learned_linker(linked):
    a, b, train, *_ = linked
    p = pipelines.LearnedLinker([BlockingRule.of("last"), BlockingRule.of("town")], {"first": "FUZZY", "last": "EXACT", "town": "DONT_USE"})
    got = p.clusters(a, b, train)
    assert got.where("node LIKE 'A:%'").count() > 100 and got.where("score < 0.5").count() == 0


def test_streaming_matches_equal_batch(spark, linked, tmp_path):
    a, b, train, *_ = linked
    comps, rules = [Comparison("last"), Comparison("year")], [BlockingRule.of("last")]
    model = fellegi_sunter.estimate(a, b, train, comps, 2000)
    a.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.match_stream(stream, b, rules, model, 0.0, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    from matchwright.operators.blocking import link_only

    want = fellegi_sunter.predict(link_only(a, b, rules), a, b, model, 0.0)
    pick = lambda d: sorted((r["left_id"], r["right_id"]) for r in d.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(want)


def test_catalogue_agrees_with_sql(spark):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "clients"):
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet'")
    wrong = []
    for name, run in catalogue.QUERIES.items():
        got = run(spark, d).toPandas()
        if name in catalogue.ORACLE_SQL:
            want = con.sql(catalogue.ORACLE_SQL[name]).df()[list(got.columns)]
            plain = lambda v: None if v is None or v != v else v
            same = lambda x: sorted(repr([plain(v) for v in row]) for row in x.astype(object).itertuples(index=False, name=None))
            if same(got) != same(want):
                wrong.append(name)
    assert not wrong


def test_engine_stands_without_the_corpus_operators():
    code = "import sys; sys.modules['matchwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for path in (ROOT / "matchwright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_engine_stands_when_the_corpus_folders_are_deleted(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for path in (copy / "matchwright" / "llm", copy / "tests" / "llm"):
        shutil.rmtree(path)
    (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, check=True, timeout=120, stdout=subprocess.DEVNULL)


def test_a_missing_library_of_the_corpus_operators_is_an_error():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120, stderr=subprocess.DEVNULL).returncode != 0
