"""Normalising, similarities and statistics on single values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchwright.functions import chi2
from matchwright.functions import normalize as N
from matchwright.functions import similarity as S


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values)))
    return row.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "args", "want"),
    [
        (N.clean_text, ("  Café  ÉLAN\n",), "cafe elan"),
        (N.clean_text, ("   ",), None),
        (N.clean_text, ("Straße Łódź Ørsted",), "strasse lodz orsted"),
        (N.clean_text_nan, ("NaN",), None),
        (N.lower_or_empty, (None,), ""),
        (N.lower_or_empty, ("\t Ab ",), "ab"),
        (N.strip_symbols, ("Ab-cd (x) [y] e!f",), "ab cd ef"),
        (N.parse_price, ("$1,234.50",), 1234.5),
        (N.parse_price, ("0",), None),
        (N.parse_price, ("free",), None),
        (N.parse_weight, ("2.5 lbs",), 2.5),
        (N.to_number, ("nan",), None),
        (N.number_text, ("12.0",), "12"),
        (N.norm_id, (" 12.0 ",), "12"),
        (N.norm_id, ("a12",), "a12"),
        (N.keep_alphanumeric, ("XB-10/a",), "xb10a"),
        (N.first_word, ("  Sony Bravia",), "Sony"),
        (N.first_word, ("",), None),
        (N.model_token, ("Sony Bravia TV - KDL-40/B",), "kdl40b"),
        (N.model_token, ("Sony KDL40 black",), "kdl40"),
        (N.model_token, ("no digits",), ""),
        (N.vendor_token, ("Inc. Adobe Systems",), "adobe"),
        (N.vendor_token, (None,), ""),
        (N.version_token, ("Office v. 2.1 pro",), "v2.1"),
        (N.version_token, ("Office 2003",), "2003"),
        (N.version_token, ("plain",), ""),
        (N.first_author_surname, ("J. Smith, A. Doe",), "smith"),
        (N.leading_year, ("1999-05-01",), "1999"),
        (N.embedded_year, ("in 2003 and 2004",), "2003"),
        (N.embedded_year, ("12003",), None),
        (N.episode_key, ("1.0", "2"), "s1e2"),
        (N.episode_key, ("1", None), None),
        (N.date_year, ("2001-02-03",), 2001),
        (N.date_year, ("soon",), None),
        (N.joined_text, ("a", None), "a"),
        (N.first_filled, ("", "b"), "b"),
    ],
)
def test_normalising(spark, f, args, want):
    assert one(spark, f, *args) == want


def test_profile_cleaning(spark):
    got = one(spark, lambda c: N.profile_clean(c, ("the",), punctuation=True, numbers=True, unicode=True), "The 3 cafés, 日本")
    assert got == "cafes"


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.961111), ("abcdxxxx", "abcdyyyy", 0.666667), ("", "", 0.0), ("a", "a", 1.0), ("abc", "", 0.0), ("blue plate", "small plate", 0.731169)])
def test_jaro_winkler_values(a, b, want):
    assert abs(S.jaro_winkler_text(a, b) - want) < 1e-6


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_jaro_winkler_agrees_with_duckdb_and_its_bound(a, b):
    import duckdb

    got = S.jaro_winkler_text(a, b)
    assert abs(got - duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]) < 1e-9
    short, long = min(len(a), len(b)), max(len(a), len(b))
    j = (1 + short / long + 1) / 3 if long else 0
    assert got <= (0 if short == 0 else j if j <= 0.7 else j + 0.4 * (1 - j)) + 1e-9


def test_jaro_winkler_on_distinct_pairs(spark):
    rows = [("a", "a"), ("", ""), (None, "a"), ("martha", "marhta"), ("martha", "marhta"), ("ab", "abcdefghijkl")]
    got = S.with_jaro_winkler(spark.createDataFrame(rows, "l string, r string"), "l", "r", "s", 0.9).collect()
    assert sorted((str(r["l"]), None if r["s"] is None else round(r["s"], 4)) for r in got) == [("", 0.0), ("None", None), ("a", 1.0), ("ab", 0.0), ("martha", 0.9611), ("martha", 0.9611)]


def test_thresholds_and_other_measures(spark):
    assert S.jaro_winkler_thresholds(0.95) == [0.95, 0.88, 0.8]
    assert S.jaro_winkler_thresholds(1.0) == [0.98, 0.93, 0.85]
    assert S.jaro_winkler_thresholds(0.1) == [0.1, 0.03]
    assert one(spark, S.levenshtein_similarity, "", "") == 1.0
    assert one(spark, lambda a, b: S.within_edits(a, b, 1), "abc", "axy") is False
    assert abs(one(spark, S.string_cosine, "night", "nacht") - 0.25) < 1e-9
    assert one(spark, S.string_cosine, "", "a") == 0.0
    assert one(spark, S.string_cosine, None, "a") is None
    assert one(spark, lambda a, b: S.exact(a, b, 0.0), None, "a") == 0.0
    f = lambda k: one(spark, lambda a, b: S.numeric_features(a, b)[k], 0.0, 0.0)
    assert f("rel") == 0.0 and f("known") == 1.0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(S.vector_cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - math.sqrt(0.5)) < 1e-12 and got[1:] == [None, None]
    assert df.select(S.vector_euclidean(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_chi_square():
    assert abs(chi2.survival(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2.survival(34.913, 6) - 4.481e-06) < 2e-9
    assert abs(chi2.quantile(0.95, 8) - 15.507313) < 1e-5
    assert chi2.cdf(0, 3) == 0
