"""Comparison levels and features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import similarity as S
from ..spec import Comparison


def similarity(pairs: DataFrame, c: Comparison, to: str) -> DataFrame:
    """``pairs`` (with columns <c>_l and <c>_r) with the similarity of a comparison."""
    l, r = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")  # noqa: E741
    if c.kind == "jaro_winkler":
        return S.with_jaro_winkler(pairs, f"{c.column}_l", f"{c.column}_r", to, min(c.levels))
    how = {
        "exact": lambda: S.exact(l, r),
        "levenshtein": lambda: S.levenshtein_similarity(l, r),
        "string_cosine": lambda: S.string_cosine(l, r),
        "jaccard": lambda: S.jaccard(F.array_distinct(F.split(l, " ")), F.array_distinct(F.split(r, " "))),
        "numeric": lambda: 1.0 - S.numeric_features(l, r)["rel"],
        "cosine_vector": lambda: S.vector_cosine(l, r),
    }[c.kind]()
    return pairs.withColumn(to, F.when(l.isNotNull() & r.isNotNull(), how))


def level(sim: Column, c: Comparison) -> Column:
    """-1 for null, 0 for the last level (else), then upwards to the strictest."""
    out = F.lit(0)
    for k, t in enumerate(sorted(c.levels)):
        out = F.when(sim >= t, F.lit(k + 1)).otherwise(out)
    return F.when(sim.isNull(), F.lit(-1)).otherwise(out)


def with_levels(pairs: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """``pairs`` with the level of each comparison in ``gamma_<column>``."""
    for c in comparisons:
        pairs = similarity(pairs, c, "__sim").withColumn(f"gamma_{c.column}", level(F.col("__sim"), c)).drop("__sim")
    return pairs


def auto_features(left: DataFrame, right: DataFrame, columns: list[str], long_text: float = 5.0, alignments: bool = False) -> list[tuple[str, str]]:
    """(column, kind) of generated features by inferred type: numbers get exact,
    absolute and relative differences; texts of one word, of a few and of many
    get the measures that suit their length. Lengths are averages of both tables.
    alignments: texts of a few words get alignment and hybrid measures as well."""
    kinds = dict(left.dtypes)
    numeric = [c for c in columns if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    texts = [c for c in columns if kinds[c] == "string"]
    out = [(c, k) for c in numeric for k in ("exact", "num_abs", "num_rel")]
    if texts:
        both = left.select(*texts).unionByName(right.select(*texts))
        mean = both.agg(*[F.avg(F.size(F.split(F.col(c), " "))).alias(c) for c in texts]).first()
        for c in texts:
            n = mean[c] or 0.0
            short, middle = ("exact", "jaro_winkler", "levenshtein", "jaccard_q3"), ("levenshtein", "jaccard_q3", "cosine_words", "jaccard_words")
            kinds_of = short if n <= 1.5 else middle if n <= long_text else ("cosine_words", "jaccard_words", "jaccard_q3")
            out += [(c, k) for k in kinds_of + (("monge_elkan", "needleman_wunsch", "smith_waterman") if alignments and kinds_of is middle else ())]
    return out


#: Features that align the two texts, each distinct pair of values once.
ALIGNED = {"needleman_wunsch": A.NEEDLEMAN_WUNSCH, "smith_waterman": A.SMITH_WATERMAN, "affine_gap": A.AFFINE_COST}


def feature_table(pairs: DataFrame, features: list[tuple[str, str]]) -> DataFrame:
    """``pairs`` with one numeric column for each feature, ``f_<column>_<kind>``; null if a side is."""
    for c, kind in features:
        l, r, to = F.col(f"{c}_l"), F.col(f"{c}_r"), f"f_{c}_{kind}"  # noqa: E741
        if kind == "jaro_winkler":
            pairs = S.with_jaro_winkler(pairs, f"{c}_l", f"{c}_r", to)
            continue
        if kind in ALIGNED:
            pairs = A.with_alignment(pairs, f"{c}_l", f"{c}_r", {to: ALIGNED[kind]})
            continue
        words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
        value = {
            "exact": lambda: S.exact(l, r),
            "levenshtein": lambda: S.levenshtein_similarity(l, r),
            "jaccard_q3": lambda: S.jaccard(S.qgrams(l, 3), S.qgrams(r, 3)),
            "string_cosine": lambda: S.string_cosine(l, r),
            "cosine_words": lambda: S.multiset_cosine(words(l), words(r)),
            "jaccard_words": lambda: S.jaccard(words(l), words(r)),
            "monge_elkan": lambda: A.monge_elkan(l, r),
            "num_abs": lambda: F.abs(l.cast("double") - r.cast("double")),
            "num_rel": lambda: S.numeric_features(l, r)["rel"],
            "price": lambda: S.price_similarity(l.cast("double"), r.cast("double")),
            "known": lambda: (l.isNotNull() & r.isNotNull()).cast("double"),
        }[kind]()
        keep_null = kind != "known"
        pairs = pairs.withColumn(to, F.when(l.isNotNull() & r.isNotNull(), value) if keep_null else value)
    return pairs


#: Typed comparators of a trained matcher: the features of each field type.
FIELD_TYPES = {"String": ("affine_gap", "jaccard_q3"), "ShortString": ("jaro_winkler", "levenshtein"), "Text": ("cosine_words",), "Price": ("price",), "Exact": ("exact",), "Numeric": ("num_abs", "num_rel")}
#: Match types of a learned linker: the features of each.
MATCH_TYPES = {"FUZZY": ("jaro_winkler", "levenshtein", "jaccard_q3"), "TEXT": ("jaccard_words", "cosine_words"), "EXACT": ("exact",), "NUMERIC": ("num_rel",), "DONT_USE": ()}


def typed_features(fields: dict[str, str], has_missing: tuple[str, ...] = (), types: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, str]]:
    """The features of typed fields; a field in ``has_missing`` gets a presence indicator."""
    table = types or FIELD_TYPES
    return [(c, k) for c, t in fields.items() for k in (*table[t], *(("known",) if c in has_missing and table[t] else ()))]


def match_type_features(fields: dict[str, str]) -> list[tuple[str, str]]:
    return typed_features(fields, types=MATCH_TYPES)
