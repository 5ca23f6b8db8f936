"""Public entity-resolution benchmarks as declarations: how their tables are read and
normalised, which keys block, what is compared by which kind of matcher.

Column names, delimiters, blocking keys and field types in this module are fixed values:
they must be those of the published data sets and of their usual configurations.

Every preset can be run by any pipeline of ``plans.pipelines``. Sides are bound by
name, never by the order of two files; ids are normalised on both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.similarity import jaro_winkler_thresholds
from ..operators import classifiers
from ..sources.tables import read_delimited, rename
from ..spec import BlockingRule, Comparison, DatasetSpec, FieldSpec
from . import pipelines


@dataclass(frozen=True)
class Preset:
    """fuzzy and exact: columns compared by Jaro-Winkler levels and by equality. typed:
    fields of the trained matcher. features, tfidf: of the feature classifier.
    blocks: columns whose tokens block. match_types: of the learned linker. joined:
    columns of the text that an encoder gets."""

    left: DatasetSpec
    right: DatasetSpec | None
    rules: tuple[BlockingRule, ...]
    fuzzy: tuple[str, ...]
    exact: tuple[str, ...]
    typed: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    features: tuple[tuple[str, str], ...] = ()
    tfidf: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    match_types: dict[str, str] = field(default_factory=dict)
    joined: tuple[str, ...] = ()

    def comparisons(self, strictness: float) -> list[Comparison]:
        levels = tuple(jaro_winkler_thresholds(strictness))
        return [*(Comparison(c, "jaro_winkler", levels) for c in self.fuzzy), *(Comparison(c) for c in self.exact)]

    def probabilistic(self, strictness: float = 0.9, max_pairs: int = 1_000_000) -> pipelines.Probabilistic:
        return pipelines.Probabilistic(list(self.rules), self.comparisons(strictness), max_pairs)

    def meta_blocking(self, **options) -> pipelines.MetaBlocking:
        return pipelines.MetaBlocking(list(self.blocks), **options)

    def feature_classifier(self, config: classifiers.Config = classifiers.Config()) -> pipelines.FeatureClassifier:
        return pipelines.FeatureClassifier(list(self.features), list(self.tfidf), config)

    def trained_matcher(self, config: classifiers.Config = classifiers.Config()) -> pipelines.FeatureClassifier:
        """Typed fields, each optional one with an indicator of presence."""
        from ..operators.compare import typed_features

        return pipelines.FeatureClassifier(typed_features(self.typed, self.optional), [], config)

    def learned_linker(self, config: classifiers.Config = classifiers.Config(), threshold: float = 0.5) -> pipelines.LearnedLinker:
        return pipelines.LearnedLinker(list(self.rules), self.match_types, config, threshold)

    def texts(self, records: DataFrame) -> DataFrame:
        """(id, text): the record as one text for an encoder."""
        return records.select("id", N.joined_text(*[N.number_text(F.col(c)) for c in self.joined]).alias("text"))

    def read(self, spark: SparkSession, left: str, right: str | None = None, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Both normalised tables from files; ``names`` maps ontology headers."""

        def one(spec: DatasetSpec, path: str) -> DataFrame:
            raw = read_delimited(spark, path, spec.sep)
            return spec.apply(rename(raw, names) if names else raw)

        return one(self.left, left), None if self.right is None or right is None else one(self.right, right)


def _fields(*specs: tuple[str, Callable | None, str] | tuple[str, str, Callable | None, str]) -> tuple[FieldSpec, ...]:
    """(name, clean, missing) or (name, column, clean, missing)."""
    return tuple(FieldSpec(s[0], s[1], s[2], s[3]) if len(s) == 4 else FieldSpec(s[0], None, s[1], s[2]) for s in specs)


def _rules(*keys: str) -> tuple[BlockingRule, ...]:
    """Rules, each written as key expressions between ``&``."""
    return tuple(BlockingRule(tuple(k.strip() for k in rule.split("&"))) for rule in keys)


ID = FieldSpec("id", clean=N.norm_id)
KEPT, EMPTY = "null", "empty"
low = N.lower_or_empty


def _year0(c):
    return N.leading_year(c, "0")


def _number(c):
    return N.number_text(N.to_number(c))


def _sides(sep: str, left: tuple, right: tuple, derive: dict | None = None, more_left: dict | None = None, more_right: dict | None = None, names: tuple[str, str] = ("left", "right"), ident: FieldSpec = ID) -> tuple[DatasetSpec, DatasetSpec]:
    d = derive or {}
    return DatasetSpec(names[0], ident, left, d | (more_left or {}), sep, "a"), DatasetSpec(names[1], ident, right, d | (more_right or {}), sep, "b")


def _publications(names: tuple[str, str], sep: str) -> Preset:
    f = _fields(("title", low, EMPTY), ("authors", low, EMPTY), ("venue", low, EMPTY), ("year", lambda c: F.coalesce(_number(c), F.lit("0")), EMPTY))
    a, b = _sides(sep, f, f, {"first_author": N.first_author_surname(F.col("authors"))}, names=names)
    return Preset(
        a, b, _rules("year & first_author", "first_author", "year & substr(title, 1, 3)", "substr(title, 1, 5)"), ("title", "authors", "venue"), ("year",),
        typed={"title": "String", "authors": "String", "venue": "String", "year": "String"}, optional=("venue", "year"),
        features=(("title", "string_cosine"), ("title", "jaro_winkler"), ("authors", "string_cosine"), ("venue", "string_cosine"), ("year", "exact")),
        tfidf=("title", "authors"), blocks=("title",), match_types={"title": "FUZZY", "authors": "FUZZY", "venue": "FUZZY", "year": "DONT_USE"}, joined=("title", "authors", "venue"),
    )


def _films(names: tuple[str, str], years: tuple[str, str], year: Callable, extra: tuple[str, ...] = ()) -> Preset:
    common = [("title", low, EMPTY), ("name", low, EMPTY), ("episode", "episodeNumber", _number, KEPT), ("season", "seasonNumber", _number, KEPT), *((c, low, EMPTY) for c in extra)]
    derive = {"entity_text": N.first_filled(F.col("title"), F.col("name")), "ep_key": N.episode_key(F.col("season"), F.col("episode"))}
    a, b = _sides("|", _fields(*common, ("year", years[0], year, KEPT)), _fields(*common, ("year", years[1], year, KEPT)), derive, names=names)
    return Preset(
        a, b, _rules("year & substr(entity_text, 1, 3)", "year & substr(entity_text, 1, 5)", "ep_key", "substr(entity_text, 1, 8)"), ("entity_text",), ("year", "ep_key"),
        typed={"title": "String", "year": "String", **{c: "String" for c in extra if c == "genre_list"}}, optional=("year", *(c for c in extra if c == "genre_list")),
        features=(("title", "string_cosine"), ("title", "jaro_winkler"), ("name", "string_cosine"), ("name", "jaro_winkler"), *((c, "string_cosine") for c in extra), ("episode", "exact"), ("season", "exact"), *((("year", "exact"),) if "abstract" in extra else ())),
        tfidf=("title", "name", *(c for c in extra if c == "abstract")), blocks=("title", "name"), match_types={"title": "FUZZY", "name": "FUZZY", **{c: "FUZZY" for c in extra}},
        joined=("title", "name", *(("genre_list",) if "genre_list" in extra else ("episode", "season"))),
    )


def _abt_buy() -> Preset:
    f = _fields(("name", low, EMPTY), ("description", N.clean_text, KEPT), ("price", N.parse_price, KEPT))
    a, b = _sides("|", f, f, {"brand": F.coalesce(N.first_word(F.col("name")), F.lit("")), "model": N.model_token(F.col("name"))}, names=("abt", "buy"))
    return Preset(
        a, b, _rules("brand & model", "model", "brand & substr(name, 1, 3)", "substr(name, 1, 5)"), ("name",), ("brand", "model"),
        typed={"name": "String", "description": "Text", "price": "Price"}, optional=("price",),
        features=(("name", "string_cosine"), ("name", "jaro_winkler"), ("description", "string_cosine"), ("price", "num_abs"), ("price", "num_rel"), ("price", "known")),
        tfidf=("name", "description"), blocks=("name",), match_types={"name": "FUZZY", "description": "FUZZY", "price": "DONT_USE"}, joined=("name", "description"),
    )


def _amazon_google() -> Preset:
    f = _fields(("title", low, EMPTY), ("manufacturer", low, EMPTY), ("description", N.clean_text, KEPT), ("price", N.parse_price, KEPT))
    version = {"version": N.version_token(F.col("title"))}
    a, b = _sides("#", f, f, version, {"mfr_block": N.vendor_token(F.col("manufacturer"))}, {"mfr_block": N.vendor_token(F.col("title"))}, ("amazon", "google"), FieldSpec("id", clean=lambda c: F.trim(c)))
    return Preset(
        a, b, _rules("mfr_block & version", "version", "mfr_block & substr(title, 1, 3)", "substr(title, 1, 5)"), ("title",), ("mfr_block", "version"),
        typed={"title": "String", "description": "Text", "manufacturer": "String", "price": "Price"}, optional=("manufacturer", "price"),
        features=(("title", "string_cosine"), ("title", "jaro_winkler"), ("description", "string_cosine"), ("manufacturer", "string_cosine"), ("price", "num_abs"), ("price", "num_rel"), ("price", "known")),
        tfidf=("title", "description"), blocks=("title",), match_types={"title": "FUZZY", "manufacturer": "FUZZY", "description": "FUZZY", "price": "DONT_USE"}, joined=("title", "manufacturer", "description"),
    )


def _walmart_amazon() -> Preset:
    f = _fields(("title", low, EMPTY), ("brand", low, EMPTY), ("modelno", lambda c: N.keep_alphanumeric(low(c)), EMPTY), ("price", N.parse_price, KEPT), ("shipweight", N.parse_weight, KEPT), ("dimensions", low, EMPTY))
    a, b = _sides("|", f, f, names=("walmart", "amazon"))
    return Preset(
        a, b, _rules("brand & modelno", "modelno", "brand & substr(title, 1, 3)", "substr(title, 1, 5)"), ("title",), ("brand", "modelno"),
        typed={"title": "String", "modelno": "String", "brand": "String", "price": "Price", "dimensions": "String"}, optional=("modelno", "brand", "price", "dimensions"),
        features=(("title", "string_cosine"), ("title", "jaro_winkler"), ("brand", "string_cosine"), ("brand", "jaro_winkler"), ("modelno", "jaro_winkler"), *((c, k) for c in ("price", "shipweight") for k in ("num_abs", "num_rel", "known"))),
        tfidf=("title", "brand", "dimensions"), blocks=("title",), match_types={"title": "FUZZY", "modelno": "FUZZY", "brand": "FUZZY"}, joined=("title", "brand", "modelno"),
    )


def _cora() -> Preset:
    f = _fields(*((c, N.clean_text_nan if c != "title" else N.clean_text, KEPT) for c in ("title", "author", "venue", "publisher", "year")))
    spec = DatasetSpec("cora", FieldSpec("id", "Entity Id", N.norm_id), f, {"first_author": N.first_word(F.col("author")), "year_clean": F.coalesce(F.col("year"), N.embedded_year(F.col("title")))}, "|")
    keys = ("first_author", "year_clean", "substr(title, 1, 3)", "substr(title, 1, 5)", "substr(title, 1, 8)", "substr(author, 1, 4)", "substr(venue, 1, 4)", "publisher", "substr(title, 1, 10)")
    return Preset(
        spec, None, _rules(*keys), ("title", "author", "venue"), ("publisher", "year_clean"),
        typed={"title": "Text", "author": "Text", "venue": "String", "publisher": "String", "year": "String"}, optional=("venue", "publisher", "year"),
        blocks=("title", "author", "venue", "publisher", "year"), match_types={"title": "FUZZY", "author": "FUZZY", "venue": "FUZZY", "publisher": "DONT_USE", "year": "DONT_USE"}, joined=("title", "author", "venue", "publisher", "year"),
    )


def _cddb() -> Preset:
    f = _fields(*((c, N.clean_text_nan, KEPT) for c in ("artist", "title", "genre", "category", "year")))
    spec = DatasetSpec("cddb", ID, f, {"first_artist": N.first_word(F.col("artist"))}, ",")
    keys = ("first_artist", "year", "substr(title, 1, 2)", "substr(title, 1, 3)", "substr(title, 1, 5)", "substr(artist, 1, 2)", "substr(artist, 1, 4)", "genre", "category")
    return Preset(
        spec, None, _rules(*keys), ("artist", "title"), ("genre", "category", "year"),
        typed={"artist": "Text", "title": "Text", "genre": "String", "category": "String", "year": "String"}, optional=("genre", "category", "year"),
        blocks=("artist", "title", "year"), match_types={"artist": "FUZZY", "title": "FUZZY", "genre": "EXACT", "category": "EXACT", "year": "EXACT"}, joined=("artist", "title", "year"),
    )


def _persons() -> Preset:
    columns = ("given_name", "surname", "address_1", "suburb", "postcode", "state", "date_of_birth", "soc_sec_id", "phone_number")
    f = _fields(*((c, N.clean_text_nan, KEPT) for c in columns))
    derive = {"surname_2": N.prefix(F.col("surname"), 2), "surname_4": N.prefix(F.col("surname"), 4), "postcode_3": N.prefix(F.col("postcode"), 3)}
    return Preset(
        DatasetSpec("persons", ID, f, derive, ","), None, _rules("surname_2", "surname_4", "postcode", "postcode_3", "suburb", "given_name"),
        ("given_name", "surname", "address_1"), ("postcode", "suburb", "state", "date_of_birth", "soc_sec_id", "phone_number"),
        typed={c: "Text" if c in ("given_name", "surname", "address_1") else "String" for c in columns}, optional=columns,
        blocks=("given_name", "surname", "address_1", "suburb", "postcode"), match_types={c: "FUZZY" if c in ("given_name", "surname", "address_1", "suburb") else "EXACT" for c in columns}, joined=("given_name", "surname", "address_1", "suburb", "postcode"),
    )


#: Built on demand, for columns need a session.
PRESETS: dict[str, Callable[[], Preset]] = {
    "abt_buy": _abt_buy,
    "amazon_google": _amazon_google,
    "dblp_acm": lambda: _publications(("dblp", "acm"), "%"),
    "imdb_tmdb": lambda: _films(("imdb", "tmdb"), ("startYear", "release_year"), _year0, ("genre_list",)),
    "imdb_tvdb": lambda: _films(("imdb", "tvdb"), ("startYear", "releaseDate"), N.leading_year),
    "tmdb_tvdb": lambda: _films(("tmdb", "tvdb"), ("releaseDate", "releaseDate"), N.leading_year, ("abstract",)),
    "walmart_amazon": _walmart_amazon,
    "dblp_scholar": lambda: _publications(("dblp", "scholar"), ">"),
    "cora": _cora,
    "cddb": _cddb,
    "persons": _persons,
}
