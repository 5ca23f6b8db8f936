"""Normalising and key derivation: functions from Column to Column.

All are built-in expressions and stay inside whole-stage code generation. Null
gives null unless a function says otherwise; nothing throws in ANSI mode.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters they decompose to."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()
#: Letters that no decomposition covers.
LIGATURES = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i"}


def ascii_fold(x: Column) -> Column:
    """Latin letters without their marks. Letters of other scripts stay as they
    are: a transliteration of them is not attempted."""
    out = F.translate(x, _MARKED, _PLAIN)
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def squeeze(x: Column) -> Column:
    """Runs of white space, also Unicode's, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def clean_text(x: Column, fold: bool = True) -> Column:
    """Folded, squeezed, lower-cased; empty becomes null."""
    x = x.cast("string")
    return blank_to_null(F.lower(squeeze(ascii_fold(x) if fold else x)))


def clean_text_nan(x: Column, fold: bool = False) -> Column:
    """clean_text for text from number-minded tools: the word ``nan`` is null too."""
    return F.nullif(clean_text(x, fold), F.lit("nan"))


def lower_or_empty(x: Column) -> Column:
    """Lower-cased and trimmed; missing becomes empty, so missing keys block together."""
    return F.coalesce(F.lower(F.regexp_replace(x.cast("string"), r"(?U)^\s+|\s+$", "")), F.lit(""))


def strip_symbols(x: Column, lower: bool = True, brackets: bool = True) -> Column:
    """The text cleaning of record-linkage toolkits: lower case, bracketed parts
    out, white-space-like punctuation to spaces, other symbols out, squeezed."""
    x = F.lower(x) if lower else x
    if brackets:
        x = F.regexp_replace(x, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", "")
    x = F.regexp_replace(x, r"[-_/.,;:|]+", " ")
    return squeeze(F.regexp_replace(x, r"(?U)[^\w\s]+", ""))


def parse_price(x: Column, zero_is_missing: bool = True) -> Column:
    """A double without currency sign and thousands commas. Unreadable text and,
    by default, zero are null."""
    value = F.expr("null").cast("double") if x is None else _to_double(F.regexp_replace(x.cast("string"), "[$,]", ""))
    return F.nullif(value, F.lit(0.0)) if zero_is_missing else value


def parse_weight(x: Column) -> Column:
    """A double without the unit lb or lbs."""
    return _to_double(F.regexp_replace(F.lower(x.cast("string")), "lbs?", ""))


def _to_double(x: Column) -> Column:
    value = F.trim(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_number(x: Column, fill: float | None = None) -> Column:
    """A double; what cannot be read, and NaN, is null or ``fill``."""
    value = _to_double(x.cast("string"))
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def number_text(x: Column) -> Column:
    """A number as text without a trailing ``.0``; missing becomes empty."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"\.0+$", ""), F.lit(""))


def norm_id(x: Column) -> Column:
    """``12.0`` and ``12`` are one id; what is no number stays as trimmed text."""
    text = F.trim(x.cast("string"))
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def keep_alphanumeric(x: Column) -> Column:
    """Lower case with nothing but a-z and 0-9 (model numbers)."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, SPACE), lambda w: w != "")


def first_word(x: Column) -> Column:
    """The first word; null without one (brand, first token of an author)."""
    return F.try_element_at(words(x), F.lit(1))


def model_token(x: Column) -> Column:
    """A model number in a product name: the part behind the last `` - ``, squeezed to a-z and
    0-9, if it has a digit; else the last alphanumeric word that has one, else empty."""
    name = lower_or_empty(x)
    digit = lambda w: w.rlike(r"\d")
    chunks = F.split(name, " - ")
    tail = keep_alphanumeric(F.element_at(chunks, -1))
    spaced = words(F.regexp_replace(name, r"[^a-z0-9\s]", " "))
    return F.when((F.size(chunks) > 1) & digit(tail), tail).otherwise(F.coalesce(F.try_element_at(F.filter(spaced, digit), F.lit(-1)), F.lit("")))


#: Company words that carry no name.
COMPANY_WORDS = ("inc", "llc", "corp", "ltd", "systems", "software", "technologies", "usa")


def vendor_token(x: Column) -> Column:
    """The first word left when company words are taken out; empty without one."""
    plain = F.regexp_replace(lower_or_empty(x), r"\b(?:" + "|".join(COMPANY_WORDS) + r")\b\.?", "")
    return F.coalesce(first_word(plain), F.lit(""))


def version_token(x: Column) -> Column:
    """``v1.2``, a year of 1900-2099 or a decimal number in a title, without spaces; empty without one."""
    found = F.regexp_extract(lower_or_empty(x), r"\b(v\.?\s*\d[\d.]*|(?:19|20)\d{2}\b|\d+\.\d+\b)", 1)
    return F.replace(F.regexp_replace(found, r"\s+", ""), F.lit("v."), F.lit("v"))


def first_author_surname(x: Column) -> Column:
    """The last word of the first author, letters only; empty without one."""
    first = F.regexp_replace(F.element_at(F.split(lower_or_empty(x), "[,;]"), 1), r"[^a-z\s]", "")
    return F.coalesce(F.try_element_at(words(first), F.lit(-1)), F.lit(""))


def leading_year(x: Column, missing: str | None = None) -> Column:
    """Four digits at the start of a text, else ``missing``."""
    return F.coalesce(blank_to_null(F.regexp_extract(F.trim(x.cast("string")), r"^(\d{4})", 1)), F.lit(missing))


def embedded_year(x: Column) -> Column:
    """The first year of 1900-2099 in a text; null without one."""
    return blank_to_null(F.regexp_extract(x, r"\b((?:19|20)\d{2})\b", 1))


def year_or_embedded(year: Column, title: Column) -> Column:
    return F.coalesce(leading_year(year), embedded_year(title))


def first_filled(*xs: Column) -> Column:
    """The first text that is neither null nor empty, else empty."""
    return F.coalesce(*[blank_to_null(x) for x in xs], F.lit(""))


def episode_key(season: Column, episode: Column) -> Column:
    """``s1e2``; null if either is missing."""
    part = lambda x: blank_to_null(number_text(x))
    return F.concat(F.lit("s"), part(season), F.lit("e"), part(episode))


def prefix(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def date_year(x: Column) -> Column:
    return F.year(F.try_to_date(x.cast("string")))


def joined_text(*xs: Column) -> Column:
    """Columns joined by spaces; missing ones count as empty text and leave no gap."""
    return F.concat_ws(" ", *[blank_to_null(x.cast("string")) for x in xs])


def profile_clean(x: Column, stopwords: tuple[str, ...] = (), punctuation: bool = False, numbers: bool = False, unicode: bool = False) -> Column:
    """Optional cleaning of whole profiles: each flag removes what it names."""
    if unicode:
        x = F.regexp_replace(ascii_fold(x), r"[^\x00-\x7F]", "")
    if punctuation:
        x = F.regexp_replace(x, r"\p{Punct}", "")
    if numbers:
        x = F.regexp_replace(x, r"\d+", "")
    if stopwords:
        return F.array_join(F.filter(words(x), lambda w: ~F.lower(w).isin(*stopwords)), " ")
    return squeeze(x)
