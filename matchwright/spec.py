"""Declarations of data sets, blocking rules and comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldSpec:
    """source: the column's name in the file (a URI, perhaps). clean: a function
    from Column to Column. missing: whether missing stays null or becomes empty;
    null keys never block together, empty ones do."""

    name: str
    source: str | None = None
    clean: Callable[[Column], Column] | None = None
    missing: str = "null"
    kind: str = "string"

    def column(self) -> Column:
        c = F.col(f"`{self.source or self.name}`")
        c = self.clean(c) if self.clean else c
        if self.kind == "double":
            c = c.try_cast("double")
        return (F.coalesce(c, F.lit("")) if self.missing == "empty" else c).alias(self.name)


@dataclass(frozen=True)
class DatasetSpec:
    """derive: further columns, name to SQL expression over the fields."""

    name: str
    id: FieldSpec
    fields: tuple[FieldSpec, ...]
    derive: dict[str, str | Column] = field(default_factory=dict)
    sep: str = ","
    tag: str = "a"

    def apply(self, raw: DataFrame) -> DataFrame:
        """(src, id, fields, derived) from the raw table; other columns are pruned."""
        out = raw.select(F.lit(self.tag).alias("src"), self.id.column().alias("id"), *[f.column() for f in self.fields])
        for name, what in self.derive.items():
            out = out.withColumn(name, F.expr(what) if isinstance(what, str) else what)
        return out


@dataclass(frozen=True)
class BlockingRule:
    """Key expressions in SQL, over one record's columns; all must agree."""

    keys: tuple[str, ...]

    @staticmethod
    def of(*keys: str) -> "BlockingRule":
        return BlockingRule(tuple(keys))


@dataclass(frozen=True)
class Comparison:
    """kind: exact, jaro_winkler, levenshtein, string_cosine, numeric, jaccard.
    levels: similarity thresholds in falling order; the last level is ``else``."""

    column: str
    kind: str = "exact"
    levels: tuple[float, ...] = (1.0,)

    @property
    def count(self) -> int:
        return len(self.levels) + 1
