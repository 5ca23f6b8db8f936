"""Chat formatting by schema fingerprints.

The field paths that a row fills in (``messages[].role``, ``instruction`` ...) are
collected from its nested columns, sorted and hashed. Each known layout has the
hashes of its required paths with every choice of its optional ones; a row's
hash selects the layout whose declarative mapping turns it into canonical turns
(role, text). Turns are then written in one template.

The template marks a turn as ``<|role|>text<|end|>`` and a line feed. Inside roles
and texts a backslash becomes ``\\b`` and a bar ``\\p``; so no text holds a bar, no
control string can appear in it, and undoing the two replacements in reverse
gives the text back exactly. The loss mask has, for each turn, how many code
points of it are skipped and how many then count: an assistant's text, and no more.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """needs, may: field paths. turns: maps a getter of columns by path, and the
    set of paths that rows of this hash fill in, to an array of (role, text)."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[Callable[[str], Column], frozenset[str]], Column]

    def hashes(self) -> dict[str, frozenset[str]]:
        out = {}
        for n in range(len(self.may) + 1):
            for extra in itertools.combinations(self.may, n):
                paths = frozenset(self.needs) | frozenset(extra)
                out[fingerprint_of(paths)] = paths
        return out


def fingerprint_of(paths) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _listed(array: str, role: str, text: str, alias: dict[str, str]):
    """Turns from an array of structs, with an optional system text before them."""

    def build(col, paths):
        def one(m: Column) -> Column:
            r = F.coalesce(m[role].cast("string"), F.lit(""))
            for name, canonical in alias.items():
                r = F.when(m[role] == name, F.lit(canonical)).otherwise(r)
            return F.struct(r.alias("role"), F.coalesce(m[text].cast("string"), F.lit("")).alias("text"))

        turns = F.transform(F.filter(col(array), lambda m: m.isNotNull()), one)
        return F.concat(F.array(_turn("system", col("system"))), turns) if "system" in paths else turns

    return build


def _asked(question: str, answer: str, more: str | None = None):
    """One user and one assistant turn; ``more`` follows the question after an empty line."""

    def build(col, paths):
        asked = F.concat(col(question).cast("string"), F.lit("\n\n"), col(more).cast("string")) if more in paths else col(question)
        first = [_turn("system", col("system"))] if "system" in paths else []
        return F.array(*first, _turn("user", asked), _turn("assistant", col(answer)))

    return build


# Role names that other layouts use for the canonical ones.
_FROM = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}

LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), _listed("messages", "role", "content", {})),
    Layout("turns", ("messages[].role", "messages[].text"), ("system",), _listed("messages", "role", "text", {})),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), _listed("conversations", "from", "value", _FROM)),
    Layout("instruction", ("instruction", "output"), ("input", "system"), _asked("instruction", "output", "input")),
    Layout("prompt", ("prompt", "completion"), ("system",), _asked("prompt", "completion")),
    Layout("response", ("prompt", "response"), ("system",), _asked("prompt", "response")),
    Layout("question", ("question", "answer"), ("context", "system"), _asked("question", "answer", "context")),
)


def _paths(schema: T.StructType) -> dict[str, tuple[Column, T.DataType]]:
    """Each leaf's path with a condition that says whether a row fills it in."""
    out: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, seen: Callable[[Callable[[Column], Column]], Column]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", lambda test, name=f.name: seen(lambda c: test(c[name])))
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path + "[]", lambda test: seen(lambda c: F.coalesce(F.exists(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))))
        else:
            out[path] = seen(lambda c: c.isNotNull())

    for f in schema.fields:
        walk(f.dataType, f.name, lambda test, name=f.name: test(F.col(f"`{name}`")))
    return out


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of the paths of ``layouts`` that a row fills in. Other columns do not count."""
    known = {p for x in layouts for p in (*x.needs, *x.may)}
    have = {p: c for p, c in _paths(df.schema).items() if p in known}
    filled = F.array(*[F.when(have[p], F.lit(p)) for p in sorted(have)]) if have else F.array().cast("array<string>")
    return F.sha2(F.array_join(filled, ","), 256)


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, to: str = "turns") -> DataFrame:
    """``df`` with ``to``, an array of (role, text), and ``<to>_layout``, the name of
    the layout. A row of no known layout has null in both."""
    mark = F.lit(None).cast(TURNS)
    name = F.lit(None).cast("string")
    print_name = to + "_fingerprint"
    have = set(_paths(df.schema))
    for layout in layouts:
        if not set(layout.needs) <= have:
            continue
        for digest, paths in layout.hashes().items():
            if paths <= have:
                turns = layout.turns(lambda path: F.col(f"`{path}`"), paths).cast(TURNS)
                mark = F.when(F.col(print_name) == digest, turns).otherwise(mark)
                name = F.when(F.col(print_name) == digest, F.lit(layout.name)).otherwise(name)
    return df.withColumn(print_name, fingerprint(df, layouts)).withColumns({to: mark, to + "_layout": name})


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column) -> Column:
    """The formatted text of an array of (role, text); null for null."""
    one = lambda t: F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>"), escaped(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """For each turn (skip, take): code points before the text and, in a turn of
    ``role``, of the text; take is 0 in others."""
    skip = lambda t: (F.length(escaped(t["role"])) + 4).alias("skip")
    take = lambda t: F.when(t["role"] == role, F.length(escaped(t["text"]))).otherwise(F.lit(0)).alias("take")
    return F.transform(turns, lambda t: F.struct(skip(t), take(t)))


def segments(formatted: Column) -> Column:
    """The formatted text cut behind each end mark, without the marks."""
    parts = F.split(formatted, r"<\|end\|>\n")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    head = lambda s: F.substring_index(s, "|>", 1)
    role = lambda s: unescaped(F.substring(head(s), F.lit(3), F.length(head(s)))).alias("role")
    text = lambda s: unescaped(F.substring(s, F.length(head(s)) + 3, F.length(s))).alias("text")
    return F.transform(segments(formatted), lambda s: F.struct(role(s), text(s)))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    cut = F.zip_with(segments(formatted), mask, lambda s, m: F.when(m["take"] > 0, unescaped(F.substring(s, m["skip"] + 1, m["take"]))))
    return F.filter(cut, lambda x: x.isNotNull())


def format_chats(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout``, ``turns``, ``formatted`` and ``loss_mask``; columns of
    these names are replaced. Null for rows of no known layout; a null role or
    text of a turn counts as empty. Repeated rows are formatted each for itself."""
    tmp = "__chat"
    while any(c.lower().startswith(tmp) for c in df.columns):
        tmp += "_"
    step = canonical(df.drop("layout", "turns", "formatted", "loss_mask"), layouts, tmp)
    out = step.withColumns({"formatted": render(F.col(tmp)), "loss_mask": loss_mask(F.col(tmp))})
    return out.withColumnsRenamed({tmp: "turns", tmp + "_layout": "layout"}).drop(tmp + "_fingerprint")


def from_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation from one row a turn: (key, messages). Turns are ordered
    by number (null first), then role and text; rows that repeat stay. Null roles and
    texts are empty. Rows with a null key form one conversation with a null key."""
    one = F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("m"))
    return gathered.select(key, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))
