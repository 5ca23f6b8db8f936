"""License scans by a positional index of rare words.

Templates are phrases, notices and the paragraphs of whole licence texts; each word
of one has a fixed position. How many documents hold each template word is counted
over the whole corpus. A template's rarest words (highest inverse document
frequency) are its postings: word and position.

A file is looked up by its own words: of a template's postings, the file's
``ANCHORS`` highest ones. An occurrence of such a word at place ``i`` of the file
that stands at position ``r`` of the template proposes that the template begins at
``i - r``. The proposals are intersected by that relative position: of a phrase all
words, of a longer text at least half of the anchors, must stand where this start
puts them. A place counts if then every mandatory key phrase stands where the
template has it and enough of the template's weight agrees.

All steps are expressions over each row's own words; nothing is shuffled but the
word counts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER

#: What parts words: ASCII without digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """keys: mandatory phrases of the text, at their first place in it; none: the whole
    text is one. share: how much of the words' weight has to agree."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False
    share: float = 0.6

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(NOT_WORD, self.text.lower()) if w]

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """(position, words) of the key phrases."""
        words, out = self.words, []
        for key in self.keys or (self.text,):
            k = [w for w in re.split(NOT_WORD, key.lower()) if w]
            out.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        return out


# Phrases that name public licences.
PHRASES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("boost", "boost software license"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa 4 0"),
    Template("cc-by-nc", "cc by nc 4 0"),
    Template("cc-by-nd", "cc by nd 4 0"),
    Template("cc-by-nc-sa", "cc by nc sa 4 0"),
    Template("cc-by-nc-nd", "cc by nc nd 4 0"),
    Template("cc0", "cc0 1 0"),
    Template("cc", "creative commons attribution"),
)

# Paragraphs of public licences and of the notices that they ask for.
TEXTS = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", keys=("permission is hereby granted free of charge", "to any person obtaining a copy")),
    Template("mit", "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", keys=("to deal in the software without restriction",)),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", keys=("this permission notice shall be included", "substantial portions of the software")),
    Template("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", keys=("shall the authors or copyright holders be liable for any claim",)),
    Template("apache", "you may not use this file except in compliance with the License", keys=("use this file", "in compliance")),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", keys=("apache license version 2 0", "in compliance with the license")),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", keys=("required by applicable law or agreed to in writing", "without warranties or conditions of any kind")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", keys=("is free", "gnu general public license")),
    Template("gpl", "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", keys=("published by the free software foundation", "in the hope that it will be useful")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", keys=("redistribution and use in source and binary forms", "are permitted provided")),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", keys=("redistributions of source code must retain the above copyright notice",)),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", keys=("redistributions in binary form must reproduce the above copyright notice",)),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", keys=("used to endorse or promote products derived from this software",)),
    Template("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", keys=("procurement of substitute goods or services", "even if advised of the possibility of such damage")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", keys=("permission to use copy modify", "purpose with or")),
    Template("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", keys=("the author disclaims all warranties with regard to this software", "negligence or other tortious action")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", keys=("be held liable for any damages arising from the use",)),
    Template("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", keys=("permission is granted to anyone to use this software", "and to alter it and redistribute it freely")),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", keys=("to any person or organization obtaining a copy", "to prepare derivative works of the software")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", keys=("this source code form is subject to the terms", "mozilla public license")),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", keys=("unencumbered software", "into the public domain")),
    Template("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", keys=("anyone is free to copy modify publish use compile sell or distribute",)),
)

TEMPLATES = PHRASES + TEXTS
#: Rarest words of a template that are posted, and how many of them a file is looked up by.
POSTED, ANCHORS = 10, 4


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.array_remove(F.split(lower, NOT_WORD), "")


def document_frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> tuple[dict[str, int], int]:
    """In how many rows each template word occurs, and the number of rows. What
    comes to the driver is bounded by the templates' vocabulary."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    found = {r["w"]: r["n"] for r in counts}
    return found, found.pop("", 0)


def _strings(words: list[str]) -> str:
    """An array in SQL: words hold no ASCII but digits and lower-case letters."""
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def postings(t: Template, idf: dict[str, float]) -> list[str]:
    """The words by which a template is found, the rarest first: all of a phrase, of
    a longer text the ``POSTED`` rarest (ties by the word)."""
    rare = sorted(set(t.words), key=lambda w: (-idf[w], w))
    return rare[:POSTED] if t.keys else rare


def _places(t: Template, idf: dict[str, float], words: str, hits: str, held: str) -> Column:
    """Where a template stands: array of (start, weight that agrees). ``words``, ``hits``
    and ``held`` name columns. One SQL expression a template keeps the driver's work small."""
    tw, posted = t.words, postings(t, idf)
    at = "map(" + ", ".join(f"'{w}', array({', '.join(str(r) for r, v in enumerate(tw) if v == w)})" for w in posted) + ")"
    anchors = f"filter({_strings(posted)}, w -> array_contains(`{held}`, w))"
    if t.keys:
        anchors = f"slice({anchors}, 1, {ANCHORS})"
    least = f"greatest(least(size({anchors}), 2), ceil(size({anchors}) / 2))" if t.keys else str(len(posted))
    proposed = f"flatten(transform({anchors}, a -> flatten(transform(filter(`{hits}`, h -> h.w = a), h -> transform({at}[a], r -> h.i - r)))))"
    together = f"size(filter({anchors}, w -> exists({at}[w], r -> coalesce(get(`{words}`, s + r) = w, false)))) >= {least}"
    phrases = "".join(f" AND slice(`{words}`, greatest(s, 0) + {begin + 1}, {len(k)}) = {_strings(k)}" for begin, k in t.phrases)
    total = sum(idf[w] for w in tw)
    parts = "array(" + ", ".join(f"named_struct('r', {r}, 'w', '{w}', 'x', {idf[w] / total!r}D)" for r, w in enumerate(tw)) + ")"
    agreed = f"least(1.0D, aggregate({parts}, 0.0D, (got, p) -> got + if(coalesce(get(`{words}`, s + p.r) = p.w, false), p.x, 0.0D)))" if t.keys else "1.0D"
    starts = f"filter(array_distinct({proposed}), s -> s >= 0 AND {together}{phrases})"
    placed = f"filter(transform({starts}, s -> named_struct('start', s, 'weight', {agreed})), p -> p.weight >= {t.share}D)"
    # Without all words of a phrase, or those of a key phrase that are posted, nothing can stand.
    needed = sorted(set(tw) if not t.keys else {w for _, k in t.phrases for w in k} & set(posted))
    able = f"size(array_except({_strings(needed)}, `{held}`)) = 0" if needed else "true"
    return F.expr(f"if({able}, {placed}, cast(array() as array<struct<start:int,weight:double>>))")


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with a struct column ``license_scan`` (underscores are appended if
    the name is taken): n_words, n_base, first_word, last_word (of the base
    phrases, words from 0, null without one), base_labels, labels (distinct,
    sorted, joined by commas, empty without one), score (the largest share of a
    template's weight at one of its places, 0 without one).

    A null text counts as empty. Every place counts, also where phrases overlap; of
    places of one template with the same weight (ties) each stands for itself. Repeated
    rows, and rows with null or repeated ids, are scanned each for itself; an empty
    table gives an empty one."""
    from .common import temp_name

    seen, rows = document_frequencies(docs, text, templates)
    vocabulary = {w for t in templates for w in t.words}
    idf = {w: math.log((1 + rows) / (1 + seen.get(w, 0))) + 1.0 for w in vocabulary}
    posted = sorted({w for t in templates for w in postings(t, idf)})
    cols = list(docs.columns)
    out = temp_name(docs, "license_scan")
    w, h, d, p = (temp_name(docs, x) for x in ("__words", "__hits", "__held", "__places"))
    step = docs.withColumn(w, words_of(F.col(text)))
    indexed = F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(posted), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    step = step.withColumn(h, indexed)
    step = step.withColumn(d, F.array_distinct(F.transform(F.col(h), lambda x: x["w"])))
    places = [_places(t, idf, w, h, d) for t in templates]
    nothing = F.size(h) == 0
    step = step.withColumn(p, F.when(~nothing, F.array(*places)))
    of = lambda picked: F.flatten(F.array(*[F.col(p)[k] for k in picked])) if picked else F.array()
    base = of([k for k, t in enumerate(templates) if t.base])
    starts = F.transform(base, lambda x: x["start"])
    weights = F.transform(of(range(len(templates))), lambda x: x["weight"])

    def labels(picked: list[int]) -> Column:
        named = F.array(*[F.when(F.size(F.col(p)[k]) > 0, F.lit(templates[k].label)) for k in picked])
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ","), F.lit(""))

    found = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.when(F.col(p).isNull(), F.lit(0)).otherwise(F.size(base)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels([k for k, t in enumerate(templates) if t.base]).alias("base_labels"),
        labels(list(range(len(templates)))).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )
    return step.withColumn(out, found).select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{out}`"))
