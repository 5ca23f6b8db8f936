"""SimHash near-dedup, compaction and cross-tokenizer alignment against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matchwright.llm import html_extraction, language_id, queries, sentencepiece_backend, simhash_dedup

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\n\n", "x " * 50_000, "é ß 日本 😀", "same text here", "same text here", "1 2 3 !!", "\u0000", "A b c\x1cd E", "<|endoftext|> <s>"]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, distance=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
            root[b] = a
    return [ids[find(i)] for i in range(len(ids))]


def test_simhash_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op11_simhash_dedup(spark, SF).orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == components([r["doc_id"] for r in rows], fps)


def test_simhash_odd_texts(spark):
    got = simhash_dedup.near_duplicates(documents(spark, ODD).withColumn("fp", F.lit("mine"))).orderBy("doc_id").collect()
    fps = [brute_fingerprint(t) for t in ODD]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == components(list(range(len(ODD))), fps)


def test_simhash_null_and_repeated_ids_and_empty(spark):
    rows = [(None, "one two three four"), (7, "one two three four"), (7, "five six seven"), (None, "eight nine ten"), (3, "five six seven")]
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 7), (3, 3), (7, 3), (7, 7)]
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def clustered(rng, n):
    """Fingerprints at few bits from one another, some bits constant, some tied together."""
    out = []
    while len(out) < n:
        base = rng.getrandbits(64) & ~0xFFFF | 0xAAAA
        base = base & ~(0xFF << 16) | ((base >> 24 & 0xFF) << 16)
        for _ in range(rng.choice([1, 2, 30])):
            out.append(base)
            for b in rng.sample(range(64), rng.randrange(4)):
                out[-1] ^= 1 << b
    return sorted(set(out[:n]))


@pytest.mark.parametrize("p", [simhash_dedup.Params(), simhash_dedup.Params(most=40), simhash_dedup.Params(layouts=(2,)), simhash_dedup.Params(layouts=(3,), posting=1.0), simhash_dedup.Params(layouts=(5,), most=16), simhash_dedup.Params(distance=5, layouts=(3, 4))])
def test_simhash_links_equal_brute_force_with_any_layout(spark, p):
    """Dense groups, skewed and tied bits, hot runs dealt in parts: no link is lost."""
    fps = clustered(random.Random(p.distance + len(p.layouts)), 700)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, doc_id long")
    parts = simhash_dedup.plan(nodes, p)
    assert sum(r + 1 for _, r in parts) == p.distance + 1
    links = simhash_dedup.verified_links(simhash_dedup.postings(nodes, parts), p).collect()
    place = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        i, j = place[r["a"]], place[r["b"]]
        assert (fps[i] ^ fps[j]).bit_count() <= p.distance
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == components(list(range(len(fps))), fps, p.distance)


def test_simhash_of_one_dense_group_makes_a_forest_not_all_pairs(spark):
    base = random.Random(5).getrandbits(64)
    fps = [base] + [base ^ 1 << a ^ 1 << b for a, b in itertools.combinations(range(0, 64, 2), 2)]
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, doc_id long")
    p = simhash_dedup.Params()
    parts = simhash_dedup.plan(nodes, p)
    assert simhash_dedup.verified_links(simhash_dedup.postings(nodes, parts), p).count() < 8 * len(fps)


def test_thresholds_of_least_cost():
    """The dynamic programme against all allotments; correlated bits share a group."""
    rng = random.Random(3)
    for _ in range(20):
        costs = [[0.0, *sorted(rng.uniform(0, 100) for _ in range(4))] for _ in range(4)]
        every = [r for r in itertools.product(range(-1, 4), repeat=4) if sum(r) == 0]
        best = min(sum(c[r + 1] for c, r in zip(costs, radii)) for radii in every)
        cost, radii = simhash_dedup.allot(costs, 3)
        assert abs(cost - best) < 1e-9 and sum(radii) == 0
    bits = np.random.default_rng(0).integers(0, 2, (500, 64))
    bits[:, 40:48] = bits[:, :8]
    groups = simhash_dedup.correlated_parts(bits.T @ bits, 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(any({b, b + 40} <= set(g) for g in groups) for b in range(8))


# ---------------------------------------------------------------- pages, mended

FIRST = "The first long paragraph of the article tells something about the town and its people, at some length."
SECOND = "The second paragraph goes on about the same matter, and adds some more to what was said before."


def article(piece, opener="<article>"):
    return f"<html><body><nav><ul><li><a href=x>home</a></li></ul></nav>{opener}<h1>Title here</h1><p>{FIRST}</p>{piece}<p>{SECOND}</p></article><footer><p>Copyright foo</p></footer></body></html>"


@pytest.mark.parametrize(
    "piece",
    [
        *[f'<{tag} class="{hint}"><p>LEAK I do not agree with this at all, it is wrong.</p><p>LEAK Nor do I.</p></{tag}>' for tag in ("div", "section", "aside") for hint in ("comments", "user-comments", "discussion")],
        '<ol class="comment-list"><li>LEAK I do not agree with this at all.</li><li>LEAK Nor do I.</li></ol>',
        *[f'<div class="{hint}"><p>LEAK Buy our great product now, it is cheap and good for you.</p></div>' for hint in ("advert", "ad", "sponsored")],
        "<button><div>LEAK Click me</div></button>",
        "<label><p>LEAK a label</p></label>",
        "<select><option>LEAK one<option>LEAK two</select>",
        '<div aria-hidden="true"><p>LEAK not to be seen by anybody who reads this page.</p></div>',
    ],
)
def test_extraction_leaves_out_a_piece_and_nothing_else(piece):
    assert html_extraction.main_text(html_extraction.default_field(), article(piece)) == f"Title here\n\n{FIRST}\n\n{SECOND}"


@pytest.mark.parametrize(
    "piece, text",
    [
        ('<p title="the hidden life of trees">Trees live long lives and nobody sees it happen.</p>', "Trees live long lives and nobody sees it happen."),
        ("<p data-x='display:none'>Trees live long lives and nobody sees it happen.</p>", "Trees live long lives and nobody sees it happen."),
        ("<p>Some visible text <span hidden>LEAK <span>LEAK</span> LEAK</span>goes on here.</p>", "Some visible text goes on here."),
        ('<p>Some visible text <i style="color:red;display : none">LEAK</i>goes on here.</p>', "Some visible text goes on here."),
        ("<p>Here the number <math><mi>n</mi></math> is <object>large</object>, as was said.</p>", "Here the number n is large, as was said."),
        ("<p>Text before a control that nobody closed <button>LEAK copy</p>", "Text before a control that nobody closed"),
    ],
)
def test_extraction_keeps_all_of_a_block_but_what_is_hidden(piece, text):
    assert html_extraction.main_text(html_extraction.default_field(), article(piece)) == f"Title here\n\n{FIRST}\n\n{text}\n\n{SECOND}"


def test_extraction_of_articles_with_odd_attributes_and_of_plain_text():
    field = html_extraction.default_field()
    for opener in ('<article data-title="a hidden gem">', "<article title='x hidden y' data-hidden=1>"):
        assert html_extraction.main_text(field, article("", opener)) == f"Title here\n\n{FIRST}\n\n{SECOND}"
    assert html_extraction.main_text(field, "Plain  text\nwithout tags &amp; so on.") == "Plain text without tags & so on."
    assert html_extraction.main_text(field, "") == "" and html_extraction.attributes("a=1 B='x y' hidden c = \"z\" a=2") == {"a": "1", "b": "x y", "hidden": "", "c": "z"}


# ---------------------------------------------------------------- SentencePiece parity


def test_sentencepiece_parity_is_of_raw_texts(spark):
    """Texts that end in spaces or are made of them, markers, control characters; a codec that
    cuts or normalises wrongly is found out."""
    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    texts = ["hello world ", " ", "   ", "", None, "▁", "a ▁ b", " lead", "\t\n", "\u0000x", "two  spaces ", "é ß 日本 😀 ", "<s> </s>"]
    rows = sentencepiece_backend.encode(documents(spark, texts), model, check=True).collect()
    assert len(rows) == len(texts) and all(r["parity"] for r in rows)
    wrong = sentencepiece_backend.Codec(sentencepiece_backend.parse(model), model)
    wrong.normalise = lambda text: text.replace(" ", "▁")
    ids, sizes = wrong.encode(["hello world"])
    assert wrong.all_equal(["hello world"], ids, np.array([0, len(ids)])) == [False]


# ---------------------------------------------------------------- language ID, document by document


def brute_language(model, text):
    """Each window by itself, each filter at each place, without folded tables."""
    data, size = text.encode(), model.window
    total = np.zeros(len(model.languages))
    for at in range(0, max(1, len(data)), size):
        x = language_id._FOLD[np.frombuffer(data[at : at + size].ljust(size), dtype=np.uint8)]
        hidden = []
        for w, kernel in zip(language_id.WIDTHS, model.filters):
            places = [sum(model.embedding[x[p + j]].astype(np.float64) @ kernel[j] for j in range(w)) for p in range(size - language_id.SPAN + 1)]
            hidden.append(np.max(places, axis=0))
        z = np.maximum(np.concatenate(hidden) + model.filter_bias, 0) @ model.out + model.out_bias
        z = np.exp(z - z.max())
        total += z / z.sum() * (sum(bool(language_id._LETTER[b]) for b in x) + 1e-9)
    total /= total.sum()
    return model.languages[int(total.argmax())], total.max()


def test_language_of_whole_texts_equals_brute_force(spark):
    """Texts that end at, before and behind the edges of windows, that change language in later
    windows, and short ones; every window of a whole text counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = language_id.Params(rows_per_language=30, epochs=2)
    model = language_id.fit(docs, params=p)
    by = {r["lang"]: r["text"] for r in docs.where("lang is not null and length(text) > 2000").orderBy("doc_id").collect()}
    samples = [t for _, t in sorted(by.items())]
    size = model.window
    texts = ["a", "é ß 日本", "1 2 3 x", samples[0][: size // 2] + samples[-1][: 3 * size]]
    texts += [s.encode()[:n].decode(errors="ignore") for s in samples for n in (size - 1, size, size + 1, 2 * size, 3 * size + 7)]
    got = documents(spark, texts).select("doc_id", language_id.predict(F.col("text"), model).alias("l")).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        want, score = brute_language(model, text)
        assert r["l"]["lang"] == want and abs(r["l"]["score"] - score) < 1e-3
