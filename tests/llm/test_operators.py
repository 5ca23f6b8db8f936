"""The corpus operators on small tables: against brute force, and in odd cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchwright.functions import chi2
from matchwright.llm import chat_format, exact_topk, html_extraction, language_id, license_scan, minhash_dedup, queries, sentencepiece_backend, source_mixing, stable_projection_ann, token_files, vector_blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "a", "\n\n", "x " * 50_000, "é ß 日本 😀", "same text here", "same text here", "1 2 3 !!", "\u0000", "<|endoftext|> <s>"]


# ---------------------------------------------------------------- language ID


def test_language_id_learns_without_seeing_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).select("lang", "language_id.*", language_id.held_out(F.col("doc_id")).alias("held")).toPandas()
    kept = got[got.held]
    assert (kept["lang"].iloc[:, 0] == kept["lang"].iloc[:, 1]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_folded_tables_equal_the_network():
    rng = np.random.default_rng(0)
    rows = language_id._FOLD[rng.integers(0, 256, (40, 64), dtype=np.uint8)]
    m = language_id.train(rows, rng.integers(0, 3, 40), ["a", "b", "c"], language_id.Params(window=64, epochs=1))
    seen = m.embedding[rows]
    pooled = []
    for w, k in zip(language_id.WIDTHS, m.filters):
        act = sum(seen[:, j : j + 64 - language_id.SPAN + 1] @ k[j] for j in range(w))
        pooled.append(act.max(axis=1))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + m.filter_bias, 0)
    z = hidden @ m.out + m.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(m.windows(rows), z / z.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_id_sample_is_bounded_and_the_same_in_any_order(spark):
    """Null and repeated ids spread over the sample like others; the model depends on no partitioning."""
    p = language_id.Params(rows_per_language=40, epochs=1)
    rows = [(None if i % 2 else 7, f"{w} number {i} and more of it", w) for i in range(1500) for w in ("the", "der")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = language_id.train
    try:
        language_id.train = lambda x, y, names, q: seen.append((x, y)) or train(x, y, names, q)
        for d in (df, df.unionByName(df).repartition(7)):
            language_id.fit(d, params=language_id.Params(rows_per_language=40 * (1 + (d is not df)), epochs=1))
    finally:
        language_id.train = train
    assert 20 < len(seen[0][0]) < 2 * 2 * 40 * 2 and p.windows_per_row == 2
    assert np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1])


def test_language_id_odd_cases(spark):
    docs = documents(spark, [*ODD, "the cat and the dog", "der hund und die katze"] * 3, {12: "en", 13: "de", 0: None}).withColumn("language_id", F.lit(1))
    got = {r["doc_id"]: r["language_id_"] for r in language_id.identify(docs).collect()}
    assert got[0]["lang"] == "und" and got[1]["lang"] == "und" and got[9]["lang"] == "und" and got[9]["score"] == 0.0
    assert got[6]["lang"] in ("en", "de")
    empty = language_id.identify(docs.limit(0).drop("language_id"))
    assert empty.count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")).drop("language_id"))
    assert {r["lang"] for r in unlabelled.select("language_id.lang").collect()} == {"und"}


# ---------------------------------------------------------------- near-duplicates


def brute_components(texts, p=minhash_dedup.Params()):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(p.words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and p.over * shared >= p.under * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def copies(seed, groups=12, low=1, high=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    passage = rng.choices(vocab, k=60)
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(8, 160))
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(low, high)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_dedup_equals_brute_force(spark, seed):
    texts = [*copies(seed), *ODD, "one two three four", "One two THREE four", "one two three four five"]
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    for i, (n, c) in enumerate(brute_components(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), texts[i][:80] if texts[i] else texts[i]


@pytest.mark.parametrize("p", [minhash_dedup.Params(rounds=0, block=16), minhash_dedup.FOUR_FIFTHS, minhash_dedup.Params(under=80, collisions=12, rounds=0, block_shingles=200)])
def test_minhash_dedup_with_texts_of_all_sizes(spark, p):
    """Sizes from a few words to thousands, pairs near the threshold, a passage that many share."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocab, k=40)
    texts = []
    for size in (6, 9, 20, 33, 60, 120, 400, 3000):
        for _ in range(3):
            base = rng.choices(vocab, k=size) + passage * (size < 60)
            for drop in (0, 0.05, 0.1, 0.15, 0.19, 0.2, 0.25):
                texts.append(" ".join(base[: round(len(base) * (1 - drop))]))
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(documents(spark, texts), p=p).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts, p)]


def test_minhash_dedup_large_group_by_blocks(spark):
    """With no round for pivots but the last, blocks alone must find every link."""
    texts = copies(5, groups=3, low=40, high=60)
    p = minhash_dedup.Params(rounds=0, block=16)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(documents(spark, texts), p=p).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_minhash_dedup_looks_at_a_pair_of_several_lists_once():
    """Two outsiders that three lists hold: of both lists and both sides one has the pair."""
    import numpy as np
    import pyarrow as pa

    p = minhash_dedup.FOUR_FIFTHS
    node, sig, earlier = [b"a", b"b"], np.zeros((2, p.coordinates), dtype=np.int32).tolist(), {5: [], 7: [5], 9: [5, 7]}
    kept = 0
    for key in earlier:
        for u, v in ((0, 1), (1, 0)):
            rows = {"node": [node[u], node[v]], "n": [100, 100], "sig": [sig[u], sig[v]], "comp": [node[u], node[v]], "earlier": pa.array([earlier[key]] * 2, pa.list_(pa.int64())), "main": [False, False], "outsider": [True, False]}
            kept += minhash_dedup._colliding(p)(pa.table(rows)).num_rows
    assert kept == 2


def test_minhash_dedup_null_and_repeated_ids_and_empty(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (5, "z y x w v u"), (None, None)], "doc_id long, text string")
    got = sorted(minhash_dedup.near_duplicates(df).collect(), key=str)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, 3, False), (3, 3, True), (5, 5, True), (None, None, True)}
    assert len(got) == 5
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_minhash_dedup_near_copies_without_an_id_or_with_a_shared_one(spark):
    base = [[f"{c}{i}" for i in range(120)] for c in "abcd"]
    near = [" ".join(x[:-1] + ["other"]) for x in base]
    texts = [" ".join(x) for x in base]
    # a: both ids null; b, c: id 7 stands on two texts, each with a near copy; d: one null
    rows = [(None, texts[0]), (None, near[0]), (7, texts[1]), (7, texts[2]), (8, near[1]), (9, near[2]), (None, texts[3]), (5, near[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (None, 5, False), (5, 5, True)], key=str)


# ---------------------------------------------------------------- vectors


def vectors(spark, n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    rows += [(n, None, 1), (n + 20, [0.0] * dim, 1), (n + 40, [float("nan")] * dim, 1), (None, [1.0] * dim, 1), (n + 60, [None] * dim, 1), (n + 80, [], 1), (n + 100, [1.0, 2.0], 1), (n + 120, [2.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int"), rows


def brute_top(rows, k, scale, zero):
    good = [(i, np.array([np.float64(np.float32(v)) for v in x])) for i, x, _ in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    good = [(i, np.floor(64 * x) if scale else x) for i, x in good if zero or np.any(x != 0)]
    out = {}
    for i, x in good:
        if i % 20 == 0:
            s = sorted([(-float((x * y).sum()), j) for j, y in good if j != i and len(y) == len(x)])[:k]
            out[i] = [(j, -v) for v, j in s]
    return out


@pytest.mark.parametrize("shard_rows", [40, 1000])
def test_exact_top_k_equals_brute_force(spark, shard_rows):
    df, rows = vectors(spark)
    got = exact_topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=shard_rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_top(rows, 20, True, True)
    assert found == {q: [(j, int(v)) for j, v in hits] for q, hits in want.items() if hits}
    assert exact_topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_exact_top_k_with_huge_components(spark):
    df = spark.createDataFrame([(i, [float(10**7 + i), float(i % 3)]) for i in range(0, 60)], "vec_id long, embedding array<double>")
    got = exact_topk.exact_top_k(df, df.where("vec_id = 20"), k=3).orderBy("rank").collect()
    whole = lambda i: [math.floor(64 * (10**7 + i)), 64 * (i % 3)]
    want = sorted(((-sum(a * b for a, b in zip(whole(20), whole(i))), i) for i in range(60) if i != 20))[:3]
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("shard_rows", [60, 1000])
def test_ann_recall_and_scores(spark, shard_rows):
    df, rows = vectors(spark, 600, 16, 3)
    got = stable_projection_ann.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=shard_rows).collect()
    want = brute_top(rows, 20, False, False)
    hit = total = 0
    for q, hits in want.items():
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert len(mine) == len(hits)
        hit += len(mine.keys() & {j for j, _ in hits})
        total += len(hits)
        for j, v in hits:
            assert j not in mine or abs(mine[j] - v) < 1e-9
    assert hit / total >= 0.9
    for q in {r["query_id"] for r in got}:
        ranked = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(-r["score"], r["vec_id"]) for r in ranked] == sorted((-r["score"], r["vec_id"]) for r in ranked)


def test_ann_ties_go_to_the_smaller_id_beyond_any_margin(spark):
    """400 distinct vectors with one score: the 20 smallest ids of those verified, here all.
    Repeated ids and vectors count each."""
    rng = np.random.default_rng(2)
    rows = [(1000, [1.0] + [0.0] * 7)] + [(i, [0.5, *[float(v) for v in rng.integers(-3, 4, 7)]]) for i in range(400)]
    df = spark.createDataFrame(rows + [(7, [0.5] + [1.0] * 7), (7, [0.5] + [1.0] * 7)], "vec_id long, embedding array<double>")
    got = stable_projection_ann.nearest(df, df.where("vec_id = 1000"), k=20, confidence=1 - 1e-12).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [*range(8), 7, 7, *range(8, 18)] and {r["score"] for r in got} == {0.5}
    assert stable_projection_ann.nearest(df.limit(0), df.limit(0)).count() == 0
    exact = exact_topk.exact_top_k(df, df.where("vec_id = 1000"), k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in exact] == [*range(8), 7, 7, *range(8, 18)]


def test_ann_stops_before_half_of_the_vectors(spark):
    """On vectors in groups the chi-square test ends the search early, with a recall of 0.9 or more."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 4000)] + 0.6 * rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    build = stable_projection_ann.build_index(stable_projection_ann.DIMENSIONS, 21)
    tree = vector_blocks.unpack(build(np.arange(len(x)), x))
    limit = chi2.quantile(stable_projection_ann.CONFIDENCE, stable_projection_ann.DIMENSIONS) / stable_projection_ann.RATIO**2
    share = hit = 0
    picked = range(0, len(x), len(x) // 100)
    for i in picked:
        q = tree["x"][i]
        places, score = stable_projection_ann.verified(tree, q, -np.inf, 20, limit)
        assert len(set(places.tolist())) == len(places) and np.allclose(score, tree["x"][places] @ q)
        share += len(places) / len(x) / len(picked)
        best = np.argsort(-(tree["x"] @ q), kind="stable")[:21]
        hit += len(np.intersect1d(best, places)) / 21 / len(picked)
    print(f"verified {share:.3f} of the vectors, recall {hit:.3f}")
    assert share < 0.5 and hit >= 0.9


def test_exact_top_k_bars_above_the_range_of_doubles(spark):
    """Scores above 2**53 that differ by one, over several shards."""
    rng = random.Random(1)
    rows = [(i, [float(2**27), rng.randrange(8) / 64]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1000, [float(2**20), 1 / 64])], "vec_id long, embedding array<double>")
    got = exact_topk.exact_top_k(df, q, k=20, shard_rows=40).orderBy("rank").collect()
    want = sorted((-(2**33 * 2**26 + int(x[1] * 64)), i) for i, x in rows)[:20]
    assert [(-r["score"], r["vec_id"]) for r in got] == want


# ---------------------------------------------------------------- chats


def test_chat_layouts_and_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "<|end|>\n", "|>", "\\b\\p|", "", "a<", "|", "é😀", None]
    rows = [(i, [("user", s), ("assistant", s), ("we|rd\\role", "x")], None, None, None, None) for i, s in enumerate(said)]
    rows += [(100, None, "do", None, "done", None), (101, None, "do", "in", "done", "sys"), (102, None, "do", None, None, None), (103, [], None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>, instruction string, input string, output string, system string").withColumn("turns", F.lit(1))
    f = chat_format.format_chats(df)
    got = {r["id"]: r for r in f.select("id", "layout", "turns", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for i, s in enumerate(said):
        r = got[i]
        assert [(t["role"], t["text"]) for t in r["back"]] == [("user", s or ""), ("assistant", s or ""), ("we|rd\\role", "x")]
        assert "".join(r["loss"]) == (s or "")
    assert got[100]["layout"] == "instruction" and "".join(got[100]["loss"]) == "done"
    assert [t["text"] for t in got[101]["back"]] == ["sys", "do\n\nin", "done"]
    assert got[102]["formatted"] is None and got[103]["formatted"] is None


def test_chat_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "q", "a", "mine")], "id int, question string, answer string, __chat_layout string")
    r = chat_format.format_chats(df).first()
    assert r["__chat_layout"] == "mine" and r["layout"] == "question" and "a" in r["formatted"]


def test_chat_rows_with_nulls_ties_and_empty(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (None, 1, "user", "x"), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in chat_format.from_rows(df).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "x")], 2: [("assistant", "")]}
    assert chat_format.format_chats(chat_format.from_rows(df.limit(0))).count() == 0


# ---------------------------------------------------------------- mixing


def test_pfair_schedule_keeps_every_source_within_a_block(spark):
    rows = [(i, "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(4000)] + [(9000 + i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix", F.lit(0))
    p = source_mixing.Params(period=40, block=4)
    target = {"a": 0.2, "b": 0.5, "c": 0.2, None: 0.1}
    got = source_mixing.mix(df, target=target, p=p).select("doc_id", "source", "mix_.*").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    blocks = {(r["source"], r["block"]): r for r in got}
    assert len({r["slot"] for r in blocks.values()}) == len(blocks)
    for r in blocks.values():
        assert r["release"] <= r["slot"] < r["deadline"]
    weights = {r["source"]: r["weight"] for r in got}
    assert sum(weights.values()) == 40
    ends = {s: max(r["slot"] for r in got if r["source"] == s) for s in weights}
    until = min(ends.values())
    for t in range(until):
        for s, w in weights.items():
            done = sum(1 for (x, _), r in blocks.items() if x == s and r["slot"] < t)
            assert abs(done - t * w / 40) < 1
    assert source_mixing.mix(df.limit(0)).count() == 0


def test_mix_in_order_keeps_all_rows(spark):
    df = documents(spark, [*ODD] * 4, sources={i: f"s{i % 3}" for i in range(40)})
    assert sorted(r["doc_id"] for r in source_mixing.in_order(source_mixing.mix(df)).collect()) == list(range(48))


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_sentencepiece_parity(spark, pieces):
    rng = random.Random(4)
    parts = [" ", "  ", " " * 5, " " * 17, "the", "é", "\n", "日", "▁", "<s>", "<0x41>", "\t", "1", "...", "😀", "\0", "an"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [t or "" for t in ODD]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert sentencepiece_backend.parity(pieces, texts) == []
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    c = sentencepiece_backend.codec(pieces)
    for t in texts[:1500]:
        assert c.decode(c.encode([t])[0]) == sp.decode(sp.encode(t))


def test_sentencepiece_unigram_model_builds():
    m = sentencepiece_backend.SpModel([("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("▁ab", -1.0, 1), ("ab", -1.5, 1)], kind=sentencepiece_backend.UNIGRAM, squeeze=False)
    c = sentencepiece_backend.Codec(m)
    ids, sizes = c.encode(["ab ab", "", "aab"])
    assert ids.tolist() == [4, 4, 1, 2, 5] and sizes.tolist() == [2, 0, 3]


def model_file(pieces, kind, fallback, normaliser):
    """A SentencePiece model as a protobuf: no training, given pieces and scores."""
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def put(number, value):
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value

    made = b"".join(put(1, put(1, p.encode()) + put(2, float(s)) + put(3, k)) for p, s, k in pieces)
    return made + put(2, put(3, kind) + put(35, int(fallback))) + put(3, normaliser)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("fallback", [True, False])
def test_sentencepiece_unigram_models_with_character_maps(spark, pieces, rule, fallback):
    """Unigram scores over the public vocabulary, with the library's own normalising rules."""
    import sentencepiece

    rng = random.Random(1)
    vocab = []
    for i, (p, _, k) in enumerate(sentencepiece_backend.parse(pieces).pieces):
        word = p.lstrip("▁")
        if k == sentencepiece_backend.BYTE and not fallback or k == sentencepiece_backend.NORMAL and ("▁" in word or not word and len(p) > 1):
            continue
        vocab.append((p, -3 - math.log(i + 2) - rng.random() if k == sentencepiece_backend.NORMAL else 0.0, k))
    model = model_file(vocab, sentencepiece_backend.UNIGRAM, fallback, sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    assert sentencepiece_backend.parse(model).kind == sentencepiece_backend.UNIGRAM
    parts = [" ", "  ", "e\u0301", "é", "ﬁ", "\t", "the", "ing", "日", "ﾃﾞ", "①", "½", "\u00a0", "\u3000", "\u1112\u1161\u11ab", "a", "b", "quick", "😀", "\u200d", "\x85", "▁", "Å", "한", "…", "A"]
    texts = ["", " ", "  two  spaces ", "ｆｕｌｌ　ｗｉｄｔｈ", "▁mark ▁▁", "é́ x", *["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]]
    assert sentencepiece_backend.parity(model, texts) == []
    # Over whole long texts the other library adds its 32-bit scores up, so chunks are compared.
    long = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    c = sentencepiece_backend.codec(model, check=True)
    c.encode(texts + long)
    assert c.cuts and not c.unequal and all(map(c.equal, texts + long))
    c.unequal.add("▁the")
    assert not c.equal("see the end") and c.equal("see them")


def test_sentencepiece_query(spark, pieces):
    got = {r["doc_id"]: r for r in sentencepiece_backend.encode(documents(spark, ODD).withColumn("ids", F.lit(1)), pieces, keep_ids=True).collect()}
    c = sentencepiece_backend.codec(pieces)
    for i, t in enumerate(ODD):
        ids = c.encode([t or ""])[0].astype("<u4")
        assert got[i]["ids"] == ids.tolist() and got[i]["ids_crc32"] == zlib.crc32(ids.tobytes()) and got[i]["round_trip"]
    twice = sentencepiece_backend.encode(documents(spark, ["a b", None]).unionByName(documents(spark, ["a b"])).withColumn("parity", F.lit(2)), pieces, check=True).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["parity"]) for r in twice) == [(0, 2, True), (0, 2, True), (1, 0, True)]
    assert sentencepiece_backend.encode(documents(spark, []), pieces, check=True).count() == 0


# ---------------------------------------------------------------- token files


def test_pfor_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([0], [5] * 100, list(range(4096)), [2**32 - 1, 0], rng.integers(0, 50000, 4096).tolist(), [7] * 95 + [2**31] * 5):
        a = np.array(ids, dtype=np.uint32)
        assert token_files.unpack_block(token_files.pack_block(a)).tolist() == ids


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    with open(queries.vocabulary("byte_bpe_50k.json")) as f:
        model = f.read()
    tok = Tokenizer.from_str(model)
    tok.encode_special_tokens = True
    rng = random.Random(3)
    parts = [" ", "a", "\n", "1", "'s", "é", "\t", "!", " ", "x", "\x1c", " "]
    texts = [*ODD, "a  b", "a   b", "  x", "x  ", "\n\n  b c", *["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(800)]]
    files = token_files.write_tokens(documents(spark, texts), token_files.fresh_folder(spark, "test"), model, parts=3)
    got = token_files.read_documents(spark, files).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, enumerate(texts), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    where, name = token_files._open(files[1][1])
    with where.open_input_file(name) as f:
        part = token_files.PartReader(f, f.size())
        k = part.docs // 2
        t = texts[part.keys(k, k + 1)[0]]
        assert part.document(k).tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def test_token_files_equal_the_library_as_it_comes(spark, tmp_path, monkeypatch):
    """The query against a tokenizer that nothing was set on, special tokens in texts included."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "INDEX", 7)
    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*ODD, end, end * 2, f"x {end} y", f" {end}", f"a{end}", f"{end} \n b", f"a b {end[:-1]} c", f" x{end}y z", "", None, f"a  {end}   b"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for i, r in enumerate(queries.op10_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()):
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes())), texts[i]
        start += len(ids)
    assert i == len(texts) - 1


def test_token_files_null_repeated_and_empty(spark):
    with open(queries.vocabulary("byte_bpe_50k.json")) as f:
        model = f.read()
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, None)], "doc_id long, text string")
    files = token_files.write_tokens(df, token_files.fresh_folder(spark, "test"), model)
    got = token_files.read_documents(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2] and [r["n_tokens"] for r in got] == [2, 1, 2, 2]
    none = token_files.write_tokens(df.limit(0), token_files.fresh_folder(spark, "test"), model)
    assert token_files.read_documents(spark, none).count() == 0


# ---------------------------------------------------------------- pages


def test_crf_decodes_like_brute_force():
    field = html_extraction.default_field()
    for page, _ in html_extraction.labelled_pages(30, seed=5):
        blocks = html_extraction.leaf_blocks(page)[:9]
        gains, before = [], None
        for k, (text, marks, link) in enumerate(blocks):
            gains.append(field._path(marks) + sum(field.weights.get(f, 0.0) for f in html_extraction.text_marks(text, link, before, marks)))
            before = marks
        best = max(itertools.product([0, 1], repeat=len(blocks)), key=lambda y: sum(g * v for g, v in zip(gains, y)) + sum(field.pair[a, b] for a, b in zip(y, y[1:])))
        assert [int(x) for x in field.decode(blocks)] == list(best)


def test_crf_on_pages_it_was_not_trained_on():
    field = html_extraction.default_field()
    right = total = 0
    for page, labels in html_extraction.labelled_pages(150, seed=99):
        got = field.decode(html_extraction.leaf_blocks(page))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_extraction_of_given_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_extraction.extract(pages).collect():
        body = re.sub(r"</?(?:b|br)>", " ", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        want = [t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)) if t]
        assert r["main_text"] == "\n\n".join(want)


def test_extraction_odd_pages(spark):
    odd = [None, "", "plain", "<", "<p", "<article><p>a &lt;b&gt; &amp;amp; &eacute;&#233;\n\t x<br>y</p></article>", "<!-- <p>no</p>", "<script>x", "<p>" * 3000, "<a href=\"x" * 200, "<article><p>one<script>var a='</p>'</script> two</p><form><p>name</p></form><p>three</p></article>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(odd)], "page_id int, html string").withColumn("main_text", F.lit(3))
    got = {r["page_id"]: r["main_text"] for r in html_extraction.extract(df).collect()}
    assert got[0] == "" and got[1] == ""
    assert got[5] == "a <b> &amp; éé x y"
    assert got[10] == "one two\n\nthree"
    assert html_extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<script" * 150_000, "<a " * 350_000, "<div>x" * 170_000, "<a" + "b" * 1_000_000, "<" * 1_000_000, '<a x=">" ' * 130_000, '<a href="x' * 100_000, "<li><ul>" + "<div>" * 100_000 + "<li></li>" * 60_000, "<div>" * 100_000 + "</p>" * 130_000, "<p class=" + " " * 1_000_000 + ">x", "<p x='" * 170_000, "</" * 500_000 + ">", "<!--x" * 200_000],
    ids=lambda p: p[:12],
)
def test_extraction_of_a_broken_megabyte_is_fast(page):
    import time

    field = html_extraction.default_field()
    began = time.process_time()
    html_extraction.main_text(field, page)
    assert time.process_time() - began < 2


def test_extraction_leaves_out_controls_and_hidden_text():
    field = html_extraction.default_field()
    some = "and this paragraph of the article goes on with many plain words."
    page = f"""<html><body><article><h1>Title of it</h1><p>Text with <button>Click <b>me</b></button> inside <label>Name</label> {some}</p>
        <p style="display:none">Secret one, {some}</p><p hidden>Secret two, {some}</p><div style="visibility: hidden"><p>Secret three, {some}</p></div>
        <p><select><option>one<option>two</select>Last {some}<!-- no --></p><p>Open <button>lost</p><p>Found again {some}</p></article><!-- <p>gone"""
    want = ["Title of it", f"Text with inside {some}", f"Last {some}", "Open", f"Found again {some}"]
    assert html_extraction.main_text(field, page) == "\n\n".join(want)


def test_extraction_reads_tags_as_a_browser_does():
    blocks = lambda page: [(b[0], b[1].tag) for b in html_extraction.leaf_blocks(page)]
    assert blocks('<p title="a > b">one</p><div class=x>two<p>three<p>four</div>five') == [("one", "p"), ("two", "div"), ("three", "p"), ("four", "p"), ("five", "")]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [(x, "li") for x in "abcd"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>d") == [("a", "td"), ("b", "td"), ("c", "td"), ("d", "")]
    assert blocks("<p>1 < 2 <3 and it's</p>") == [("1 < 2 <3 and it's", "p")]


# ---------------------------------------------------------------- licences


def test_license_scan_base_equals_brute_force(spark):
    texts = [*ODD, "MIT License mit-license. the MIT\nLICENSE é mit license2 Apache License general public license", "license", "general public general public license license mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software and related documentation files", "mit license " * 3000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    docs = documents(spark, texts).withColumn("license_scan", F.lit(0))
    got = {r["doc_id"]: r for r in license_scan.scan(docs).select("doc_id", "license_scan_.*").collect()}
    phrases = [(t.label, t.words) for t in license_scan.TEMPLATES if t.base]
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[15]["labels"] == "mit" and got[15]["base_labels"] == "" and 0.6 <= got[15]["score"] < 1
    assert license_scan.scan(docs.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_licences(texts):
    """Every template at every start of every text, without an index."""
    split = [words_of(t) for t in texts]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in x for x in map(set, split)))) + 1.0 for t in license_scan.TEMPLATES for w in t.words}
    out = []
    for w in split:
        labels, best, have = set(), 0.0, set(w)
        for t in license_scan.TEMPLATES:
            tw, posted = t.words, license_scan.postings(t, idf)
            if not t.keys:
                if any(w[s : s + len(tw)] == tw for s in range(len(w))):
                    labels.add(t.label)
                    best = 1.0
                continue
            anchors = [x for x in posted if x in have][: license_scan.ANCHORS]
            if not anchors or any(w[i : i + len(k)] == k for i in range(len(w)) for _, k in t.phrases) is False:
                continue
            for s in range(len(w)):
                stand = sum(any(tw[r] == x and s + r < len(w) and w[s + r] == x for r in range(len(tw))) for x in anchors)
                if stand < max(min(len(anchors), 2), math.ceil(len(anchors) / 2)) or any(w[s + b : s + b + len(k)] != k for b, k in t.phrases):
                    continue
                total = sum(idf[x] for x in tw)
                weight = 0.0
                for r, x in enumerate(tw):
                    if s + r < len(w) and w[s + r] == x:
                        weight += idf[x] / total
                if min(1.0, weight) >= t.share:
                    labels.add(t.label)
                    best = max(best, min(1.0, weight))
        out.append((",".join(sorted(labels)), best))
    return out


def test_license_scan_labels_and_score_equal_brute_force(spark):
    rng = random.Random(6)
    prose = [f"w{i}" for i in range(300)] + ["software", "license", "copyright", "the", "of", "permission"]
    texts = [*ODD]
    for t in license_scan.TEMPLATES:
        for edits in (0, 0, 1, 3, len(t.words) // 4, len(t.words) // 2):
            words = t.text.split()
            for _ in range(edits):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([["other"], [], [words[k], "more"], [words[k].upper()], [rng.choice(words)]])
                words = words or ["none"]
            texts.append(" ".join(rng.choices(prose, k=rng.randint(0, 30)) + words + rng.choices(prose, k=rng.randint(0, 30))))
    texts.append("\n\n".join(t.text for t in license_scan.TEXTS if t.label == "mit") * 3)
    texts += [" ".join(rng.choices([w for t in license_scan.TEMPLATES for w in t.words], k=400)) for _ in range(20)]
    texts += [t.text for t in license_scan.TEXTS] * 2
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(documents(spark, texts)).select("doc_id", "license_scan.*").collect()}
    want = brute_licences(texts)
    assert [got[i][0] for i in range(len(texts))] == [x for x, _ in want]
    assert [got[i][1] for i in range(len(texts))] == pytest.approx([x for _, x in want], abs=1e-12)
    assert {x for t, (x, _) in zip(texts, want) if t in {y.text for y in license_scan.TEXTS}} >= {"mit", "bsd", "isc", "zlib", "boost", "unlicense"}


# ---------------------------------------------------------------- queries and pipeline


def test_queries_with_sql_agree(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        assert sorted(map(repr, got.astype(object).itertuples(index=False, name=None))) == sorted(map(repr, want.astype(object).itertuples(index=False, name=None))), name


def test_pipeline_against_brute_force(spark, pieces):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    lettered = [r for r in docs if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    comps = brute_components([r["text"] for r in lettered], minhash_dedup.FOUR_FIFTHS)
    want = {r["doc_id"]: r["text"] for k, r in enumerate(lettered) if comps[k][1] == k}
    assert got.keys() == want.keys()
    c = sentencepiece_backend.codec(pieces)
    for k, text in want.items():
        assert got[k]["ids"] == c.encode([text])[0].tolist()


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = documents(spark, [*ODD, "the cat sat on the mat with the other cat"] * 2)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        if k < 3:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() == 6


def test_pipeline_keeps_the_mixture_in_files_of_several_sizes(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, [f"text number {i} " * (1 + i % 3) for i in range(600)]).orderBy("doc_id").toArrow()
    for k, (a, b) in enumerate(((0, 10), (10, 400), (400, 430), (430, 600))):
        pq.write_table(docs.slice(a, b - a), tmp_path / f"part-{k:05d}.parquet")
    read = spark.read.parquet(str(tmp_path))
    assert [r["doc_id"] for r in read.collect()] != list(range(600))
    got = corpus_pipeline.encode_pieces(spark, read, SF).collect()
    assert [(r["doc_id"], r["position"]) for r in got] == [(i, i) for i in range(600)]


def test_pipeline_rows_come_in_the_order_of_the_mixture(spark):
    import corpus_pipeline

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # stage 3 writes several files
    try:
        got = corpus_pipeline.run(spark, SF).select("doc_id", "position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin([r["doc_id"] for r in got]))
    want = [r["doc_id"] for r in source_mixing.in_order(source_mixing.mix(kept)).collect()]
    assert [r["doc_id"] for r in got] == want and [r["position"] for r in got] == list(range(len(want)))


def test_pipeline_keeps_one_row_of_a_group_whatever_its_ids(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(4, a), (4, a), (6, a + " more"), (None, b), (None, b), (None, b + " more"), (None, c), (2, c), (None, d), (9, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    df.coalesce(1).write.parquet(str(tmp_path / "docs"))
    want = sorted([(4, a), (None, b), (2, c), (None, d), (9, None)], key=str)
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
