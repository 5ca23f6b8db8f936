"""Compaction and cross-tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchwright.llm import compaction, queries, token_alignment

SF = "/root/testdata/sf0.001"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


# ---------------------------------------------------------------- compaction


def local(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def brute_compaction(rows):
    """rows: (click_id, arrived_at, value). The final files, as the query describes them."""
    total = len(rows)
    s = lambda x: 1 + total // x
    days = defaultdict(list)
    for r in rows:
        days[None if r[1] is None else (r[1] - datetime(1970, 1, 1)).days].append(r)
    out = []
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            files[h // 16 % (1 + len(own) // s(150)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[1] or datetime.min, -1 if r[0] is None else r[0]))
        final, open_ = [[k] for k, f in files.items() if len(f) >= s(600)], []
        for k in sorted((k for k, f in files.items() if len(f) < s(600)), key=lambda k: (-len(files[k]), k)):
            for g in open_:
                if sum(len(files[x]) for x in g) + len(files[k]) <= s(500):
                    g.append(k)
                    break
            else:
                open_.append([k])
        for g in final + open_:
            held = [r for k in g for r in files[k]]
            ids = [r[0] for r in held]
            known = [i for i in ids if i is not None]
            out.append(
                (
                    day, g[0][0], g[0][1], len(held), min(known, default=None), max(known, default=None),
                    sum(math.floor(100 * r[2] + 0.5) for r in held if r[2] is not None and math.isfinite(r[2])),
                    ",".join(f"{lot}-{piece}" for lot, piece in g),
                    hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest(),
                    len(g) > 1,
                )
            )
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def told(rows):
    got = [(r["day"], r["lot"], r["piece"], r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) for r in rows]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def test_compaction_query_equals_brute_force(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    rows = queries.op12_compaction(spark, SF).collect()
    assert told(rows) == brute_compaction([(r["click_id"], r["arrived_at"], r["value"]) for r in clicks.collect()])
    assert any(r["rewritten"] for r in rows) and not all(r["rewritten"] for r in rows)
    # the folder holds these files and nothing else, each with all columns in the order of the table
    folder = os.path.dirname(local(rows[0]["path"]))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["path"]) for r in rows)
    for r in rows:
        held = pq.ParquetFile(local(r["path"]))
        assert held.schema_arrow.names == clicks.columns == r["columns"].split(",") and held.metadata.num_rows == r["n_rows"]
    back = spark.read.parquet(folder)
    assert back.schema == clicks.schema
    assert back.exceptAll(clicks).isEmpty() and clicks.exceptAll(back).isEmpty()


def test_compaction_leaves_other_files_as_they_were(spark, monkeypatch):
    """Byte for byte: the files before the merge are copied aside and compared."""
    before = {}
    merge = compaction.merge_files

    def seen(schema, folder, *more):
        for name in os.listdir(local(folder)):
            with open(f"{local(folder)}/{name}", "rb") as f:
                before[name] = f.read()
        return merge(schema, folder, *more)

    monkeypatch.setattr(compaction, "merge_files", seen)
    for r in queries.op12_compaction(spark, SF).collect():
        with open(local(r["path"]), "rb") as f:
            assert r["rewritten"] or f.read() == before[os.path.basename(r["path"])]


def test_compaction_odd_rows_and_clashing_names(spark):
    """Null ids, times and amounts, amounts that are no numbers, repeated rows, one day with most
    rows, columns that are named like the plan's own."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        at = None if i % 50 == 0 else datetime(2024, 1, 1) + timedelta(days=0 if i % 3 else rng.randrange(40), seconds=rng.randrange(86_400))
        value = rng.choice([None, float("nan"), float("inf"), -0.005, 1.005, rng.uniform(-100, 100)])
        rows.append((None if i % 70 == 0 else i // 2, at, at, None, None, value, "{}"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, CLICKS)
    for c in ("day", "lot", "piece", "position", "d", "n_rows", "name", "at_day", "file_name", "odd.name"):
        df = df.withColumn(c, F.lit("mine"))
    got = compaction.compact(df).collect()
    assert told(got) == brute_compaction([(r[0], r[2], r[5]) for r in rows])
    assert {r["columns"] for r in got} == {",".join(df.columns)}
    assert compaction.compact(spark.createDataFrame([], CLICKS)).collect() == []


def test_first_fit_in_blocks_equals_first_fit():
    """The blocks find the earliest group with room, for any sizes."""
    rng = random.Random(8)
    for n in (1, 2, 7, 60, 500):
        for capacity in (10, 100, 1000):
            sizes = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=rng.random() < 0.7)
            fit, room = compaction.FirstFit(capacity, n), []
            for size in sizes:
                want = next((g for g, left in enumerate(room) if left >= size), len(room))
                if want == len(room):
                    room.append(capacity)
                room[want] -= size
                assert fit.place(size) == want
            assert len(fit.most) <= math.isqrt(n) + 3


def test_compaction_refuses_rows_that_the_plan_does_not_know(spark, tmp_path):
    df = spark.createDataFrame([(i, None, datetime(2024, 1, 1, 0, 0, i), None, "k", 1.0, "") for i in range(40)], CLICKS)
    folder, drafts = f"file://{tmp_path}/files", f"file://{tmp_path}/drafts"
    os.makedirs(f"{tmp_path}/files"), os.makedirs(f"{tmp_path}/drafts")
    keyed = df.withColumns({"d": F.lit(1), "l": F.col("click_id") % 2, "p": F.lit(0)})
    files = compaction.write_files(keyed, ["d", "l", "p"], df.columns, folder, drafts, ["arrived_at", "click_id"], 100)
    wrong = compaction.plan(files, 100, 100).withColumn("n_rows", F.col("n_rows") + 1)
    with pytest.raises(Exception, match="the plan says"):
        compaction.merge_files(df.schema, folder, drafts, wrong)
    assert sorted(os.listdir(tmp_path / "files")) == ["small-1-0-0.parquet", "small-1-1-0.parquet"]


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def files():
    with open(queries.vocabulary("byte_bpe_50k.json")) as a, open(queries.vocabulary("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def brute_alignment(files, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(files[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    alphabet = token_alignment.byte_alphabet()

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for t in texts:
        a = [(i, bytes(alphabet[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, piece(i)) for i in sp.encode(t)] if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append(([], [], []))
            continue
        ends = []
        for side in (a, b):
            at = 0
            ends.append([at := at + len(x) for _, x in side])
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in both:
            ga, gb = [], []
            while i < len(a) and ends[0][i] <= e:
                ga.append(a[i][0])
                i += 1
            while j < len(b) and ends[1][j] <= e:
                gb.append(b[j][0])
                j += 1
            groups.append((ga, gb))
        found.append((a, b, groups))
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for *_, groups in found]
    count = Counter(p for own in links for p in own)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (a, b, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(text.encode()).hexdigest() if groups else "", sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items())))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
TEXTS = [
    None, "", " ", "  two  spaces   three ", "a", "\n\n\t x\r\n", "é ß 日本語 😀👩‍👩‍👧 ́", "mark ▁ here", "same text here", "same text here", "<|endoftext|> <s></s><unk> <0x41>",
    "\u0000 zero", "antidisestablishmentarianism " * 40, "=" * 400 + "a" * 3001, "ﬁ ligature   space", "1234567890" * 30, "ends in space ", "न" * 50, "\x1c\x1d odd \x85 breaks ",
]


def test_alignment_query_equals_brute_force(spark, files):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op13_token_alignment(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute_alignment(files, [r["text"] for r in rows])


@pytest.mark.parametrize("portion, listed", [(2_000_000, 4096), (60, 2), (1, 0)])
def test_alignment_of_odd_texts_in_portions_of_any_size(spark, files, monkeypatch, portion, listed):
    """Every portion stands on its own; large groups are counted by distinct ids."""
    monkeypatch.setattr(token_alignment, "PORTION", portion)
    monkeypatch.setattr(token_alignment, "LISTED", listed)
    monkeypatch.setattr(token_alignment, "PAIRS", 3 if portion < 100 else 4096)
    if portion > 100:
        df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("portion", "which", "pairs")})
        got = token_alignment.align_documents(df.repartition(3), *files).orderBy("doc_id").collect()
        assert [tuple(r[c] for c in COLUMNS) for r in got] == brute_alignment(files, TEXTS)
    got = token_alignment.align(token_alignment._pair(*files), TEXTS)
    want = brute_alignment(files, TEXTS)
    assert [(*c, h) for c, h in zip(got.counts.tolist(), got.hashes)] == [w[:5] for w in want]
    assert sum(got.times.tolist()) == sum(w[3] for w in want)


def test_alignment_null_and_repeated_ids_and_empty(spark, files):
    rows = [(None, "one two"), (7, "one two"), (7, None), (None, None), (7, "three")]
    got = token_alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), *files).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute_alignment(files, [r[1] for r in rows]))]
    assert Counter(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in got) == Counter(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align_documents(empty, *files).collect() == []


def test_gaps_never_spanned_end_groups():
    """Against the plain rule, for random tilings: a group ends where both sides end a token."""
    import numpy as np

    rng = random.Random(6)
    for _ in range(200):
        total = rng.randint(1, 40)
        a, b = ([e - s for s, e in zip([0, *cuts], [*cuts, total])] for cuts in (sorted(rng.sample(range(1, total), rng.randrange(total))) for _ in range(2)))
        ga, gb = token_alignment.groups(np.array(a), np.array(b))
        ends = [set(np.cumsum(x).tolist()) for x in (a, b)]
        both = sorted({0} | (ends[0] & ends[1]))[:-1]
        assert [sum(a[:k]) for k in ga] == both == [sum(b[:k]) for k in gb]
