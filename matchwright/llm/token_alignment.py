"""Alignment of two tokenizers' ids over the bytes of each text.

A text's tokens of either tokenizer are intervals that tile the same bytes. The
intervals of B are a static index: their starts and their ends, both sorted. For each
A token two bisections find the first and the last B token that it overlaps. Where
the overlaps of one A token end before those of the next begin, no token of either
side spans the gap: there a group of tokens ends. Within a group all A tokens are
linked with all B tokens.

A pair of ids is counted over all documents that hold it linked. Documents are taken
in portions of some MB; a portion's distinct pairs meet the counts of the corpus in
a join, and come back to its documents by a cogroup, so the table of pairs is never
whole in one place and a pair that every document holds is one row of each portion.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sentencepiece_backend
from .chunked import Chunks
from .common import small_batches, stored
from .token_files import _Pieces, byte_level_chunks

#: Bytes of text that are aligned at once; links of a group that are listed one by one.
PORTION = 2_000_000
LISTED = 4096
#: Pairs in one row of a portion's list.
PAIRS = 4096


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones of
    Latin-1 for themselves, the others from U+0100 on, in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenBytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(b) for b in table] or [0], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Pair:
    """Both tokenizers: A byte-level, as the tokenizers library has it; B of SentencePiece."""

    def __init__(self, a: str, b: bytes):
        pieces = _Pieces(a, special=False)
        self.a = Chunks(pieces, " ", most=3_000_000)
        alphabet = byte_alphabet()
        vocab = pieces.tok.get_vocab(with_added_tokens=True)
        added = {t.content for t in pieces.tok.get_added_tokens_decoder().values()}
        table = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            table[i] = token.encode() if token in added or any(c not in alphabet for c in token) else bytes(alphabet[c] for c in token)
        self.a_bytes = TokenBytes(table)
        self.b = sentencepiece_backend.Codec(sentencepiece_backend.parse(b))
        self.b_bytes = TokenBytes(self.b.table)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, how many each text has, B ids, how many each text has)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a = self.a.ids([byte_level_chunks(" " + t, self.a.encode.whole) for t in texts])
        return *a, *self.b.encode(texts)


_pairs: dict[int, Pair] = {}


def _pair(a: str, b: bytes) -> Pair:
    key = zlib.crc32(b, zlib.crc32(a.encode()))
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(a, b)
    return _pairs[key]


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first A and the first B token of each group; both sides have tokens, none of
    them without bytes, that tile the same bytes."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    last = np.searchsorted(b_end - b_size, a_end, "left") - 1
    begin = np.concatenate([[True], last[:-1] < first[1:]])
    return np.flatnonzero(begin), first[begin]


@dataclass
class Aligned:
    """Of some documents, in their order: the number of A and B tokens, groups and links, the
    hash of the groups, and each document's distinct pairs with how many links they are.
    pairs has the distinct pairs of all, as A << 32 | B, and docs how many documents hold each."""

    counts: np.ndarray
    hashes: list[str]
    edges: np.ndarray
    which: np.ndarray
    times: np.ndarray
    pairs: np.ndarray
    docs: np.ndarray


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. most, with room for one character more, and how many."""
    width = len(str(most)) + 1
    text = np.array([str(i).ljust(width) for i in range(most + 1)], dtype=f"S{width}")
    size = np.array([len(str(i)) for i in range(most + 1)], dtype=np.int64)
    return np.frombuffer(text.tobytes(), dtype=np.uint8).reshape(most + 1, width), size


_decimal: list = []


def _written(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with its mark behind it, one after another, and where each ends."""
    most = int(ids.max(initial=0))
    if not _decimal or len(_decimal[0]) <= most:
        _decimal[:] = _digits(max(most, 65_535))
    table, size = _decimal
    out, ends = [], np.cumsum(size[ids] + 1)
    for k in range(0, len(ids), 1 << 18):
        own = ids[k : k + (1 << 18)]
        rows = table[own]
        rows[np.arange(len(own)), size[own]] = marks[k : k + (1 << 18)]
        out.append(rows[np.arange(rows.shape[1]) <= size[own][:, None]])
    return np.concatenate(out) if out else np.empty(0, np.uint8), ends


def align(pair: Pair, texts: list[str | None]) -> Aligned:
    """Align each text; null and empty ones, and those whose bytes a tokenizer does not
    give back, have no tokens."""
    n = len(texts)
    counts, hashes = np.zeros((n, 4), dtype=np.int64), [""] * n
    told = [i for i, t in enumerate(texts) if t]
    a_ids, a_n, b_ids, b_n = pair.encode([texts[i] for i in told])
    a_bytes, b_bytes = memoryview(pair.a_bytes.joined(a_ids)), memoryview(pair.b_bytes.joined(b_ids))
    a_at, b_at = (np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(k)])] for size, ids, k in ((pair.a_bytes.size, a_ids, a_n), (pair.b_bytes.size, b_ids, b_n)))
    same = np.zeros(len(told), dtype=bool)
    for k, i in enumerate(told):
        want = (" " + texts[i]).encode()
        same[k] = a_bytes[a_at[k] : a_at[k + 1]] == want and b_bytes[b_at[k] : b_at[k + 1]] == want
    a_ids, b_ids = a_ids[np.repeat(same, a_n)].astype(np.int64), b_ids[np.repeat(same, b_n)].astype(np.int64)
    kept, a_n, b_n = np.array(told, dtype=np.int64)[same], a_n[same], b_n[same]
    none = np.empty(0, np.int64)
    if not len(kept):
        return Aligned(counts, hashes, np.zeros(n + 1, np.int64), none, none, none, none)

    # all documents at once: each ends in a place where tokens of both sides end
    ga, gb = groups(pair.a_bytes.size[a_ids], pair.b_bytes.size[b_ids])
    na, nb = np.diff(np.append(ga, len(a_ids))), np.diff(np.append(gb, len(b_ids)))
    links = na * nb
    a_edges = np.concatenate([[0], np.cumsum(a_n)])
    first = np.searchsorted(ga, a_edges[:-1])
    doc_of = np.repeat(np.arange(len(kept)), np.diff(np.append(first, len(ga))))
    counts[kept, 0], counts[kept, 1] = a_n, b_n
    counts[kept, 2] = np.diff(np.append(first, len(ga)))
    counts[kept, 3] = np.add.reduceat(links, first)

    # the groups in writing: the A ids, then the B ids of each
    total = len(a_ids) + len(b_ids)
    ids, marks = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[np.arange(len(a_ids)) + np.repeat(gb, na)] = a_ids
    ids[np.arange(len(b_ids)) + np.repeat(ga + na, nb)] = b_ids
    marks[ga + na + gb - 1], marks[ga + na + gb + nb - 1] = ord("|"), ord(";")
    flat, ends = _written(ids, marks)
    stop = ends[np.cumsum(a_n + b_n) - 1]
    view = memoryview(flat)
    for k, (begin, end) in enumerate(zip(np.concatenate([[0], stop[:-1]]), stop)):
        hashes[kept[k]] = hashlib.sha256(view[begin : end - 1]).hexdigest()

    # links: one by one in small groups, by distinct ids in large ones
    small = np.flatnonzero(links <= LISTED)
    rep = np.repeat(small, links[small])
    k = np.arange(len(rep)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    code = [a_ids[ga[rep] + k // nb[rep]] << 32 | b_ids[gb[rep] + k % nb[rep]]]
    owner, times = [doc_of[rep]], [np.ones(len(rep), dtype=np.int64)]
    for g in np.flatnonzero(links > LISTED):
        (x, cx), (y, cy) = (np.unique(ids[at : at + size], return_counts=True) for ids, at, size in ((a_ids, ga[g], na[g]), (b_ids, gb[g], nb[g])))
        code.append((x[:, None] << 32 | y[None, :]).ravel())
        owner.append(np.full(len(x) * len(y), doc_of[g]))
        times.append(np.outer(cx, cy).ravel())
    pairs, place = np.unique(np.concatenate(code), return_inverse=True)
    key = np.concatenate(owner) * len(pairs) + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    which, of = key[new] % len(pairs), kept[key[new] // len(pairs)]
    return Aligned(counts, hashes, np.searchsorted(of, np.arange(n + 1)), which, np.add.reduceat(np.concatenate(times)[order], new), pairs, np.bincount(which, minlength=len(pairs)))


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_LINKED = f"portion long, {DOC}, which array<int>, times array<long>, start int, pairs array<long>, docs array<int>"


def _lists(edges: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def _linked(a: str, b: bytes):
    """Rows of documents (pairs: null), and rows with a portion's distinct pairs (which: null)."""

    def run(batches):
        pair = _pair(a, b)
        portion = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held < PORTION):
                    held += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
                    end += 1
                got = align(pair, texts.slice(at, end - at).to_pylist())
                n = end - at
                same = lambda rows: [pa.array(np.full(rows, portion), pa.int64())]
                null = lambda rows, *kinds: [pa.nulls(rows, k) for k in kinds]
                columns = [keys.slice(at, n), *(pa.array(got.counts[:, k]) for k in range(4)), pa.array(got.hashes, pa.string())]
                names = [f.split()[0] for f in _LINKED.split(", ")]
                yield pa.RecordBatch.from_arrays(same(n) + columns + [_lists(got.edges, got.which, pa.int32()), _lists(got.edges, got.times, pa.int64())] + null(n, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())), names=names)
                starts = np.arange(0, len(got.pairs), PAIRS)
                edges, rows = np.append(starts, len(got.pairs)), len(starts)
                if rows:
                    empty = null(rows, *[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(same(rows) + empty + [pa.array(starts, pa.int32()), _lists(edges, got.pairs, pa.int64()), _lists(edges, got.docs, pa.int32())], names=names)
                portion += 1
                at = end

    return run


def linked(docs: DataFrame, a: str, b: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What each document and each portion of documents has: see ``_linked``. Stored, for
    three steps read it."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_linked(a, b), _LINKED), "linked")


def _listed(links: DataFrame) -> DataFrame:
    """(portion, place, pair, docs) of the distinct pairs of each portion."""
    rows = links.where("pairs is not null")
    each = rows.select("portion", "start", F.posexplode(F.arrays_zip("pairs", "docs")).alias("k", "p"))
    return each.select("portion", (F.col("start") + F.col("k")).alias("place"), F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): the documents that hold each pair linked, and whether no pair
    of its A id has more. An A id has as many pairs as B has ids at most."""
    counts = _listed(links).groupBy("pair").agg(F.sum("docs").cast("long").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    size = counts.num_rows
    place = np.asarray(counts.column("place"))
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[place] = np.asarray(counts.column("count"))
    best[place] = np.asarray(counts.column("best").cast(pa.int64()))
    sums = {"n_best": [], "count_sum": []}
    for which, times in zip(docs.column("which").chunks, docs.column("times").chunks):
        edges = np.asarray(which.offsets) - which.offsets[0].as_py()
        w, t = np.asarray(which.flatten()), np.asarray(times.flatten())
        for name, value in (("n_best", best), ("count_sum", count)):
            sums[name].append(np.diff(np.concatenate([[0], np.cumsum(value[w] * t)])[edges]))
    out = docs.select([f.split()[0] for f in DOC.split(", ")])
    for name, parts in sums.items():
        out = out.append_column(name, pa.array(np.concatenate(parts), pa.int64()))
    return out


def align_documents(docs: DataFrame, a: str, b: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row:
    A is the JSON of a byte-level tokenizer, B a SentencePiece model.

    Null and empty texts, and those that either tokenizer does not give back byte for byte
    (the marker character itself, texts that a normaliser changes), have zeros and an
    empty hash, and no pair of theirs counts. The strings of special tokens are plain text.
    Rows that repeat an id are documents each; null ids stay null; an empty table gives
    an empty one. Other columns of ``docs`` are not read."""
    links = linked(docs, a, b, key, text)
    counts = _listed(links).select("portion", "place", "pair").join(pair_counts(links), "pair").select(F.col("portion").alias("of_portion"), "place", "count", "best")
    rows = links.where("pairs is null").select("portion", *[f.split()[0] for f in DOC.split(", ")], "which", "times")
    return rows.groupBy("portion").cogroup(counts.groupBy("of_portion")).applyInArrow(_scored, f"{DOC}, n_best long, count_sum long")
