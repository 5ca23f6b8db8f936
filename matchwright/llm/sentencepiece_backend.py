"""SentencePiece models on the tokenizers library.

The model file, a protobuf, is parsed here: pieces with scores and kinds, the
trainer's model type and byte fallback, the normaliser's settings. From these
come a normaliser, the metaspace marker, a unigram model with its scores or a
byte-pair model whose merges follow the pieces' scores, byte fallback and a
decoder. Batches are encoded by the library's own threads.

Where no piece holds the marker behind another character, nothing joins across
the place before a run of markers: texts are cut there and each distinct chunk
is encoded once. ``parity`` compares with the sentencepiece library.
"""

from __future__ import annotations

import itertools
import math
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import Chunks
from .common import small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The library's threads in one Python worker.
THREADS = 2


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes):
    """(number, value) of a protobuf message; values of length-prefixed fields are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in a SentencePiece model")
        yield key >> 3, value


def parse(data: bytes) -> SpModel:
    m = SpModel()
    for number, value in _fields(data):
        if number == 1:  # a piece: text, score, type
            p = dict(_fields(value))
            m.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:  # trainer: model_type 3, byte_fallback 35
            t = dict(_fields(value))
            m.kind, m.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
        elif number == 3:  # normaliser: charsmap 2, dummy prefix 3, extra white space 4, escape 5
            n = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
    return m


class Charsmap:
    """The precompiled replacements of a normaliser: a double-array trie over UTF-8
    keys, whose leaves point to zero-ended replacements behind it. The longest key at
    each place is replaced; a character that begins no key stays. (The library's own
    reader of these maps goes by whole graphemes, which gives other texts.)"""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units, self.pool = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
        ascii_keys = {a: self._longest(bytes([a]), 0) for a in range(128)}
        self.table = {a: found[1] for a, found in ascii_keys.items() if found}
        #: Whether ASCII alone is replaced character by character.
        self.single = not any((f := self._longest(bytes([a, b]), 0)) and f[0] == 2 for a in range(128) for b in range(128))
        self._seen: dict[str, str] = {}

    def _longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """(bytes, replacement) of the longest key that begins at ``at``."""
        units = self.units
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, best = step(units[0]), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(0, best[1])].decode()

    def _walk(self, text: str) -> str:
        got = self._seen.get(text)
        if got is None:
            data, out, at = text.encode(), [], 0
            while at < len(data):
                found = self._longest(data, at)
                if found:
                    at += found[0]
                    out.append(found[1])
                else:
                    n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                    out.append(data[at : at + n].decode())
                    at += n
            got = "".join(out)
            if len(text) < 16:
                if len(self._seen) > 50_000:
                    self._seen.clear()
                self._seen[text] = got
        return got

    def __call__(self, text: str) -> str:
        if not self.single:
            return self._walk(text)
        if text.isascii():
            return text.translate(self.table)
        # A character before others that are not ASCII may belong to their key.
        parts = _beyond.split(text)
        parts[0::2] = [p.translate(self.table) for p in parts[0::2]]
        parts[1::2] = [self._walk(p) for p in parts[1::2]]
        return "".join(parts)


_beyond = re.compile(r"([\x00-\x7f]?[^\x00-\x7f]+)")
_spaces = re.compile(" {2,}")


def build(m: SpModel):
    """A tokenizers Tokenizer of the model, for texts that are normalised."""
    from tokenizers import Tokenizer, decoders, models

    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
    elif m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        usable = {p for p, _, kind in m.pieces if kind in (NORMAL, USER)}
        merges = []
        for p, s, kind in m.pieces:
            if kind in (NORMAL, USER) and len(p) > 1:
                merges += [(-s, vocab[p], k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"SentencePiece model type {m.kind} is not supported")
    tok = Tokenizer(core)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return tok


_run = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """Encodes and decodes batches of texts with a parsed model."""

    def __init__(self, m: SpModel, check: bytes | None = None, chunks: bool = True):
        """check: the model file, if the sentencepiece library is to be at hand. chunks: each
        distinct chunk is compared with it as it comes (``equal``); raw texts are compared
        when ``all_equal`` is asked."""
        self.m, self.by_chunk = m, check is not None and chunks
        #: Chunks, or texts that cannot be cut, that the sentencepiece library encodes otherwise.
        self.unequal: set[str] = set()
        self.other = None
        if check is not None:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=check)
        self.tok = build(m)
        self.charsmap = Charsmap(m.charsmap) if m.charsmap else None
        usable = [p for p, _, kind in m.pieces if kind in (NORMAL, USER)]
        self.cuts = MARK in usable and all(MARK not in p.lstrip(MARK) for p in usable) and not any(kind == USER for _, _, kind in m.pieces)
        self.ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        marks = {p: s for p, s, kind in m.pieces if kind == NORMAL and len(p) > 1 and not p.strip(MARK)}
        #: Marker runs of one score merge from the left; the library would merge them by rank.
        self.level = set(marks) if m.kind == BPE and len(set(marks.values())) == 1 else set()
        self.chunks = Chunks(self._new, MARK, most=1_000_000)
        self.table = [self._bytes(p, kind) for p, _, kind in m.pieces]
        sizes = np.array([len(b) for b in self.table], dtype=np.int64)
        self.table_at, self.table_size = np.cumsum(sizes) - sizes, sizes
        self.table_flat = np.frombuffer(b"".join(self.table), dtype=np.uint8)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [i for i, c in enumerate(chunks) if not (self.level and c.startswith(MARK * 3))]
        out: list[list[int]] = [[]] * len(chunks)
        for i, e in zip(plain, self.tok.encode_batch_fast([chunks[i] for i in plain], add_special_tokens=False)):
            out[i] = e.ids
        for i, c in enumerate(chunks):
            if self.level and c.startswith(MARK * 3):
                out[i] = self._marked(c)
        if self.by_chunk:
            lead = 1 if self.m.dummy_prefix else 0
            for c, want, ids in zip(chunks, self.other.encode([c[lead if c[:1] == MARK else 0 :] for c in chunks]), out):
                if want != ids and not self._tied(want, ids):
                    self.unequal.add(c)
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.fromiter(itertools.chain.from_iterable(out), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _tied(self, a: list[int], b: list[int]) -> bool:
        """Whether two unigram segmentations score the same: between such the
        sentencepiece library decides by how its 32-bit sums happen to round."""
        score = lambda ids: sum(self.m.pieces[i][1] for i in ids)
        return self.m.kind == UNIGRAM and math.isclose(score(a), score(b), rel_tol=1e-6)

    def _marked(self, chunk: str) -> list[int]:
        word = chunk.lstrip(MARK)
        k = len(chunk) - len(word)
        tail: list[int] = []
        if word:
            tail = self.tok.encode(MARK + word, add_special_tokens=False).ids
            if tail[0] == self.ids.get(MARK):
                tail = tail[1:]
            else:
                k -= 1
        run, i = [1] * k, 0
        while i < len(run) - 1:
            if MARK * (run[i] + run[i + 1]) in self.level:
                run[i : i + 2] = [run[i] + run[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        return [self.ids[MARK * n] for n in run] + tail

    def normalise(self, text: str) -> str:
        """Characters replaced by the model's map; with ``squeeze`` runs of spaces made
        one, none at the ends; the dummy prefix; spaces as markers."""
        if self.charsmap:
            text = self.charsmap(text)
        if self.m.squeeze:
            text = _spaces.sub(" ", text.lstrip(" "))
        if not text:
            return ""
        if self.m.dummy_prefix:
            text = " " + text
        if self.m.escape:
            text = text.replace(" ", MARK)
        return text.rstrip(MARK if self.m.escape else " ") if self.m.squeeze else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has."""
        if not self.cuts:
            got = self.tok.encode_batch_fast([self.normalise(t) for t in texts], add_special_tokens=False)
            if self.by_chunk:
                self.unequal |= {t for t, e, want in zip(texts, got, self.other.encode(texts)) if e.ids != want}
            sizes = np.array([len(e.ids) for e in got], dtype=np.int64)
            return np.array([i for e in got for i in e.ids], dtype=np.uint32), sizes
        return self.chunks.ids([self._split(t) for t in texts])

    def _split(self, text: str) -> list[str]:
        """The chunks of a text; all but the first without the marker that begins them."""
        t = self.normalise(text)
        if MARK + MARK in t:
            parts = _run.findall(t)
            return ["", *(p[1:] for p in parts)] if t[0] == MARK else [parts[0], *(p[1:] for p in parts[1:])]
        return t.split(MARK) if t else []

    def equal(self, text: str) -> bool:
        """Whether all chunks of a text that was encoded have the ids of the sentencepiece library."""
        if not self.unequal:
            return True
        if not self.cuts:
            return text not in self.unequal
        return not any((c if k == 0 else MARK + c) in self.unequal for k, c in enumerate(self._split(text)))

    def all_equal(self, texts: list[str], ids: np.ndarray, edges: np.ndarray) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each raw text: cuts, normaliser
        and all. ids holds those of all texts, edges where each begins and ends. Each distinct
        text is encoded once."""
        place = {t: i for i, t in enumerate(texts)}
        known = dict(zip(place, self.other.encode(list(place), num_threads=1)))
        same = lambda want, own: want == own or self._tied(want, own)
        return [same(known[t], ids[edges[i] : edges[i + 1]].tolist()) for i, t in enumerate(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: pieces' bytes, markers as spaces, without the first
        space of a dummy prefix; bytes that are no UTF-8 become U+FFFD."""
        data = self.decode_bytes(ids)
        return data.decode("utf-8", errors="replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.table_size[ids]
        ends = np.cumsum(size)
        data = self.table_flat[np.repeat(self.table_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        return data[1:] if self.m.dummy_prefix and data[:1] == b" " else data


_codecs: dict[tuple[int, bool], Codec] = {}


def codec(model: bytes, check: bool = False) -> Codec:
    key = zlib.crc32(model), check
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse(model), model if check else None, chunks=False)
    return _codecs[key]


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", keep_ids: bool = False, place: str | None = None, check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_chars, round_trip[, parity][, ids][, place]) of each
    row, rows in the order of ``docs``. place: a whole-number column that is carried along.
    check: add parity, whether the sentencepiece library gives the same ids for the whole
    raw text.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers. round_trip:
    whether the ids decode to the very text; it fails where the model's
    normaliser changes a text, and for the marker character itself, which reads
    back as a space. A null text counts as empty. Repeated rows are encoded each for
    itself; null and repeated keys stay as they are; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean" + (", parity boolean" if check else "") + (", ids array<int>" if keep_ids else "") + (f", `{place}` long" if place else "")

    def run(batches):
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read once a process, when the library starts its threads
        c = codec(model, check)
        for batch in batches:
            os.environ["TOKENIZERS_PARALLELISM"] = "true"
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):  # some MB of text at a time
                end, held = at, 0
                while end < len(texts) and (end == at or held < 1_000_000):
                    held += len(texts[end].as_buffer()) if texts[end].is_valid else 0
                    end += 1
                raw = [t or "" for t in texts.slice(at, end - at).to_pylist()]
                ids, sizes = c.encode(raw)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                wide = ids.astype("<u4")
                crc, chars, same = [], [], []
                for i, t in enumerate(raw):
                    own = wide[edges[i] : edges[i + 1]]
                    crc.append(zlib.crc32(own.tobytes()))
                    back = c.decode(own)
                    chars.append(len(back))
                    same.append(back == t)
                columns = [keys.slice(at, end - at), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())]
                if check:
                    columns.append(pa.array(c.all_equal(raw, ids, edges), pa.bool_()))
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(wide.view("<i4"), pa.int32())))
                if place:
                    columns.append(batch.column(2).slice(at, end - at))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "round_trip"] + ["parity"] * check + ["ids"] * keep_ids + ([place] if place else []))
                at = end

    carried = [F.col(place).cast("long")] if place else []
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carried).mapInArrow(run, schema)


def parity(model: bytes, texts: list[str]) -> list[int]:
    """Numbers of the texts that the sentencepiece library encodes otherwise."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)
    ids, sizes = codec(model).encode(texts)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return [i for i in range(len(texts)) if other[i] != ids[edges[i] : edges[i + 1]].tolist()]
