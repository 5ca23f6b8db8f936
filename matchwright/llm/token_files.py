"""Token ids in files of patched frame-of-reference blocks.

A part file holds the ids of its documents, in ascending order of doc_id, as
one sequence cut into blocks of ``BLOCK`` ids:

    magic "MWPFOR01"
    each block: u32 minimum, u32 ids, u8 width, u32 exceptions,
                the differences to the minimum, packed at ``width`` bits each,
                u32 positions and u32 differences of the exceptions
    footer:     i64 start of each block, i64 doc_id and i64 first id of each
                document, u8 null mark of each document
    trailer:    i64 start of the footer, i64 blocks, i64 documents, i64 ids, magic

The width is the one at which the ``PERCENTILE`` of a block's differences fit;
larger ones are exceptions, of which the packed part holds the low bits only.
The parts of a corpus are ordered: all documents of one come before those of
the next.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked import Chunks
from .common import shared_dir, small_batches

MAGIC = b"MWPFOR01"
BLOCK = 4096
PERCENTILE = 90
#: Bytes of input that one part is meant to hold, and documents whose index is read at a time.
PART_BYTES = 128 << 20
INDEX = 1 << 16
_HEAD, _TAIL = struct.Struct("<IIBI"), struct.Struct("<qqqq8s")


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another, highest bit first."""
    size = 1 if width <= 8 else 2 if width <= 16 else 4
    wide = np.unpackbits(values.astype(f">u{size}").view(np.uint8)).reshape(len(values), 8 * size)
    return np.packbits(wide[:, 8 * size - width :]).tobytes()


def _values(data, at: int, count: int, width: int) -> np.ndarray:
    size = 1 if width <= 8 else 2 if width <= 16 else 4
    wide = np.zeros((count, 8 * size), dtype=np.uint8)
    wide[:, 8 * size - width :] = np.unpackbits(np.frombuffer(data, np.uint8, -(-count * width // 8), at), count=count * width).reshape(count, width)
    return np.packbits(wide.reshape(-1)).view(f">u{size}").astype(np.uint32)


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    over = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(over, k := min(len(over) - 1, len(over) * PERCENTILE // 100))[k]).bit_length()
    out = np.flatnonzero(over >> np.uint32(width) if width < 32 else np.zeros_like(over)).astype("<u4")
    return _HEAD.pack(low, len(ids), width, len(out)) + _bits(over, width) + out.tobytes() + over[out].astype("<u4").tobytes()


def unpack_block(data: bytes | memoryview) -> np.ndarray:
    low, n, width, extra = _HEAD.unpack_from(data)
    over = _values(data, _HEAD.size, n, width)
    if extra:
        at = _HEAD.size + -(-n * width // 8)
        over[np.frombuffer(data, "<u4", extra, at)] = np.frombuffer(data, "<u4", extra, at + 4 * extra)
    return over + np.uint32(low)


class PartWriter:
    """Takes documents in order and writes one part, block by block."""

    def __init__(self, out):
        self.out, self.at = out, out.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.held = self.ids = 0
        self.blocks, self.keys, self.firsts, self.nulls = array("q"), array("q"), array("q"), array("B")

    def add(self, keys: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.ids + np.cumsum(sizes)
        self.firsts.frombytes(np.asarray(ends - sizes, dtype=np.int64).tobytes())
        self.keys.extend(0 if k is None else k for k in keys)
        self.nulls.extend(k is None for k in keys)
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        end = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            self.blocks.append(self.at)
            self.at += self.out.write(pack_block(ids[a : min(a + BLOCK, end)]))
        self.rest, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for kind, values in (("<i8", self.blocks), ("<i8", self.keys), ("<i8", self.firsts), ("u1", self.nulls)):
            self.out.write(np.asarray(values, dtype=kind).tobytes())
        self.out.write(_TAIL.pack(self.at, len(self.blocks), len(self.keys), self.ids, MAGIC))


class PartReader:
    """Reads a part; of its index no more than is asked for."""

    def __init__(self, file, size: int):
        file.seek(size - _TAIL.size)
        self.foot, self.count, self.docs, self.ids, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.file = file

    def _index(self, kind: str, start: int, first: int, last: int) -> np.ndarray:
        each = np.dtype(kind).itemsize
        self.file.seek(self.foot + start + each * first)
        return np.frombuffer(self.file.read(each * (last - first)), kind)

    def keys(self, first: int, last: int) -> np.ndarray:
        return self._index("<i8", 8 * self.count, first, last)

    def firsts(self, first: int, last: int) -> np.ndarray:
        """The first ids of documents, with the end of all ids behind the last one."""
        got = self._index("<i8", 8 * (self.count + self.docs), first, min(last, self.docs))
        return got if last <= self.docs else np.append(got, self.ids)

    def nulls(self, first: int, last: int) -> np.ndarray:
        return self._index("u1", 8 * (self.count + 2 * self.docs), first, last).astype(bool)

    def span(self, first: int, last: int) -> np.ndarray:
        """The ids from number ``first`` to before ``last``, from their blocks only."""
        if last <= first:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        edges = self._index("<i8", 0, a, min(b + 1, self.count))
        edges = edges if b < self.count else np.append(edges, self.foot)
        self.file.seek(int(edges[0]))
        data = memoryview(self.file.read(int(edges[-1] - edges[0])))
        ids = np.concatenate([unpack_block(data[i - edges[0] : j - edges[0]]) for i, j in zip(edges, edges[1:])])
        return ids[first - a * BLOCK : last - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        first, last = self.firsts(k, k + 2)
        return self.span(int(first), int(last))

    def groups(self, most: int = 256 * BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, null marks, edges, ids) of runs of documents with about ``most`` ids."""
        for begin in range(0, self.docs, INDEX):
            end = min(begin + INDEX, self.docs)
            keys, nulls, edges = self.keys(begin, end), self.nulls(begin, end), self.firsts(begin, end + 1)
            a = 0
            while a < end - begin:
                b = max(a + 1, int(np.searchsorted(edges[1:], edges[a] + most, "right")))
                yield keys[a:b], nulls[a:b], edges[a : b + 1], self.span(int(edges[a]), int(edges[b]))
                a = b


_three = re.compile(r"\s\s\s|\s\s\Z")
_encoders: dict[int, Chunks] = {}


def byte_level_chunks(text: str, whole: re.Pattern | None = None) -> list[str]:
    """Cuts a text before single spaces. The byte-level pre-tokenizer starts a new
    piece there, unless white space stands on both sides: such a text stays whole, and
    so does one in which ``whole`` finds a special token's string."""
    return [text] if _three.search(text) or (whole and whole.search(text)) else text.split(" ")


class _Pieces:
    """Encodes chunks many at a time. Chunks that begin with a space and end in no white
    space are joined to long texts, whose pieces begin anew at each chunk; the ids are
    dealt back by the number of bytes that each stands for. special: whether the string
    of an added token in a text is that token, as the library has it by default."""

    JOIN = 1000

    def __init__(self, model: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.tok.encode_special_tokens = not special
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if special or not t.special]
        self.whole = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        vocab = self.tok.get_vocab(with_added_tokens=False)
        #: In a byte-level vocabulary each character of a token is one byte.
        self.size = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)

    def __call__(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; a worker may have run other operators before
        joined, alone = [], []
        for i, c in enumerate(new):
            (joined if c[:1] == " " and not c[-1].isspace() and not (self.whole and self.whole.search(c)) else alone).append(i)
        plain = [new[i] for i in joined]
        texts = ["".join(plain[a : a + self.JOIN]) for a in range(0, len(plain), self.JOIN)]
        got = [e.ids for e in self.tok.encode_batch_fast(texts + [new[i] for i in alone], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(got[: len(texts)]), dtype=np.uint32)
        reach = np.cumsum(self.size[ids])
        lengths = np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in plain), dtype=np.int64, count=len(plain))
        ends = np.searchsorted(reach, np.cumsum(lengths)) + 1
        rest = [np.asarray(x, dtype=np.uint32) for x in got[len(texts) :]]
        sizes = np.empty(len(new), dtype=np.int64)
        sizes[joined] = np.diff(ends, prepend=0)
        sizes[alone] = [len(x) for x in rest]
        # the chunks' own order: joined ones and others stand in two runs
        flat = np.concatenate([ids, *rest])
        order = np.array(joined + alone, dtype=np.int64)
        starts = np.empty(len(new), dtype=np.int64)
        in_run = sizes[order]
        starts[order] = np.cumsum(in_run) - in_run
        at = np.cumsum(sizes)
        return flat[np.repeat(starts - (at - sizes), sizes) + np.arange(len(flat))], sizes


def _encoder(model: str, special: bool = False) -> Chunks:
    key = hash((model, special))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Chunks(_Pieces(model, special), " ", most=9_000_000)
    return _encoders[key]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, model: str, end_id: int, special: bool):
    def run(batches):
        chunks = _encoder(model, special)
        where, base = _open(folder)
        part = TaskContext.get().partitionId()
        final, draft = f"{base}/part-{part:06d}.tok", f"{base}/_draft-{part:06d}-{uuid.uuid4().hex}"
        docs = ids_written = 0
        with where.open_output_stream(draft) as out:
            writer = PartWriter(out)
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                at = 0
                while at < len(texts):
                    end, held = at, 0
                    while end < len(texts) and (end == at or held < 1_000_000):
                        held += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
                        end += 1
                    split = [byte_level_chunks(t or "", chunks.encode.whole) for t in texts.slice(at, end - at).to_pylist()]
                    ids, sizes = chunks.ids(split)
                    ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                    writer.add(keys[at:end], ids, sizes + 1)
                    at = end
            writer.close()
            docs, ids_written = len(writer.keys), writer.ids
        where.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}.tok"]), pa.array([docs], pa.int64()), pa.array([ids_written], pa.int64())], names=["part", "path", "docs", "ids"])

    return run


def write_tokens(docs: DataFrame, folder: str, model: str, end_id: int = 2, key: str = "doc_id", text: str = "text", parts: int | None = None, special: bool = False) -> list[tuple[int, str, int, int]]:
    """Encode every text (null: empty) with the tokenizers model ``model`` (its
    JSON), append ``end_id``, write part files in ascending order of ``key`` to
    ``folder`` (a URI that executors share). Gives (part, path, documents, ids)
    of each file, in order. Null keys come first; rows that repeat a key stay,
    in the order of a hash of their text. A repeated attempt of a task writes
    the same bytes and replaces the file in one move; an empty table gives no document.

    special: whether a text that spells an added token (``<|endoftext|>``) means that
    token, as the library has it by default, or plain text. parts: by default as many
    as the session has shuffle partitions, more where the plan's size asks for it."""
    spark = docs.sparkSession
    small_batches(spark)
    where, base = _open(folder)
    where.create_dir(base, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts or max(least, min(size // PART_BYTES, 1_000_000) if size < 1 << 62 else least)
    dealt = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    made = dealt.mapInArrow(_write(folder, model, end_id, special), "part int, path string, docs long, ids long").collect()
    return sorted((r["part"], r["path"], r["docs"], r["ids"]) for r in made)


def read_documents(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""
    rows, start = [], 0
    for _, path, _, ids in files:
        rows.append((path, start))
        start += ids

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, name = _open(path)
                with where.open_input_file(name) as file:
                    part = PartReader(file, file.size())
                    for keys, nulls, edges, ids in part.groups():
                        data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                        off = (edges - edges[0]) * 4
                        crc = [zlib.crc32(data[i:j]) for i, j in zip(off, off[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64(), mask=nulls), pa.array(base + edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(spark: SparkSession, name: str) -> str:
    root = shared_dir(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/{name}-{uuid.uuid4().hex}"
