"""Entity collections from Java object streams, without a JVM class for them.

The stream grammar is that of the Java Object Serialization Specification,
chapter 6. A stream is read into plain values: objects as dicts of their fields
(with the class name under ``#class`` and custom data under ``#data``), arrays
and the common collections as lists.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC, VERSION = 0xACED, 5
# Fixed values of the specification: type codes and class flags.
NULL, REFERENCE, CLASSDESC, OBJECT, STRING, ARRAY, CLASS, BLOCK, END, RESET, BLOCKLONG, EXCEPTION, LONGSTRING, PROXY, ENUM = range(0x70, 0x7F)
BASE_HANDLE, HAS_WRITE, IS_SERIAL, IS_EXTERNAL = 0x7E0000, 1, 2, 4
_PRIMITIVE = {"B": ">b", "C": ">H", "D": ">d", "F": ">f", "I": ">i", "J": ">q", "S": ">h", "Z": ">?"}


class JavaStream:
    def __init__(self, data: bytes):
        self.data, self.at, self.handles = memoryview(data), 0, []
        if self.take(">HH") != (MAGIC, VERSION):
            raise ValueError("not a Java object stream")

    def take(self, form: str):
        got = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return got if len(got) > 1 else got[0]

    def text(self, long: bool = False) -> str:
        n = self.take(">q" if long else ">H")
        raw = bytes(self.data[self.at : self.at + n])
        self.at += n
        # modified UTF-8: a zero as two bytes, higher planes as two surrogates
        text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def keep(self, value):
        self.handles.append(value)
        return value

    def everything(self) -> list:
        out = []
        while self.at < len(self.data):
            out.append(self.value())
        return out

    def value(self):
        code = self.take(">B")
        if code == NULL:
            return None
        if code == REFERENCE:
            return self.handles[self.take(">i") - BASE_HANDLE]
        if code in (STRING, LONGSTRING):
            return self.keep(self.text(code == LONGSTRING))
        if code == OBJECT:
            return self._object()
        if code == ARRAY:
            return self._array()
        if code == CLASSDESC:
            return self._described()
        if code == CLASS:
            return self.keep(self._class())
        if code == ENUM:
            self._class()
            slot = len(self.handles)
            self.handles.append(None)
            self.handles[slot] = self.value()
            return self.handles[slot]
        if code in (BLOCK, BLOCKLONG):
            n = self.take(">B" if code == BLOCK else ">i")
            self.at += n
            return bytes(self.data[self.at - n : self.at])
        if code == RESET:
            self.handles.clear()
            return self.value()
        raise ValueError(f"type code {code:#x} at {self.at - 1}")

    def _class(self):
        code = self.take(">B")
        if code == NULL:
            return None
        if code == REFERENCE:
            return self.handles[self.take(">i") - BASE_HANDLE]
        if code == CLASSDESC:
            return self._described()
        raise ValueError(f"class code {code:#x} at {self.at - 1}")

    def _described(self) -> dict:
        name = self.text()
        self.take(">q")
        about = self.keep({"name": name, "fields": [], "super": None})
        about["flags"] = self.take(">B")
        for _ in range(self.take(">H")):
            kind = chr(self.take(">B"))
            field = self.text()
            if kind in "L[":
                self.value()  # the field's type, as a string
            about["fields"].append((kind, field))
        self._annotation()
        about["super"] = self._class()
        return about

    def _annotation(self) -> list:
        out = []
        while self.data[self.at] != END:
            out.append(self.value())
        self.at += 1
        return out

    def _field(self, kind: str):
        return self.take(_PRIMITIVE[kind]) if kind in _PRIMITIVE else self.value()

    def _object(self):
        about = self._class()
        out = self.keep({"#class": about["name"], "#data": []})
        chain = []
        while about:
            chain.append(about)
            about = about["super"]
        for c in reversed(chain):
            if c["flags"] & IS_EXTERNAL:
                out["#data"] += self._annotation()
                continue
            for kind, field in c["fields"]:
                out[field] = self._field(kind)
            if c["flags"] & HAS_WRITE:
                out["#data"] += self._annotation()
        return out

    def _array(self) -> list:
        about = self._class()
        out = self.keep([])
        for _ in range(self.take(">i")):
            out.append(self._field(about["name"][1]))
        return out


def members(value) -> list:
    """The elements of a list, an ArrayList or a HashSet."""
    return value if isinstance(value, list) else [x for x in value["#data"] if not isinstance(x, bytes)]


def _field_of(obj: dict, *names: str):
    """The first of some fields that the object has; 0 is a value like any other."""
    for n in names:
        if n in obj and obj[n] is not None:
            return obj[n]
    return None


def _batches(parse, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse(path, data)
                for a in range(0, max(1, len(rows)), 50_000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 50_000], schema=schema)

    return run


def _profiles(path: str, data: bytes) -> list[dict]:
    out = []
    for i, p in enumerate(x for top in JavaStream(data).everything() for x in members(top)):
        pairs: dict[str, str] = {}
        for a in members(p["attributes"]):
            name, value = _field_of(a, "name"), _field_of(a, "value")
            if name is not None and value is not None:
                pairs[name] = value if name not in pairs else f"{pairs[name]} {value}"
        out.append({"path": path, "id": i, "url": _field_of(p, "entityUrl", "url"), "attributes": list(pairs.items())})
    return out


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, url, attributes map): entity profiles of serialized collections; the
    id is the profile's place in its file."""
    schema = pa.schema([("path", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_batches(_profiles, schema), "path string, id long, url string, attributes map<string,string>")


def _duplicates(path: str, data: bytes) -> list[dict]:
    out = []
    for d in (x for top in JavaStream(data).everything() for x in members(top)):
        a, b = _field_of(d, "entityId1", "id1"), _field_of(d, "entityId2", "id2")
        if a is not None and b is not None:
            out.append({"path": path, "id1": a, "id2": b})
    return out


def read_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """(path, id1, id2): pairs of serialized ground truth."""
    schema = pa.schema([("path", pa.string()), ("id1", pa.int64()), ("id2", pa.int64())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_batches(_duplicates, schema), "path string, id1 long, id2 long")


def flatten(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """One column for each named attribute."""
    from pyspark.sql import functions as F

    return profiles.select("id", "url", *[F.try_element_at("attributes", F.lit(c)).alias(c) for c in columns])
