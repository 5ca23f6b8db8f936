"""Readers, writers, profiling, Java object streams."""

import io
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from matchwright.sources import java_stream, tables
from matchwright.spec import DatasetSpec, FieldSpec
from matchwright.functions import normalize as N


def test_delimited_quirks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id|name|price\n1|"say ""hi""\nthere"|NA\n2||$1,234.50\nx3|z|\n'.encode())
    rows = [tuple(r) for r in tables.read_delimited(spark, str(p), "|").collect()]
    assert rows == [("1", 'say "hi"\nthere', "NA"), ("2", None, "$1,234.50"), ("x3", "z", None)]
    assert tables.read_delimited(spark, str(p), "|").columns == ["id", "name", "price"]
    kept = [tuple(r) for r in tables.read_delimited(spark, str(p), "|", nulls=False).collect()]
    assert kept[1] == ("2", "", "$1,234.50")
    good, dropped = tables.valid_ids(tables.read_delimited(spark, str(p), "|"))
    assert good.count() == 2 and dropped.first()["dropped"] == 1


@pytest.mark.parametrize("sep", ["|", "#", "%", ">", ","])
def test_delimiters(spark, tmp_path, sep):
    df = spark.createDataFrame([("1", f"a{sep}b"), ("2", 'q"q')], "id string, t string")
    tables.write_table(df, str(tmp_path / "x"), "csv", sep=sep)
    assert sorted(tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "x"), sep).collect()) == [("1", f"a{sep}b"), ("2", 'q"q')]


def test_both_formats_and_pipes(spark, tmp_path):
    df = spark.range(3)
    tables.write_table(df, str(tmp_path / "y"), "both")
    assert tables.read_pipe(spark, "parquet", str(tmp_path / "y" / "parquet")).count() == 3
    assert tables.read_pipe(spark, "csv", str(tmp_path / "y" / "csv"), {"header": "true"}, "id long").count() == 3
    tables.register(df, "three")
    assert spark.sql("select count(*) from three").first()[0] == 3


def test_rename_and_spec(spark):
    df = spark.createDataFrame([("1", " A ", "x", "drop")], "`http://e.org/o/id` string, `http://e.org/o/title` string, `http://e.org/o/brand` string, junk string")
    assert tables.rename(df, {"id": "id", "http://e.org/o/title": "t"}).columns[:2] == ["id", "t"]
    with pytest.raises(KeyError):
        tables.rename(df, {"nothing": "x"})
    spec = DatasetSpec("d", FieldSpec("id", "http://e.org/o/id", N.norm_id), (FieldSpec("title", "http://e.org/o/title", N.clean_text), FieldSpec("none", "http://e.org/o/brand", lambda c: F.nullif(c, F.lit("x")), "empty")), {"t1": "substr(title, 1, 1)"}, tag="b")
    assert spec.apply(df).first().asDict() == {"src": "b", "id": "1", "title": "a", "none": "", "t1": "a"}
    assert tables.with_positions(df, list("abcd")).columns == list("abcd")


def test_profile_results_models(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    got = {r["column"]: (r["rows"], r["nulls"], r["null_pct"]) for r in tables.profile(df).collect()}
    assert got == {"a": (2, 0, 0.0), "b": (2, 1, 50.0)}
    assert tables.profile(df.limit(0)).count() == 2
    for k in (1, 2, 1):
        tables.append_result(df, str(tmp_path / "r"), k)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    tables.save_model({"prior": 0.1, "m": {"a": 1}}, str(tmp_path / "m"), spark)
    assert tables.load_model(str(tmp_path / "m"), spark, prior=0.5) == {"prior": 0.5, "m": {"a": 1}}
    a = spark.createDataFrame([("d2", 0.5)], "dataset string, f1 double")
    b = spark.createDataFrame([("D3", 1.0)], "dataset string, t double")
    both, lacking = tables.combine({"x": a, "y": b}, ["dataset", "f1"])
    assert {r["dataset"] for r in both.collect()} == {"D2", "D3"} and lacking == {"y": ["f1"]}


def test_sniffing_and_archives(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "a.txt").write_text("plain text")
    (d / "b_groundtruth.bin").write_bytes(b"\x1f\x8b\x08\x00")
    (d / "c").write_bytes(b"PAR1xxxxPAR1")
    (d / "d").write_bytes(b"\xac\xed\x00\x05p")
    got = {r["path"].rsplit("/", 1)[-1]: r["format"] for r in tables.sniff(spark, str(d)).collect()}
    assert got == {"a.txt": "text", "b_groundtruth.bin": "gzip", "c": "parquet", "d": "java-serialized"}
    assert [r["path"].rsplit("/", 1)[-1] for r in tables.truth_files(spark, str(d)).where("is_truth").collect()] == ["b_groundtruth.bin"]
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        info = tarfile.TarInfo("in/side.csv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"a,b"))
    assert [(r["member"], r["size"]) for r in tables.archive_members(spark, str(tmp_path / "x.tar")).collect()] == [("in/side.csv", 3)]


class Writer:
    """Just enough of the serialization protocol to write a test file."""

    def __init__(self):
        self.out, self.handles = bytearray(struct.pack(">HH", 0xACED, 5)), {}

    def utf(self, s):
        b = s.encode()
        self.out += struct.pack(">H", len(b)) + b

    def string(self, s):
        self.out += b"t"
        self.utf(s)
        self.n = getattr(self, "n", 0) + 1

    def describe(self, name, fields, flags=2):
        if name in self.handles:
            self.out += b"q" + struct.pack(">i", 0x7E0000 + self.handles[name])
            return
        self.out += b"r"
        self.utf(name)
        self.out += struct.pack(">q", 1)
        self.handles[name] = self.n = getattr(self, "n", -1) + 1 if hasattr(self, "n") else 0
        self.out += struct.pack(">BH", flags, len(fields))
        for kind, f in fields:
            self.out += kind.encode()
            self.utf(f)
            if kind == "L":
                self.string("Ljava/lang/Object;")
        self.out += b"xp"

    def begin(self, name, fields, flags=2):
        self.out += b"s"
        self.describe(name, fields, flags)
        self.n += 1

    def collection(self, name, size):
        self.begin(name, [("I", "size")], 3)
        self.out += struct.pack(">i", size) + b"w\x04" + struct.pack(">i", size)


def test_java_streams(spark, tmp_path):
    w = Writer()
    w.collection("java.util.ArrayList", 2)
    for url, attrs in (("u0", [("name", "Ann"), ("city", "Rome")]), ("u1", [("name", "Bob")])):
        w.begin("EntityProfile", [("L", "attributes"), ("L", "entityUrl")])
        w.collection("java.util.ArrayList", len(attrs))
        for k, v in attrs:
            w.begin("Attribute", [("L", "name"), ("L", "value")])
            w.string(k)
            w.string(v)
        w.out += b"x"
        w.string(url)
    w.out += b"x"
    (tmp_path / "p").write_bytes(bytes(w.out))
    got = java_stream.flatten(java_stream.read_profiles(spark, str(tmp_path / "p")), ["name", "city"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "u0", "Ann", "Rome"), (1, "u1", "Bob", None)]
    w = Writer()
    w.collection("java.util.HashSet", 2)
    for a, b in ((0, 5), (7, 0)):
        w.begin("IdDuplicates", [("I", "entityId1"), ("I", "entityId2")])
        w.out += struct.pack(">ii", a, b)
    w.out += b"x"
    (tmp_path / "g").write_bytes(bytes(w.out))
    assert sorted((r["id1"], r["id2"]) for r in java_stream.read_duplicates(spark, str(tmp_path / "g")).collect()) == [(0, 5), (7, 0)]
