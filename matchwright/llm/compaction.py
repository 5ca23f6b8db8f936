"""Compaction of small files into bins, planned by first fit and executed by Spark.

1. Rows are dealt to files by a key, sorted and written: each run of a key is a
   stream into one file, under a draft's name until it is whole.
2. The small files of a bucket, by descending rows, each join the earliest-opened
   group that has room for them. The groups stand in blocks of about the square root
   of the files, and each block knows the most room that any of its groups has left:
   the first block with enough is found among the blocks, the group within it. A
   bucket's files are planned by one task, buckets apart.
3. The plan and the rows of the small files are cogrouped: both are dealt by the file
   that is to be, and sorted, so that a task reads the sources of a file with their
   sizes first and then their rows in joining order, as a stream. What it read has to
   be what the plan says. No file is ever whole in memory.
4. Sources go once all new files stand. Files that are not merged are not touched.

A repeated attempt of a task writes a draft of its own and moves it to the same name,
so a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, temp_name
from .token_files import fresh_folder

#: Bytes of rows that become one row group of a file.
ROW_GROUP = 32 << 20
#: Buckets whose sizes may be broadcast: some MB.
BUCKETS = 100_000
KEY = "day long, lot long, piece long"
_FILE = f"{KEY}, name string, n_rows long, columns string"
_NONE = -(1 << 62)


class FirstFit:
    """Groups of one capacity, in the order in which they were opened."""

    def __init__(self, capacity: int, items: int):
        """items: how many are to come; the blocks hold about the root of it."""
        self.capacity, self.width = capacity, max(1, math.isqrt(items))
        self.room: list[int] = []
        #: The most room in each block of ``width`` groups.
        self.most: list[int] = []

    def place(self, size: int) -> int:
        """The number of the earliest group that has room for ``size``, or of a new one;
        what is larger than a group has a new one for itself."""
        block = next((b for b, most in enumerate(self.most) if most >= size), None)
        if block is None:
            group, block = len(self.room), len(self.room) // self.width
            self.room.append(max(self.capacity, size))
            if block == len(self.most):
                self.most.append(0)
        else:
            begin = block * self.width
            group = begin + next(k for k, room in enumerate(self.room[begin : begin + self.width]) if room >= size)
        self.room[group] -= size
        self.most[block] = max(self.room[block * self.width : (block + 1) * self.width])
        return group


def first_fit(files: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """(day, name, lot, piece, position, members) of each file: the lot and piece of the first
    file of its group, its place in the group and how many the group has."""
    files = files.sort_values(["n_rows", "lot", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    fit = FirstFit(capacity, len(files))
    group = np.array([fit.place(int(n)) for n in files["n_rows"]], dtype=np.int64)
    by = files.assign(group=group).groupby("group", sort=False)
    out = files[["day", "name", "n_rows"]].copy()
    out["source"] = files["lot"].astype(str) + "-" + files["piece"].astype(str)
    out["lot"], out["piece"] = by["lot"].transform("first"), by["piece"].transform("first")
    out["position"], out["members"] = by.cumcount(), by["name"].transform("size")
    return out


_PLAN = f"{KEY}, name string, n_rows long, source string, position long, members long"


def plan(files: DataFrame, limit: int, capacity: int) -> DataFrame:
    """The groups of the files under ``limit`` rows (all others are left out), a row for each."""
    names = [f.split()[0] for f in _PLAN.split(", ")]
    return files.where(F.col("n_rows") < limit).groupBy("day").applyInPandas(lambda rows: first_fit(rows, capacity)[names], _PLAN)


# ---------------------------------------------------------------- files


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, rows) of the runs of equal keys in a batch."""
    columns = [np.asarray(batch.column(k).fill_null(_NONE)) for k in range(keys)]
    change = np.zeros(batch.num_rows, dtype=bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(np.concatenate([[True], change[1:]])) if batch.num_rows else []
    for s, e in zip(starts, [*starts[1:], batch.num_rows]):
        yield tuple(int(c[s]) for c in columns), int(s), int(e - s)


class _File:
    """One file as it is written: a draft that is moved to its name once it is whole."""

    def __init__(self, folder: str, drafts: str, key: tuple):
        self.where, self.base = pafs.FileSystem.from_uri(folder)
        self.draft = f"{pafs.FileSystem.from_uri(drafts)[1]}/{uuid.uuid4().hex}"
        self.key, self.rows, self.held = key, 0, 0
        self.waiting: list[pa.RecordBatch] = []
        self.writer = None

    def add(self, batch: pa.RecordBatch) -> None:
        self.waiting.append(batch)
        self.rows += batch.num_rows
        self.held += batch.nbytes
        if self.held >= ROW_GROUP:
            self._flush()

    def _flush(self) -> None:
        rows = pa.Table.from_batches(self.waiting)
        if self.writer is None:
            self.schema = rows.schema
            self.writer = pq.ParquetWriter(self.draft, self.schema, filesystem=self.where)
        self.writer.write_table(rows, row_group_size=max(1, rows.num_rows))
        self.waiting, self.held = [], 0

    def close(self, kind: str) -> pa.RecordBatch:
        if self.waiting:
            self._flush()
        self.writer.close()
        day, *rest = self.key
        name = "-".join([kind, "null" if day == _NONE else str(day), *map(str, rest)]) + ".parquet"
        self.where.move(self.draft, f"{self.base}/{name}")
        values = [None if day == _NONE else day, *rest, name, self.rows, ",".join(self.schema.names)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()])], names=[f.split()[0] for f in _FILE.split(", ")])


def _write(folder: str, drafts: str, limit: int, columns: list[str]):
    """Files of sorted rows whose first three columns are the key, the others ``columns``."""

    def run(batches):
        file = None
        kind = lambda f: "small" if f.rows < limit else "full"
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns[3:], names=columns)
            for key, at, n in _runs(batch, 3):
                if file is not None and file.key != key:
                    yield file.close(kind(file))
                    file = None
                file = file or _File(folder, drafts, key)
                file.add(rows.slice(at, n))
        if file is not None:
            yield file.close(kind(file))

    return run


def _merge(folder: str, drafts: str, columns: list[str]):
    """Files of sorted rows: three columns of the key, the source's position (-1: a row of
    the plan, which come first), the row's number (of the plan: the position) and the rows
    that the plan expects of the source."""

    def finished(file: _File, expected: dict[int, int], seen: dict[int, int]) -> pa.RecordBatch:
        if expected != seen:
            raise RuntimeError(f"sources of {file.key} have {seen} rows, the plan says {expected}")
        return file.close("merged")

    def run(batches):
        file, expected, seen = None, {}, {}
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns[6:], names=columns)
            for (*key, position), at, n in _runs(batch, 4):
                if file is not None and file.key != tuple(key):
                    yield finished(file, expected, seen)
                    file = None
                if file is None:
                    file, expected, seen = _File(folder, drafts, tuple(key)), {}, {}
                if position < 0:
                    expected |= dict(zip(batch.column(4).slice(at, n).to_pylist(), batch.column(5).slice(at, n).to_pylist()))
                else:
                    seen[position] = seen.get(position, 0) + n
                    file.add(rows.slice(at, n))
        if file is not None:
            yield finished(file, expected, seen)

    return run


def write_files(keyed: DataFrame, keys: list[str], columns: list[str], folder: str, drafts: str, order: list[str], limit: int) -> DataFrame:
    """Write one file of the named columns for each value of ``keys`` (a day, a lot and a piece),
    its rows sorted by ``order``, then by the other columns that can be sorted; a file of
    fewer than ``limit`` rows is called small. Gives (day, lot, piece, name, n_rows, columns)
    of each."""
    names, plain = [f"k{i}" for i in range(3)], {c: f"v{i}" for i, c in enumerate(columns)}
    dealt = keyed.select(*[F.col(k).cast("long").alias(n) for k, n in zip(keys, names)], *[F.col(f"`{c}`").alias(n) for c, n in plain.items()])
    rest = [f.name for f in dealt.schema.fields[3:] if f.dataType.typeName() not in ("map", "variant")]
    dealt = dealt.repartition(*names).sortWithinPartitions(*names, *[plain[c] for c in order], *rest)
    return stored(dealt.mapInArrow(_write(folder, drafts, limit, columns), _FILE), "files")


def merge_files(schema, folder: str, drafts: str, merges: DataFrame) -> DataFrame:
    """Write one file of the sources of each group of ``merges``, see ``plan``."""
    rows = merges.sparkSession.read.schema(schema).parquet(f"{folder}/small-*.parquet")
    names, plain = [f"k{i}" for i in range(6)], {c: f"v{i}" for i, c in enumerate(rows.columns)}
    key = [F.col(c).alias(n) for c, n in zip(("day", "lot", "piece"), names)]
    found = rows.select(F.col("_metadata.file_name").alias("of"), F.col("_metadata.row_index").alias("k4"), F.lit(None).cast("long").alias("k5"), *[F.col(f"`{c}`").alias(n) for c, n in plain.items()])
    data = found.join(merges.select(*key, F.col("position").alias("k3"), F.col("name").alias("of")), "of").select(*names, *plain.values())
    told = merges.select(*key, F.lit(-1).cast("long").alias("k3"), F.col("position").alias("k4"), F.col("n_rows").alias("k5"))
    both = data.unionByName(told, allowMissingColumns=True).select(*names, *plain.values())
    dealt = both.repartition(*names[:3]).sortWithinPartitions(*names[:5])
    return stored(dealt.mapInArrow(_merge(folder, drafts, rows.columns), _FILE), "merged")


def remove_files(names: DataFrame, folder: str) -> None:
    """Delete the files named; what is gone already was deleted by an earlier attempt."""

    def run(batches):
        where, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    where.delete_file(f"{base}/{name}")
                except FileNotFoundError:
                    pass
            yield batch

    names.select("name").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


# ---------------------------------------------------------------- reading back


def read_back(spark, schema, folder: str, id_column: str, amount: Column) -> DataFrame:
    """(name, path, n_rows, min_id, max_id, amount, ids_sha256) of each file of the folder: the
    ids in the order of the file, read as a stream."""
    rows = spark.read.schema(schema).parquet(folder)
    names = [temp_name(rows, n) for n in ("path", "row")]
    narrow = rows.select(F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]), F.col(f"`{id_column}`").cast("long").alias("id"), amount.cast("long").alias("amount"))
    kind = "path string, n_rows long, min_id long, max_id long, amount long, ids_sha256 string"

    def run(batches):
        path = digest = None
        n = total = 0
        low = high = None

        def told():
            values = [path, n, low, high, total, digest.hexdigest()]
            kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in kind.split(", ")])

        for batch in batches:
            paths = batch.column(0)
            at = 0
            while at < len(paths):
                now = paths[at].as_py()
                # the rows of a path stand together
                last = int(np.searchsorted(np.asarray(pc.not_equal(paths, now).slice(at).cast(pa.int8())), 1)) + at
                if now != path:
                    if path is not None:
                        yield told()
                    path, digest, n, total, low, high = now, hashlib.sha256(), 0, 0, None, None
                ids, amounts = batch.column(2).slice(at, last - at), batch.column(3).slice(at, last - at)
                digest.update(((b"," if n else b"") + ",".join("" if i is None else str(i) for i in ids.to_pylist()).encode()))
                n += last - at
                total += sum(x or 0 for x in amounts.to_pylist())
                ends = pc.min_max(ids).as_py()
                low = ends["min"] if low is None else min(low, ends["min"] if ends["min"] is not None else low)
                high = ends["max"] if high is None else max(high, ends["max"] if ends["max"] is not None else high)
                at = last
        if path is not None:
            yield told()

    got = narrow.repartition(names[0]).sortWithinPartitions(*names).mapInArrow(run, kind)
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "*")


def compact(rows: DataFrame, id_column: str = "click_id", time_column: str = "arrived_at", value_column: str = "value") -> DataFrame:
    """Write ``rows`` as Parquet to a new folder in ``spark.checkpoint.dir``, merge its small
    files and describe what then stands there: (day, lot, piece, n_rows, min_click_id,
    max_click_id, cents, sources, ids_sha256, columns, path, rewritten) of each file. A path
    in a local file system comes without its scheme.

    Rows without a time are a day of their own (null, ``null`` in the names of files); a null
    id counts as an empty text; amounts that are null or not finite count zero. Repeated rows
    stay, next to each other; an empty table gives no file. Columns with names of the plan's
    own are left alone. With 150, 500 and 600 parts of the table as sizes there are at most
    some hundred files a day, however many the rows."""
    spark = rows.sparkSession
    small_batches(spark)
    root = fresh_folder(spark, "compaction")
    folder, drafts = f"{root}/files", f"{root}/drafts"
    for f in (folder, drafts):
        where, base = pafs.FileSystem.from_uri(f)
        where.create_dir(base, recursive=True)

    columns, schema = rows.columns, rows.schema
    time = lambda: F.unix_date(F.col(f"`{time_column}`").cast("date")).cast("long")
    own = [temp_name(rows, n) for n in ("at_day", "of_day", "day_rows")]
    sizes = stored(rows.groupBy(time().alias(own[1])).agg(F.count("*").alias(own[2])), "days")
    total, days = sizes.agg(F.coalesce(F.sum(own[2]), F.lit(0)), F.count("*")).first()
    part = lambda x: 1 + total // x
    sized = rows.withColumn(own[0], time()).join(F.broadcast(sizes) if days <= BUCKETS else sizes, F.col(own[0]).eqNullSafe(F.col(own[1])))
    h = F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")))
    lots = 1 + F.floor(F.col(own[2]) / part(150))
    keys = [F.col(own[0]), F.pmod(F.floor(h / 16), lots), F.least(F.pmod(h, F.lit(4)), F.pmod(F.floor(h / 4), F.lit(4)))]
    named = {temp_name(sized, n): k for n, k in zip(("d", "l", "p"), keys)}
    files = write_files(sized.withColumns(named), list(named), columns, folder, drafts, [time_column, id_column], part(600))

    grouped = stored(plan(files, part(600), part(500)), "plan")
    merges = grouped.where("members > 1")
    single = files.join(merges.select("name"), "name", "left_anti").select("name", "day", "lot", "piece", F.concat("lot", F.lit("-"), "piece").alias("sources"), "columns", F.lit(False).alias("rewritten"))
    final = single
    if not merges.isEmpty():
        merged = merge_files(schema, folder, drafts, merges)
        remove_files(merges, folder)
        joined = merges.groupBy("day", "lot", "piece").agg(F.array_sort(F.collect_list(F.struct("position", "source"))).alias("s"))
        joined = joined.select(F.col("day").alias("d"), F.col("lot").alias("l"), F.col("piece").alias("p"), F.array_join("s.source", ",").alias("sources"))
        told = merged.join(joined, F.col("day").eqNullSafe(F.col("d")) & (F.col("lot") == F.col("l")) & (F.col("piece") == F.col("p")))
        final = single.unionByName(told.select("name", "day", "lot", "piece", "sources", "columns", F.lit(True).alias("rewritten")))

    value = F.col(f"`{value_column}`").cast("double")
    cents = F.when(F.abs(value) < 9e16, F.floor(100 * value + 0.5)).otherwise(F.lit(0))
    back = read_back(spark, schema, folder, id_column, cents)
    return back.join(final, "name").select("day", "lot", "piece", "n_rows", F.col("min_id").alias("min_click_id"), F.col("max_id").alias("max_click_id"), F.col("amount").alias("cents"), "sources", "ids_sha256", "columns", F.regexp_replace("path", "^file:/+", "/").alias("path"), "rewritten")

