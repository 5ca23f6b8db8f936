"""Near-duplicates by SimHash fingerprints and the general pigeonhole principle.

1. Each bit of a 64-bit fingerprint is the majority of that bit over a text's
   shingle hashes. Equal fingerprints form one node.
2. The bits are grouped into partitions, correlated bits together, from the counts
   of each pair of bits over all fingerprints. Two fingerprints within a distance of
   ``t`` lie within ``r[i]`` in some partition ``i`` of ``m`` whenever the thresholds
   ``r[i] >= -1`` add up to ``t - m + 1``; a partition with -1 is left out.
3. For layouts of several numbers of partitions the pairs that agree in each partition
   are counted over all fingerprints; with the bits' own odds that estimates the
   candidates of every threshold, and a dynamic programme allots the thresholds
   of least cost. Any layout finds all links: only the work differs.
4. Fingerprints are posted under their value in each partition, and under the values
   within the partition's threshold (probes). Runs of one value are verified on all
   64 bits; what comes out of a run is a spanning forest, never all its pairs. A run
   of more than ``most`` rows is dealt to (part, part) tasks.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import dropped, small_batches, stored

BITS = 64
_U = np.uint64


@dataclass(frozen=True)
class Params:
    words: int = 3
    seed: int = 42
    #: Linked at so many differing bits or fewer.
    distance: int = 3
    #: Numbers of partitions that are weighed against each other.
    layouts: tuple[int, ...] = (2, 3, 4, 5)
    #: What a posted row costs, with the verification of one pair as 1.
    posting: float = 500.0
    #: Rows of a run that one task takes; more are dealt to several.
    most: int = 8192


def fingerprints(texts: list[bytes | None], p: Params = Params()) -> np.ndarray:
    """The fingerprints (unsigned) of texts: A-Z lower-cased, words parted by ASCII white
    space; with fewer words than a shingle has the whole sequence is one; no word, zero."""
    hashes, sizes = [], []
    digest, seed = xxhash.xxh64_intdigest, p.seed
    for text in texts:
        words = (text or b"").lower().split()
        n = len(words) - p.words + 1
        if n > 1:
            line = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            hashes += [digest(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[p.words - 1 :])]
        elif words:
            hashes.append(digest(b" ".join(words), seed))
        sizes.append(max(n, 1) if words else 0)
    out = np.zeros(len(texts), dtype=_U)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.array(hashes, dtype=">u8")
    size = np.array(sizes, dtype=np.int64)[full]
    edges = np.concatenate([[0], np.cumsum(size)])
    counts = np.zeros((len(full), BITS), dtype=np.int64)
    for a in range(0, len(h), step := 1 << 17):  # bounded, however long a text is
        b = min(a + step, len(h))
        first, last = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b, "left")
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.maximum(edges[first:last], a) - a
        counts[first:last] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * counts > size[:, None], axis=1).view(">u8").ravel()
    return out


def _portions(texts: pa.Array, most: int = 1_000_000):
    """(start, rows) of slices with some MB of text each."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held < most):
            held += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
            end += 1
        yield at, end - at
        at = end


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, n in _portions(texts):
                got = fingerprints([t.as_buffer().to_pybytes() if t.is_valid else None for t in texts.slice(at, n)], p)
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """(64, 64): how many fingerprints have both bits set, bit 0 the lowest. Each task adds up
    its own rows; 4,096 sums come to the driver, whatever the rows."""

    def run(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(_U)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=_U)) & _U(1)).astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["counts"])

    rows = nodes.select("fp").mapInArrow(run, "counts array<long>").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS, dtype=np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out.reshape(BITS, BITS)


def correlated_parts(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of like size: a group begins with the free bit that is
    most correlated with the others that are free, and takes what correlates most with it."""
    share = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs(counts / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def agreeing_pairs(nodes: DataFrame, layouts: list[list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each (layout, partition) the ordered pairs of fingerprints, a fingerprint with
    itself included, that agree in it, over all fingerprints."""
    keys = [F.struct(F.lit(a).alias("layout"), F.lit(b).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("value")) for a, parts in enumerate(layouts) for b, bits in enumerate(parts)]
    sizes = nodes.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.layout", "k.part", "k.value").agg(F.count("*").cast("double").alias("n"))
    return {(r["layout"], r["part"]): r["pairs"] for r in sizes.groupBy("layout", "part").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()}


def within(odds: np.ndarray, most: int) -> np.ndarray:
    """The chances that exactly 0, 1 .. ``most`` of some bits differ, with each bit's odds."""
    out = np.zeros(most + 1)
    out[0] = 1
    for d in odds:
        out[1:] = out[1:] * (1 - d) + out[:-1] * d
        out[0] *= 1 - d
    return out


def estimated_cost(bits: list[int], odds: np.ndarray, n: int, agree: float, radius: int, p: Params) -> float:
    """What posting, probing and verifying costs at a threshold: the candidates at 0 are
    counted, those beyond in the ratio that the bits' odds of differing give."""
    if radius < 0:
        return 0.0
    by = within(odds[bits], radius)
    probes = sum(math.comb(len(bits), k) for k in range(radius + 1))
    return p.posting * n * probes + agree * min(by.sum() / max(by[0], 1e-300), n * n / max(agree, 1.0))


def allot(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """The thresholds of least total cost; costs[i][r + 1] is that of threshold ``r`` in
    partition ``i``. They add up to distance - partitions + 1."""
    want = distance + 1  # of r + 1, over all partitions
    best: list[tuple[float, list[int]] | None] = [(0.0, []), *[None] * want]
    for own in costs:
        after: list[tuple[float, list[int]] | None] = [None] * (want + 1)
        for t, got in enumerate(best):
            for r in range(want - t + 1) if got else ():
                cost = got[0] + own[r]
                if after[t + r] is None or cost < after[t + r][0]:
                    after[t + r] = (cost, got[1] + [r - 1])
        best = after
    return best[want]


def plan(nodes: DataFrame, p: Params = Params()) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is to be probed."""
    n = nodes.count()
    counts = bit_counts(nodes)
    layouts = [correlated_parts(counts, n, m) for m in p.layouts]
    agree = agreeing_pairs(nodes, layouts)
    share = np.diag(counts) / max(n, 1)
    odds = 2 * share * (1 - share)
    best = None
    for a, parts in enumerate(layouts):
        costs = [[estimated_cost(bits, odds, n, agree.get((a, b), 0.0), r, p) for r in range(-1, p.distance + 1)] for b, bits in enumerate(parts)]
        cost, radii = allot(costs, p.distance)
        if best is None or cost < best[0]:
            best = cost, [(bits, r) for bits, r in zip(parts, radii) if r >= 0]
    return best[1]


# ---------------------------------------------------------------- probing and verifying


def _flips(bits: list[int], radius: int) -> list[int]:
    """What a value is changed by to reach all values within the radius but itself."""
    return [mask_of(list(c)) for k in range(1, radius + 1) for c in itertools.combinations(bits, k)]


def postings(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): each fingerprint under its own value, and under those within
    the threshold, where it looks for others' own."""

    def key(i: int, value: Column, own: bool) -> Column:
        return F.struct(F.lit(i).alias("part"), value.alias("value"), F.lit(own).alias("own"))

    values = [F.col("fp").bitwiseAND(F.lit(mask_of(bits))) for bits, _ in parts]
    every = [F.array(*[key(i, v, True) for i, v in enumerate(values)])]
    for i, ((bits, radius), value) in enumerate(zip(parts, values)):
        if radius > 0:
            flips = F.array(*[F.lit(f) for f in _flips(bits, radius)])
            every.append(F.transform(flips, partial(lambda i, value, f: key(i, value.bitwiseXOR(f), False), i, value)))
    every = F.concat(*every)
    return nodes.select("fp", F.explode(every).alias("k")).select("k.part", "k.value", "fp", "k.own")


def forest(fp: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (places in ``fp``) that join what is within the distance of each other, no
    more than a forest needs; at least one end of a link stands under its own value."""
    near = np.zeros(len(fp), dtype=bool)
    for a in range(0, len(fp), 256):  # most meet by chance: those near to none drop out at once
        d = (np.bitwise_count(fp[a : a + 256, None] ^ fp[None, :]) <= distance) & (own[a : a + 256, None] | own[None, :])
        d[np.arange(len(d)), np.arange(a, a + len(d))] = False
        near[a : a + 256] = d.any(axis=1)
    left, out = np.flatnonzero(near), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            these, front = front[:64], front[64:]
            d = (np.bitwise_count(fp[these, None] ^ fp[None, left]) <= distance) & (own[these, None] | own[None, left])
            hit = d.any(axis=0)
            out += zip(these[d.argmax(axis=0)[hit]].tolist(), left[hit].tolist())
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return out


SHORT = 8


def _run_links(run: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of sorted rows; run[i] says which run row ``i`` belongs to. Short runs are
    compared place against place, all at once; longer ones one by one."""
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(run)))
    short = np.repeat(sizes <= SHORT, sizes)
    a, b = [], []
    for k in range(1, SHORT):
        i = np.flatnonzero(short[:-k] & (run[k:] == run[:-k])) if len(run) > k else np.empty(0, np.int64)
        if not len(i):
            break
        j = i + k
        i, j = (x[(np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (own[i] | own[j]) & (fp[i] != fp[j])] for x in (i, j))
        a.append(fp[i]), b.append(fp[j])
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        for i, j in forest(fp[s : s + n], own[s : s + n], distance):
            a.append(fp[s + i : s + i + 1]), b.append(fp[s + j : s + j + 1])
    empty = np.empty(0, _U)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def verified_links(posted: DataFrame, p: Params = Params()) -> DataFrame:
    """(a, b): links of the runs of ``posted``, sorted together by Spark and read as a
    stream; a run is at most two parts of ``most`` rows."""
    sizes = posted.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > p.most)
    hot = stored(sizes, "hot")
    place = ["part", "value", "i", "j"]
    if hot.isEmpty():
        dealt = posted.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        parts = F.ceil(F.coalesce("n", F.lit(1)) / p.most).cast("int")
        mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
        dealt = posted.join(hot, ["part", "value"], "left").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.select("part", "value", "fp", "own", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    # a fingerprint stands in a run once, under its own value or as a probe
    dealt = dealt.repartition(*place).sortWithinPartitions(*place).select(*place, "fp", "own")

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [np.asarray(batch.column(k).cast(pa.int64())) for k in range(5)] + [np.asarray(batch.column(5).to_numpy(zero_copy_only=False), dtype=bool)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if rest is None or not len(rest[0]):
                continue
            change = np.zeros(len(rest[0]), dtype=bool)
            for column in rest[:4]:
                change[1:] |= column[1:] != column[:-1]
            number = np.cumsum(change)
            ready = len(number) if batch is None else int(np.searchsorted(number, number[-1]))  # the last run may go on
            if ready:
                a, b = _run_links(number[:ready], rest[4][:ready].view(_U), rest[5][:ready], p.distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                rest = [x[ready:] for x in rest]

    links = dealt.mapInArrow(run, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    component_id is the smallest id that links reach, the row's own included. Null, empty
    and wordless texts have the fingerprint zero and are linked like any other. Rows that
    repeat an id are described each for itself; a null id names no component that has an
    id; an empty table gives an empty one. Other columns of ``docs`` are not read."""
    small_batches(docs.sparkSession)
    rows = stored(describe(docs, key, text, p), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    links = stored(verified_links(postings(nodes, plan(nodes, p)), p), "links")
    comps = connected_components(links, "a", "b")
    label = nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("comp"))
    label = stored(label, "labels")
    smallest = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = stored(label.select("fp", "comp").join(smallest, "comp").select("fp", "component_id"), "labels")
    dropped(links)
    return rows.join(label, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
