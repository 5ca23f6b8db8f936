"""Near-duplicates by an inverted join on MinHash signature coordinates.

1. A document's set is its distinct five-word shingles; a signature of ``K``
   minima describes it. Documents with equal sets form one class.
2. A class is posted under each (coordinate, value) of its signature. Two sets
   with a similarity of at least the threshold share at least ``T`` coordinates
   but for a chance near 1e-8 (the binomial tail at the threshold; it falls fast
   above it), so a class with fewer than ``T`` values that any other class shares
   is set aside (skipped), and of the ``m`` shared values of a class only the
   ``m - T + 1`` rarest (its prefix) can be the only meeting place with a partner.
   Of posting lists that hold the very same classes one is merged, the rest skipped.
3. Within a posting list the classes meet a pivot, never each other: collisions
   of their signatures are counted, pairs with at least ``T`` are confirmed on
   full sets and confirmed links merge components. A pivot has then met its whole
   list and leaves it. The first is the class whose values most others share, the
   centre of a group of copies; later ones lie outside its component. A list is
   done when what it still holds is one component.
4. Lists in which many classes stay outside the main component are finished in
   blocks of bounded rows and shingles: classes outside meet the others of the list
   whose sizes fit, first by counting collisions, so that only classes with at
   least ``T`` in some pair of a block go on; their full sets then decide, and only
   links that join two components come out. A pair that several lists hold is looked at
   in the first of them. No pair of a list that could join two
   components stays unexamined, and no block's pairs are ever rows of a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import dropped, small_batches, stored

_U = np.uint64


@dataclass(frozen=True)
class Params:
    words: int = 5
    #: Similarity as a fraction of whole numbers: linked if over * shared >= under * union.
    over: int = 100
    under: int = 85
    #: With 14 of 32, a pair at 0.85 is missed with a chance of 1.0e-8.
    coordinates: int = 32
    collisions: int = 14
    rounds: int = 6
    #: Classes of one side of a block at most, and their shingles.
    block: int = 512
    block_shingles: int = 1_000_000
    seed: int = 11


#: A similarity of 0.8; a pair at 0.8 is missed with a chance of 2.6e-8.
FOUR_FIFTHS = Params(under=80, collisions=12)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text, words lower-cased in A-Z
    and parted by ASCII white space. A shorter text is one shingle; no word, none."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=_U, count=len(found))
    n = min(words, len(found))
    total = np.zeros(len(found) - n + 1, dtype=_U)
    for k in range(n):
        total = _mixed(total + h[k : len(found) - n + 1 + k] + _U(0x9E3779B97F4A7C15))
    return np.unique(total if n == words else total + _U(n))


def signatures(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """MinHash signatures (len(sets), coordinates) of sets, none of them empty."""
    rng = np.random.default_rng(p.seed)
    xor = rng.integers(0, 2**64, p.coordinates, dtype=_U)
    mul = rng.integers(0, 2**63, p.coordinates, dtype=_U) * _U(2) + _U(1)
    out = np.empty((len(sets), p.coordinates), dtype=np.int32)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (end == begin or held + len(sets[end]) <= 100_000):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        for c in range(p.coordinates):
            value = ((flat ^ xor[c]) * mul[c]) >> _U(32)
            out[begin:end, c] = np.minimum.reduceat(value, starts).astype(np.uint32).view(np.int32)
        begin = end
    return out


def _portions(texts: pa.Array, most: int = 2_000_000):
    """(start, rows) of slices with some MB of text each."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held < most):
            held += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
            end += 1
        yield at, end - at
        at = end


def _describe(p: Params, key_type: pa.DataType):
    def run(batches):
        for batch in batches:
            keys, texts, marks = batch.column(0), batch.column(1), batch.column(2)
            for at, n in _portions(texts):
                sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else None, p.words) for t in texts.slice(at, n)]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, p)) if full else iter(())
                nodes, sigs = [], []
                for s in sets:
                    if len(s):
                        with np.errstate(over="ignore"):
                            parts = np.array([_mixed(s).sum(dtype=_U), np.bitwise_xor.reduce(_mixed(s + _U(len(s))))], dtype=_U)
                        nodes.append(parts.tobytes())
                        sigs.append(next(sig))
                    else:
                        nodes.append(None)
                        sigs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, n).cast(key_type), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), marks.slice(at, n)],
                    names=["doc_id", "n_shingles", "node", "sig", "mark"],
                )

    return run


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, node, sig, mark): node names the document's set, null if
    empty; mark is a hash of its text."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return rows.mapInArrow(_describe(p, pa.int64()), "doc_id long, n_shingles long, node binary, sig array<int>, mark long")


def _shared(left, right):
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _column(rows: pa.Table, name: str) -> pa.Array:
    c = rows.column(name).combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


class _Block:
    """The classes of one block: outsiders, who look for partners, and members."""

    def __init__(self, rows: pa.Table, p: Params):
        self.p = p
        self.sig = np.asarray(_column(rows, "sig").flatten()).reshape(rows.num_rows, -1)
        self.n = np.asarray(rows.column("n"))
        names: dict[bytes, int] = {}
        self.root = np.array([names.setdefault(c, len(names)) for c in rows.column("comp").to_pylist()], dtype=np.int64)
        # the keys before this list's of which a class also holds the lists, as numbers of this block
        earlier = _column(rows, "earlier")
        flat, edges = np.unique(np.asarray(earlier.flatten()), return_inverse=True)[1], np.asarray(earlier.offsets)
        edges = edges - edges[0]
        self.earlier = np.full((rows.num_rows, int(np.diff(edges).max(initial=0))), -1, dtype=np.int64)
        self.earlier[np.repeat(np.arange(rows.num_rows), np.diff(edges)), np.arange(len(flat)) - np.repeat(edges[:-1], np.diff(edges))] = flat
        self.seen = np.zeros(len(flat) + 1, dtype=bool)
        # outsiders in the order of their names, main members behind them all
        place = np.unique(np.array(_column(rows, "node").to_pylist(), dtype=object), return_inverse=True)[1]
        self.place = np.where(np.asarray(rows.column("main")), rows.num_rows, place)
        outsider = np.asarray(rows.column("outsider"))
        self.seekers, self.others = np.flatnonzero(outsider), np.flatnonzero(~outsider)

    def candidates(self, u: int) -> np.ndarray:
        """Members that collide with ``u`` often enough, fit its size, are not joined to it and
        meet it in no earlier list: a pair is looked at in the first of the lists that hold it,
        and two outsiders once, at the one that comes first."""
        met = (self.sig[self.others] == self.sig[u]).sum(axis=1) >= self.p.collisions
        rest = self.others[met]
        n, m = self.n[u], self.n[rest]
        rest = rest[(self.root[rest] != self.root[u]) & (self.p.over * np.minimum(n, m) >= self.p.under * np.maximum(n, m))]
        rest = rest[self.place[rest] > self.place[u]]
        own = self.earlier[u]
        own = own[own >= 0]
        self.seen[own] = True
        rest = rest[~self.seen[self.earlier[rest]].any(axis=1)]
        self.seen[own] = False
        return rest


def _colliding(p: Params):
    """The rows of a block that a pair with enough collisions holds."""

    def run(rows: pa.Table) -> pa.Table:
        block = _Block(rows, p)
        keep = np.zeros(rows.num_rows, dtype=bool)
        for u in block.seekers:
            found = block.candidates(u)
            keep[found] = True
            keep[u] |= len(found) > 0
        kept = rows.filter(pa.array(keep))
        at = kept.column_names.index("earlier")
        return kept.set_column(at, "earlier", kept.column(at).cast(pa.list_(pa.int64())))

    return run


def _block_links(p: Params):
    """Pairs of a block with enough collisions, confirmed on full sets; only links that
    join what was not yet joined."""

    def run(rows: pa.Table) -> pa.Table:
        block = _Block(rows, p)
        items, nodes = _column(rows, "items"), _column(rows, "node")
        edges = np.asarray(items.offsets)
        values, inverse = np.unique(np.asarray(items.values), return_inverse=True)
        flags = np.zeros(len(values), dtype=bool)
        out_a, out_b = [], []
        for u in block.seekers:
            own = inverse[edges[u] : edges[u + 1]]
            flags[own] = True
            for v in block.candidates(u):
                if block.root[u] != block.root[v]:
                    shared = int(flags[inverse[edges[v] : edges[v + 1]]].sum())
                    if p.over * shared >= p.under * int(block.n[u] + block.n[v] - shared):
                        out_a.append(nodes[u].as_py()), out_b.append(nodes[v].as_py())
                        block.root[block.root == block.root[v]] = block.root[u]
            flags[own] = False
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def _finish(now: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) among what the lists ``now`` (key, node, n, sig, comp, main) still hold.

    Sizes of partners differ by the threshold at most, so classes are dealt to bands
    of that width and meet their own band and its neighbours only."""
    width = math.log(p.over / p.under) + 1e-9
    # Of two classes with different components one at least is outside in every list that holds
    # both, so that the first such list looks at the pair and the others need not.
    held = F.collect_list("key").over(Window.partitionBy("node"))
    now = now.withColumn("earlier", F.filter(held, lambda k: k < F.col("key")))
    rows = now.select("key", "node", F.col("n").cast("long").alias("n"), "sig", "comp", "main", "earlier", F.floor(F.log(F.col("n").cast("double")) / width).cast("int").alias("band"), F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(1 << 40)).alias("place"))
    room = lambda band: F.greatest(F.lit(1.0), F.least(F.lit(float(p.block)), F.floor(F.lit(float(p.block_shingles)) / F.exp((F.col(band) + 1) * width))))
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("size"), F.sum((~F.col("main")).cast("long")).alias("out"))
    sizes = sizes.select("key", "band", F.ceil(F.col("size") / room("band")).cast("long").alias("blocks"), F.ceil(F.col("out") / room("band")).cast("long").alias("outside"))
    seeking = sizes.where("outside > 0").select("key", F.col("band").alias("ob"), "outside", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("mb"))
    meets = stored(seeking.join(sizes.select("key", F.col("band").alias("mb"), "blocks"), ["key", "mb"]), "bands")
    place = ["key", "ob", "mb", "i", "j"]
    cols = [*place, "node", "n", "sig", "comp", "earlier", "main", "outsider"]
    outsiders = rows.where("not main").withColumnRenamed("band", "ob").join(meets, ["key", "ob"])
    outsiders = outsiders.select("*", F.pmod("place", "outside").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("outsider")).select(cols)
    members = rows.withColumnRenamed("band", "mb").join(meets, ["key", "mb"])
    members = members.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outside") - 1)).alias("i"), F.pmod("place", "blocks").alias("j"), F.lit(False).alias("outsider")).select(cols)
    kind = "key long, ob int, mb int, i long, j long, node binary, n long, sig array<int>, comp binary, earlier array<long>, main boolean, outsider boolean"
    met = outsiders.unionByName(members).groupBy(place).applyInArrow(_colliding(p), kind)
    met = stored(met, "colliding")
    links = met.join(sets, "node").groupBy(place).applyInArrow(_block_links(p), "a binary, b binary")
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    dropped(met)
    dropped(meets)
    return links


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, p: Params) -> DataFrame:
    """(node, items) of the classes in ``wanted`` (node, doc_id, mark), from a row each
    with that id, which may be null, and that text; rows that are equal repeat a class."""

    def run(batches):
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1)
            for at, n in _portions(texts):
                sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else None, p.words).view(np.int64) for t in texts.slice(at, n)]
                yield pa.RecordBatch.from_arrays([nodes.slice(at, n), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    of = wanted.select("node", F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"))
    chosen = rows.join(of, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    return chosen.select("node", "text").mapInArrow(run, "node binary, items array<bigint>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    component_id is the smallest id that links reach; a document without words
    has no link and is its own component. Rows that repeat an id are described
    row by row. A null id stays null and never names a component that has an
    id. Other columns of ``docs`` are not read."""
    small_batches(docs.sparkSession)
    all_docs = stored(describe(docs, key, text, p), "described")
    classes = all_docs.where("node is not null").groupBy("node", "n_shingles").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("row"), F.first("sig").alias("sig"))
    classes = stored(classes.select("node", F.col("n_shingles").alias("n"), "row.doc_id", "row.mark", "sig"), "classes")

    # Sets below this size meet the threshold with equal sets only.
    least = next(n for n in range(1, 10**6) if p.over * n >= p.under * (n + 1))
    posted = classes.where(F.col("n") >= least).select("node", F.posexplode("sig").alias("c", "v"))
    posted = posted.select("node", (F.shiftleft(F.col("c").cast("long"), 32) + (F.col("v").cast("long") + F.lit(1 << 31))).alias("key"))
    posted = stored(posted, "posted")
    counts = stored(posted.groupBy("key").agg(F.count("*").alias("n_key")).where("n_key > 1"), "counts")
    met = posted.join(counts, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n_key", "key"))).alias("keys"), F.sum("n_key").alias("popular"))
    met = met.where(F.size("keys") >= p.collisions)
    prefix = met.select("node", "popular", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (p.collisions - 1))).alias("k")).select("node", "popular", F.col("k.key").alias("key"))
    prefix = stored(prefix, "prefix")
    dropped(posted)
    dropped(counts)
    same = prefix.groupBy("key").agg(F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in range(3)])
    merged = same.where("size > 1").groupBy("size", "h0", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    full, prefix = prefix, stored(prefix.join(merged, "key", "left_semi"), "merged")
    dropped(full)
    active = stored(prefix.select("node").distinct().join(classes, "node"), "active")
    sets = stored(_sets(docs, key, text, active, p).dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        pairs = stored(pairs, "candidates")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").cast("long").alias("nx"), F.size("y").cast("long").alias("ny"), F.size(F.array_intersect("x", "y")).cast("long").alias("s"))
        found = stored(both.where(p.over * F.col("s") >= p.under * (F.col("nx") + F.col("ny") - F.col("s"))).select("a", "b"), "links")
        dropped(pairs)
        return found

    # The state: the members of each list that have not been its pivot, with their components so far.
    described = prefix.join(active.select("node", "n", "sig"), "node")
    lists = stored(described.select("key", "node", "popular", "n", "sig", F.col("node").alias("comp"), F.lit(False).alias("main")), "members")
    dropped(prefix)
    links = comps = before = None
    for turn in range(p.rounds + 1):
        pivot = F.max(F.struct((~F.col("main")).alias("outside"), "popular", "node", "n", "sig", "comp")).alias("pivot")
        heads = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum((~F.col("main")).cast("long")).alias("out"), pivot)
        heads = stored(heads.where("lo <> hi").drop("lo", "hi"), "heads")
        now = stored(lists.join(heads, "key"), "lists")
        left = heads.agg(F.sum(F.least("out", "size"))).first()[0]
        if not left:
            break
        last = turn == p.rounds or (turn >= 2 and before is not None and left > 0.8 * before)
        before = left
        pv = F.col("pivot")
        if last:
            found = _finish(now, sets, p)
        else:
            fits = p.over * F.least("n", pv["n"]) >= p.under * F.greatest("n", pv["n"])
            pairs = now.where((F.col("comp") != pv["comp"]) & fits & (_shared(F.col("sig"), pv["sig"]) >= p.collisions))
            found = confirmed(pairs.select(F.col("node").alias("a"), pv["node"].alias("b")).distinct())
        links = found if links is None else links.unionByName(found)
        joined = connected_components(links, "a", "b")
        comps = stored(joined, "components")
        dropped(joined)
        if last:
            break
        part = comps.select(F.col("node").alias("pivot_node"), F.col("component").alias("pivot_comp"))
        rest = now.where(F.col("node") != pv["node"]).select("key", "node", "popular", "n", "sig", pv["node"].alias("pivot_node"))
        rest = rest.join(comps, "node", "left").join(part, "pivot_node", "left").withColumn("comp", F.coalesce("component", "node"))
        after = stored(rest.select("key", "node", "popular", "n", "sig", "comp", (F.col("comp") == F.coalesce("pivot_comp", "pivot_node")).alias("main")), "members")
        for old in (lists, heads, now):
            dropped(old)
        lists = after

    for old in (lists, heads, now, active, sets):
        dropped(old)

    label = classes.select("node", "doc_id")
    if links is not None:
        label = label.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        smallest = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        label = stored(label.select("node", "comp").join(smallest, "comp").select("node", "component_id"), "labels")
    else:
        label = label.select("node", F.col("doc_id").alias("component_id"))
    out = all_docs.select("doc_id", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))
