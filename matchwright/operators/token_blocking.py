"""Schema-agnostic blocking on tokens and meta-blocking.

Blocks are a long table (block, src, id); no list of a block's members is ever
formed. The blocking graph's edges come from one self-join of the filtered
table on the block, counted into one row for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, spread, stored
from .topn import top_n


def tokens(x: Column) -> Column:
    """The distinct lower-cased alphanumeric tokens of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_blocks(records: DataFrame, columns: list[str], two_sources: bool = False) -> DataFrame:
    """(block, src, id): a block for each token of the named columns, with at least two
    records, or, for two sources (column src), with records of both."""
    src = F.col("src") if "src" in records.columns else F.lit("a")
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    # texts are split once; sizes and the join back read the narrow table
    rows = stored(records.select(src.alias("src"), "id", F.explode(tokens(text)).alias("block")), "tokens")
    sizes = block_sizes(rows, two_sources)
    return rows.join(sizes.where("cardinality > 0").select("block"), "block")


def block_sizes(blocks: DataFrame, two_sources: bool = False) -> DataFrame:
    """(block, size, cardinality): members and comparisons of each block."""
    if two_sources:
        return blocks.groupBy("block").agg(F.count("*").alias("size"), (F.count_if(F.col("src") == "a") * F.count_if(F.col("src") != "a")).cast("long").alias("cardinality"))
    return blocks.groupBy("block").agg(F.count("*").alias("size"), (F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("cardinality"))


def largest_kept(sizes: DataFrame, smoothing: float = 1.025) -> int | None:
    """The largest cardinality of a block that purging keeps; None: all are kept. Over the
    distinct cardinalities, from the largest down, the ratio of all members to all comparisons
    up to each is compared with its neighbour's; the first cardinality at which it no longer
    rises by the smoothing factor is the largest kept."""
    levels = sizes.groupBy("cardinality").agg(F.sum("size").alias("members"), (F.sum("cardinality")).alias("comparisons"))
    # One row for each distinct size of a block: some thousands, whatever the data.
    upto = Window.orderBy("cardinality").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = levels.select("cardinality", F.sum("members").over(upto).alias("m"), F.sum("comparisons").over(upto).alias("c"))
    down = Window.orderBy(F.desc("cardinality"))
    stepped = cumulative.select("cardinality", "m", "c", F.lag("m").over(down).alias("pm"), F.lag("c").over(down).alias("pc"), F.lag("cardinality").over(down).alias("above"))
    # at the first level (from above) where comparisons fell little for the members lost, the level above stays
    return stepped.where(F.col("pm").isNotNull() & (F.col("m").cast("double") * F.col("pc") < F.lit(smoothing) * F.col("c") * F.col("pm"))).agg(F.max("above").alias("top")).first()["top"]


def purge(blocks: DataFrame, two_sources: bool = False, smoothing: float = 1.025, max_cardinality: int | None = None) -> DataFrame:
    """Blocks without the oversized ones, see ``largest_kept``."""
    sizes = block_sizes(blocks, two_sources)
    if max_cardinality is None:
        max_cardinality = largest_kept(sizes, smoothing)
        if max_cardinality is None:
            return blocks
    return blocks.join(sizes.where(F.col("cardinality") <= max_cardinality).select("block"), "block")


def _smallest(sized: DataFrame, ratio: float) -> DataFrame:
    mine = Window.partitionBy("src", "id")
    ranked = sized.withColumns({"__r": F.row_number().over(mine.orderBy("cardinality", "block")), "__n": F.count("*").over(mine)})
    return ranked.where(F.col("__r") <= F.greatest(F.lit(1), F.round(F.col("__n") * ratio))).select("block", "src", "id")


def filter_blocks(blocks: DataFrame, ratio: float = 0.8, two_sources: bool = False) -> DataFrame:
    """Each record stays in its smallest blocks only: the ``ratio`` share, one at least."""
    return _smallest(blocks.join(block_sizes(blocks, two_sources), "block"), ratio)


def numbered_blocks(sizes: DataFrame) -> DataFrame:
    """The blocks with ``number`` from 0 on, in the order in which they stand."""
    placed = stored(sizes.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33).cast("int")
    # one row for each partition
    many = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in many:
        starts.append((p, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(starts, "__p int, __before long")
    number = (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("number")
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").select(*sizes.columns, number)


def pruned_blocks(records: DataFrame, columns: list[str], two_sources: bool = False, smoothing: float = 1.025, ratio: float = 0.8) -> DataFrame:
    """Token blocks, purged and filtered: the same as the three steps one after another, with
    the blocks' sizes counted and joined once. A stored table; ``block`` is the block's number
    in the order of comparisons, then token, so no token goes through a shuffle."""
    src = F.col("src") if "src" in records.columns else F.lit("a")
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    rows = stored(spread(records.select(src.alias("src"), "id", text.alias("text"))).select("src", "id", F.explode(tokens(F.col("text"))).alias("block")), "tokens")
    sizes = stored(block_sizes(rows, two_sources).where("cardinality > 0"), "sizes")
    top = largest_kept(sizes, smoothing)
    kept = numbered_blocks((sizes if top is None else sizes.where(F.col("cardinality") <= top)).orderBy("cardinality", "block"))
    own = F.array_sort(F.collect_list("number"))
    listed = rows.join(kept.select("block", "number"), "block").groupBy("src", "id").agg(own.alias("own"))
    share = F.greatest(F.lit(1), F.round(F.size("own") * ratio).cast("int"))
    out = stored(listed.select(F.explode(F.slice("own", F.lit(1), share)).alias("block"), "src", "id"), "blocks")
    for old in (rows, sizes):
        dropped(old)
    return out


GRAPH = ("left_id", "right_id", "common", "bl", "br", "blocks", "arcs", "cnl", "cnr", "sizes", "snl", "snr")


def edges(blocks: DataFrame, two_sources: bool = False, most: int = 2000) -> DataFrame:
    """The blocking graph: (left_id, right_id, common, bl, br, blocks, arcs, cnl, cnr, sizes,
    snl, snr): shared blocks, blocks of either record, all blocks; the sum of 1 / comparisons
    over the shared blocks and over those of either record; the sums of 1 / members.

    A block of more than ``most`` records is dealt to (part of the left, part of the right)
    tasks, so its pairs are never one task's."""
    sizes = block_sizes(blocks, two_sources).where("cardinality > 0")
    kept = blocks.join(sizes, "block")
    own = kept.groupBy("src", "id").agg(F.count("*").alias("n"), F.sum(1.0 / F.col("cardinality")).alias("cn"), F.sum(1.0 / F.col("size")).alias("sn"))
    total = sizes.agg(F.count("*").alias("blocks"))
    parts = F.ceil(F.col("size") / most).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    l = kept.select("block", "cardinality", "size", F.col("src").alias("ls"), F.col("id").alias("left_id"), mine.alias("__i"), every.alias("__j"))  # noqa: E741
    r = kept.select("block", F.col("src").alias("rs"), F.col("id").alias("right_id"), mine.alias("__j"), every.alias("__i"))
    rule = (F.col("ls") == "a") & (F.col("rs") != "a") if two_sources else F.col("left_id") < F.col("right_id")
    both = l.join(r, ["block", "__i", "__j"]).where(rule).groupBy("ls", "rs", "left_id", "right_id").agg(F.count("*").alias("common"), F.sum(1.0 / F.col("cardinality")).alias("arcs"), F.sum(1.0 / F.col("size")).alias("sizes"))
    a = own.select(F.col("src").alias("ls"), F.col("id").alias("left_id"), F.col("n").alias("bl"), F.col("cn").alias("cnl"), F.col("sn").alias("snl"))
    b = own.select(F.col("src").alias("rs"), F.col("id").alias("right_id"), F.col("n").alias("br"), F.col("cn").alias("cnr"), F.col("sn").alias("snr"))
    return both.join(a, ["ls", "left_id"]).join(b, ["rs", "right_id"]).crossJoin(F.broadcast(total)).select(*GRAPH)


#: Weighting schemes without a published definition.
UNPUBLISHED = ("CN-CBS", "SN-CBS", "CNC", "SNC", "CND", "SND", "CNJ", "SNJ")


def weigh(graph: DataFrame, scheme: str = "CBS") -> DataFrame:
    """The graph with ``weight``: CBS, ECBS, JS, EJS, ARCS, X2, COSINE or DICE
    (Papadakis et al., TKDE 2014; Simonini et al., PVLDB 2016). Names without a
    published definition raise: see ``weigh_normalised``."""
    c, bl, br, n = (F.col(x).cast("double") for x in ("common", "bl", "br", "blocks"))
    js = c / (bl + br - c)
    scheme = scheme.upper()
    if scheme in UNPUBLISHED:
        raise NotImplementedError(f"{scheme} has no published definition; take weigh_normalised or pass a Column to weigh_by")
    if scheme == "EJS":
        degree = graph.select(F.explode(F.array("left_id", "right_id")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
        count = graph.agg(F.count("*").alias("edges"))
        d1, d2 = degree.select(F.col("id").alias("left_id"), F.col("deg").alias("dl")), degree.select(F.col("id").alias("right_id"), F.col("deg").alias("dr"))
        out = graph.join(d1, "left_id").join(d2, "right_id").crossJoin(F.broadcast(count))
        return out.withColumn("weight", js * F.ln(F.col("edges") / F.col("dl")) * F.ln(F.col("edges") / F.col("dr"))).drop("dl", "dr", "edges")
    if scheme == "X2":
        o12, o21, o22 = bl - c, br - c, n - bl - br + c
        top = n * F.pow(c * o22 - o12 * o21, 2)
        weight = F.coalesce(F.try_divide(top, bl * br * (n - bl) * (n - br)), F.lit(0.0))
    else:
        weight = {"CBS": c, "ECBS": c * F.ln(n / bl) * F.ln(n / br), "JS": js, "ARCS": F.col("arcs"), "COSINE": c / F.sqrt(bl * br), "DICE": 2.0 * c / (bl + br)}[scheme]
    return graph.withColumn("weight", weight)


def weigh_normalised(graph: DataFrame, by: str = "comparisons", how: str = "sum") -> DataFrame:
    """The graph with a weight that counts each shared block as 1 / its comparisons or 1 /
    its members (``by``). how: that ``sum`` itself, or set against the same sums over
    all blocks of either record as a ``cosine``, a ``dice`` or a ``jaccard`` coefficient.

    These are this engine's readings of the eight names in ``UNPUBLISHED``: CN for
    comparisons, SN for members; CBS, C, D and J for the four forms."""
    shared, l, r = (F.col(x) for x in {"comparisons": ("arcs", "cnl", "cnr"), "members": ("sizes", "snl", "snr")}[by])
    return graph.withColumn("weight", {"sum": shared, "cosine": shared / F.sqrt(l * r), "dice": 2.0 * shared / (l + r), "jaccard": shared / (l + r - shared)}[how])


def weigh_by(graph: DataFrame, weight: Column) -> DataFrame:
    """The graph with a weight of one's own over the graph's columns."""
    return graph.withColumn("weight", weight)


def budget(blocks: DataFrame, two_sources: bool = False) -> tuple[int, int]:
    """(edges to keep in all, edges to keep at each record): half of the memberships,
    and the memberships for each record less one."""
    row = block_sizes(blocks, two_sources).where("cardinality > 0").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    records = blocks.select("src", "id").distinct().count()
    return row["s"] // 2, max(1, row["s"] // records - 1) if records else 1


def cardinality_edge_pruning(weighted: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges; ties by ids."""
    return top_n(weighted, k, "weight", "left_id", "right_id")


def cardinality_node_pruning(weighted: DataFrame, k: int, two_sources: bool = False) -> DataFrame:
    """Edges that are among the ``k`` heaviest of at least one of their ends. The ids
    of two sources are apart even where they are equal."""
    cols = weighted.columns
    ends = weighted.select("*", F.explode(F.array(F.struct(F.lit("l").alias("s"), F.col("left_id").alias("id")), F.struct(F.lit("r").alias("s"), F.col("right_id").alias("id")))).alias("e"))
    order = Window.partitionBy("e.s", "e.id") if two_sources else Window.partitionBy("e.id")
    top = ends.withColumn("__r", F.row_number().over(order.orderBy(F.desc("weight"), "left_id", "right_id"))).where(F.col("__r") <= k)
    return top.select(*cols).distinct()


def weighted_edge_pruning(weighted: DataFrame) -> DataFrame:
    """Edges of at least the mean weight."""
    return weighted.crossJoin(F.broadcast(weighted.agg(F.avg("weight").alias("__mean")))).where(F.col("weight") >= F.col("__mean")).drop("__mean")
