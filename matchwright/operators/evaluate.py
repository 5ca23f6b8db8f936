"""Quality of predicted pairs and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import components_over
from .value_pairs import ValuePairs

STEPS = 100


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; 0 where nothing is predicted or true."""
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def pairwise(scored: DataFrame, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of labelled pairs (label, score); ``weight`` names
    how many pairs a row stands for."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    of = F.count_if if weight is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0)).cast("long")
    counts = scored.agg(of(hit & true).alias("tp"), of(hit & ~true).alias("fp"), of(~hit & true).alias("fn"))
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(scored: DataFrame, first: int = 0, last: int = STEPS, step: float = 0.01, weight: str | None = None) -> DataFrame:
    """(t, precision, recall, f1) at the thresholds ``i * step``, score >= t predicted.

    ``weight`` names how many pairs a row stands for. One pass: scores are counted at the
    highest threshold they reach, and the counts are summed from the top. The double ``i * step`` itself is compared."""
    i = F.floor(F.col("score") / step)
    # rounding may put a score one step off; the comparison with the double settles it
    i = F.when((i + 1) * F.lit(step) <= F.col("score"), i + 1).when(i * F.lit(step) > F.col("score"), i - 1).otherwise(i)
    reach = F.greatest(F.least(i, F.lit(last)), F.lit(first - 1)).cast("int")
    each = F.lit(1).cast("long") if weight is None else F.col(weight)
    counts = scored.select(reach.alias("i"), (F.col("label") == 1).cast("long").alias("y"), each.alias("w"))
    counts = counts.groupBy("i").agg(F.sum(F.col("w") * F.col("y")).alias("tp"), F.sum(F.col("w") * (1 - F.col("y"))).alias("fp"))
    grid = scored.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("i"))
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    full = grid.join(counts, "i", "left").na.fill(0, ["tp", "fp"])
    summed = full.select("i", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp"), F.sum("tp").over(whole).alias("true"))
    out = summed.where(F.col("i") >= first)
    return out.select("i", (F.col("i") * F.lit(step)).alias("t"), *[c.alias(n) for n, c in prf(F.col("tp"), F.col("fp"), F.col("true") - F.col("tp")).items()])


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row of the sweep with the best F1; of equals, the lowest threshold."""
    return curve.orderBy(F.desc("f1"), "i").limit(1)


def pr_curve(curve: DataFrame) -> DataFrame:
    """The sweep as it is reported: t to 3 places, metrics to 6, half to even."""
    return curve.select(F.bround("t", 3).alias("t"), *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def bcubed(assignment: DataFrame, predicted: str = "pred", truth: str = "gt") -> DataFrame:
    """(n, precision, recall, f1) by B-cubed (Bagga and Baldwin, 1998), from counts of
    (predicted, true) cluster pairs only."""
    joint = assignment.groupBy(predicted, truth).agg(F.count("*").alias("j"))
    p, g = joint.groupBy(predicted).agg(F.sum("j").alias("p")), joint.groupBy(truth).agg(F.sum("j").alias("g"))
    sums = joint.join(p, predicted).join(g, truth).agg(F.sum("j").alias("n"), F.sum(F.col("j") * F.col("j") / F.col("p")).alias("sp"), F.sum(F.col("j") * F.col("j") / F.col("g")).alias("sr"))
    pr, re = ratio(F.col("sp"), F.col("n")), ratio(F.col("sr"), F.col("n"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), pr.alias("precision"), re.alias("recall"), ratio(2 * pr * re, pr + re).alias("f1"))


def tagged(pairs: DataFrame, two_sources: bool) -> DataFrame:
    """Pairs with ids that carry their side, so equal ids of two sources stay apart."""
    if not two_sources:
        return pairs
    return pairs.withColumns({"left_id": F.concat(F.lit("A:"), F.col("left_id").cast("string")), "right_id": F.concat(F.lit("B:"), F.col("right_id").cast("string"))})


def test_metrics(scored: DataFrame, threshold: float, two_sources: bool = True) -> DataFrame:
    """One row with pairwise and B-cubed metrics of a labelled, scored split. B-cubed
    compares the components of predicted with those of true pairs over the records
    of the split; most are alone there, so it runs near 1."""
    pairs = tagged(scored.select("left_id", "right_id", "label", "score"), two_sources)
    return _test_metrics(pairwise(pairs, threshold), pairs, pairs.where(F.col("score") >= threshold), pairs.where("label = 1"))


def test_metrics_of_values(candidates: ValuePairs, scored: DataFrame, threshold: float, two_sources: bool = False) -> DataFrame:
    """The same of one table's pairs of values (left_class, right_class, pairs, label, score):
    pairs are counted, and components are those of some links of each record."""
    counted = pairwise(candidates.counted(scored), threshold, "pairs")
    return _test_metrics(counted, *[tagged(candidates.stars(x), two_sources) for x in (scored, scored.where(F.col("score") >= threshold), scored.where("label = 1"))])


def _test_metrics(counted: DataFrame, pairs: DataFrame, hits: DataFrame, true: DataFrame) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("left_id", "right_id")).alias("node")).distinct()
    pred = components_over(nodes, hits).withColumnRenamed("cluster_id", "pred")
    gt = components_over(nodes, true).withColumnRenamed("cluster_id", "gt")
    b = bcubed(pred.join(gt, "node")).select("n", *[F.col(c).alias(f"bcubed_{c}") for c in ("precision", "recall", "f1")]).withColumnRenamed("n", "n_entities")
    p = counted.select(*[F.col(c).alias(f"pairwise_{c}") for c in ("precision", "recall", "f1")], (F.col("tp") + F.col("fp")).alias("n_pred_pairs"), (F.col("tp") + F.col("fn")).alias("n_gt_pairs"))
    return p.crossJoin(F.broadcast(b))


def cluster_metrics(split: DataFrame, clusters: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairwise metrics of clusters on a labelled split."""
    from .pairs import same_cluster

    return pairwise(same_cluster(split, clusters), threshold)


def group_metrics(records: DataFrame, split: list[str], cluster: list[str], truth: list[str]) -> DataFrame:
    """The same as ``cluster_metrics`` where the split is all pairs that agree on the columns
    ``split``, clusters are the records that agree on ``cluster`` and matches those that agree
    on ``truth``: from counts alone, no pair is made."""
    from .blocking import pairs_of

    counts = pairs_of(records, [*split, *cluster, *truth], "tp").crossJoin(pairs_of(records, [*split, *cluster], "__h")).crossJoin(pairs_of(records, [*split, *truth], "__t"))
    counts = counts.select("tp", (F.col("__h") - F.col("tp")).alias("fp"), (F.col("__t") - F.col("tp")).alias("fn"))
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def best_config(results: DataFrame, by: str = "valid_f1") -> DataFrame:
    """The configuration with the best validation score; of equals, the lowest number.
    Selecting by a test column is refused."""
    if by.startswith("test"):
        raise ValueError("configurations are chosen on validation data")
    return results.where("status = 'OK'").orderBy(F.desc(by), "config_id").limit(1)


def split_summary(splits: DataFrame) -> DataFrame:
    """(split, pairs, positives, negatives, ratio)."""
    out = splits.groupBy("split").agg(F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("negatives").cast("double"), "positives"), F.lit(0.0)))
