"""Vectors of words and records from the records' own texts, with no model file.

Words that stand near each other are counted; the counts' positive pointwise mutual
information is a sparse symmetric matrix, a row for each pair of words that met. Its leading
eigenvectors come from a block power iteration that starts from random columns (Halko,
Martinsson and Tropp, 2011): the matrix times a block of columns is a join and a
grouped sum, and making the columns orthogonal needs only their inner products, a
square of the vectors' length. A record's vector is the mean of its words' vectors, rare
words counting more (Arora, Liang and Ma, 2017).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order; none of a missing text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cooccurrences(records: DataFrame, text: str, window: int = 4) -> DataFrame:
    """(word, other, n): how often two words stand at most ``window`` places apart, both ways
    round. Work is linear in a text's length; a word met with itself counts twice a place."""
    placed = records.select(words(F.col(text)).alias("w")).select("w", F.posexplode("w").alias("at", "word"))
    # One place to ``window`` places to the right; the other way round is the same number.
    met = placed.select("word", F.explode(F.slice("w", F.col("at") + 2, window)).alias("other")).groupBy("word", "other").agg(F.count("*").alias("n"))
    return met.unionByName(met.select(F.col("other").alias("word"), F.col("word").alias("other"), "n")).groupBy("word", "other").agg(F.sum("n").alias("n"))


def information(counts: DataFrame) -> DataFrame:
    """(word, other, weight): ln(n * total / (sum of word * sum of other)) where that is positive."""
    sums = counts.groupBy("word").agg(F.sum("n").alias("s"))
    total = counts.agg(F.sum("n").alias("total"))
    each = counts.join(sums, "word").join(sums.toDF("other", "o"), "other").join(F.broadcast(total))  # one row
    weight = F.log(F.col("n") * F.col("total") / (F.col("s").cast("double") * F.col("o")))
    return each.select("word", "other", weight.alias("weight")).where(F.col("weight") > 0)


def _columns(size: int) -> list[str]:
    return [f"v{i}" for i in range(size)]


def _times(matrix: DataFrame, block: DataFrame, size: int) -> DataFrame:
    """The matrix times a block of columns (word, v0, ...)."""
    sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in _columns(size)]
    return matrix.join(block.withColumnRenamed("word", "other"), "other").groupBy("word").agg(*sums)


def _products(a: DataFrame, right: list[str], size: int) -> np.ndarray:
    """Inner products of a table's columns v0, ... with its columns ``right``."""
    by = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(_columns(size))]))
    rows = a.select(by.alias("e"), *right).groupBy("e.i").agg(*[F.sum(F.col("e.x") * F.col(c)).alias(f"s{j}") for j, c in enumerate(right)])
    out = np.zeros((size, len(right)))
    for r in rows.collect():
        out[r["i"]] = [r[f"s{j}"] for j in range(len(right))]
    return out


def _turned(block: DataFrame, by: np.ndarray) -> DataFrame:
    """The columns of a block times a small square of numbers."""
    names = _columns(len(by))
    turned = [sum((F.col(c) * float(by[i, j]) for i, c in enumerate(names)), F.lit(0.0)).alias(names[j]) for j in range(by.shape[1])]
    return block.select("word", *turned)


def _orthogonal(block: DataFrame, size: int) -> DataFrame:
    """The block with columns of length 1 at right angles; those without a direction of their own are 0."""
    values, vectors = np.linalg.eigh(_products(block, _columns(size), size))
    firm = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    return _turned(block, vectors * np.where(firm, 1 / np.sqrt(np.where(firm, values, 1.0)), 0.0))


def word_vectors(matrix: DataFrame, size: int = 16, rounds: int = 4, spare: int = 8, seed: int = 42) -> DataFrame:
    """(word, vector): each word's place along the ``size`` leading eigenvectors by magnitude, times
    the root of the eigenvalue's magnitude. ``spare`` more columns take part in the iteration."""
    wide = size + spare
    matrix = stored(matrix, "information")
    # Normal numbers from two hashes of the word for each column: the same in every run and place.
    even = lambda i, part: (F.pmod(F.xxhash64("word", F.lit(seed), F.lit(i), F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    start = [(F.sqrt(-2 * F.log(even(i, 0))) * F.cos(2 * np.pi * even(i, 1))).alias(c) for i, c in enumerate(_columns(wide))]
    block = stored(matrix.select("word").distinct().select("word", *start), "columns")
    for _ in range(rounds):
        whole = stored(_times(matrix, block, wide), "columns")
        dropped(block)
        block = stored(_orthogonal(whole, wide), "columns")
        dropped(whole)
    image = stored(_times(matrix, block, wide).select("word", *[F.col(c).alias(f"m{i}") for i, c in enumerate(_columns(wide))]), "image")
    small = _products(block.join(image, "word"), [f"m{i}" for i in range(wide)], wide)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-np.abs(values))[:size]
    # An eigenvector's sign is free: its part of largest magnitude is positive.
    turn = vectors[:, top] * np.where(vectors[np.abs(vectors[:, top]).argmax(0), top] < 0, -1.0, 1.0) * np.sqrt(np.abs(values[top]))
    names = _columns(wide)
    placed = [sum((F.col(c) * float(turn[i, j]) for i, c in enumerate(names)), F.lit(0.0)) for j in range(len(top))]
    return block.select("word", F.array(*placed).alias("vector"))


def record_vectors(records: DataFrame, text: str, vectors: DataFrame, size: int = 16, common: float = 1e-3) -> DataFrame:
    """(id, embedding) of every record: the mean of its words' vectors, each weighing
    common / (common + its share of all words). Zeros where no word has a vector."""
    each = records.select("id", F.explode(words(F.col(text))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    counts = each.groupBy("word").agg(F.sum("n").alias("all"))
    total = counts.agg(F.sum("all").alias("total"))
    weight = F.lit(common) / (common + F.col("all") / F.col("total"))
    known = stored(vectors.join(counts, "word").join(F.broadcast(total)).select("word", "vector", weight.alias("weight")), "words")  # one row
    part = each.join(known, "word").withColumn("share", F.col("n") * F.col("weight"))
    mean = part.groupBy("id").agg(*[(F.sum(F.col("share") * F.col("vector")[i]) / F.sum("share")).alias(f"v{i}") for i in range(size)])
    placed = mean.select("id", F.array(*_columns(size)).alias("embedding"))
    zeros = F.array(*[F.lit(0.0)] * size)
    return records.select("id").join(placed, "id", "left").select("id", F.coalesce("embedding", zeros).alias("embedding"))
