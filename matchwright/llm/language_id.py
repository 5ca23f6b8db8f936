"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a fixed-length window,
each filter is max-pooled over the window and a softmax names the language.
The network is trained in numpy (Adam, cross-entropy); back-propagation touches
only the winning position of each filter. A text is cut into consecutive
windows that cover it from its first to its last byte; the text's distribution
is the mean of its windows' distributions, weighted by their letters.

At inference the embedding and the filters are folded into lookup tables: a
byte pair selects a row that holds what the pair adds to every filter, so a
window needs two gathers and a maximum, and no matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = (2, 3, 4)
SPAN = max(WIDTHS)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
#: Bytes that count as letters when windows are weighted.
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = _LETTER[128:] = 1


@dataclass
class Params:
    """``rows_per_language`` bounds the labelled sample that reaches the driver:
    so many distinct documents of each language are expected, chosen by a hash of id
    and text, and at most ``windows_per_row`` evenly spaced windows of each."""

    window: int = 256
    embedding: int = 8
    filters: int = 12
    rows_per_language: int = 400
    windows_per_row: int = 2
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the pair at a position, and the pair two further on, add to each filter."""
        if getattr(self, "_tables", None) is None:
            e = self.embedding
            n = self.filter_bias.size
            f = n // len(WIDTHS)
            part = np.zeros((SPAN, 256, n), dtype=np.float32)
            for k, (w, kernel) in enumerate(zip(WIDTHS, self.filters)):
                for j in range(w):
                    part[j, :, k * f : (k + 1) * f] = e @ kernel[j]
            near = (part[0][:, None, :] + part[1][None, :, :]).reshape(65536, n) + self.filter_bias
            far = (part[2][:, None, f:] + part[3][None, :, f:]).reshape(65536, n - f)
            self._tables = np.ascontiguousarray(near, np.float32), np.ascontiguousarray(far, np.float32), f
        return self._tables

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Class probabilities of windows given as an array (n, window) of folded bytes."""
        near, far, f = self.tables()
        probs = np.empty((len(rows), len(self.languages)))
        last = self.window - SPAN + 1
        for a in range(0, len(rows), 64):
            x = rows[a : a + 64].astype(np.uint16)
            pair = (x[:, :-1] << 8) | x[:, 1:]
            act = near[pair[:, :last]]
            act[:, :, f:] += far[pair[:, 2 : 2 + last]]
            pooled = np.maximum(act.max(axis=1), 0.0)
            z = pooled @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            probs[a : a + 64] = z / z.sum(axis=1, keepdims=True)
        return probs

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and the score of each text, in blocks of bounded size."""
        size = self.window
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        k = 0
        while k < len(texts):
            owner, rows, held = [], [], 0
            begin = k
            while k < len(texts) and (held == 0 or held + len(texts[k]) < 1_000_000):
                held += len(texts[k])
                k += 1
            total = np.zeros((k - begin, len(self.languages)))
            counts = [max(1, -(-len(t) // size)) for t in texts[begin:k]]
            flat = np.full(sum(counts) * size, 32, dtype=np.uint8)
            at = 0
            for t, n in zip(texts[begin:k], counts):
                flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
                at += n * size
            rows = _FOLD[flat].reshape(-1, size)
            owner = np.repeat(np.arange(k - begin), counts)
            weight = _LETTER[rows].sum(axis=1, dtype=np.int64) + 1e-9
            np.add.at(total, owner, self.windows(rows) * weight[:, None])
            total /= total.sum(axis=1, keepdims=True)
            best[begin:k] = total.argmax(axis=1)
            score[begin:k] = total.max(axis=1)
        return best, np.clip(score, 0.0, 1.0)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], p: Params) -> Model:
    """Fit the network to folded windows (n, p.window) and class numbers."""
    rng = np.random.default_rng(p.seed)
    e, f, classes = p.embedding, p.filters, len(languages)
    emb = rng.normal(0, 0.5, (256, e))
    kernels = [rng.normal(0, (1.0 / (w * e)) ** 0.5, (w * e, f)) for w in WIDTHS]
    bias = np.zeros(f * len(WIDTHS))
    out, out_bias = rng.normal(0, 0.1, (f * len(WIDTHS), classes)), np.zeros(classes)
    weights = [emb, *kernels, bias, out, out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    positions = p.window - SPAN + 1
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), p.batch):
            pick = order[a : a + p.batch]
            x, y = rows[pick], labels[pick]
            n = len(pick)
            seen = emb[x].astype(np.float32)
            pooled, where = [], []
            for w, kernel in zip(WIDTHS, kernels):
                patch = np.lib.stride_tricks.as_strided(seen, (n, positions, w * e), (seen.strides[0], seen.strides[1], seen.strides[2]))
                act = (np.ascontiguousarray(patch).reshape(-1, w * e) @ kernel.astype(np.float32)).reshape(n, positions, f)
                where.append(act.argmax(axis=1))
                pooled.append(np.take_along_axis(act, where[-1][:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(pooled, axis=1).astype(np.float64) + bias
            hidden = np.maximum(raw, 0)
            z = hidden @ out + out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y] -= 1
            z /= n
            g_hidden = (z @ out.T) * (raw > 0)
            grads = [np.zeros_like(emb), *[np.zeros_like(k) for k in kernels], g_hidden.sum(axis=0), hidden.T @ z, z.sum(axis=0)]
            for k, w in enumerate(WIDTHS):
                g = g_hidden[:, k * f : (k + 1) * f]
                at = where[k][:, :, None] + np.arange(w)
                bytes_at = x[np.arange(n)[:, None, None], at]
                patch = emb[bytes_at].reshape(n, f, w * e)
                grads[1 + k] += np.einsum("nfd,nf->df", patch, g)
                g_patch = (g[:, :, None] * kernels[k].T[None]).reshape(n, f, w, e)
                np.add.at(grads[0], bytes_at, g_patch)
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    shaped = [k.reshape(w, e, f).astype(np.float32) for w, k in zip(WIDTHS, kernels)]
    return Model(languages, emb.astype(np.float32), shaped, bias.astype(np.float32), out, out_bias, p.window)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", params: Params | None = None) -> Model:
    """Train on a bounded sample of the labelled rows of ``docs``.

    Rows without a language or without text teach nothing, rows that repeat id and text
    teach once, and the order of the rows is of no effect. With no labelled row at all the model knows no language, and every text is ``und``."""
    p = params or Params()
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((256, 1), np.float32), [], np.zeros(0, np.float32), np.zeros((0, 0)), np.zeros(0), p.window)
    languages = sorted(counts)
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, p.rows_per_language / n))).otherwise(share)
    chance = F.pmod(F.xxhash64("k", "t", F.lit(p.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = p.window * 4
    pieces = F.array(*[F.substring("t", F.greatest(F.lit(1), (F.length("t") * (2 * i + 1) / (2 * p.windows_per_row)).cast("int") - p.window // 2), F.lit(p.window)) for i in range(p.windows_per_row)])
    sample = known.where(chance < share).select("l", F.explode(F.array_distinct(pieces)).alias("t")).where(F.length("t") <= room).distinct()
    got = sample.toArrow()
    rows = np.full((got.num_rows, p.window), 32, dtype=np.uint8)
    for i, t in enumerate(got.column("t").to_pylist()):
        b = t.encode()[: p.window]
        rows[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
    index = {name: i for i, name in enumerate(languages)}
    labels = np.array([index[x] for x in got.column("l").to_pylist()])
    order = sorted(range(len(rows)), key=lambda i: (labels[i], rows[i].tobytes()))
    return train(_FOLD[rows][order], labels[order], languages, p)


def predict(text: Column, model: Model) -> Column:
    """A struct column (lang string, score double) for a text column. A null
    text, a text without a letter and a model without languages give ``und``, 0."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    if not model.languages:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang:string,score:double>")
    def apply(values: pa.Array) -> pa.Array:
        texts = [memoryview(v.as_buffer()) if v.is_valid else b"" for v in values]
        best, score = model.texts(texts)
        names = pa.array(model.languages).take(pa.array(best))
        return pa.StructArray.from_arrays([names.cast(pa.string()), pa.array(score)], fields=list(kind))

    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    # Not repeated where a filter and a projection both read it.
    got = apply.asNondeterministic()(F.when(has_letter, text))
    return F.when(has_letter, got).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))


def held_out(key: Column) -> Column:
    """Whether a document may only be predicted: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", params: Params | None = None) -> DataFrame:
    """All rows and columns of ``docs`` and a struct column ``language_id`` (with
    underscores appended if that name is taken), from a model trained on
    ``labelled``: by default the rows of ``docs`` that are not held out.

    Of languages with the same mean (ties) the first in order of names is given. Rows
    that repeat, and rows with null or repeated ids, are predicted each for itself;
    null ids are not held out. An empty table gives an empty one."""
    from .common import small_batches, temp_name

    small_batches(docs.sparkSession)
    taught = labelled if labelled is not None else docs.where(~held_out(F.col(key)))
    model = fit(taught, text, lang, key, params)
    return docs.withColumn(temp_name(docs, "language_id"), predict(F.col(text), model))
