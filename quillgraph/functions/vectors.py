"""Vectors: hashing embedder, norms, cosine similarity, top-k, two-dimensional projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64
#: Letters whose words are counted together.
BLOCK = 1 << 18
PCA_STEPS = 30


def bucket(token: Column) -> Column:
    """31-based string hash modulo 64: 64 divides 2**32, so the low bits are all that count."""
    return F.aggregate(F.split(token, ""), F.lit(0), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(DIMENSIONS - 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(F.transform(a, lambda x: F.lit(0).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the common length; 0 for empty or zero vectors."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(x) * norm(y)
    return F.when((n > 0) & (length > 0), dot(x, y) / length).otherwise(0.0)


_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True


def hash_vectors(texts: list[str | None]) -> np.ndarray:
    """Normalised counts of word buckets of each text, words being runs of ASCII word characters; a blank text is the zero vector.

    The bucket of a word is its 31-based hash modulo 64. As 31 * 31 is 1 modulo 64, a letter counts once or 31 times by the parity of its
    distance from the word's end, so two running sums over all letters give every word's bucket. The sums may wrap at 256, a multiple of 64,
    so they take a byte a letter, and texts go through in blocks of about ``BLOCK`` letters.
    """
    out, lo, size = np.zeros((len(texts), DIMENSIONS), np.float32), 0, 0
    for hi, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= BLOCK or hi == len(texts):
            out[lo:hi] = _block_vectors(texts[lo:hi])
            lo, size = hi, 0
    return out


def _block_vectors(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    inside = np.r_[False, _WORD[data], False]
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    even, odd = data.copy(), data.copy()
    even[1::2] *= 31
    odd[::2] *= 31
    zero = np.zeros(1, np.uint8)
    last_even = np.concatenate([zero, np.cumsum(even, dtype=np.uint8)])
    last_odd = np.concatenate([zero, np.cumsum(odd, dtype=np.uint8)])
    bucket = np.where((end - 1) & 1 == 1, last_odd[end] - last_odd[start], last_even[end] - last_even[start]) % DIMENSIONS
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    counts = np.bincount(np.searchsorted(ends, start, side="right") * DIMENSIONS + bucket, minlength=len(raw) * DIMENSIONS).reshape(len(raw), DIMENSIONS).astype(np.float64)
    size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return (counts / np.where(size > 0, size, 1)).astype(np.float32)


def _bucket_of(word: str) -> int:
    return int(hash_vectors([word]).argmax())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    return pd.Series(list(hash_vectors(list(text))), index=text.index)


def ranked(scored: DataFrame, *group: str, order: str = "ord") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), order)))


def principal_axes(mean: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two principal axes by 30 power steps each from fixed starts, the first one deflated before the second."""
    d = len(mean)
    zero = np.zeros(d)
    if n <= 1:
        return zero, zero
    covariance = gram / n - np.outer(mean, mean)

    def power(start: np.ndarray, off: np.ndarray | None) -> np.ndarray:
        v = start / np.linalg.norm(start)
        for _ in range(PCA_STEPS):
            w = covariance @ v
            if off is not None:
                w = w - (w @ off) * off
            size = np.linalg.norm(w)
            if size <= 1e-12:
                return zero
            v = w / size
        return v

    first = power(np.ones(d), None)
    second = power(np.where(np.arange(d) % 2 == 0, 1.0, -1.0), first if first.any() else None)
    return first, second


def projection_model(vectors: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axis 1, axis 2): partial sums of the d x d product matrix per partition, so d * d numbers each reach the driver."""

    def sums(batches):
        total, n = None, 0
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else None
            if x is not None:
                ones = np.hstack([x, np.ones((len(x), 1))])
                total = ones.T @ ones if total is None else total + ones.T @ ones
                n += len(x)
        if total is not None:
            import pandas as pd

            yield pd.DataFrame({"i": np.arange(total.size), "v": total.reshape(-1)})

    rows = vectors.select(vector).where(F.col(vector).isNotNull()).mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    if not len(rows):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    d1 = int(round(len(rows) ** 0.5))
    total = rows["v"].to_numpy().reshape(d1, d1)
    n = int(round(total[-1, -1]))
    mean = total[-1, :-1] / n
    return mean, *principal_axes(mean, total[:-1, :-1], n)


def projected(vector: Column, mean: np.ndarray, axis: np.ndarray) -> Column:
    centre, direction = (F.array(*[F.lit(float(x)) for x in v]) for v in (mean, axis))
    return dot(F.zip_with(vector, centre, lambda x, m: x.cast("double") - m), direction)
