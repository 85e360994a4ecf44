"""Exact nearest-vector search over a table that is clustered once.

Vectors are brought to length one, so cosine similarity s is the distance sqrt(2 - 2 s). Centroids are fitted on at most ``SAMPLE``
rows, the least by a hash of their key; every row is then assigned to its nearest centroid and the table is sorted by cluster and
distance to it, so that Parquet's statistics skip what a search leaves out. A search reads each question's nearest clusters first, which gives a bound
for its k-th distance, and then only rows that the triangle inequality can't rule out: clusters whose shell lies within the
bound, and in them the rows whose distance to the centroid differs from the question's by no more. The result is that of a full scan.

Vectors that are null, empty or of another length than most are compared over the common length and are always read; zero vectors
score 0 and are read where the bound allows that.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import vectors as vx
from quillgraph.operators.tables import shared_dir

SAMPLE = 8192
MOST = 1024
ROUNDS = 6
BLOCK = 256  # questions that go through the table together
ROWS = 512  # rows of a task that meet all centroids together
_ODD, _ZERO = -2, -1
_SLACK = 1e-6
_ROW_GROUP = 4 << 20


@dataclass
class Clustered:
    """The sorted table (cluster, radius, other columns) and what a search plans with: centroids, sizes and shells."""

    table: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: str
    vector: str


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows of the sample."""
    k = min(len(sample), max(1, n))
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        of = np.argmax(sample @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        count = np.bincount(of, minlength=k)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _dense(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have ``d`` numbers, as a matrix, and which rows these are."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == d) if d else np.zeros(0, np.int64)
    flat = column.take(pa.array(whole)).flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), d), whole


def _assigned(centroids: np.ndarray, place: int):
    half = 0.5 * (centroids**2).sum(axis=1)

    def run(batches):
        for b in batches:
            x, whole = _dense(b.column(place), centroids.shape[1])
            cluster, radius = np.full(b.num_rows, _ODD, np.int32), np.zeros(b.num_rows)
            norms = np.linalg.norm(x, axis=1)
            cluster[whole[norms == 0]] = _ZERO
            x, whole = _unit(x[norms > 0]), whole[norms > 0]
            for lo in range(0, len(whole), ROWS):  # a number for each row and centroid is held at a time
                some, at = x[lo : lo + ROWS], whole[lo : lo + ROWS]
                cluster[at] = np.argmax(some @ centroids.T - half, axis=1)
                radius[at] = np.linalg.norm(some - centroids[cluster[at]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(radius), *b.columns], names=["cluster", "radius", *b.schema.names])

    return run


def clustered(vectors: DataFrame, key: str = "ord", vector: str = "embedding") -> Clustered:
    """``vectors`` (key, vector and any other columns) assigned to clusters, about sqrt(rows) / 2 but at most ``MOST``."""
    rows = vectors.withColumn(vector, F.col(vector).cast("array<double>"))
    known = rows.where(F.size(vector) > 0)
    first = known.select(vector).withColumn("h", F.xxhash64(vector)).orderBy("h").limit(SAMPLE).select(vector).collect()
    lengths = [len(r[0]) for r in first]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    usual = [[x or 0.0 for x in r[0]] for r in first if len(r[0]) == d]
    sample = np.array(usual, np.float64).reshape(len(usual), d)
    sample = _unit(sample[np.linalg.norm(sample, axis=1) > 0])
    n = known.count()
    centroids = _fitted(sample, min(MOST, math.ceil(math.sqrt(n) / 2))) if len(sample) else np.zeros((0, d))
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("radius", T.DoubleType()), *rows.schema])
    path = shared_dir(vectors.sparkSession)
    dealt = rows.mapInArrow(_assigned(centroids, rows.columns.index(vector)), schema)
    dealt.repartitionByRange("cluster", "radius").sortWithinPartitions("cluster", "radius").write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    table = vectors.sparkSession.read.schema(schema).parquet(path)
    sizes, low, high = np.zeros(len(centroids), np.int64), np.zeros(len(centroids)), np.zeros(len(centroids))
    for c, count, a, b in table.where("cluster >= 0").groupBy("cluster").agg(F.count("*"), F.min("radius"), F.max("radius")).collect():  # at most MOST rows
        sizes[c], low[c], high[c] = count, a, b
    return Clustered(table, centroids, sizes, low, high, key, vector)


def distances(index: Clustered, queries: np.ndarray) -> np.ndarray:
    """From each question (of length one, or zero) to each centroid."""
    gap = (queries**2).sum(axis=1)[:, None] + (index.centroids**2).sum(axis=1)[None, :] - 2 * queries @ index.centroids.T
    return np.sqrt(np.maximum(gap, 0))


def first_clusters(index: Clustered, away: np.ndarray, k: int) -> np.ndarray:
    """For each question the nearest clusters that hold ``k`` rows together, as a table of flags."""
    order = np.argsort(away, axis=1)
    ahead = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
    flags = np.zeros(away.shape, bool)
    np.put_along_axis(flags, order, ahead < k, axis=1)
    return flags


def possible_clusters(index: Clustered, away: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each question the clusters whose shell comes within its bound."""
    return (away - index.high <= bound[:, None]) & (index.low - away <= bound[:, None]) & (index.sizes > 0)


def _scan(index: Clustered, queries: np.ndarray, away: np.ndarray, flags: np.ndarray, bound: np.ndarray, k: int, rest: bool) -> DataFrame:
    """(q, columns, score): the best rows of each batch in the flagged clusters; ``rest``: odd and zero vectors too."""
    columns = [c for c in index.table.columns if c not in ("cluster", "radius", index.vector)]
    wanted = [int(c) for c in np.flatnonzero(flags.any(axis=0))] + ([_ODD] if rest else [])
    zero = bound >= math.sqrt(2) - _SLACK
    if rest and zero.any():
        wanted.append(_ZERO)
    d, at = index.centroids.shape[1], index.table.columns.index(index.vector)
    key = index.key

    def scored(b: pa.RecordBatch):
        cluster = b.column(0).to_numpy(zero_copy_only=False)
        radius = b.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
        for lo, hi in itertools.pairwise(cuts.tolist()):
            c = int(cluster[lo])
            if c >= 0:
                x, _ = _dense(b.column(at).slice(lo, hi - lo), d)
                x = _unit(x)
                for q in np.flatnonzero(flags[:, c]).tolist():
                    a, z = np.searchsorted(radius[lo:hi], [away[q, c] - bound[q], away[q, c] + bound[q]])
                    if a < z:
                        yield q, np.arange(lo + a, lo + z), x[a:z] @ queries[q]
            elif c == _ZERO:
                for q in np.flatnonzero(zero).tolist():
                    yield q, np.arange(lo, hi), np.zeros(hi - lo)
            else:
                for i, value in enumerate(b.column(at).slice(lo, hi - lo).to_pylist()):
                    v = np.array([y or 0.0 for y in value or []], np.float64)
                    n = min(len(v), queries.shape[1])
                    size = np.linalg.norm(v[:n]) * np.linalg.norm(queries[:, :n], axis=1)
                    score = np.where(size > 0, queries[:, :n] @ v[:n] / np.where(size > 0, size, 1), 0.0)
                    for q in range(len(queries)):
                        yield q, np.array([lo + i]), score[q : q + 1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for q, rows, score in scored(b):
                score = np.round(score, 12)  # equal vectors tie, wherever they stand in a block
                if q in best:
                    rows, score = np.r_[best[q][0], rows], np.r_[best[q][1], score]
                if len(rows) > k:
                    few = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    few = few[np.lexsort((keys[rows[few]], -score[few]))][:k]
                    rows, score = rows[few], score[few]
                best[q] = rows, score
            if best:
                at_rows = pa.array(np.concatenate([r for r, _ in best.values()]))
                q = np.repeat(np.array(list(best), np.int32), [len(r) for r, _ in best.values()])
                kept = [b.column(b.schema.get_field_index(c)).take(at_rows) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(q), *kept, pa.array(np.concatenate([s for _, s in best.values()]))], names=["q", *columns, "score"])

    schema = T.StructType([T.StructField("q", T.IntegerType()), *[index.table.schema[c] for c in columns], T.StructField("score", T.DoubleType())])
    return index.table.where(F.col("cluster").isin(wanted)).mapInArrow(run, schema)


def nearest(index: Clustered, queries: np.ndarray, k: int) -> DataFrame:
    """(q, columns, score, rank): the k rows most similar to each row of ``queries`` (at most ``BLOCK``), ties by key."""
    queries = _unit(np.asarray(queries, np.float64))
    d = index.centroids.shape[1]
    if queries.shape[1] != d:  # compared over the common length, which the clusters say nothing about
        return _ranked(_common(index, queries), index.key, k)
    away = distances(index, queries)
    first = first_clusters(index, away, k)
    wide = np.full(len(queries), math.inf)
    near = _scan(index, queries, away, first, wide, k, rest=False)
    kth = _ranked(near, index.key, k).where(F.col("rank") == k).select("q", "score").collect()  # a row a question
    bound = wide.copy()
    for q, score in kth:
        bound[q] = math.sqrt(max(0.0, 2 - 2 * score)) + _SLACK
    if not len(index.sizes) or not queries.any():
        bound = wide
    return _ranked(_scan(index, queries, away, possible_clusters(index, away, bound), bound, k, rest=True), index.key, k)


def _common(index: Clustered, queries: np.ndarray) -> DataFrame:
    """Every row's similarity over the common length with questions of another length."""
    columns = [c for c in index.table.columns if c not in ("cluster", "radius", index.vector)]
    asked = F.array(*[F.struct(F.lit(q).alias("q"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for q, v in enumerate(queries)])
    rows = index.table.select(*columns, index.vector, F.explode(asked).alias("a"))
    return rows.select(F.col("a.q").cast("int").alias("q"), *columns, vx.cosine(F.col(index.vector), F.col("a.v")).alias("score"))


def _ranked(rows: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_of(index: Clustered, questions: DataFrame, k: int) -> DataFrame:
    """(q_id, columns, score, rank) for ``questions`` (q_id, vector) in blocks of ``BLOCK``."""
    spark, out = questions.sparkSession, None
    asked = questions.select("q_id", "vector").orderBy("q_id").toLocalIterator()
    while block := list(itertools.islice(asked, BLOCK)):
        d = max(len(r["vector"] or []) for r in block)
        vectors = np.array([[x or 0.0 for x in r["vector"] or []] + [0.0] * (d - len(r["vector"] or [])) for r in block], np.float64).reshape(len(block), d)
        named = spark.createDataFrame([(q, r["q_id"]) for q, r in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), questions.schema["q_id"]]))
        part = nearest(index, vectors, k).join(F.broadcast(named), "q").drop("q")
        out = part if out is None else out.unionByName(part)
    if out is None:
        columns = [index.table.schema[c] for c in index.table.columns if c not in ("cluster", "radius", index.vector)]
        return spark.createDataFrame([], T.StructType([questions.schema["q_id"], *columns, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return out
