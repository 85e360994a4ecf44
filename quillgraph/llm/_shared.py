"""Tables in the shared folder of the cluster, and connected components over them."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.tables import components, forget, shared_dir, small, steady, written

__all__ = ["chunked", "components", "content_key", "forget", "fresh", "groups", "lean", "looked_up", "released", "shared_dir", "small", "trimmed", "without", "written"]


def trimmed(run):
    """``run`` over Arrow batches, after which the worker gives the memory that it no longer needs back, as it may wait beside
    other stages."""
    return lambda batches: released(run(batches))


def released(batches):
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a C library that can
        pass


def lean(spark) -> None:
    """Arrow batches of 2 MB where the user has set no size: wide binary rows of many stages cost an executor less memory outside its
    heap, at the same speed."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if steady(spark).conf.get(size) == "8MB":  # the usual size here
        spark.conf.set(size, "2MB")


#: Tasks that the rows of one key are spread over in a salted join.
SALTS = 16


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}" in taken:
            name += "_"
        out.append(f"_{name}")
    return out


def content_key(*columns: str) -> tuple[Column, Column]:
    """Two 64-bit ids of what stands in the columns of a row; null and empty are equal."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.xxhash64(*parts).alias("key1"), F.xxhash64(F.lit(1), *parts).alias("key2")


def without(docs: DataFrame, bad: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose content in ``columns`` has none of the keys (key1, key2) of ``bad``.

    A verdict that depends on these columns alone goes back to just the rows it was made for, whatever their ids.
    """
    one, two = content_key(*columns)
    bad1, bad2 = fresh(docs, "bad1", "bad2")
    bad = small(bad.select(F.col("key1").alias(bad1), F.col("key2").alias(bad2)).distinct())
    return docs.join(bad, (one == F.col(bad1)) & (two == F.col(bad2)), "left_anti")


def groups(batches):
    """Columns of a stream sorted by its first column, cut so that no group of equal keys is parted."""
    held: list[list[np.ndarray]] = []  # the group that may go on

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        end = int(np.searchsorted(columns[0], columns[0][-1]))
        if end or held and held[-1][0][-1] != columns[0][0]:
            yield joined([*held, [c[:end] for c in columns]])
            held = []
        held.append([c[end:] for c in columns])
    if held:
        yield joined(held)


def chunked(rows: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """``rows`` with groups of more than ``most`` rows dealt into chunks, where every two chunks of a group are a group of their own.

    All pairs of items of a group still meet, but no task holds more than about twice ``most`` of them.
    """
    big = written(rows.groupBy(group).agg(F.count("*").alias("n_")).where(F.col("n_") > most))
    if big.isEmpty():
        return rows
    dealt = rows.join(big, group, "left").withColumn("chunks_", F.ceil(F.col("n_") / most).cast("int"))
    dealt = dealt.withColumn("own_", F.pmod(F.xxhash64(item), F.col("chunks_")).cast("int"))
    dealt = dealt.withColumn("other_", F.explode(F.when(F.col("chunks_") > 1, F.sequence(F.lit(0), F.col("chunks_") - 1)).otherwise(F.array(F.lit(0)))))
    named = F.when(F.col("chunks_") > 1, F.xxhash64(group, F.least("own_", "other_"), F.greatest("own_", "other_"))).otherwise(F.col(group))
    return dealt.withColumn(group, named).drop("n_", "chunks_", "own_", "other_")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", most: int = 2_000_000) -> DataFrame:
    """``rows`` joined with a table of unique ``keys``, where one key may fill a large part of ``rows``.

    A table of at most ``most`` rows is broadcast; for a larger one the rows of each key are spread over ``SALTS`` tasks by ``by``
    and the table is repeated for each.
    """
    table = written(table)
    if table.count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    repeated = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "salt_"], how).drop("salt_")
