"""Tables in the shared folder of the cluster, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def steady(spark: SparkSession) -> SparkSession:
    """Set what all plans here rely on: Arrow batches of few megabytes, and a rule of Spark 4.1 off that gives wrong groups.

    By that rule a union keeps the partitioning that its children have in common, and an aggregate or window over it needs no shuffle;
    but where adaptive execution merges the children's partitions in different ways, a group stands in two of them and comes twice.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64MB"):  # not set by the user
        spark.conf.set(_BATCH, "8MB")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under ``spark.checkpoint.dir``, which every executor must see.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster there is no safe place, so it is an error.
    """
    root = steady(spark).conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = getattr(spark, "_quillgraph_tmp", None) or tempfile.mkdtemp(prefix="quillgraph-")
        spark._quillgraph_tmp = root
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/quillgraph-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quillgraph-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(ids: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A narrow table, written once; broadcast if it has at most ``rows`` rows, else left to a shuffle join."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= rows else ids


def ranked_globally(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with the running number (from 1) of each in the order of the whole table.

    Rows are range-partitioned, numbered in their partition and shifted by the counts of the partitions before it, so no
    task sees the whole table.
    """
    part, here, ahead = f"{name}_part", f"{name}_here", f"{name}_ahead"
    dealt = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count("*").alias(here))
    before = counts.select(part, (F.sum(here).over(Window.orderBy(part)) - F.col(here)).alias(ahead))  # one row a partition
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(before), part).withColumn(name, F.col(ahead) + within).drop(part, ahead)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b) as (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stops changing. Every step is an aggregate and a
    join; no edge or label reaches the driver, only a row count and a checksum per round. Rounds grow with the logarithm of
    the longest path, so there is no limit to them.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node points at smaller nodes only; a node that already is the least of its own keeps its edges through others
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small)
        forget(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
