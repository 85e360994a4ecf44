"""The graph store: one Parquet table per kind of record, partitioned by corpus and by buckets of a hash of the key.

Parquet has no row-level updates, so a write makes a new version of the buckets that hold the keys it touches: rows by key, the last
one wins. The new version is written beside the old one and then swapped in, partition by partition (dynamic overwrite), so files are read and
written in proportion to the change once it is small against the number of buckets. Reads are DataFrames with the partition filter
pushed to the scan.
"""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import maps
from quillgraph.operators.tables import forget, steady, written
from quillgraph.sources.schemas import KEYS, SCHEMAS

EVENTS, TRACES = 5000, 500
TERMINAL = ("ingestion-complete", "error")


#: The partition column beside corpus_id.
BUCKET = "key_bucket"
#: Parts that a bucket's rows are dealt to by their keys when it is written; small ones end in one.
SPREAD = 64
#: Keys that are broadcast to the rows of a table.
NEAR = 2_000_000


class Store:
    """A store under ``path``; ``buckets`` a corpus and table must stay the same for a path, and may be thousands for large corpora."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets, self._cache = steady(spark), path.rstrip("/"), buckets, OrderedDict()

    # -- reads -----------------------------------------------------------------------------------------------------------

    def table(self, name: str, corpus: str | None = None) -> DataFrame:
        """The rows of a table, of one corpus or all."""
        rows = self._bucketed(name).drop(BUCKET)
        return rows if corpus is None else rows.where(F.col("corpus_id") == corpus)

    def _bucketed(self, name: str) -> DataFrame:
        """A table with the bucket that each row lies in."""
        schema = self.spark.createDataFrame([], f"{SCHEMAS[name]}, {BUCKET} int").schema
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*schema.names)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _bucket(self, name: str) -> Column:
        """The bucket of a key."""
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS[name]]
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int") if key else F.lit(0)

    def _within(self, name: str, places: list[tuple[str, int]]) -> DataFrame:
        """The rows of some buckets; the filter is on partition columns."""
        of: dict[str, list[int]] = {}
        for corpus, bucket in places:
            of.setdefault(corpus, []).append(bucket)
        test = F.lit(False)
        for corpus, buckets in of.items():
            test = test | ((F.col("corpus_id") == corpus) & F.col(BUCKET).isin(buckets))
        return self._bucketed(name).where(test)

    def cached(self, name: str, corpus: str, seconds: float | None = None) -> DataFrame:
        """A read that is kept in memory until the next write to its table, or until it is ``seconds`` old."""
        key = name, corpus
        if key in self._cache and seconds is not None and time.monotonic() - self._cache[key][1] > seconds:
            self._cache.pop(key)[0].unpersist()
        if key not in self._cache:
            self._cache[key] = self.table(name, corpus).cache(), time.monotonic()
            while len(self._cache) > 16:
                self._cache.popitem(last=False)[1][0].unpersist()
        return self._cache[key][0]

    def invalidate(self, name: str | None = None, corpus: str | None = None) -> None:
        """Forget the kept reads of a table, a corpus, or all."""
        for key in [k for k in self._cache if name in (None, k[0]) and corpus in (None, k[1])]:
            self._cache.pop(key)[0].unpersist()

    def units(self, corpus: str) -> DataFrame:
        return self.table("text_units", corpus).orderBy("document_name", "ordinal", "id")

    # -- writes ----------------------------------------------------------------------------------------------------------

    def _replace(self, name: str, rows: DataFrame, places: list[tuple[str, int]]) -> None:
        """Put ``rows`` (with their buckets, all in ``places``) in place of what these buckets hold."""
        self.invalidate(name)
        fresh = written(self._dealt(name, rows.select(*self._bucketed(name).columns)))
        self._put(name, fresh)
        left = {tuple(r) for r in fresh.select("corpus_id", BUCKET).distinct().collect()}
        forget(fresh)
        for corpus, bucket in set(places) - left:
            self._drop(name, corpus, bucket)

    def _dealt(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with those of a bucket in few tasks, of which large ones are split by what they would read."""
        return rows.withColumn("_s", self._share(name)).hint("rebalance", "corpus_id", BUCKET, "_s").drop("_s")

    def _share(self, name: str) -> Column:
        return F.pmod(F.hash(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS[name]], F.lit(0)), F.lit(SPREAD))

    def _put(self, name: str, staged: DataFrame) -> None:
        """Swap staged rows in for the buckets that they lie in; as they are dealt by bucket already, they are not shuffled again."""
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_id", BUCKET).parquet(f"{self.path}/{name}")

    def _places(self, rows: DataFrame) -> list[tuple[str, int]]:
        """The buckets of ``rows``: at most ``buckets`` for each corpus that a write touches."""
        return [tuple(r) for r in rows.select("corpus_id", BUCKET).distinct().collect()]

    def _drop(self, name: str, corpus: str, bucket: int | None = None) -> None:
        self.invalidate(name)
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(corpus)
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/corpus_id={folder}" + (f"/{BUCKET}={bucket}" if bucket is not None else ""))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _merge(self, name: str, rows: DataFrame, *last: Column) -> None:
        """Put rows with their buckets by key; of equal keys, stored ones too, the first in the order ``last`` stays."""
        rows = written(rows)
        places = self._places(rows)
        every = self._within(name, places).unionByName(rows)
        one = F.row_number().over(Window.partitionBy("corpus_id", *KEYS[name]).orderBy(*last))
        self._replace(name, every.withColumn("n_", one).where("n_ = 1"), places)
        forget(rows)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Put rows by key; later rows of ``rows`` (by ``ord`` where there is one) win."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        if "attributes" in schema.names:
            rows = rows.withColumn("attributes", maps.attributes(F.col("attributes")))
        if name == "relationships":
            rows = rows.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)))
        key = ["corpus_id", *KEYS[name]]
        rows = rows.withColumn(BUCKET, self._bucket(name))
        if "ord" not in schema.names:
            rows = self._dealt(name, rows).withColumn("_s", F.lit(0))
        else:
            rows = rows.withColumn("_s", self._share(name)).repartition("corpus_id", BUCKET, "_s")
            last = F.row_number().over(Window.partitionBy("corpus_id", BUCKET, "_s", *key[1:]).orderBy(F.desc("ord")))
            rows = rows.withColumn("_n", last).where("_n = 1").drop("_n")
        rows = written(rows.drop("_s"))
        places = self._places(rows)
        old = self._within(name, places)
        if old.isEmpty():  # nothing to keep
            self.invalidate(name)
            self._put(name, rows)
        else:
            old = old.join(rows.select(*key), key, "left_anti")
            self._replace(name, old.select(*rows.columns).unionByName(rows), places)
        forget(rows)

    def put_entities(self, rows: DataFrame) -> None:
        self.upsert("entities", rows.withColumn("identity", maps.identity(F.col("name"), F.col("type"))))

    def put_relationships(self, rows: DataFrame) -> None:
        """Upsert edges and create ends that don't exist yet, by name and type."""
        self.upsert("relationships", rows)
        ends = rows.select("corpus_id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type")))).alias("e"))
        stubs = ends.select("corpus_id", "e.name", "e.type", maps.identity(F.col("e.name"), F.col("e.type")).alias("identity")).distinct()
        stubs = stubs.join(self.table("entities"), ["corpus_id", "identity"], "left_anti")
        self.upsert("entities", stubs.withColumn("ord", F.lit(1 << 40) + F.pmod(F.xxhash64("identity"), F.lit(1 << 40))).withColumn("description", F.lit("")))

    def put_memberships(self, rows: DataFrame) -> None:
        """Upsert memberships and create communities and entities that they name and nothing has yet."""
        rows = rows.withColumn("community_id", F.coalesce(F.nullif(F.trim("community_id"), F.lit("")), F.lit("community-unknown")))
        self.upsert("memberships", rows)
        lost = rows.select("corpus_id", "community_id").distinct().join(self.table("communities"), ["corpus_id", "community_id"], "left_anti")
        self.upsert("communities", lost.withColumns({"title": F.lit(""), "summary": F.lit("Community cluster"), "ord": F.lit(1 << 40).cast("long")}))
        stubs = rows.select("corpus_id", "identity").distinct().join(self.table("entities"), ["corpus_id", "identity"], "left_anti")
        named = {"name": F.substring_index("identity", "::", 1), "type": F.initcap(F.substring_index("identity", "::", -1)), "description": F.lit(""), "ord": F.lit(1 << 40) + F.pmod(F.xxhash64("identity"), F.lit(1 << 40))}
        self.upsert("entities", stubs.withColumns(named))

    def mentions(self, corpus: str) -> DataFrame:
        """(identity, unit_id): which entities are mentioned in which stored units."""
        from quillgraph.operators import graph

        return graph.mentions(self.table("entities", corpus), self.table("text_units", corpus))

    def put_embeddings(self, name: str, rows: DataFrame) -> None:
        """Upsert vectors; mixed dimensions, or others than those stored, are an error."""
        sizes = rows.select("corpus_id", F.size("embedding").alias("d")).unionByName(self.table(name).select("corpus_id", F.size("embedding").alias("d"))).groupBy("corpus_id").agg(F.countDistinct("d").alias("k"))
        if not sizes.where("k > 1").isEmpty():
            raise ValueError("embeddings of one corpus must have one dimension")
        self.upsert(name, rows)

    def put_chunks(self, rows: DataFrame) -> None:
        self.upsert("chunks", rows.where("text is not null and embedding is not null and projection is not null"))

    def retype(self, corpus: str, previous: str, name: str, kind: str) -> None:
        """Give an entity a new name and type, and rewrite the ends of its edges."""
        new = maps.identity(F.lit(name), F.lit(kind))
        # what has the new key already takes the place of the old one, or leaves it to it, as a later write would
        ends = {"src_id": ("src_id", new), "source": ("src_id", F.lit(name)), "source_type": ("src_id", F.lit(kind)), "tgt_id": ("tgt_id", new), "target": ("tgt_id", F.lit(name)), "target_type": ("tgt_id", F.lit(kind))}
        own = {"identity": ("identity", new)}
        given = own | {"name": ("identity", F.lit(name)), "type": ("identity", F.lit(kind))}
        hit, edge = F.col("identity") == previous, (F.col("src_id") == previous) | (F.col("tgt_id") == previous)
        for table, test, values, last in (("entities", hit, given, F.desc("ord")), ("relationships", edge, ends, F.desc("ord")), ("memberships", hit, own, F.col("ord").asc()), ("entity_embeddings", hit, own, F.hash("embedding").asc())):
            old = written(self.table(table, corpus).where(test))
            if not old.isEmpty():
                moved = old.select(*[F.when(F.col(values[c][0]) == previous, values[c][1]).otherwise(F.col(c)).alias(c) if c in values else c for c in old.columns])
                self._without(table, corpus, old.select(*KEYS[table]), *KEYS[table])
                self._merge(table, moved.withColumn(BUCKET, self._bucket(table)), last)
            forget(old)

    # -- deletes (all idempotent) -----------------------------------------------------------------------------------------

    def _without(self, name: str, corpus: str, gone: DataFrame, *on: str) -> None:
        """Rewrite the buckets that hold rows of ``gone`` without these."""
        gone = written(gone.select(*on) if list(on) == KEYS[name] else gone.select(*on).distinct())
        rows = self._bucketed(name).where(F.col("corpus_id") == corpus)
        if list(on) == KEYS[name]:  # the keys tell their buckets
            places = self._places(gone.select(F.lit(corpus).alias("corpus_id"), self._bucket(name).alias(BUCKET)))
        else:
            near = F.broadcast(gone) if gone.count() <= NEAR else gone
            places = self._places(rows.join(near, list(on), "left_semi"))
        if places:
            self._replace(name, self._within(name, places).join(gone, list(on), "left_anti"), places)
        forget(gone)

    def delete_units(self, corpus: str, ids: DataFrame) -> None:
        self._without("text_units", corpus, ids, "id")

    def delete_entities(self, corpus: str, ids: DataFrame) -> None:
        """Entities with their edges, memberships and embeddings."""
        ids = written(ids.select("identity").distinct())
        for end in ("src_id", "tgt_id"):
            self._without("relationships", corpus, ids.withColumnRenamed("identity", end), end)
        for name in ("memberships", "entity_embeddings", "entities"):
            self._without(name, corpus, ids, "identity")
        forget(ids)

    def delete_relationships(self, corpus: str, keys: DataFrame) -> None:
        self._without("relationships", corpus, keys, *KEYS["relationships"])

    def delete_communities(self, corpus: str, ids: DataFrame | None = None) -> None:
        """Communities (community_id), or all, with their memberships and embeddings."""
        for name in ("communities", "memberships", "community_embeddings"):
            if ids is None:
                self._drop(name, corpus)
            else:
                self._without(name, corpus, ids, "community_id")

    def delete_chunks(self, corpus: str, document: str | None = None) -> None:
        if document is None:
            self._drop("chunks", corpus)
        else:
            self._without("chunks", corpus, self.table("chunks", corpus).where(F.col("document_name") == document).select("id"), "id")

    def delete_corpus(self, corpus: str) -> None:
        for name in SCHEMAS:
            self._drop(name, corpus)

    def violations(self) -> DataFrame:
        """(table, corpus_id, n): keys that stand more than once."""
        out = None
        for name, key in KEYS.items():
            rows = self.table(name).groupBy("corpus_id", *key).count().where("count > 1").groupBy("corpus_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "corpus_id", "n")
            out = rows if out is None else out.unionByName(rows)
        return out

    # -- registry, traces, events -------------------------------------------------------------------------------------------

    def register(self, corpus: str, documents: list[str], name: str | None = None) -> None:
        now = F.current_timestamp()
        names = F.array(*[F.lit(d) for d in documents]).cast("array<string>")
        label = F.lit(name) if name else maps.corpus_name(names)
        self.upsert("corpora", self.spark.range(1).select(F.lit(corpus).alias("corpus_id"), label.alias("name"), names.alias("document_names"), F.lit("BUILDING").alias("status"), now.alias("created_at"), now.alias("last_activated_at")))

    def mark(self, corpus: str, status: str | None = None) -> None:
        """Set a status, or record an activation."""
        rows = self.table("corpora", corpus)
        self.upsert("corpora", rows.withColumn("status", F.lit(status)) if status else rows.withColumn("last_activated_at", F.current_timestamp()))

    def corpora(self) -> DataFrame:
        return self.table("corpora").orderBy(F.desc("last_activated_at"), "corpus_id")

    def reconcile(self) -> None:
        """Builds that a stopped process left behind have failed."""
        self.upsert("corpora", self.table("corpora").where("status = 'BUILDING'").withColumn("status", F.lit("FAILED")))

    def put_trace(self, steps: DataFrame, most: int = TRACES) -> None:
        """Put traces; a corpus keeps the ``most`` that were put or read last."""
        touched = written(steps.select("corpus_id", "trace_id").distinct())
        self.upsert("trace_steps", steps)
        corpora = self._touch(touched)
        seen = self.table("trace_uses").where(F.col("corpus_id").isin(corpora))
        old = written(seen.withColumn("n_", F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.desc("used_at"), "trace_id"))).where(F.col("n_") > most).select("corpus_id", "trace_id"))
        if not old.isEmpty():
            for name in ("trace_steps", "trace_uses"):
                for corpus in corpora:
                    self._without(name, corpus, old.where(F.col("corpus_id") == corpus).select("trace_id"), "trace_id")

    def _touch(self, traces: DataFrame) -> list[str]:
        self.upsert("trace_uses", traces.withColumn("used_at", F.lit(time.time_ns())))
        return [r[0] for r in traces.select("corpus_id").distinct().collect()]

    def trace(self, corpus: str, trace_id: str) -> DataFrame:
        """The steps of a trace; reading it keeps it from being the next to go."""
        rows = self.table("trace_steps", corpus).where(F.col("trace_id") == trace_id)
        if not rows.isEmpty():
            self._touch(self.spark.createDataFrame([(corpus, trace_id)], "corpus_id string, trace_id string"))
        return rows.orderBy("step_no")

    def append_events(self, events: DataFrame) -> None:
        """Put events behind those of their corpus; what the buffer no longer holds goes."""
        events = written(events.select(*self.table("progress_events").columns))
        corpora = [r[0] for r in events.select("corpus_id").distinct().collect()]
        before = self.table("progress_events").where(F.col("corpus_id").isin(corpora))
        held = event_buffer(before.unionByName(events)).withColumn(BUCKET, self._bucket("progress_events"))
        self._replace("progress_events", held, [(c, k) for c in corpora for k in range(self.buckets)])
        forget(events)


def event_buffer(events: DataFrame, most: int = EVENTS) -> DataFrame:
    """The last events of each corpus since its last terminal one, which clears the buffer."""
    w = Window.partitionBy("corpus_id")
    ended = F.max(F.when(F.col("type").isin(*TERMINAL), F.col("seq"))).over(w)
    open_ = events.withColumn("_end", ended).where(F.col("_end").isNull() | (F.col("seq") > F.col("_end"))).drop("_end")
    return open_.withColumn("_n", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("_n") <= most).drop("_n")


def latest_status(changes: DataFrame) -> DataFrame:
    """(corpus_id, status, at) of the last change of each corpus; a build that never ended has failed."""
    last = changes.groupBy("corpus_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    return last.withColumn("status", F.when(F.col("status") == "BUILDING", "FAILED").otherwise(F.col("status")))
