"""Incremental ingestion: a stream of text units folded into graph state and change events.

The state of a corpus is, for each name key, its canonical name and counts of types; every micro-batch emits what changed.
State is keyed by (corpus, name key), so a large corpus spreads over the cluster, and only names that occur again are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import merge
from quillgraph.operators.tables import ranked_globally, small, written

EVENT = "corpus_id string, name_key string, event string, name string, type string, mentions long"
#: Types of events.
KINDS = ("ingestion-started", "text-unit-extracted", "entity-extracted", "relationship-extracted", "entity-retyped", "community-detected", "ingestion-complete", "error", "heartbeat")
_STATE = "name string, types string, mentions long"


def mentions(units: DataFrame) -> DataFrame:
    """(corpus_id, name_key, name, type, at) of the names in a stream or table of units (corpus_id, id, text, ord)."""
    rows = units.select("corpus_id", "ord", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    found = F.transform(F.regexp_extract_all("sentence", F.lit(merge.NAME), F.lit(1)), lambda n: F.trim(n))
    names = F.array_distinct(F.filter(found, lambda n: (F.length(n) > 1) & ~n.isin("The", "A", "An")))
    rows = rows.select("corpus_id", "ord", "pos", F.posexplode(names).alias("n", "name"))
    at = F.format_string("%020d/%010d/%010d", "ord", "pos", "n")
    return rows.select("corpus_id", tx.name_key("name").alias("name_key"), "name", merge.guessed_type(F.col("name")).alias("type"), at.alias("at"))


def _fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    import json

    name, types, total = (state.get[0], json.loads(state.get[1]), state.get[2]) if state.exists else (None, {}, 0)
    before = max(types, key=types.get) if types else None
    rows = pd.concat(list(batches)).sort_values("at")
    for n, t in zip(rows["name"], rows["type"], strict=True):
        name = name or n
        types[t] = types.get(t, 0) + 1
        total += 1
    after = max(types, key=types.get)
    state.update((name, json.dumps(types), total))
    event = "entity-extracted" if before is None else "entity-retyped" if before != after else "entity-extracted"
    yield pd.DataFrame([(*key, event, name, after, total)], columns=["corpus_id", "name_key", "event", "name", "type", "mentions"])


def entity_events(units: DataFrame) -> DataFrame:
    """A stream of change events from a stream of units."""
    return mentions(units).groupBy("corpus_id", "name_key").applyInPandasWithState(_fold, EVENT, _STATE, "update", "NoTimeout")


EDGE = "corpus_id string, src_key string, type string, tgt_key string, event string, source string, target string, weight long"


def edge_mentions(units: DataFrame) -> DataFrame:
    """(corpus_id, src_key, type, tgt_key, source, target, unit, at): edges between the name keys of a stream or table of units, so
    they follow a name however it is spelt."""
    rows = units.select("corpus_id", "id", "ord", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    found = F.transform(F.regexp_extract_all("sentence", F.lit(merge.NAME), F.lit(1)), lambda n: F.trim(n))
    names = F.array_distinct(F.filter(found, lambda n: (F.length(n) > 1) & ~n.isin("The", "A", "An")))
    rows = rows.withColumn("names", names).where(F.size("names") >= 2)
    kind = F.lit("related_to")
    for verb in reversed(merge.VERBS):
        kind = F.when(F.contains(F.lower("sentence"), F.lit(f" {verb} ")), verb).otherwise(kind)
    rows = rows.select("corpus_id", F.element_at("names", 1).alias("source"), kind.alias("type"), F.element_at("names", -1).alias("target"), F.col("id").alias("unit"), F.format_string("%020d/%010d", "ord", "pos").alias("at"))
    return rows.select("corpus_id", tx.name_key("source").alias("src_key"), "type", tx.name_key("target").alias("tgt_key"), "source", "target", "unit", "at")


def _fold_edge(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    source, target, weight = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("at")
    source, target = source or rows["source"].iloc[0], target or rows["target"].iloc[0]
    weight += rows["unit"].nunique()  # a unit comes in one micro-batch
    state.update((source, target, int(weight)))
    yield pd.DataFrame([(*key, "relationship-extracted", source, target, weight)], columns=["corpus_id", "src_key", "type", "tgt_key", "event", "source", "target", "weight"])


def relationship_events(units: DataFrame) -> DataFrame:
    """A stream of relationships with their weight so far (units that state them), from a stream of units."""
    return edge_mentions(units).groupBy("corpus_id", "src_key", "type", "tgt_key").applyInPandasWithState(_fold_edge, EDGE, "source string, target string, weight long", "update", "NoTimeout")


def payloads(kind: str, rows: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(corpus_id, kept columns, type, data): rows as event payloads of one of the event types, data as JSON of the given columns."""
    if kind not in KINDS:
        raise ValueError(f"unknown event type: {kind}")
    return rows.select("corpus_id", *keep, F.lit(kind).alias("type"), F.to_json(F.struct(*columns)).alias("data"))


def extraction_progress(units: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(corpus_id, seq, type, data): an event for each unit (corpus_id, id, ord) of an extraction in order, with how many of its corpus
    are done and how many there are, and the error of a unit that is among ``failures`` (corpus_id, unit_id, message).

    Units are numbered by range partitions, so a corpus of any size is no single task.
    """
    rows = ranked_globally(units.select("corpus_id", "id", "ord"), "place", F.col("corpus_id"), F.col("ord"), F.col("id"))
    rows = written(rows)
    corpora = rows.groupBy("corpus_id").agg((F.min("place") - 1).alias("ahead"), F.count("*").alias("total"))
    rows = rows.join(small(corpora), "corpus_id").withColumn("done", (F.col("place") - F.col("ahead")).cast("long"))
    if failures is not None:
        told = failures.groupBy("corpus_id", F.col("unit_id").alias("id")).agg(F.min("message").alias("error"))
        rows = rows.join(told, ["corpus_id", "id"], "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    return payloads("text-unit-extracted", rows.withColumn("seq", F.col("done")), "id", "done", "total", "error", keep=("seq",)).select("corpus_id", "seq", "type", "data")


def sink(events: DataFrame, store, checkpoint: str):
    """Start writing events into the store's replay buffer; each micro-batch once."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("corpus_id", (F.lit(epoch) * 1_000_000 + F.row_number().over(_by_key())).cast("long").alias("seq"), F.col("event").alias("type"), F.to_json(F.struct("name", "type", "mentions")).alias("data"))
        store.append_events(rows)

    return events.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).start()


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("corpus_id").orderBy("name_key")
