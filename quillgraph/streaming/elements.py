"""The whole extraction fold as a stream: extracted mentions in, changed entities and relationships out.

State lies in the state store by (corpus, name key) and by (corpus, edge): the first name, counts of types, attributes, the merged
description and the units seen, so a mention costs what it changes and a common name's units are never read back together. Rows
carry new units only; ``current_entities`` and ``current_relationships`` put the rows emitted so far together as the tables that ``updates.folded``
makes of all mentions at once. Edges are kept by the names that their ends were told with and follow these to their
present identity when they are read, so a name that changes its type takes its edges along.

Mentions must come in the order of ``at`` from one micro-batch to the next (descriptions merge in order); within one the order is restored.
Rows without a name belong to no element and are left out. A restart from the checkpoint goes on with the state of the last finished micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgraph.functions import maps
from quillgraph.functions import text as tx
from quillgraph.operators import merge

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = "array<struct<at:long,pos:int,unit:string>>"
ENTITY = f"corpus_id string, name_key string, event string, name string, type string, previous string, description string, new_units {_UNITS}, attributes map<string,string>, mentions long, ord long"
_EDGE_KEY = ["corpus_id", "source_id", "kind", "target_id"]
EDGE = f"corpus_id string, source_id string, kind string, target_id string, event string, type string, source string, source_type string, target string, target_type string, description string, new_units {_UNITS}, weight long, mentions long, ord long"


def _rows(batches: Iterator[pd.DataFrame]) -> list[dict]:
    return sorted((r for pdf in batches for r in pdf.to_dict("records")), key=lambda r: (r["at"], r["description"] or ""))


def _listed(values) -> list:
    return [] if values is None else list(values)


class _Units:
    """Which units have been seen, and those that are new."""

    def __init__(self, state):
        self.state, self.new = state, []

    def add(self, at: int, units) -> None:
        for pos, unit in enumerate(_listed(units)):
            if unit and unit.strip() and not self.state.containsKey((unit,)):
                self.state.updateValue((unit,), (at,))
                self.new.append({"at": at, "pos": pos, "unit": unit})


class Names(StatefulProcessor):
    """Folds the mentions of one name key; ``limit`` bounds the description."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "name string, first long, description string, mentions long")
        self.types = handle.getMapState("types", "type string", "n long, first long")
        self.attributes = handle.getMapState("attributes", "k string", "v string")
        self.units = handle.getMapState("units", "unit string", "at long")

    def _majority(self) -> str | None:
        counted = [(-n, first, t) for (t,), (n, first) in self.types.iterator()]
        return min(counted)[2] if counted else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, first, said, mentions = self.value.get() or (None, None, None, 0)
        before, units = self._majority(), _Units(self.units)
        for r in _rows(rows):
            at = int(r["at"])
            if first is None or at < first:
                name, first = r["name"], at
            n, seen = self.types.getValue((r["type"],)) if self.types.containsKey((r["type"],)) else (0, at)
            self.types.updateValue((r["type"],), (n + 1, min(seen, at)))
            if r["description"] and r["description"].strip(" "):
                said = r["description"].strip() if said is None else merge._extended(said, None, r["description"], self.limit)[0]
            for k, v in _listed(r["attributes"].items() if isinstance(r["attributes"], dict) else r["attributes"]):
                if not self.attributes.containsKey((k,)):
                    self.attributes.updateValue((k,), (v,))
            units.add(at, r["unit_ids"])
            mentions += 1
        self.value.update((name, first, said, mentions))
        after = self._majority()
        event = "entity-retyped" if before is not None and before != after else "entity-extracted"
        attributes = {k: v for (k,), (v,) in self.attributes.iterator()}
        yield pd.DataFrame([{"corpus_id": key[0], "name_key": key[1], "event": event, "name": name, "type": after, "previous": before, "description": (said or "")[: self.limit], "new_units": units.new, "attributes": attributes, "mentions": mentions, "ord": first}])


class Edges(StatefulProcessor):
    """Folds the mentions of one relationship between two names as they were told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "type string, source string, source_type string, target string, target_type string, description string, first long, weight long, mentions long")
        self.units = handle.getMapState("units", "unit string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told, units = self.value.get(), _Units(self.units)
        for r in _rows(rows):
            at, weight = int(r["at"]), int(r["weight"])
            if told is None or at < told[6]:
                told = (r["type"], r["source"], r["source_type"], r["target"], r["target_type"], r["description"], at, max(weight, told[7] if told else weight), told[8] if told else 0)
            told = (*told[:7], max(told[7], weight), told[8] + 1)
            units.add(at, r["unit_ids"])
        self.value.update(told)
        yield pd.DataFrame([dict(zip(_EDGE_KEY, key, strict=True)) | {"event": "relationship-extracted", **dict(zip(("type", "source", "source_type", "target", "target_type", "description", "ord", "weight", "mentions"), told, strict=True)), "new_units": units.new}])


def _stored(df: DataFrame) -> DataFrame:
    """State of several kinds needs the store on disk."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return df


def entity_changes(mentions: DataFrame, limit: int = merge.DESCRIPTION) -> DataFrame:
    """A stream of changed entities from a stream of (corpus_id, name, type, description, unit_ids, attributes, at)."""
    rows = mentions.where("name is not null").select("corpus_id", tx.name_key("name").alias("name_key"), "name", "type", "description", "unit_ids", maps.attributes(F.col("attributes")).alias("attributes"), F.col("at").cast("long").alias("at"))
    return _stored(rows).groupBy("corpus_id", "name_key").transformWithStateInPandas(Names(limit), ENTITY, "Update", "None")


def relationship_changes(mentions: DataFrame) -> DataFrame:
    """A stream of changed relationships from a stream of (corpus_id, source, source_type, type, target, target_type, description, unit_ids,
    weight, at)."""
    rows = mentions.where("source is not null and target is not null").select("corpus_id", maps.identity(F.col("source"), F.col("source_type")).alias("source_id"), F.lower("type").alias("kind"), maps.identity(F.col("target"), F.col("target_type")).alias("target_id"), "type", "source", "source_type", "target", "target_type", "description", "unit_ids", F.col("weight").cast("long").alias("weight"), F.col("at").cast("long").alias("at"))
    return _stored(rows).groupBy(*_EDGE_KEY).transformWithStateInPandas(Edges(), EDGE, "Update", "None")


def _latest(changes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The last row of each key, and all its units (key, at, pos, unit); rows written twice by a repeated micro-batch count once."""
    newest = F.max_by(F.struct(*[c for c in changes.columns if c not in (*key, "new_units")]), "mentions")
    last = changes.groupBy(*key).agg(newest.alias("row")).select(*key, "row.*")
    return last, changes.select(*key, F.explode("new_units").alias("u")).select(*key, "u.at", "u.pos", "u.unit").distinct()


def current_entities(changes: DataFrame) -> DataFrame:
    """(corpus_id, name_key, identity, name, type, description, unit_ids, attributes, ord) of all changes so far."""
    last, units = _latest(changes, ["corpus_id", "name_key"])
    lists = units.groupBy("corpus_id", "name_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pos", "unit"))), lambda u: u["unit"]).alias("unit_ids"))
    out = last.join(lists, ["corpus_id", "name_key"], "left")
    return out.select("corpus_id", "name_key", maps.identity(F.col("name"), F.col("type")).alias("identity"), "name", "type", "description", F.coalesce("unit_ids", F.array().cast("array<string>")).alias("unit_ids"), "attributes", "ord")


def current_relationships(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships (corpus_id, src_id, tgt_id, type, source ... weight, ord) of all changes so far, their ends at the present
    names and types of ``entities`` (from ``current_entities``)."""
    last, units = _latest(changes, _EDGE_KEY)
    at = last
    for end, side in (("source", "src_id"), ("target", "tgt_id")):
        of = entities.select("corpus_id", F.col("name_key").alias("k_"), F.col("name").alias("n_"), F.col("type").alias("t_"))
        at = at.withColumn("k_", tx.name_key(end)).join(of, ["corpus_id", "k_"], "left")
        at = at.withColumns({end: F.coalesce("n_", F.col(end)), f"{end}_type": F.coalesce("t_", F.col(f"{end}_type"))}).drop("k_", "n_", "t_")
        at = at.withColumn(side, maps.identity(F.col(end), F.col(f"{end}_type")))
    key = ["corpus_id", "src_id", "kind", "tgt_id"]
    cited = at.join(units, _EDGE_KEY).select(*key, "unit").distinct().groupBy(*key).agg(F.count("*").alias("units_"))
    first = [F.min_by(c, "ord").alias(c) for c in ("type", "source", "source_type", "target", "target_type", "description")]
    whole = at.groupBy(*key).agg(*first, F.sum("mentions").alias("n_"), F.max("weight").alias("w_"), F.min("ord").alias("ord")).join(cited, key, "left")
    weight = F.when(F.col("n_") == 1, F.col("w_")).otherwise(F.greatest(F.coalesce("units_", F.lit(1)), F.lit(1))).cast("long")
    return whole.withColumn("weight", weight).drop("kind", "n_", "w_", "units_")
