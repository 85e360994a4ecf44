"""Whole-graph imports, source updates and element embeddings, applied to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import maps
from quillgraph.operators import community, graph, merge
from quillgraph.operators.tables import written
from quillgraph.sources.store import Store

KEY_MEMBERS = 5
PARTS = ("text_units", "entities", "relationships", "communities", "memberships")


# -- extraction into elements ----------------------------------------------------------------------------------------------


def folded(entities: DataFrame, edges: DataFrame, limit: int = merge.DESCRIPTION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, retyped) of what was extracted from units: names resolved, types by majority, edges re-keyed.

    ``entities``: (name, type, description, unit_ids, attributes, at); ``edges``: (source, source_type, type, target, target_type,
    description, unit_ids, weight, at). All mentions of a name key become its first name with its commonest type, and edges
    follow their ends to it; ends that nothing mentions keep their own name and type. ``retyped`` has (name, previous, type) of
    names whose first type was another.
    """
    keyed = entities.withColumn("name_key", merge.tx.name_key("name"))
    names = written(merge.resolved_names(keyed, F.col("name_key")).select("name_key", "canonical", F.col("type").alias("kind")))
    first = keyed.groupBy("name_key").agg(F.min_by("type", "at").alias("previous"))
    retyped = first.join(names, "name_key").where("previous <> kind").select(F.col("canonical").alias("name"), "previous", F.col("kind").alias("type"))
    rows = keyed.join(names, "name_key").withColumns({"name": F.col("canonical"), "type": F.col("kind"), "identity": maps.identity(F.col("canonical"), F.col("kind"))})
    merged = merge.merge_entities(rows.select("identity", "name", "type", "description", "unit_ids", "attributes", "at"), limit)
    out = edges
    for end in ("source", "target"):
        of = names.select(F.col("name_key").alias("k_"), F.col("canonical").alias("n_"), F.col("kind").alias("t_"))
        out = out.withColumn("k_", merge.tx.name_key(end)).join(of, "k_", "left")
        out = out.withColumns({end: F.coalesce("n_", F.col(end)), f"{end}_type": F.coalesce("t_", F.col(f"{end}_type"))}).drop("k_", "n_", "t_")
    out = out.withColumns({"src_id": maps.identity(F.col("source"), F.col("source_type")), "tgt_id": maps.identity(F.col("target"), F.col("target_type"))})
    return merged, merge.merge_relationships(out, "units"), retyped


# -- import ----------------------------------------------------------------------------------------------------------------


def read_graph(spark, path: str, corpus: str, form: str = "parquet") -> dict[str, DataFrame]:
    """The tables of an exact graph from files ``path``/<table> (Parquet or JSON) in the schemas of the store; absent ones are empty."""
    from pyspark.errors import AnalysisException

    from quillgraph.sources.schemas import SCHEMAS

    out = {}
    for name in PARTS:
        schema = spark.createDataFrame([], SCHEMAS[name]).drop("corpus_id").schema
        try:
            rows = spark.read.format(form).schema(schema).load(f"{path.rstrip('/')}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], schema)
        out[name] = rows.select(F.lit(corpus).alias("corpus_id"), "*")
    return out


def import_whole(store: Store, corpus: str, tables: dict[str, DataFrame], policy: str = "CREATE", detect: Callable[[DataFrame, DataFrame], DataFrame] | None = None, embed: Callable[[Column], Column] | None = None) -> dict[str, int]:
    """Put an exact graph into a corpus: units, merged elements, supplied communities or those that ``detect`` finds, and vectors
    of what was imported. Returns the numbers of elements."""
    stored = store.table("entities", corpus).select("identity")
    given = tables["entities"].withColumns({"identity": maps.identity(F.col("name"), F.col("type")), "at": F.col("ord")})
    entities = merge.merge_entities(given.withColumns({"unit_ids": F.coalesce("unit_ids", F.array().cast("array<string>")), "attributes": F.coalesce("attributes", F.create_map().cast("map<string,string>"))}))
    edges = tables["relationships"].withColumns({"src_id": maps.identity(F.col("source"), F.col("source_type")), "tgt_id": maps.identity(F.col("target"), F.col("target_type")), "at": F.col("ord"), "unit_ids": F.coalesce("unit_ids", F.array().cast("array<string>")), "weight": F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))})
    entities, merged = merge.import_graph(entities, edges, stored, policy)
    here = F.lit(corpus)
    entities, merged = written(entities.withColumn("corpus_id", here)), merged.withColumn("corpus_id", here)
    merged = written(merged) if policy == "DROP" else merged  # else they are a table already
    store.upsert("text_units", tables["text_units"])
    store.upsert("entities", entities)
    store.upsert("relationships", merged)
    communities, members = tables["communities"], tables["memberships"]
    if communities.isEmpty() and detect is not None:
        found = detect(entities.select("corpus_id", "identity", "ord"), merged)
        top = found.groupBy("corpus_id").agg(F.max("level").alias("level"))
        groups = found.join(top, ["corpus_id", "level"]).select("identity", "community")
        numbered = community.numbered(groups, entities)
        members = groups.join(numbered.select("community_id", "community"), "community").join(entities.select("identity", "ord"), "identity").select(here.alias("corpus_id"), "community_id", "identity", "ord")
        named = community.described(members.join(entities.select("identity", "name"), "identity").select("community_id", "name", "ord"))
        communities = named.join(numbered.select("community_id", F.col("first").alias("ord")), "community_id").withColumn("corpus_id", here)
    communities, members = written(communities), written(members)
    store.upsert("communities", communities)
    store.put_memberships(members)
    if embed is not None:
        store.put_embeddings("entity_embeddings", entities.select("corpus_id", "identity", embed(embedded_entity_text()).alias("embedding")))
        told = community_texts(communities, members, entities, merged)
        store.put_embeddings("community_embeddings", told.select(here.alias("corpus_id"), "community_id", embed(F.col("text")).alias("embedding")))
    return {"entities": entities.count(), "relationships": merged.count(), "communities": communities.count(), "memberships": members.count()}


# -- embeddings of elements ------------------------------------------------------------------------------------------------


def embedded_entity_text() -> Column:
    """``name: description``, or the name alone."""
    return F.concat(F.col("name"), F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.concat(F.lit(": "), F.trim("description"))).otherwise(""))


def key_members(members: DataFrame, edges: DataFrame, most: int = KEY_MEMBERS) -> DataFrame:
    """(community_id, identity, n): members with the most internal weight, ties in stored order."""
    weights = graph.internal_weight(edges, members)
    rows = members.select("community_id", "identity", "ord").join(weights, ["community_id", "identity"], "left")
    n = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc(F.coalesce("weight", F.lit(0))), "ord"))
    return rows.withColumn("n", n).where(F.col("n") <= most).select("community_id", "identity", "n")


def community_texts(communities: DataFrame, members: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, text): title, summary and key members as they are embedded."""
    named = key_members(members, edges).join(entities.select("identity", "name"), "identity")
    lists = named.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("names"))
    lead = F.concat_ws(": ", F.nullif(F.trim("title"), F.lit("")), "summary")
    return communities.join(lists, "community_id", "left").select("community_id", F.concat(lead, F.coalesce(F.concat(F.lit("\nKey members: "), "names"), F.lit(""))).alias("text"))


# -- removal and replacement -----------------------------------------------------------------------------------------------


def _sourced(store: Store, corpus: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = lambda document=None: maps.element_source(F.col("attributes"), F.col("locator.path"), document).alias("source")
    units = store.table("text_units", corpus).select("id", of(F.col("document_name")))
    entities = store.table("entities", corpus).select("identity", of(), "unit_ids")
    edges = store.table("relationships", corpus).select("src_id", "tgt_id", "type", of(), "unit_ids", "ord")
    return units, entities, edges


def _trimmed(rows: DataFrame, key: list[str], gone: DataFrame) -> DataFrame:
    """``rows`` without the units that are gone in their lists; the order of the rest stays."""
    left = rows.select(*key, F.posexplode("unit_ids").alias("p", "unit_id")).join(gone, "unit_id", "left_anti")
    lists = left.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "unit_id"))), lambda x: x["unit_id"]).alias("kept_"))
    return rows.join(lists, key, "left").withColumn("unit_ids", F.coalesce("kept_", F.array().cast("array<string>"))).drop("kept_")


def remove_source(store: Store, corpus: str, source: str) -> dict[str, int]:
    """Take a source out of a corpus: its units and elements, elements that cite only its units, orphans, its chunks and the
    communities that lost members; other elements keep their weight and lose its units. Returns the numbers removed."""
    units, entities, edges = _sourced(store, corpus)
    members = store.table("memberships", corpus)
    effect = {k: written(v) for k, v in merge.remove_source(units, entities, edges, members, source).items()}
    key = ["src_id", "type", "tgt_id"]
    dead = effect["edges"].select(*key)
    touched = written(_trimmed(store.table("entities", corpus).join(effect["updated_entities"], "identity", "left_semi"), ["identity"], effect["units"]))
    changed = written(_trimmed(store.table("relationships", corpus).join(effect["updated_edges"], "ord", "left_semi"), key, effect["units"]))
    store.delete_units(corpus, effect["units"].withColumnRenamed("unit_id", "id"))
    store.delete_relationships(corpus, dead)
    store.delete_entities(corpus, effect["entities"].unionByName(effect["orphans"]))
    store.upsert("entities", touched)
    store.upsert("relationships", changed)
    store.delete_communities(corpus, effect["stale_communities"])
    store.delete_chunks(corpus, source)
    return {k: v.count() for k, v in effect.items()}


def replace_source(store: Store, corpus: str, source: str, tables: dict[str, DataFrame], policy: str = "CREATE", **options) -> tuple[dict[str, int], dict[str, int]]:
    """Remove a source and import its new graph; communities are not detected unless asked for."""
    removed = remove_source(store, corpus, source)
    return removed, import_whole(store, corpus, tables, policy, **options)
