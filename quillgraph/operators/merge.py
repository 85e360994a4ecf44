"""From units of text to merged graph elements: extraction, name resolution, merges, exact imports, source updates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import maps
from quillgraph.functions import text as tx
from quillgraph.operators import graph
from quillgraph.operators.tables import ranked_globally, small, written

DESCRIPTION = 1000
HINTS = 50
#: Descriptions of one group that a round of merging takes.
PARTS = 256
#: Verbs of the offline extractor in the order in which they are tried.
VERBS = ("met", "visited", "helped", "chased", "told")
PEOPLE = ("holmes", "watson", "morstan")
NAME = r"(?:^|\s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"


# -- offline extraction ---------------------------------------------------------------------------------------------------


def named_sentences(units: DataFrame) -> DataFrame:
    """(unit_id, ord, pos, sentence, names): sentences with their capitalised names, in order."""
    parts = units.select(F.col("id").alias("unit_id"), "ord", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    found = F.transform(F.regexp_extract_all("sentence", F.lit(NAME), F.lit(1)), lambda n: F.trim(n))
    names = F.array_distinct(F.filter(found, lambda n: (F.length(n) > 1) & ~n.isin("The", "A", "An")))
    return parts.select("unit_id", "ord", "pos", F.trim("sentence").alias("sentence"), names.alias("names"))


def guessed_type(name) -> F.Column:
    test = F.lit(False)
    for person in PEOPLE:
        test = test | F.contains(F.lower(name), F.lit(person))
    return F.when(test, "Person").otherwise("Concept")


def extracted_entities(units: DataFrame) -> DataFrame:
    """(unit_id, ord, identity, name, type, description, at): the first sighting of each name in each unit."""
    rows = named_sentences(units).select("unit_id", "ord", "pos", "sentence", F.posexplode("names").alias("n", "name"))
    rows = rows.withColumn("type", guessed_type(F.col("name"))).withColumn("identity", maps.identity(F.col("name"), F.col("type"))).withColumn("at", F.struct("ord", "pos", "n"))
    first = rows.groupBy("unit_id", "ord", "identity").agg(*[F.min_by(c, "at").alias(c) for c in ("name", "type", "sentence")], F.min("at").alias("at"))
    return first.withColumnRenamed("sentence", "description")


def extracted_edges(units: DataFrame) -> DataFrame:
    """(unit_id, ord, pos, source, type, target, description): one edge from first to last name of a sentence with two."""
    rows = named_sentences(units).where(F.size("names") >= 2)
    kind = F.lit("related_to")
    for verb in reversed(VERBS):
        kind = F.when(F.contains(F.lower("sentence"), F.lit(f" {verb} ")), verb).otherwise(kind)
    return rows.select("unit_id", "ord", "pos", F.element_at("names", 1).alias("source"), kind.alias("type"), F.element_at("names", -1).alias("target"), F.col("sentence").alias("description"))


# -- resolution and merges ------------------------------------------------------------------------------------------------


def resolved_names(mentions: DataFrame, key=None) -> DataFrame:
    """(name_key, canonical, type, n): of (name, type, at) the first name and the majority type of each key, ties to the earliest type.

    Counts come first, so a name that fills a third of all mentions is a few rows by then.
    """
    keyed = mentions.withColumn("name_key", tx.name_key("name") if key is None else key)
    types = keyed.groupBy("name_key", "type").agg(F.count("*").alias("n"), F.min(F.struct("at", "name")).alias("first"))
    best = F.max_by("type", F.struct(F.col("n"), F.struct(*[(-F.col("first.at")).alias("a")])))
    return types.groupBy("name_key").agg(F.min("first")["name"].alias("canonical"), best.alias("type"), F.sum("n").alias("n"))


def frequent_names(mentions: DataFrame, count: int = HINTS) -> DataFrame:
    keyed = mentions.groupBy("name").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return keyed.orderBy(F.desc("n"), "at").limit(count)


def merged_description(parts: list[str], limit: int = DESCRIPTION) -> str:
    """New sentences appended while they fit; the first that doesn't ends the merge, and is cut if nothing stands yet."""
    out, have = (parts[0] if parts else "").strip(), None
    for extra in parts[1:]:
        out, have = _extended(out, have, extra, limit)
    return out[:limit]


def _extended(out: str, have: set[str] | None, extra: str | None, limit: int) -> tuple[str, set[str] | None]:
    """``out`` with the new sentences of one part, and its sentences for the next part (none if it changed)."""
    if len(out) >= limit:
        return out, have
    before = out
    if have is None:
        have = {s.strip().lower() for s in _sentences(out)}
    for s in _sentences(extra):
        if s.lower() in have:
            continue
        grown = f"{out} {s}" if out else s
        if len(grown) > limit:
            if not out:
                out = s[:limit]
            break
        out = grown
        have.add(s.lower())
    return out, have if out == before else None


def _sentences(text: str | None) -> list[str]:
    import re

    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]


def merge_descriptions(rows: DataFrame, limit: int = DESCRIPTION, group: str = "identity") -> DataFrame:
    """(group, description): the ordered fold of each group's descriptions (``description``, ``at``).

    The first ``PARTS`` descriptions of every group are folded as a stream; the limit by rank is taken before the shuffle, so a group of any size
    sends few rows. Of a group with more, each later description is then held against the text so far where it lies, and only
    those that still add to it go on to the next round: as the room shrinks to the end of the text, these are soon few. Rows that are equal
    in place and text count once.
    """
    parts = rows.where(F.trim("description") != "").select(group, "description", "at")
    begun = parts.withColumn("said", F.lit(None).cast("string"))
    done, going = None, None
    while True:
        order = Window.partitionBy(group).orderBy("at", "description")
        head = begun.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PARTS)
        schema = T.StructType([rows.schema[group], T.StructField("description", T.StringType()), T.StructField("last", T.StringType()), rows.schema["at"], T.StructField("full", T.BooleanType())])
        state = written(head.select(group, "description", "at", "said", "nth").mapInArrow(_folded(limit), schema))
        if going is not None:  # groups whose later descriptions add nothing stay as they were
            state = written(going.join(state.select(F.col(group).alias("new"), F.lit(1).alias("has")), F.col(group).eqNullSafe(F.col("new")), "left_anti").withColumn("full", F.lit(False)).unionByName(state))
        ended = state.where("not full").select(group, "description")
        done = ended if done is None else done.unionByName(ended)
        going = state.where("full")
        if going.isEmpty():
            return done
        held = small(going.select(F.col(group).alias("of"), F.col("description").alias("said"), F.struct("at", "last").alias("before")))
        rest = parts.join(held, F.col(group).eqNullSafe(F.col("of")) & (F.struct("at", F.col("description").alias("last")) > F.col("before"))).select(group, "description", "at", "said")
        begun = written(rest.mapInArrow(_adding(limit), T.StructType([rows.schema[group], T.StructField("description", T.StringType()), rows.schema["at"], T.StructField("said", T.StringType())])))
        parts = begun.drop("said")


def _folded(limit: int):
    """One row a group from rows (group, description, at, said so far, nth) in order: the text, its last part's place, and whether more may follow."""

    def run(batches):
        now = out = have = None  # out is None until the first row
        row = last = None
        names = ["group", "description", "last", "at", "full"]

        def closed(b):
            return [row.column(0), pa.array([out[:limit]], pa.string()), row.column(1).cast(pa.string()), row.column(2), pa.array([row.column(4)[0].as_py() == PARTS and len(out) < limit])]

        for b in batches:
            kept = []
            columns = [b.column(k).to_pylist() for k in (0, 1, 2, 3, 4)]
            for i, (key, text, at, said, nth) in enumerate(zip(*columns, strict=True)):
                if nth == 1:
                    if out is not None:
                        kept.append(closed(b))
                    now, out, have, last = key, said, None, None
                elif key != now or nth != row.column(4)[0].as_py() + 1:
                    raise RuntimeError("descriptions are out of order")
                if out is None:
                    out = text.strip()
                elif (at, text) != last:
                    out, have = _extended(out, have, text, limit)
                row, last = b.slice(i, 1), (at, text)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*kept, strict=True)], names=names)
        if out is not None:
            yield pa.RecordBatch.from_arrays(closed(row), names=names)

    return run


def _adding(limit: int):
    """The rows (group, description, at, said) that add to what is said, or may once a last sentence without an end goes on."""

    def run(batches):
        said = have = open_end = None
        for b in batches:
            keep = []
            for text, now in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now != said:
                    said, ends = now, _sentences(now)
                    have = {s.lower() for s in ends}
                    open_end = ends[-1].lower() if ends and ends[-1][-1] not in ".!?" else None
                grown, _ = _extended(said, set(have), text, limit)
                keep.append(grown != said or open_end is not None and any(s.lower().startswith(open_end) for s in _sentences(text)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def merge_entities(rows: DataFrame, limit: int = DESCRIPTION) -> DataFrame:
    """One row per identity of (identity, name, type, description, unit_ids, attributes, at): first values, united lists."""
    names = rows.groupBy("identity").agg(F.min_by("name", "at").alias("name"), F.min_by("type", "at").alias("type"), F.min("at").alias("ord"))
    units = rows.select("identity", "at", F.posexplode("unit_ids").alias("p", "unit")).where("trim(unit) <> ''").groupBy("identity", "unit").agg(F.min(F.struct("at", "p")).alias("o"))
    units = units.groupBy("identity").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "unit"))), lambda x: x["unit"]).alias("unit_ids"))
    attrs = rows.select("identity", "at", F.explode(maps.attributes(F.col("attributes"))).alias("k", "v")).groupBy("identity", "k").agg(F.min_by("v", "at").alias("v"))
    attrs = attrs.groupBy("identity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    out = names.join(merge_descriptions(rows, limit), "identity", "left").join(units, "identity", "left").join(attrs, "identity", "left")
    return out.select("identity", "name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("unit_ids", F.array().cast("array<string>")).alias("unit_ids"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), "ord")


def merge_relationships(rows: DataFrame, weight: str = "units") -> DataFrame:
    """One row per (src_id, type, tgt_id), types compared in lower case; weight: distinct units, or the sum for imports, which
    unite the lists ``unit_ids`` as well where there are any.

    A relationship that is seen once keeps its own weight.
    """
    key = ["src_id", "kind", "tgt_id"]
    rows = rows.withColumn("kind", F.lower("type"))
    own = ("type", "source", "source_type", "target", "target_type", "description")
    if weight == "sum" and "unit_ids" in rows.columns:
        # edges are dealt once by key; each is counted at its first unit, and mentions of a unit are one before lists are made
        dealt = rows.select(*key, *own, "weight", "at", "unit_ids").repartition(*key)
        cited = dealt.select(*key, *own, "weight", "at", F.posexplode_outer("unit_ids").alias("p", "unit"))
        whole = F.coalesce("p", F.lit(0)) == 0
        first = F.min(F.when(whole, F.struct("at", *own))).alias("first")
        by = cited.groupBy(*key, "unit").agg(first, F.sum(F.when(whole, F.col("weight"))).alias("weight"), F.min(F.when(F.col("p").isNotNull(), F.struct("at", "p"))).alias("o"))
        listed = F.filter(F.array_sort(F.collect_list(F.struct("o", "unit"))), lambda x: x["o"].isNotNull())
        merged = by.groupBy(*key).agg(F.min("first").alias("first"), F.greatest(F.sum("weight"), F.lit(1)).cast("long").alias("weight"), F.transform(listed, lambda x: x["unit"]).alias("unit_ids"))
        return merged.select("src_id", "tgt_id", *[F.col(f"first.{c}").alias(c) for c in own], "weight", F.col("first.at").alias("ord"), "unit_ids")
    if weight != "sum":  # distinct units are counted by key and unit first, so a hot relationship is no long list
        cited = rows.select(*key, F.explode("unit_ids").alias("unit")).distinct().groupBy(*key).agg(F.count("*").alias("units_"))
        rows = rows.join(cited, key, "left")
    first = [F.min_by(c, "at").alias(c) for c in own]
    total = F.greatest(F.sum("weight"), F.lit(1)) if weight == "sum" else F.when(F.count("*") == 1, F.max("weight")).otherwise(F.greatest(F.coalesce(F.max("units_"), F.lit(1)), F.lit(1)))
    return rows.groupBy(*key).agg(*first, total.cast("long").alias("weight"), F.min("at").alias("ord")).drop("kind")


# -- imports and updates ---------------------------------------------------------------------------------------------------


def import_graph(entities: DataFrame, edges: DataFrame, stored: DataFrame | None = None, policy: str = "CREATE") -> tuple[DataFrame, DataFrame]:
    """Merged (entities, edges) of an exact graph; ends that exist nowhere are created, kept as they are, or their edges dropped."""
    edges = written(merge_relationships(edges, "sum"))
    known = [entities] + ([stored] if stored is not None else [])
    missing = graph.missing_endpoints(edges, *known)
    if policy == "DROP":
        return entities, graph.complete_edges(edges, missing, *known)
    if policy == "CREATE":
        most = entities.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("most"))  # one row
        stubs = ranked_globally(missing, "n", F.col("at"), F.col("identity")).crossJoin(F.broadcast(most))
        entities = entities.unionByName(stubs.select("identity", "name", "type", (F.col("most") + F.col("n")).alias("ord")), allowMissingColumns=True)
    return entities, edges


def remove_source(units: DataFrame, entities: DataFrame, edges: DataFrame, memberships: DataFrame, source: str) -> dict[str, DataFrame]:
    """What removing one source does: removed units, entities, edges, orphans, updated elements, stale communities.

    ``units``: (id, source); ``entities``: (identity, source, unit_ids); ``edges``: (src_id, tgt_id, source, unit_ids, ord).
    """
    gone = written(units.where(F.col("source") == source).select(F.col("id").alias("unit_id")))

    def lost(table: DataFrame, key: str) -> DataFrame:
        """(key, only): elements that cite a removed unit, and whether they cite no other; all others stay where they lie."""
        cited = table.select(key, F.explode("unit_ids").alias("unit_id"))
        hit = small(cited.join(gone, "unit_id", "left_semi").select(key).distinct())
        marked = cited.join(hit, key, "left_semi").join(gone.withColumn("out", F.lit(1)), "unit_id", "left")
        return written(marked.groupBy(key).agg(F.min(F.coalesce("out", F.lit(0))).alias("only")))

    cited = lost(entities, "identity")
    removed = small(entities.where(F.col("source") == source).select("identity").unionByName(cited.where("only = 1").select("identity")).distinct())
    cited_edges = lost(edges, "ord")
    alone = small(cited_edges.where("only = 1").select("ord", F.lit(True).alias("alone")))
    marked = edges.join(alone, "ord", "left")
    for end in ("src_id", "tgt_id"):
        marked = marked.join(removed.select(F.col("identity").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    test = F.coalesce(F.col("source") == source, F.lit(False)) | F.coalesce("alone", "has_src_id", "has_tgt_id", F.lit(False))
    dead = written(marked.where(test).select(*[c for c in edges.columns if c in ("src_id", "type", "tgt_id", "ord")]).distinct())
    touched = dead.select(F.explode(F.array("src_id", "tgt_id")).alias("identity")).distinct()
    held = entities.select("identity", F.explode("unit_ids").alias("unit_id")).join(gone, "unit_id", "left_anti").select("identity").distinct()
    sourced = entities.where(F.col("source").isNotNull() & (F.col("source") != source)).select("identity")
    bare = small(touched.join(removed, "identity", "left_anti").join(held, "identity", "left_anti").join(sourced, "identity", "left_anti"))
    near = graph.touching(edges, bare).select("ord", "src_id", "tgt_id").join(dead.select("ord"), "ord", "left_anti")
    orphans = bare.join(near.select(F.explode(F.array("src_id", "tgt_id")).alias("identity")), "identity", "left_anti")
    return {
        "units": gone,
        "entities": removed,
        "edges": dead,
        "orphans": orphans,
        "updated_entities": cited.where("only = 0").select("identity").join(removed, "identity", "left_anti"),
        "updated_edges": cited_edges.where("only = 0").select("ord").join(dead, "ord", "left_anti"),
        "stale_communities": memberships.join(removed.unionByName(orphans), "identity", "left_semi").select("community_id").distinct(),
    }
