"""Reads over property graphs: entities and directed, typed, weighted relationships as DataFrames.

Tables carry ``corpus_id`` and an explicit order ``ord``. Identity sets arrive as DataFrames and every read is a semi- or
equi-join, so the optimiser picks broadcast or shuffle by the measured sizes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import maps
from quillgraph.operators.tables import small, written


def by_identity(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities whose identity stands in ``ids`` (identity)."""
    return entities.join(ids.select("identity").distinct(), "identity", "left_semi")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with a source or target in ``ids``, in one pass over them."""
    ids = small(ids.select("identity").distinct())
    for end in ("src_id", "tgt_id"):
        edges = edges.join(ids.select(F.col("identity").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    return edges.where("has_src_id or has_tgt_id").drop("has_src_id", "has_tgt_id")


def accepted(edges: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), least_weight: int = 1) -> DataFrame:
    kind = F.lower("type")
    out = edges.where(F.col("weight") >= least_weight)
    if include := [t.lower() for t in include]:
        out = out.where(kind.isin(include))
    if exclude := [t.lower() for t in exclude]:
        out = out.where(~kind.isin(exclude))
    return out


def from_frontier(edges: DataFrame, frontier: DataFrame, direction: str = "BOTH") -> DataFrame:
    """Edges of each question's frontier (q_id, identity), followed in ``direction``; an edge comes once a question.

    Edges are read once and where they lie meet the identities of the frontier; only those that touch one go on.
    """
    frontier = small(frontier.select("q_id", "identity").distinct())
    edges = written(touching(edges, frontier))
    out = edges.join(frontier.withColumnRenamed("identity", "src_id"), "src_id") if direction != "INCOMING" else None
    into = edges.join(frontier.withColumnRenamed("identity", "tgt_id"), "tgt_id") if direction != "OUTGOING" else None
    if out is None or into is None:
        return (out if into is None else into).dropDuplicates(["q_id", "ord"])
    return out.unionByName(into).dropDuplicates(["q_id", "ord"])


def missing_endpoints(edges: DataFrame, *known: DataFrame) -> DataFrame:
    """(identity, name, type) of edge ends that no table of entities has; the first mention names them."""
    ends = F.array(*[F.struct(F.col(i).alias("identity"), F.struct((F.col("ord") * 2 + k).alias("at"), F.col(n).alias("name"), F.col(t).alias("type")).alias("first")) for k, (i, n, t) in enumerate((("src_id", "source", "source_type"), ("tgt_id", "target", "target_type")))])
    found = edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.identity").alias("identity")).agg(F.min("e.first").alias("first"))
    for table in known:
        found = found.join(table.select("identity"), "identity", "left_anti")
    return written(found.select("identity", "first.name", "first.type", "first.at"))


def complete_edges(edges: DataFrame, missing: DataFrame, *known: DataFrame) -> DataFrame:
    """Edges both of whose ends exist.

    With the ``known`` tables edges are told first by the kinds of their ends (what follows ``::``): where no known entity has such a kind, the
    end is missing, and only the missing of kinds that are known are looked up.
    """
    ids = missing.select("identity")
    if known:
        kind = lambda c: F.coalesce(F.substring_index(c, "::", -1), F.lit(""))
        kinds = reduce(DataFrame.unionByName, [t.select(kind("identity").alias("kind")) for t in known]).distinct().limit(KINDS + 1).collect()
        if len(kinds) <= KINDS:
            names = ["", *(r["kind"] for r in kinds)]  # ends without an identity stay, as a look-up leaves them
            ids = ids.where(kind("identity").isin(names))
            edges = edges.where(kind("src_id").isin(names) & kind("tgt_id").isin(names))
    ids = small(ids)
    return edges.join(ids, F.col("src_id") == F.col("identity"), "left_anti").join(ids, F.col("tgt_id") == F.col("identity"), "left_anti")


#: Members that are broadcast to the edges, the smallest kinds first, and the most kinds of identities that are told apart.
NEAR, KINDS = 2_000_000, 1000


def internal_edges(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """(community_id, edge columns): relationships with both ends in one community.

    Edges are read once and where they lie meet the members of kinds (what follows ``::`` in an identity) with few members; edges between
    kinds without members stay behind. Only edges with an end of a kind with many members are shuffled to these.
    """
    members = written(memberships.select("identity", "community_id"))
    kind = lambda c: F.coalesce(F.substring_index(c, "::", -1), F.lit(""))
    sizes = members.groupBy(kind("identity").alias("kind")).count().orderBy("count", "kind").limit(KINDS + 1).collect()
    of = lambda rows, end, name: rows.select(F.col("identity").alias(end), F.col("community_id").alias(name))
    if len(sizes) > KINDS:
        inside = edges.join(of(members, "tgt_id", "community_id"), "tgt_id")
        return inside.join(of(members, "src_id", "community_id"), ["src_id", "community_id"])
    few, left = [], NEAR
    for name, n in sizes:
        left -= n
        if left >= 0:
            few.append(name)
    many = [name for name, _ in sizes if name not in few]
    near, far = members.where(kind("identity").isin(few)), members.where(kind("identity").isin(many))
    if not many:
        inside = edges.join(F.broadcast(of(near, "tgt_id", "community_id")), "tgt_id")
        return inside.join(F.broadcast(of(near, "src_id", "community_id")), ["src_id", "community_id"])
    half = edges.join(F.broadcast(of(near, "src_id", "at_src")), "src_id", "left").join(F.broadcast(of(near, "tgt_id", "at_tgt")), "tgt_id", "left")
    a, b, far_a, far_b = F.col("at_src"), F.col("at_tgt"), kind("src_id").isin(many), kind("tgt_id").isin(many)
    half = written(half.where((a.isNotNull() | far_a) & (b.isNotNull() | far_b) & (far_a | far_b | (a == b))))
    out = half.where(~far_a & ~far_b).withColumn("community_id", a)
    out = out.unionByName(half.where(far_a & ~far_b).withColumn("community_id", b).join(of(far, "src_id", "community_id"), ["src_id", "community_id"]))
    out = out.unionByName(half.where(~far_a & far_b).withColumn("community_id", a).join(of(far, "tgt_id", "community_id"), ["tgt_id", "community_id"]))
    both = half.where(far_a & far_b).join(of(far, "tgt_id", "community_id"), "tgt_id").join(of(far, "src_id", "community_id"), ["src_id", "community_id"])
    return out.unionByName(both).drop("at_src", "at_tgt")


def internal_weight(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """(community_id, identity, weight): weight of a member's internal edges, self-loops at both ends."""
    return end_weights(internal_edges(edges, memberships))


def end_weights(inside: DataFrame) -> DataFrame:
    """(community_id, identity, weight) over internal edges."""
    ends = inside.select("community_id", F.explode(F.array("src_id", "tgt_id")).alias("identity"), "weight")
    return ends.groupBy("community_id", "identity").agg(F.sum("weight").alias("weight"))


def mentions(entities: DataFrame, units: DataFrame) -> DataFrame:
    """(identity, unit_id) of the units that exist."""
    cited = entities.select("identity", F.explode("unit_ids").alias("unit_id")).distinct()
    return cited.join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi")


def edge_text(column: Column = None) -> Column:
    return F.concat(F.col("source"), F.lit(" -["), F.col("type"), F.lit("]-> "), F.col("target"), F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.concat(F.lit(": "), F.trim("description"))).otherwise(""))


def edge_label() -> Column:
    return F.concat(F.col("source"), F.lit(" —"), F.replace("type", F.lit("_"), F.lit(" ")), F.lit("→ "), F.col("target"))


def entity_text() -> Column:
    return F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.concat(F.lit(": "), F.trim("description"))).otherwise(""))


def unit_ranking(questions: DataFrame, seeds: DataFrame, reached: DataFrame, edges: DataFrame, members: bool = True) -> DataFrame:
    """(q_id, unit_id, score, first): 1 for each citing seed and other entity, the weight for each relationship.

    ``seeds``, ``reached``: (q_id, at, unit_ids); ``edges``: (q_id, at, unit_ids, weight). Ties go to the first seen.
    """
    parts = [(seeds.withColumn("w", F.lit(1)), 0)]
    if members:
        parts.append((reached.withColumn("w", F.lit(1)), 1))
    parts.append((edges.withColumn("w", F.col("weight")), 2))
    rows = None
    for part, stage in parts:
        one = part.select("q_id", F.posexplode("unit_ids").alias("pos", "unit_id"), F.col("w").cast("long").alias("w"), F.lit(stage).alias("stage"), "at")
        rows = one if rows is None else rows.unionByName(one)
    first = F.struct("stage", "at", "pos")
    return rows.groupBy("q_id", "unit_id").agg(F.sum("w").alias("score"), F.min(first).alias("first"))


@dataclass(frozen=True)
class Budget:
    """Limits of a local expansion; None is no limit."""

    hops: int = 1
    seeds: int = 3
    relationships: int | None = 50
    per_hop: int | None = 25
    new_nodes: int | None = 10
    nodes: int | None = 100
    items: int | None = None
    units: int = 10
    order: str = "WEIGHT_DESC"
    direction: str = "BOTH"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    least_weight: int = 1
    neighbours: bool = True
    member_units: bool = True
    columns: list[Column] = field(default_factory=list)


ANSWER_CONTEXT = Budget(hops=1, seeds=3, relationships=10, per_hop=None, new_nodes=None, nodes=None, units=5, neighbours=False, member_units=False)
_ITEMS = "q_id long, kind string, identifier string, score double, hop int, pos long"


def _left(limit: int | None, used: int) -> float:
    return float("inf") if limit is None else limit - used


class _Pass:
    """One question's budget pass of a hop over edges in order: what is taken, as (kind, identifier, score).

    An edge whose new ends don't fit is skipped; a full relationship or item budget ends the pass, as does that of the hop.
    """

    def __init__(self, budget: Budget):
        self.budget, self.known, self.keys = budget, set(), set()
        self.relationships = self.items = self.here = self.fresh = 0

    def begin(self, kind: str, identifier: str) -> None:
        """An item that is included from before."""
        (self.keys if kind == "RELATIONSHIP" else self.known).add(identifier)
        self.relationships += kind == "RELATIONSHIP"
        self.items += kind != "NODE"

    def ended(self) -> bool:
        b = self.budget
        return min(_left(b.relationships, self.relationships), _left(b.items, self.items), _left(b.per_hop, self.here)) <= 0

    def offer(self, source: str, key: str, target: str, weight: int) -> list[tuple[str, str, float]]:
        b = self.budget
        fresh = [x for x in dict.fromkeys((source, target)) if x not in self.known]
        if len(fresh) > _left(b.new_nodes, self.fresh) or key in self.keys:
            return []
        self.keys.add(key)
        self.here, self.relationships, self.items = self.here + 1, self.relationships + 1, self.items + 1
        out = [("RELATIONSHIP", key, float(weight))]
        for x in fresh:
            if _left(b.nodes, len(self.known)) <= 0:
                continue
            self.known.add(x)
            self.fresh += 1
            listed = b.neighbours and _left(b.items, self.items) > 0
            self.items += listed
            out.append(("ENTITY" if listed else "NODE", x, 0.0))
        return out


def _passes(budget: Budget, hop: int):
    """Passes of all questions over rows (q_id, place, kind, src_id, identifier, tgt_id, weight) sorted by q_id and place; what is included
    from before has place 0."""

    def run(batches):
        now, state, pos = object(), None, 0
        for b in batches:
            q = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else []
            out = []
            for lo, hi in itertools.pairwise(cuts):
                if q[lo] != now:
                    now, state, pos = q[lo], _Pass(budget), 0
                if state.ended() and b.column(1)[int(lo)].as_py():
                    continue  # the rest of a question is not even unpacked
                for place, kind, source, key, target, weight in zip(*(c.slice(int(lo), int(hi - lo)).to_pylist() for c in b.columns[1:]), strict=True):
                    if not place:
                        state.begin(kind, key)
                        continue
                    if state.ended():
                        break
                    for item in state.offer(source, key, target, weight):
                        pos += 1
                        out.append((int(now), *item, hop, pos))
            names = ["q_id", "kind", "identifier", "score", "hop", "pos"]
            types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def frontier_of(items: DataFrame) -> DataFrame:
    """(q_id, identity) of all nodes that are included."""
    return items.where("kind <> 'RELATIONSHIP'").select("q_id", F.col("identifier").alias("identity")).distinct()


def _candidates(found: DataFrame, items: DataFrame, budget: Budget) -> DataFrame:
    """Edges that a hop's pass can use, with their ``place`` in the budget's order, each edge key once.

    With a limit of m on relationships the pass needs few of them, whatever the frontier touches: an edge of the frontier has at most one new
    end, so until new ends run out every edge is taken, and these are among the first m; from then on only edges count whose ends are
    both included or ends of the first m, which are as many as so few nodes have between them.
    """
    known = frontier_of(items)
    order = [F.col("ord").asc()]
    if budget.columns:
        order = [*budget.columns, *order]
    elif budget.order == "NEW_NODES_FIRST":
        ends = found.select("q_id", "ord", F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("identity")).join(known, ["q_id", "identity"], "left_anti")
        fresh = ends.groupBy("q_id", "ord").agg(F.count("*").alias("fresh"))
        found = found.join(fresh, ["q_id", "ord"], "left")
        order = [F.desc(F.coalesce("fresh", F.lit(0))), *order]
    elif budget.order in ("WEIGHT_DESC", "WEIGHT_ASC"):
        order = [F.desc("weight") if budget.order == "WEIGHT_DESC" else F.asc("weight"), *order]
    taken = items.where("kind = 'RELATIONSHIP'").select("q_id", F.col("identifier").alias("edge_key"))
    rows = keyed(found).join(taken, ["q_id", "edge_key"], "left_anti")
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("q_id", "edge_key").orderBy(*order))).where("again = 1").drop("again")
    limits = [x for x in (budget.relationships, budget.per_hop, budget.items) if x is not None]
    in_order = Window.partitionBy("q_id").orderBy(*order)
    if limits:
        ahead = lambda some: some.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= min(limits)).drop("nth")
        if budget.new_nodes is None:
            rows = ahead(rows)
        else:
            rows = written(rows)
            first = written(ahead(rows))
            near = known.unionByName(first.select("q_id", F.explode(F.array("src_id", "tgt_id")).alias("identity"))).distinct()
            inside = rows
            for end in ("src_id", "tgt_id"):
                inside = inside.join(near.withColumnRenamed("identity", end), ["q_id", end], "left_semi")
            rows = first.unionByName(inside.select(*first.columns)).dropDuplicates(["q_id", "edge_key"])
    return rows.withColumn("place", F.row_number().over(in_order)).select("q_id", F.col("place").cast("long").alias("place"), F.lit(None).cast("string").alias("kind"), "src_id", F.col("edge_key").alias("identifier"), "tgt_id", F.col("weight").cast("long").alias("weight"))


def expand(seeds: DataFrame, edges: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(q_id, kind, identifier, score, hop, pos) of a bounded breadth-first expansion from ranked seeds (q_id, identity, score, rank).

    Hops are joins over all questions at once; the budget pass of a hop is one ordered scan over the candidate edges of all
    questions, which holds one question's items at a time. NODE rows are nodes that are included without being listed.
    """
    first = seeds.dropDuplicates(["q_id", "identity"]).withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy("rank")))
    most = [x for x in (budget.seeds, budget.nodes, budget.items) if x is not None]
    items = first.where(F.col("n") <= min(most)).select("q_id", F.lit("ENTITY").alias("kind"), F.col("identity").alias("identifier"), F.col("score").cast("double").alias("score"), F.lit(0).alias("hop"), F.col("n").cast("long").alias("pos"))
    items = written(items)
    usable = accepted(edges, budget.include, budget.exclude, budget.least_weight)
    frontier = items.select("q_id", F.col("identifier").alias("identity"))
    limits = replace(budget, columns=[])  # orders are columns and stay on the driver
    none = lambda kind: F.lit(None).cast(kind)
    for hop in range(1, budget.hops + 1):
        rows = _candidates(from_frontier(usable, frontier, budget.direction), items, budget)
        before = items.select("q_id", F.lit(0).cast("long").alias("place"), "kind", none("string").alias("src_id"), "identifier", none("string").alias("tgt_id"), none("long").alias("weight"))
        scan = before.unionByName(rows).repartition("q_id").sortWithinPartitions("q_id", "place")
        new = scan.mapInArrow(_passes(limits, hop), _ITEMS)
        new = written(new)
        items = items.unionByName(new)
        frontier = new.where("kind <> 'RELATIONSHIP'").select("q_id", F.col("identifier").alias("identity"))
    return items


def one_hop(seeds: DataFrame, edges: DataFrame, scored) -> DataFrame:
    """(q_id, edge columns, hop_score): each question's best edge at its best seed; ``scored(question, text)`` rates edges."""
    near = from_frontier(edges, seeds.select("q_id", "identity"))
    text = F.concat_ws(" ", "source", F.replace("type", F.lit("_"), F.lit(" ")), "target")
    rated = near.join(seeds.select("q_id", "question"), "q_id").withColumn("hop_score", scored(F.col("question"), text))
    best = rated.where("hop_score > 0").withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("hop_score"), "ord")))
    return best.where("n = 1").drop("n", "question")


def keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_key", maps.edge_key(F.col("src_id"), F.col("type"), F.col("tgt_id")))


def with_prefix(entities: DataFrame, prefix: str) -> DataFrame:
    """Entities whose name starts with ``prefix``, in any case."""
    return entities.where(F.startswith(F.lower("name"), F.lit(prefix.strip().lower())))


def citing(entities: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, identity): the entities that cite each of ``units`` (id)."""
    cited = entities.select("identity", F.explode("unit_ids").alias("unit_id")).distinct()
    return cited.join(units.select(F.col("id").alias("unit_id")).distinct(), "unit_id", "left_semi").select("unit_id", "identity")


def payload(entities: DataFrame, edges: DataFrame, communities: DataFrame, memberships: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, id, data): the rows of a graph view as JSON: entities with the documents of their units, edges, and communities with
    their members in stored order."""
    named = mentions(entities, units).join(units.select(F.col("id").alias("unit_id"), "document_name"), "unit_id").groupBy("identity").agg(F.array_sort(F.collect_set("document_name")).alias("sources"))
    nodes = entities.join(named, "identity", "left").select(F.lit("entity").alias("kind"), F.col("identity").alias("id"), F.to_json(F.struct("name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))).alias("data"))
    links = keyed(edges).select(F.lit("relationship").alias("kind"), F.col("edge_key").alias("id"), F.to_json(F.struct(F.col("src_id").alias("source"), F.col("tgt_id").alias("target"), "type", "weight")).alias("data"))
    lists = memberships.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "identity"))), lambda x: x["identity"]).alias("members"))
    groups = communities.join(lists, "community_id", "left").select(F.lit("community").alias("kind"), F.col("community_id").alias("id"), F.to_json(F.struct("title", "summary", F.coalesce("members", F.array().cast("array<string>")).alias("members"))).alias("data"))
    return nodes.unionByName(links).unionByName(groups)
