"""Communities: connected components, modularity, Louvain, levels, numbering, statistics, titles, hashes and budgets."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import graph
from quillgraph.operators.model import Model, stats_lines
from quillgraph.operators.tables import components, forget, ranked_globally, small, written

SEED, LEVELS, PASSES, EPSILON = 42, 10, 50, 1e-12
MEMBERS, EDGES, LEAST = 25, 30, 3
#: Edges of one corpus that the sequential kernel takes; a larger graph is first merged by rounds of moves over all nodes at once.
KERNEL = 2_000_000
#: Rounds of a level end when the last ``PATIENCE`` of them raised modularity by less than ``GAIN``.
GAIN, PATIENCE = 1e-3, 2
#: Rounds hold a number or two of each node as arrays, broadcast to the tasks, up to this many nodes; beyond them they are joins.
NODES = 10_000_000
#: Edge ends in one packed row, and in one task that packs them.
BLOCK, DEALT = 1 << 18, 1 << 21


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(identity, component): component is the least order of any node that it holds; lone nodes are their own.

    ``nodes``: (identity, ord). Edge ends that aren't nodes pass the connection on but are not reported.
    """
    ends = edges.select(F.explode(F.array("src_id", "tgt_id")).alias("identity")).distinct()
    every = nodes.select("identity", "ord").unionByName(ends.join(nodes, "identity", "left_anti").select("identity", (F.lit(1 << 62) + F.pmod(F.xxhash64("identity"), F.lit(1 << 61))).alias("ord")))
    number = every.select("identity", "ord")
    pairs = edges.select("src_id", "tgt_id").join(number.select(F.col("identity").alias("src_id"), F.col("ord").alias("a")), "src_id").join(number.select(F.col("identity").alias("tgt_id"), F.col("ord").alias("b")), "tgt_id").select("a", "b")
    found = components(pairs).withColumnRenamed("node", "ord")
    return nodes.join(found, "ord", "left").select("identity", F.coalesce("component", "ord").alias("component"))


def modularity(partition: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a partition (identity, community) over undirected weighted edges; edges with a foreign end don't count."""
    a = partition.select(F.col("identity").alias("src_id"), F.col("community").alias("ca"))
    b = partition.select(F.col("identity").alias("tgt_id"), F.col("community").alias("cb"))
    inside = edges.where("weight > 0").join(a, "src_id").join(b, "tgt_id")
    ends = inside.select(F.explode(F.array(F.struct(F.col("ca").alias("c")), F.struct(F.col("cb").alias("c")))).alias("e"), "weight", (F.col("ca") == F.col("cb")).cast("int").alias("own"))
    by = ends.groupBy("e.c").agg(F.sum("weight").cast("double").alias("strength"), (F.sum(F.col("weight") * F.col("own")) / 2).alias("internal"))
    return by.agg((F.sum("internal") / (F.sum("strength") / 2) - resolution * F.sum(F.pow("strength", F.lit(2))) / F.pow(F.sum("strength"), F.lit(2))).alias("modularity"))


class JavaRandom:
    """The public linear congruential generator of java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = self.state >> (48 - bits)
        return value - (1 << bits) if bits == 32 and value >> 31 else value

    def below(self, n: int) -> int:
        if n & (n - 1) == 0:
            return (n * self.next(31)) >> 31
        while True:
            u = self.next(31)
            if u - u % n + (n - 1) < 1 << 31:
                return u % n


def louvain(ids: list[str], edges: list[tuple[str, str, float]], seed: int = SEED, resolution: float = 1.0, levels: int = LEVELS, passes: int = PASSES, refine: bool = True) -> list[list[int]]:
    """Community number of every id at each level, finest first; groups are numbered by first member.

    A level moves nodes until no move gains, cuts communities into connected parts and makes each part a node of the next
    level; the last level is the one after which nothing merges. Deterministic for a given order of input: only the order
    of visits and the rule for ties are fixed, all else is array work over the edge list.
    """
    usable = [(a, b, w) for a, b, w in edges if a and b and a.strip() and b.strip() and 0 < w < float("inf")]
    named = list(dict.fromkeys(x for x in ids if x and x.strip()))
    helpers = (x for a, b, _ in usable for x in (a, b))
    index = {x: i for i, x in enumerate(dict.fromkeys([*named, *helpers]))}
    ends = np.array([(index[a], index[b]) for a, b, _ in usable], np.int64).reshape(-1, 2)
    links = _summed(np.sort(ends, axis=1), np.array([w for *_, w in usable], float), len(index))
    place = np.arange(len(index))
    found = []
    for level in range(levels):
        n = int(place.max(initial=-1)) + 1
        home = _settled(n, *links, seed + level, resolution, passes)
        part = _pieces(home, *links[:2]) if refine else home
        _, part = np.unique(_first_seen(part), return_inverse=True)
        merged = int(part.max(initial=-1)) + 1
        if level and merged == n:
            break
        place = part[place]
        found.append(_first_seen(place[: len(named)]).tolist())
        if merged == n:
            break
        links = _summed(np.sort(np.stack([part[links[0]], part[links[1]]], axis=1), axis=1), links[2], merged)
    return found or [list(range(len(named)))]


def _summed(pairs: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends (low, high) and summed weight of each undirected pair; a pair of one node is its loop."""
    key, inverse = np.unique(pairs[:, 0] * max(n, 1) + pairs[:, 1], return_inverse=True)
    return key // max(n, 1), key % max(n, 1), np.bincount(inverse, weights=weight, minlength=len(key))


def _first_seen(labels: np.ndarray) -> np.ndarray:
    """The labels renumbered from 0 in the order in which they first stand."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[inverse]


def _visits(n: int, seed: int) -> list[int]:
    """A seeded permutation of the nodes: a Fisher-Yates shuffle from the last place down."""
    order, random = list(range(n)), JavaRandom(seed)
    for last in range(n - 1, 0, -1):
        pick = random.below(last + 1)
        order[last], order[pick] = order[pick], order[last]
    return order


def _settled(n: int, low: np.ndarray, high: np.ndarray, weight: np.ndarray, seed: int, resolution: float, passes: int) -> np.ndarray:
    """The community of every node after moves of single nodes, each to where modularity gains most."""
    strength = np.bincount(low, weights=weight, minlength=n) + np.bincount(high, weights=weight, minlength=n)
    whole = float(strength.sum())
    if whole <= 0:
        return np.arange(n)
    apart = low != high
    tail, head = np.r_[low[apart], high[apart]], np.r_[high[apart], low[apart]]
    by_tail = np.argsort(tail, kind="stable")
    cut = np.searchsorted(tail[by_tail], np.arange(1, n))
    neighbours = [x.tolist() for x in np.split(head[by_tail], cut)]
    pulls = [x.tolist() for x in np.split(np.r_[weight[apart], weight[apart]][by_tail], cut)]
    home, mass, load = list(range(n)), strength.tolist(), strength.tolist()
    share = (resolution * strength / whole).tolist()
    visits = _visits(n, seed)
    for _ in range(passes):
        before = home.copy()
        for node in visits:
            now = home[node]
            toward = dict.fromkeys([now], 0.0)
            for other, pull in zip(neighbours[node], pulls[node], strict=True):
                c = home[other]
                toward[c] = toward.get(c, 0.0) + pull
            if len(toward) == 1:
                continue
            rate = share[node]
            stay = toward.pop(now) - rate * (load[now] - mass[node])
            gain = [(pull - rate * load[c], c) for c, pull in toward.items()]
            best = max(gain)[0]
            if best > stay + EPSILON:
                home[node] = to = min(c for g, c in gain if g >= best - EPSILON)
                load[now] -= mass[node]
                load[to] += mass[node]
        if home == before:
            break
    return np.array(home, np.int64)


def _pieces(home: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least node of the connected part of its community that each node lies in."""
    inside = home[low] == home[high]
    low, high = low[inside], high[inside]
    label = np.arange(len(home))
    while True:
        least = np.minimum(label[low], label[high])
        spread = label.copy()
        np.minimum.at(spread, low, least)
        np.minimum.at(spread, high, least)
        np.minimum.at(spread, label[low], least)
        np.minimum.at(spread, label[high], least)
        spread = spread[spread]
        if np.array_equal(spread, label):
            return label
        label = spread


#: A detector: ids and weighted edges of one corpus to the community numbers of the ids at each level, finest first.
Detector = Callable[[list[str], list[tuple[str, str, float]]], list[list[int]]]


def detected(nodes: DataFrame, edges: DataFrame, detector: Detector | None = None, kernel: int = KERNEL, **options) -> DataFrame:
    """(corpus_id, level, community, identity) by a detector (Louvain unless given) in each corpus, corpora in parallel.

    ``nodes``: (corpus_id, identity, ord); ``edges``: (corpus_id, src_id, tgt_id, weight, ord). The kernel is sequential by
    nature: it holds the node and edge lists of a corpus of at most ``kernel`` edges, texts stay behind. Larger corpora go through
    ``spread_louvain``; a detector that is given gets every corpus whole.
    """
    nodes, edges = nodes.select("corpus_id", "identity", "ord"), edges.select("corpus_id", "src_id", "tgt_id", "weight", "ord")
    if detector is not None:
        return _together(nodes, edges, detector)
    edges = written(_hashed(edges))
    large = [r[0] for r in edges.groupBy("corpus_id").count().where(F.col("count") > kernel).collect()]  # few, as each is large
    if not large:
        return _together(nodes, edges, partial(louvain, **options))
    known = lambda rows: F.coalesce("corpus_id", F.lit("")).isin([x or "" for x in large])
    found = _together(nodes.where(~known(nodes)), edges.where(~known(edges)), partial(louvain, **options))
    for corpus in large:
        own = lambda rows, corpus=corpus: rows.where(F.col("corpus_id").eqNullSafe(F.lit(corpus)))
        levels = spread_louvain(own(nodes), own(edges), kernel, **options)
        found = found.unionByName(levels.withColumn("corpus_id", F.lit(corpus).cast("string")))
    return found


def _together(nodes: DataFrame, edges: DataFrame, find: Detector) -> DataFrame:
    """The detector on each corpus as one group."""
    schema = "corpus_id string, level int, community int, identity string"

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = left.sort_values("ord")["identity"].tolist()
        rows = right.sort_values("ord")
        found = find(ids, list(zip(rows["src_id"], rows["tgt_id"], rows["weight"].astype(float), strict=True)))
        names = list(dict.fromkeys(x for x in ids if x and x.strip()))
        parts = [pd.DataFrame({"corpus_id": key[0], "level": k, "community": c, "identity": names}) for k, c in enumerate(found)]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["corpus_id", "level", "community", "identity"])

    return nodes.groupBy("corpus_id").cogroup(edges.groupBy("corpus_id")).applyInPandas(run, schema)


def spread_louvain(nodes: DataFrame, edges: DataFrame, kernel: int = KERNEL, seed: int = SEED, resolution: float = 1.0, levels: int = LEVELS, passes: int = PASSES, refine: bool = True) -> DataFrame:
    """(level, community, identity) of one corpus of any size, in the numbering of ``louvain``.

    A level is Louvain's with rounds in place of visits: in a round every node weighs the communities of its neighbours, a seeded half of
    those that would gain move, and the round of highest modularity stands. Its communities are cut into connected parts, and
    these are the nodes of the next level. As soon as ``kernel`` edges are left, the sequential kernel finds the other levels. Nodes and
    communities are numbers in the order of the nodes, a community being its least node. Up to ``NODES`` nodes a round is array work
    over packed edges, which never move again; beyond it, and where two nodes share a hash of 64 bits, it is joins and aggregates.
    """
    named = nodes.where(~_blank("identity")).groupBy("identity").agg(F.min("ord").alias("ord")).withColumn("rest", F.lit(0))
    usable = (edges if "a" in edges.columns else _hashed(edges)).where("a is not null and b is not null")
    if named.count() <= NODES:  # most graphs have no other ends than their nodes
        ids = written(ranked_globally(named, "id", F.col("ord"), F.col("identity")).select("identity", F.col("id").cast("long").alias("id"), "rest"))
        found = _array_louvain(ids, usable, kernel, seed, resolution, levels, passes, refine)
        if found is not None:
            return found
    ends = usable.select("src_id").distinct().unionByName(usable.select(F.col("tgt_id").alias("src_id")).distinct()).distinct().withColumnRenamed("src_id", "identity")
    lone = ends.join(named, "identity", "left_anti").select("identity", F.lit(None).cast(named.schema["ord"].dataType).alias("ord"), F.lit(1).alias("rest"))
    ids = written(ranked_globally(named.unionByName(lone), "id", F.col("rest"), F.col("ord"), F.col("identity")).select("identity", F.col("id").cast("long").alias("id"), "rest"))
    if ids.count() <= NODES:
        found = _array_louvain(ids, usable, kernel, seed, resolution, levels, passes, refine)
        if found is not None:
            return found
    at = lambda end, to: ids.select(F.col("identity").alias(end), F.col("id").alias(to))
    pairs = usable.select("src_id", "tgt_id", F.col("weight").cast("double").alias("weight")).join(at("src_id", "a"), "src_id").join(at("tgt_id", "b"), "tgt_id")
    links = _linked(pairs)
    place = ids.where("rest = 0").select("identity", "id", F.col("id").alias("community"))
    found = []
    for level in range(levels):
        if links.count() <= kernel:
            more = _finished(links, seed + level, resolution, levels - level, passes, refine)
            depth = [r[0] for r in more.select("level").distinct().collect()]
            for k in sorted(depth):
                if level and k == 0 and more.where("level = 0 and node <> part").isEmpty():
                    break  # nothing merges beyond the level before
                found.append(_moved(place, more.where(F.col("level") == k).select("node", "part")))
            break
        part = _level(links, seed + level, resolution, passes, refine)
        if part is None:
            break
        place = written(_moved(place, part))
        found.append(place)
        to = lambda end, new: part.select(F.col("node").alias(end), F.col("part").alias(new))
        links = _linked(links.join(to("low", "a"), "low").join(to("high", "b"), "high"))
    out = None
    for k, one in enumerate(found or [place]):
        labels = ranked_globally(one.select("community").distinct(), "n", F.col("community"))
        rows = one.join(labels, "community").select(F.lit(k).alias("level"), (F.col("n") - 1).cast("int").alias("community"), "identity")
        out = rows if out is None else out.unionByName(rows)
    return out


def _blank(c: str):
    return F.col(c).isNull() | (F.trim(c) == "")


def _hashed(edges: DataFrame) -> DataFrame:
    """``edges`` with 64 bits of each end (a, b), which are null where the edge doesn't count."""
    usable = ~_blank("src_id") & ~_blank("tgt_id") & (F.col("weight") > 0) & (F.col("weight").cast("double") < float("inf"))
    return edges.withColumns({to: F.when(usable, F.xxhash64(end)) for to, end in (("a", "src_id"), ("b", "tgt_id"))})


def _array_louvain(ids: DataFrame, edges: DataFrame, kernel: int, seed: int, resolution: float, levels: int, passes: int, refine: bool) -> DataFrame | None:
    """``spread_louvain`` with the communities of all nodes ``ids`` (identity, id from 1, rest) as arrays at the driver.

    None if two nodes share a hash or an end of ``edges`` is no node.
    """
    rows = ids.select(F.xxhash64("identity").alias("h"), F.col("id").cast("int").alias("id"), "rest").toArrow()
    hashes, number = rows["h"].to_numpy(), rows["id"].to_numpy() - 1
    named = int((rows["rest"].to_numpy() == 0).sum())
    order, n = np.argsort(hashes), len(hashes)
    if not n or (np.diff(hashes[order]) == 0).any():
        return None
    spark = ids.sparkSession
    held = spark.sparkContext.broadcast((hashes[order], number[order].astype(np.int32)))

    def numbered_ends(batches):
        known, numbers = held.value
        for batch in batches:
            a, b = (_places(known, numbers, batch.column(k).to_numpy()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), batch.column(2)], ["low", "high", "weight"])

    links = written(edges.select("a", "b", F.col("weight").cast("double").alias("weight")).mapInArrow(numbered_ends, _LINKS))
    held.destroy()
    if not links.where("low < 0").isEmpty():
        forget(links)
        return None
    community, found = np.arange(n, dtype=np.int32), []
    for level in range(levels):
        count = links.count()
        if count <= kernel:
            more = _finished(links, seed + level, resolution, levels - level, passes, refine).toArrow().to_pandas()
            for k, one in more.groupby("level"):
                if level and k == 0 and (one["node"] == one["part"]).all():
                    break  # nothing merges beyond the level before
                part = np.arange(n, dtype=np.int32)
                part[one["node"].to_numpy()] = one["part"].to_numpy()
                found.append(part[community])
            break
        blocks = _blocks(links, count)
        part = _array_level(blocks, links, n, seed + level, resolution, passes, refine)
        if part is None:
            break
        community = part[community]
        found.append(community)
        merged = _between(blocks, links, part)
        forget(blocks)
        forget(links)
        links = merged
    numbers = [np.unique(x[:named], return_inverse=True)[1].astype(np.int32) for x in found or [community]]
    last = spark.sparkContext.broadcast(numbers)

    def told(batches):
        for batch in batches:
            at = batch.column(1).to_numpy() - 1
            for k, x in enumerate(last.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(x[at]), batch.column(0)], ["level", "community", "identity"])

    return ids.where("rest = 0").select("identity", "id").mapInArrow(told, "level int, community int, identity string")


_LINKS = "low int, high int, weight double"


def _places(known: np.ndarray, numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each hash, -1 where it isn't known."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, numbers[at], -1).astype(np.int32)


def _blocks(links: DataFrame, count: int) -> DataFrame:
    """(node, other, weight): the links from both ends in the order of nodes, packed as arrays of about ``BLOCK`` ends a row.

    Rows are cut anywhere, so a node with many links is dealt like all others: the first and last node of a row may go on in the next.
    """
    ways = F.array(F.struct(F.col("low").alias("node"), F.col("high").alias("other")), F.struct(F.col("high").alias("node"), F.col("low").alias("other")))
    both = links.where("low <> high").select(F.explode(ways).alias("w"), "weight").select("w.node", "w.other", "weight")
    size = BLOCK

    def run(batches):
        rows, n = [], 0
        for batch in batches:
            rows.append(batch)
            n += batch.num_rows
            if n >= size:
                yield packed(rows)
                rows, n = [], 0
        if n:
            yield packed(rows)

    def packed(rows):
        table = pa.Table.from_batches(rows)
        return pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in table.columns], table.column_names)

    return written(both.repartitionByRange(2 * count // DEALT + 1, "node", "other").sortWithinPartitions("node").mapInArrow(run, "node binary, other binary, weight binary"))


def _swept(blocks: DataFrame, state: tuple, take, schema: str) -> DataFrame:
    """The record batches that ``take`` makes of each block (node, other, weight) and the broadcast ``state``, written."""
    held = blocks.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        for batch in batches:
            for node, other, weight in zip(*batch.columns, strict=True):
                yield take(*held.value, np.frombuffer(node.as_buffer(), np.int32), np.frombuffer(other.as_buffer(), np.int32), np.frombuffer(weight.as_buffer(), np.float64))

    found = written(blocks.mapInArrow(run, schema))
    held.destroy()
    return found


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _batch(**columns) -> pa.RecordBatch:
    """One row: arrays as bytes where the name begins with ``of_``, as lists where they are arrays, else plain values."""
    cells = [pa.array([v.tobytes()], pa.binary()) if k.startswith("of_") else pa.ListArray.from_arrays([0, len(v)], pa.array(v)) if isinstance(v, np.ndarray) else pa.array([v]) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays(cells, list(columns))


def _gathered(found: DataFrame, *kinds) -> list[np.ndarray]:
    """The packed columns of all rows, each as one array of its kind."""
    rows = found.collect()
    return [np.concatenate([np.zeros(0, t), *(np.frombuffer(r[k], t) for r in rows)]) for k, t in enumerate(kinds)]


def _masses(node, other, weight) -> pa.RecordBatch:
    cut = _runs(node)
    return _batch(of_node=node[cut], of_mass=np.add.reduceat(weight, cut))


def _wishes(home, load, mass, whole, resolution, seed, turn, node, other, weight) -> pa.RecordBatch:
    """The nodes of a block that gain by a move and may move now, and the sums of the first and last node, which can go on elsewhere."""
    cut = _runs(node)
    row = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(node)]))
    key = row * len(home) + home[other]
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _runs(key)
    row, to = np.divmod(key[at], len(home))
    pull = np.add.reduceat(weight[order], at)
    who, now = node[cut], home[node[cut]]
    rate = resolution * mass[who] / whole
    stay, own, cost = rate * (load[now] - mass[who]), to == now[row], rate[row] * load[to]
    edge = (row == 0) | (row == len(cut) - 1)
    inside = np.bincount(row[own], weights=pull[own], minlength=len(cut))
    gain = np.where(own, -np.inf, pull - cost)
    groups = _runs(row)
    best = np.maximum.reduceat(gain, groups)
    new = np.minimum.reduceat(np.where(gain == best[row], to, len(home)), groups)
    wants = best > inside - stay + EPSILON
    wants[[0, -1]] = False
    inside[[0, -1]] = 0
    goes = wants & _coin(who, seed, turn)
    ends = {"e_node": who[row[edge]], "e_to": to[edge].astype(np.int32), "e_pull": pull[edge], "e_own": own[edge], "e_cost": cost[edge], "e_stay": stay[row[edge]]}
    return _batch(of_node=who[goes], of_new=new[goes].astype(np.int32), inside=float(inside.sum()), wanting=int(wants.sum()), **ends)


_WISHES = "of_node binary, of_new binary, inside double, wanting long, e_node array<int>, e_to array<int>, e_pull array<double>, e_own array<boolean>, e_cost array<double>, e_stay array<double>"


def _coin(node: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A seeded half of the nodes, another in each turn."""
    x = (node.astype(np.uint64) + np.uint64(seed * 1_000_003 + turn + 1) * np.uint64(0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 0


def _lower(home, label, node, other, weight) -> pa.RecordBatch:
    """The nodes of a block that see a lower label in their community."""
    cut = _runs(node)
    own = np.repeat(home[node[cut]], np.diff(np.r_[cut, len(node)])) == home[other]
    least = np.minimum.reduceat(np.where(own, label[other], len(home)), cut)
    less = least < label[node[cut]]
    return _batch(of_node=node[cut][less], of_label=least[less].astype(np.int32))


def _array_level(blocks: DataFrame, links: DataFrame, n: int, seed: int, resolution: float, passes: int, refine: bool) -> np.ndarray | None:
    """The part of every node after one level, a part being its least node; None if nothing merges."""
    mass = np.zeros(n)
    loops = links.where("low = high").groupBy("low").agg((2 * F.sum("weight")).alias("mass")).toArrow()
    mass[loops["low"].to_numpy()] = loops["mass"].to_numpy()
    sums = _swept(blocks, (), _masses, "of_node binary, of_mass binary")
    node, more = _gathered(sums, np.int32, np.float64)
    forget(sums)
    mass += np.bincount(node, weights=more, minlength=n)
    whole = float(mass.sum())
    if not whole:
        return None
    home = np.arange(n, dtype=np.int32)
    best, best_at, since = home, -float("inf"), 0
    for turn in range(passes + 1):
        load = np.bincount(home, weights=mass, minlength=n)
        found = _swept(blocks, (home, load, mass, whole, resolution, seed, turn), _wishes, _WISHES)
        inside, wanting = found.agg(F.sum("inside"), F.sum("wanting")).first()
        parts = [c for c in found.columns if c.startswith("e_")]
        ends = found.select(F.explode(F.arrays_zip(*parts)).alias("e")).select("e.*").groupBy("e_node", "e_to").agg(F.sum("e_pull").alias("pull"), *(F.first(c).alias(c) for c in ("e_own", "e_cost", "e_stay")))
        gain = F.when(~F.col("e_own"), F.struct((F.col("pull") - F.col("e_cost")).alias("gain"), (-F.col("e_to")).alias("first")))
        ends = ends.groupBy("e_node").agg(F.max(gain).alias("best"), F.sum(F.when(F.col("e_own"), F.col("pull")).otherwise(0.0)).alias("own"), F.first("e_stay").alias("stay")).collect()  # two a block
        moving = [(r.e_node, -r.best.first) for r in ends if r.best is not None and r.best.gain > r.own - r.stay + EPSILON]
        inside, wanting = (inside or 0.0) + sum(r.own for r in ends), (wanting or 0) + len(moving)
        quality = inside / whole - resolution * float((load * load).sum()) / whole**2
        since = 0 if quality > best_at + GAIN else since + 1
        if quality > best_at:
            best, best_at = home, quality
        if not wanting or since > PATIENCE or turn == passes:
            forget(found)
            break
        node, new = _gathered(found.select("of_node", "of_new"), np.int32, np.int32)
        forget(found)
        home = home.copy()
        home[node] = new
        for node, new in moving:
            if _coin(np.array([node]), seed, turn)[0]:
                home[node] = new
    if refine:
        part = np.arange(n, dtype=np.int32)
        while True:
            found = _swept(blocks, (best, part), _lower, "of_node binary, of_label binary")
            node, least = _gathered(found, np.int32, np.int32)
            forget(found)
            if not len(node):
                break
            spread = part.copy()
            np.minimum.at(spread, node, least)
            np.minimum.at(spread, part[node], least)
            while not np.array_equal(part := spread[spread], spread):
                spread = part
    else:
        first = np.full(n, n, np.int32)
        np.minimum.at(first, best, np.arange(n, dtype=np.int32))
        part = first[best]
    return None if np.array_equal(part, np.arange(n)) else part


def _between(blocks: DataFrame, links: DataFrame, part: np.ndarray) -> DataFrame:
    """The links (low, high, weight) between parts."""

    def merged(part, node, other, weight):
        once = node < other
        a, b = part[node[once]], part[other[once]]
        low, high, weights = _summed(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).astype(np.int64), weight[once], len(part))
        return pa.RecordBatch.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(weights.astype(float))], ["low", "high", "weight"])

    held = links.sparkSession.sparkContext.broadcast(part)

    def moved(batches):
        for batch in batches:
            to = pa.array(held.value[batch.column(0).to_numpy()])
            yield pa.RecordBatch.from_arrays([to, to, batch.column(2)], ["low", "high", "weight"])

    apart = _swept(blocks, (part,), merged, _LINKS)
    loops = links.where("low = high").mapInArrow(moved, _LINKS)
    found = written(apart.unionByName(loops).groupBy("low", "high").agg(F.sum("weight").alias("weight")))
    forget(apart)
    held.destroy()
    return found


def _linked(pairs: DataFrame) -> DataFrame:
    """(low, high, weight): the summed weight of each undirected pair (a, b, weight)."""
    return written(pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "weight").groupBy("low", "high").agg(F.sum("weight").alias("weight")))


def _moved(place: DataFrame, part: DataFrame) -> DataFrame:
    """``place`` with the communities that have a new ``part`` put into it."""
    return place.join(part.withColumnRenamed("node", "community"), "community", "left").select("identity", "id", F.coalesce("part", "community").alias("community"))


def _level(links: DataFrame, seed: int, resolution: float, passes: int, refine: bool) -> DataFrame | None:
    """(node, part) of one level over linked nodes, a part being its least node; None if nothing merges."""
    ends = links.select(F.explode(F.array("low", "high")).alias("node"), "weight")
    home = written(ends.groupBy("node").agg(F.sum("weight").alias("mass")).withColumn("home", F.col("node")))
    whole = home.agg(F.sum("mass")).first()[0]
    if not whole:
        return None
    apart = links.where("low <> high")
    ways = F.array(F.struct(F.col("low").alias("node"), F.col("high").alias("other")), F.struct(F.col("high").alias("node"), F.col("low").alias("other")))
    both = apart.select(F.explode(ways).alias("w"), "weight").select("w.node", "w.other", "weight").repartition("node").persist(StorageLevel.DISK_ONLY)
    best, best_at, since = None, -float("inf"), 0
    for turn in range(passes + 1):
        load = home.groupBy("home").agg(F.sum("mass").alias("load"))
        state = small(home.join(load, "home").select("node", "home", "mass", "load"))
        loads = small(load)
        toward = both.join(state.select(F.col("node").alias("other"), F.col("home").alias("to")), "other").groupBy("node", "to").agg(F.sum("weight").alias("pull"))
        rated = toward.join(state, "node").join(loads.select(F.col("home").alias("to"), F.col("load").alias("there")), "to")
        rate = F.lit(resolution) * F.col("mass") / F.lit(whole)
        gain = F.when(F.col("to") != F.col("home"), F.struct((F.col("pull") - rate * F.col("there")).alias("gain"), (-F.col("to")).alias("first")))
        own = F.sum(F.when(F.col("to") == F.col("home"), F.col("pull")).otherwise(0.0))
        picked = rated.groupBy("node").agg(F.max(gain).alias("best"), own.alias("own"), F.first("home").alias("now"), F.first(rate * (F.col("load") - F.col("mass"))).alias("cost"))
        wants = F.coalesce(F.col("best.gain") > F.col("own") - F.col("cost") + EPSILON, F.lit(False))
        coin = F.pmod(F.xxhash64(F.col("node"), F.lit(seed), F.lit(turn)), F.lit(2)) == 0
        turned = written(picked.select("node", "own", wants.alias("wants"), F.when(wants & coin, -F.col("best.first")).alias("new")))
        inside, wanting = turned.agg(F.sum("own"), F.count_if("wants")).first()
        square = loads.agg(F.sum(F.col("load") * F.col("load"))).first()[0]
        quality = (inside or 0.0) / whole - resolution * square / whole**2
        since = 0 if quality > best_at + GAIN else since + 1
        if quality > best_at:
            best, best_at = home, quality
        if not wanting or since > PATIENCE or turn == passes:
            break
        home = written(home.join(turned.select("node", "new"), "node", "left").select("node", "mass", F.coalesce("new", "home").alias("home")))
        forget(turned)
    both.unpersist()
    homes = best.select("node", "home")
    if refine:
        of = lambda end, to: homes.select(F.col("node").alias(end), F.col("home").alias(to))
        inner = apart.join(of("low", "x"), "low").join(of("high", "y"), "high").where("x = y").select(F.col("low").alias("a"), F.col("high").alias("b"))
        labels = components(inner).select("node", F.col("component").alias("part"))
    else:
        labels = homes.join(homes.groupBy("home").agg(F.min("node").alias("part")), "home").select("node", "part")
    part = written(homes.join(labels, "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    return None if part.where("node <> part").isEmpty() else part


def _finished(links: DataFrame, seed: int, resolution: float, levels: int, passes: int, refine: bool) -> DataFrame:
    """(level, node, part) of the levels that the kernel finds over few links; a part is its least node."""

    def run(batches):
        pdf = pd.concat([pd.DataFrame({"low": [], "high": [], "weight": []}), *batches]).astype({"low": "int64", "high": "int64"}).sort_values(["low", "high"])
        ids = np.unique(np.r_[pdf["low"], pdf["high"]])
        names = [str(x) for x in ids]
        found = louvain(names, list(zip(pdf["low"].astype(str), pdf["high"].astype(str), pdf["weight"], strict=True)), seed, resolution, levels, passes, refine)
        parts = []
        for k, numbers in enumerate(found):
            _, first, inverse = np.unique(np.array(numbers), return_index=True, return_inverse=True)
            parts.append(pd.DataFrame({"level": k, "node": ids, "part": ids[first][inverse]}))
        yield pd.concat(parts)

    return written(links.repartition(1).mapInPandas(run, "level int, node long, part long"))


def selected(levels: DataFrame, most: int, start: int = -1) -> DataFrame:
    """(identity, level, community): groups at a level (-1: the coarsest), larger ones split along finer levels down to 0.

    ``levels``: (level, community, identity). One pass: each node takes the first level, from the start down, at which its
    group is small enough.
    """
    top = levels.agg(F.max("level").alias("top"))
    begin = F.when(F.lit(start) < 0, F.col("top")).otherwise(F.least(F.lit(start), F.col("top")))
    sized = levels.groupBy("level", "community").agg(F.count("*").alias("size"))
    rows = levels.join(sized, ["level", "community"]).crossJoin(F.broadcast(top)).where(F.col("level") <= begin)
    rows = rows.withColumn("fits", (F.col("size") <= most) | (F.col("level") == 0))
    best = rows.where("fits").withColumn("n", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("level"))))
    return best.where("n = 1").select("identity", "level", "community")


def numbered(groups: DataFrame, entities: DataFrame, least: int = 1) -> DataFrame:
    """(community_id, community, n, first): groups of ``least`` members and more, numbered by the order of their first member."""
    rows = groups.join(entities.select("identity", "ord"), "identity").groupBy("community").agg(F.countDistinct("identity").alias("n"), F.min("ord").alias("first")).where(F.col("n") >= least)
    return ranked_globally(rows, "n_", F.col("first"), F.col("community")).withColumn("community_id", F.concat(F.lit("community-"), F.col("n_").cast("string"))).drop("n_")


def capped(rows: DataFrame, group: str, most: int, *order) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("n") <= most)


def strongest_edges(edges: DataFrame, memberships: DataFrame, most: int = EDGES) -> DataFrame:
    return capped(graph.internal_edges(edges, memberships), "community_id", most, F.desc("weight"), "ord")


def statistics(members: DataFrame, *attributes: str) -> DataFrame:
    """(community_id, attribute, value, n) of distinct members (community_id, identity, attributes), for chosen keys or all."""
    rows = members.select("community_id", "identity", F.explode("attributes").alias("attribute", "value"))
    if attributes:
        rows = rows.where(F.col("attribute").isin(*attributes))
    rows = rows.withColumn("value", F.trim("value")).where("value <> ''").distinct()
    return rows.groupBy("community_id", "attribute", "value").agg(F.count("*").alias("n"))


def described(members: DataFrame, distinct: bool = False) -> DataFrame:
    """(community_id, title, summary) from the first names of (community_id, name, ord); a bounded head of each group is read."""
    head = capped(members, "community_id", MEMBERS, "ord").groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("names"))
    return head.select("community_id", tx.deterministic_title(F.col("names")).alias("title"), tx.fallback_summary(F.col("names"), distinct).alias("summary"))


def content_hashes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, content_hash) over the sorted lines of listed members and internal edges.

    SHA-256 is one chain, so the lines of a community, sorted by Spark, stream through a task that holds a batch of them.
    """
    lines = members.select("community_id", F.concat_ws("|", F.lit("E"), "identity", F.coalesce("description", F.lit(""))).alias("line"))
    lines = lines.unionByName(edges.select("community_id", F.concat_ws("|", F.lit("R"), "src_id", "type", "tgt_id", F.col("weight").cast("string"), F.coalesce("description", F.lit(""))).alias("line")))

    def run(batches):
        at = digest = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], to), pa.array([digest.hexdigest()], pa.string())], ["community_id", "content_hash"])
        for batch in batches:
            to = batch.schema.field(0).type
            for key, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), itemgetter(0)):
                if digest is None or key != at:
                    if digest is not None:
                        yield done()
                    at, digest = key, hashlib.sha256()
                digest.update("".join(f"{line}\n" for _, line in rows).encode())
        if digest is not None:
            yield done()

    kind = lines.schema["community_id"].dataType.simpleString()
    return lines.repartition("community_id").sortWithinPartitions("community_id", "line").mapInArrow(run, f"community_id {kind}, content_hash string")


STATUSES = ("GENERATED", "REUSED", "DETERMINISTIC", "FAILED", "SKIPPED_BUDGET")


def summarised(members: DataFrame, edges: DataFrame, stored: DataFrame, model: Model, most: int | None = None, seconds: float | None = None, attributes: tuple[str, ...] = (), parallelism: int = 4) -> DataFrame:
    """(community_id, title, summary, content_hash, status, error) of every community.

    ``members``: (community_id, identity, name, type, description, attributes, ord); ``stored``: (content_hash, title, summary) of
    earlier runs. Equal content is REUSED; of the rest the first ``most`` (by their first member) are GENERATED by the model in
    ``parallelism`` tasks, as long as the run is not older than ``seconds``; where the model fails (FAILED), isn't there
    (DETERMINISTIC) or the budget is used up (SKIPPED_BUDGET) the deterministic title and summary stand.
    """
    listed = capped(members, "community_id", MEMBERS, "ord")
    strongest = strongest_edges(edges, members.select("community_id", "identity"))
    hashes = content_hashes(listed, strongest)
    plain = described(members.select("community_id", "name", "ord"))
    first = members.groupBy("community_id").agg(F.min("ord").alias("ord"), F.countDistinct("identity").alias("n_members"))
    plan = planned(hashes.join(first, "community_id"), stored, most)
    who = listed.groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("n", "name", "type", F.coalesce("description", F.lit("")).alias("description")))).alias("who"))
    how = strongest.groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("n", "source", "type", "target", F.coalesce("description", F.lit("")).alias("description")))).alias("how"))
    counts = statistics(members, *attributes).groupBy("community_id", "attribute").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("values"))
    counts = counts.groupBy("community_id").agg(F.collect_list(F.struct("attribute", "values")).alias("counts"))
    asked = plan.where("status = 'GENERATED'").select("community_id").join(first, "community_id").join(who, "community_id").join(how, "community_id", "left").join(counts, "community_id", "left")
    end = None if seconds is None else time.time() + seconds

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if end is not None and time.time() >= end:
                    out.append((r["community_id"], None, None, "SKIPPED_BUDGET", None))
                    continue
                dicts = lambda x: [] if x is None else [dict(v) for v in x]
                table = {c["attribute"]: [(v["value"], -v["n"]) for v in c["values"]] for c in dicts(r["counts"])}
                try:
                    found = model.summary(dicts(r["who"]), dicts(r["how"]), stats_lines(r["n_members"], len(r["who"]), table))
                    out.append((r["community_id"], *(found or (None, None)), "GENERATED" if found else "DETERMINISTIC", None))
                except Exception as e:
                    out.append((r["community_id"], None, None, "FAILED", str(e)[:300]))
            yield pd.DataFrame(out, columns=["community_id", "new_title", "new_summary", "outcome", "error"])

    schema = "community_id string, new_title string, new_summary string, outcome string, error string"
    dealt = asked.repartitionByRange(parallelism, "ord").sortWithinPartitions("ord")
    new = written(dealt.select("community_id", "n_members", "who", "how", "counts").mapInPandas(run, schema))
    old = stored.groupBy("content_hash").agg(F.min(F.struct("title", "summary")).alias("old"))
    rows = plan.join(plain, "community_id").join(new, "community_id", "left").join(old, "content_hash", "left")
    status = F.coalesce("outcome", "status")
    pick = lambda c: F.when(status == "REUSED", F.col(f"old.{c}")).when(status == "GENERATED", F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("community_id", pick("title"), pick("summary"), "content_hash", status.alias("status"), "error")


def outcome(summaries: DataFrame) -> DataFrame:
    """One row: the number of summaries of each status and the outcome of the run (COMPLETE, PARTIAL or EMPTY)."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    rows = summaries.agg(F.count("*").alias("communities"), *counts)
    done = F.when(F.col("communities") == 0, "EMPTY").when(F.col("failed") + F.col("skipped_budget") > 0, "PARTIAL").otherwise("COMPLETE")
    return rows.withColumn("outcome", done)


def recomputed(store, corpus: str, model: Model, least: int = LEAST, detector: Detector | None = None, progress: Callable[[str, dict], None] | None = None, **budget) -> dict:
    """Find and summarise the communities of a stored corpus anew, with summaries of equal content kept, and store them.

    ``progress`` is told of each community and of the outcome.
    """
    kept = written(store.table("communities", corpus).select(F.col("attributes")["contentHash"].alias("content_hash"), "title", "summary").where("content_hash is not null"))
    entities, edges = store.table("entities", corpus), store.table("relationships", corpus)
    levels = detected(entities.select("corpus_id", "identity", "ord"), edges, detector)
    top = levels.groupBy("corpus_id").agg(F.max("level").alias("level"))
    groups = written(levels.join(top, ["corpus_id", "level"]).select("identity", "community"))
    named = written(numbered(groups, entities, least).select("community_id", "community", "first"))
    members = groups.join(named, "community").join(entities, "identity").select("community_id", "identity", "name", "type", "description", "attributes", "ord")
    members = written(members)
    found = written(summarised(members, edges, kept, model, **budget))
    store.delete_communities(corpus)
    here = F.lit(corpus).alias("corpus_id")
    store.upsert("communities", found.join(named, "community_id").select(here, "community_id", "title", "summary", F.create_map(F.lit("contentHash"), F.col("content_hash")).alias("attributes"), F.col("first").alias("ord")))
    store.put_memberships(members.select(here, "community_id", "identity", "ord"))
    result = outcome(found).first().asDict()
    if progress is not None:
        for r in found.orderBy("community_id").toLocalIterator():
            progress("community-detected", {"community": r["community_id"], "title": r["title"], "status": r["status"]})
        progress("ingestion-complete", result)
    return result


def planned(communities: DataFrame, stored: DataFrame, most: int | None = None) -> DataFrame:
    """(community_id, content_hash, status): REUSED where the hash is stored, GENERATED for the first ``most`` others, then SKIPPED_BUDGET."""
    known = stored.select("content_hash", F.lit(True).alias("known")).distinct()
    rows = communities.join(known, "content_hash", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    status = F.when(F.col("known"), "REUSED").otherwise("GENERATED")
    if most is not None:  # the budget is the limit of a top-n
        first = rows.where("not known").orderBy("ord", "community_id").limit(most).select("community_id", F.lit(True).alias("first"))
        rows = rows.join(first, "community_id", "left")
        status = F.when(F.col("known"), "REUSED").when(F.col("first"), "GENERATED").otherwise("SKIPPED_BUDGET")
    return rows.withColumn("status", status).select("community_id", "content_hash", "status")
