"""The prefix trie of conversations, by MSD radix partitioning of dictionary-encoded turns.

Every distinct turn (role, text) becomes a dictionary id; from then on only ids and text lengths move. Conversations with equal
sequences are one class, kept by its smallest conv_id. Buckets of classes that share their first turns are partitioned by the next
digit, a run of turns whose length doubles with each level, so that the levels grow with the logarithm of the longest
conversation. A bucket of at most ``LOCAL`` turns is finished in one task by a multikey quicksort, which emits its nodes as it
recurses; a crowded one is split again and its nodes come from one aggregate for the digit. A node is named by its smallest member
and its depth. Sums over subtrees: each node's value lies with its smallest member, running sums from below along each
member's path give that member's part of every node above, and a group of the parts is the sum.

The turns of one conversation are numbered by range partitions, so a conversation may fill several of them. ``ends_sha256`` is one
chain over the members that end at a node; they are streamed in order through one task, 8 bytes each, and never held.

Turns, prefixes and sequences are told apart by two 64-bit hashes each.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text is empty; turns are ordered by
turn (null first), then role and text; equal rows of one conversation are turns of their own; a conversation without rebuilt turns
ends at the root; extra columns are ignored; an empty table has no conversation and so no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm._shared import forget, groups, looked_up, trimmed, written

#: Turns that a bucket may hold to be finished in one task.
LOCAL = 200_000
#: Turns in the digit of the first level; each level's digit is twice as long.
DIGIT = 4
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended"]
_OUT = ", ".join(f"{c} long" for c in _NODE)


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, size): the turns of each conversation in order, from 0, as dictionary ids with the code points of their text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the place of the row: its partition, and its number there in 33 bits
    rows = written(rows.select("conv_id", number.alias("place"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2"), F.length("text").cast("long").alias("size")))
    part = F.shiftright("place", 33).alias("part")
    parts = rows.groupBy("conv_id", part).agg(F.min("place").alias("first"), F.count("*").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", "first", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    dictionary = written(rows.groupBy("k1", "k2").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    numbered = rows.drop("size").withColumn("part", part).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") - F.col("first") + F.col("ahead")).alias("pos"), "k1", "k2")
    return written(looked_up(numbered, dictionary, ["k1", "k2"], "pos").select("conv_id", "pos", "id", "size"))


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations as (conv_id), and their turns (conv_id, pos, id, size) after rebuilding from encoded ``turns``.

    Conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % heads, and goes on with its own
    turns after its first h.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    plan = written(convs.select("conv_id", "n", h, base))
    bases = plan.where("conv_id = base").select("base", F.col("n").alias("has"))
    plan = plan.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("shift"))
    plan = written(plan)
    own = looked_up(turns, plan, ["conv_id"], "pos").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "id", "size")
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    taken = plan.join(first, "base").where("pos < h").select("conv_id", "pos", "id", "size")
    return plan.select("conv_id"), written(own.unionByName(taken))


def _chains(batches):
    """(conv_id, w, n, sha) of each class, from (k1, k2, n, conv_id) sorted; a class may go over any number of batches."""
    key, first, count, chain = None, 0, 0, None
    out = []

    def closed():
        return first, count, key[2], chain.hexdigest()

    for b in batches:
        k = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not len(k[0]):
            continue
        cuts = np.flatnonzero((np.diff(k[0]) != 0) | (np.diff(k[1]) != 0) | (np.diff(k[2]) != 0)) + 1
        for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(k[0])].tolist(), strict=True):
            now = (int(k[0][lo]), int(k[1][lo]), int(k[2][lo]))
            if now != key:
                if key is not None:
                    out.append(closed())
                key, first, count, chain = now, int(k[3][lo]), 0, hashlib.sha256()
            chain.update(("," * (count > 0) + ",".join(map(str, k[3][lo:hi].tolist()))).encode())
            count += hi - lo
        if len(out) > 10_000:
            yield _class_batch(out)
            out = []
    if key is not None:
        out.append(closed())
    yield _class_batch(out)


def _class_batch(rows):
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["c", "w", "n", "sha"])


def _classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, w, n, sha): the distinct sequences by their smallest conv_id, with members, turns and the digest of the members."""
    keys = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("pos", "id")).alias("k1"), F.bit_xor(F.xxhash64("id", "pos", F.lit(1))).alias("k2"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    rows = convs.join(keys, "conv_id", "left").select(zero("k1"), zero("k2"), zero("n"), "conv_id")
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartition(parts, "k1", "k2", "n").sortWithinPartitions("k1", "k2", "n", "conv_id").mapInArrow(trimmed(_chains), "c long, w long, n long, sha string"))


def _sorted_nodes(cols):
    """All nodes below the roots of whole buckets: columns (top, base, c, w, pos, id, size) sorted by top, c and pos."""
    top, base, c, w, _, ids, size = cols
    new = np.r_[True, (top[1:] != top[:-1]) | (c[1:] != c[:-1])]
    start = np.flatnonzero(new)
    rem = np.diff(np.r_[start, len(c)])
    top, base, c, w = top[start], base[start], c[start], w[start]
    cuts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    # nodes in the order of their making, a parent before its children; the roots of the buckets come first
    owner, depth, up = top[cuts].tolist(), base[cuts].tolist(), [-1] * len(cuts)
    n_convs, value, ended = [0] * len(cuts), [0] * len(cuts), [-1] * len(cuts)
    tails = []  # (class, turn of it, node) from where a class goes on alone
    stack = [(np.arange(lo, hi), 0, k) for k, (lo, hi) in enumerate(zip(cuts, np.r_[cuts[1:], len(c)], strict=True))]
    while stack:
        who, d, node = stack.pop()
        if len(who) == 1:
            tails.append((int(who[0]), d, node))
            continue
        digit = ids[start[who] + d]
        pivot = digit[len(digit) // 2]
        same = digit == pivot
        if not same.all():
            for side in (who[digit < pivot], who[digit > pivot]):
                if len(side):
                    stack.append((side, d, node))
            who = who[same]
            if len(who) == 1:
                tails.append((int(who[0]), d, node))
                continue
        k = len(owner)
        members = int(w[who].sum())
        owner.append(int(c[who[0]]))  # classes are in the order of c
        depth.append(depth[node] + 1)
        up.append(node)
        n_convs.append(members)
        value.append((members - 1) * int(size[start[who[0]] + d]))
        last = rem[who] == d + 1
        ended.append(int(who[last][0]) if last.any() else -1)
        if not last.all():
            stack.append((who[~last], d + 1, k))
    children, leaves, saved = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), np.array(value, np.int64)
    out = []
    if tails:
        who, d, node = (np.array(x, np.int64) for x in zip(*tails, strict=True))
        length = rem[who] - d
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]), dtype=np.int64)
        of = np.repeat(np.arange(len(who)), length)
        nth = at - (ends - length)[of]
        worth = (w[who][of] - 1) * size[(start[who] + d)[of] + nth]
        total = np.r_[0, np.cumsum(worth)]
        below = total[ends][of] - total[at]
        np.add.at(children, node, 1)
        np.add.at(leaves, node, 1)
        np.add.at(saved, node, total[ends] - total[ends - length])
        final = nth == length[of] - 1
        owners = np.array(owner, np.int64)
        depths = np.array(depth, np.int64)
        mine = c[who][of]
        out.append([mine, depths[node][of] + nth + 1, np.where(nth == 0, owners[node][of], mine), w[who][of], (~final).astype(np.int64), np.ones(len(at), np.int64), below, np.where(final, who[of], -1)])
    children, leaves, saved = children.tolist(), leaves.tolist(), saved.tolist()
    for k in range(len(owner) - 1, len(cuts) - 1, -1):
        leaves[k] = leaves[k] or 1
        p = up[k]
        children[p] += 1
        leaves[p] += leaves[k]
        saved[p] += saved[k]
    inner = slice(len(cuts), None)
    parents = [owner[p] for p in up[inner]]
    out.append([np.array(x, np.int64) for x in (owner[inner], depth[inner], parents, n_convs[inner], children[inner], leaves[inner], saved[inner], ended[inner])])
    # what a bucket adds to its root, which is a node of a level above: n_convs 0 marks it
    out.append([np.array(x, np.int64) for x in (owner[: len(cuts)], depth[: len(cuts)], owner[: len(cuts)], [0] * len(cuts), children[: len(cuts)], leaves[: len(cuts)], saved[: len(cuts)], [-1] * len(cuts))])
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    gone = cols[7] < 0
    arrays = [pa.array(x, pa.int64()) for x in cols[:7]] + [pa.array(c[np.maximum(cols[7], 0)], pa.int64(), mask=gone)]
    return pa.RecordBatch.from_arrays(arrays, names=_NODE)


def _finished(batches):
    for cols in groups(batches):
        yield _sorted_nodes(cols)


def trie(convs: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row a node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` are all members (conv_id), ``turns`` their turns (conv_id, pos, id, size) with positions from 0 without gaps.
    """
    spark = convs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = _classes(convs, turns)
    rows = written(turns.withColumnRenamed("conv_id", "c").join(classes.select("c", "w", "n"), "c"))
    least = classes.agg(F.min("c").alias("top"), F.sum("w").alias("n_convs"), F.min(F.when(F.col("n") == 0, F.col("c"))).alias("ended")).where("top is not null")
    least = written(least)
    active = classes.where("n > 0").select("c", "n", "w").crossJoin(F.broadcast(least.select("top")))  # one row
    base, digit, local_members, crowded_nodes, paths = 0, DIGIT, [], [], []
    while True:
        active = written(active)
        crowds = written(active.groupBy("top").agg(F.sum(F.col("n") - base).alias("turns_")).where(F.col("turns_") > local).select("top"))
        if crowds.isEmpty():
            local_members.append(active.select("c", "top", F.lit(base).cast("long").alias("base")))
            break
        local_members.append(active.join(crowds, "top", "left_anti").select("c", "top", F.lit(base).cast("long").alias("base")))
        inside = looked_up(active.select("c", "top"), crowds, ["top"], "c")
        step = rows.where((F.col("pos") >= base) & (F.col("pos") < base + digit)).join(inside, "c")
        path = Window.partitionBy("c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        step = written(step.select("top", "c", "w", "n", "pos", "size", F.bit_xor(F.xxhash64("pos", "id")).over(path).alias("p1"), F.bit_xor(F.xxhash64("id", "pos", F.lit(1))).over(path).alias("p2")))
        keys = ["top", "pos", "p1", "p2"]
        found = step.groupBy(*keys).agg(F.min("c").alias("owner"), F.sum("w").alias("n_convs"), F.max("size").alias("size"), F.min(F.when(F.col("n") == F.col("pos") + 1, F.col("c"))).alias("ended"))
        found = written(found)
        member = written(looked_up(step.select(*keys, "c", "w", "n"), found.select(*keys, "owner"), keys, "c").select("c", "w", "n", "top", (F.col("pos") + 1).alias("depth"), "owner"))
        above = F.coalesce(F.lag("owner").over(Window.partitionBy("c").orderBy("depth")), F.col("top"))
        parent = member.withColumn("parent", above).where("c = owner").select("owner", "depth", "parent")
        crowded_nodes.append(found.select("owner", (F.col("pos") + 1).alias("depth"), "n_convs", "size", "ended").join(parent, ["owner", "depth"]))
        paths.append(member.select("c", "depth", "owner"))
        base, digit = base + digit, digit * 2
        active = member.where((F.col("depth") == base) & (F.col("n") > base)).select("c", "n", "w", F.col("owner").alias("top"))
        forget(step)
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    tasks = rows.join(union(local_members), "c").where("pos >= base").select("top", "base", "c", "w", "pos", "id", "size")
    done = written(tasks.repartition(parts, "top").sortWithinPartitions("top", "c", "pos").mapInArrow(trimmed(_finished), _OUT))
    buckets = done.where("n_convs = 0").select(F.col("conv_id").alias("owner"), "depth", "n_children", "n_leaves", "saved_tokens")
    nodes = done.where("n_convs > 0")
    top = buckets.where("depth = 0")
    if crowded_nodes:
        nodes = nodes.unionByName(_above(written(union(crowded_nodes)), union(paths), buckets))
        top = nodes.select("*")
        top = top.agg(F.sum(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.sum(F.when(F.col("depth") == 1, F.col("n_leaves"))).alias("n_leaves"), F.sum(F.when(F.col("depth") == 1, F.col("saved_tokens"))).alias("saved_tokens"))
    else:
        top = top.agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    zero = lambda name, or_: F.coalesce(F.col(name), F.lit(or_)).cast("long").alias(name)
    root = least.crossJoin(F.broadcast(top)).select(F.col("top").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero("n_children", 0), zero("n_leaves", 1), zero("saved_tokens", 0), "ended")  # one row
    nodes = written(nodes.unionByName(root))
    ends = classes.select(F.col("c").alias("ended"), F.col("sha").alias("ends_sha256"))
    ended = nodes.where("ended is not null").join(ends, "ended")
    passed = nodes.where("ended is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(passed).select(*_NODE[:-1], "ends_sha256")


def _above(found: DataFrame, paths: DataFrame, buckets: DataFrame) -> DataFrame:
    """The nodes of crowded levels with the sums over their subtrees."""
    children = found.where("depth > 1").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("k"))
    kids = buckets.select("owner", "depth", F.col("n_children").alias("k"))
    children = written(children.unionByName(kids).where("depth > 0").groupBy("owner", "depth").agg(F.sum("k").alias("n_children")))
    found = written(found.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = found.select(F.col("owner").alias("c"), "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"))
    own = own.unionByName(buckets.where("depth > 0").select(F.col("owner").alias("c"), "depth", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")))
    own = own.groupBy("c", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    below = Window.partitionBy("c").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    part = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0))).over(below).alias(name)
    parts = paths.join(own, ["c", "depth"], "left").select("owner", "depth", part("saved"), part("leaves"))
    sums = parts.groupBy("owner", "depth").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    out = found.join(sums, ["owner", "depth"])
    return out.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ended")


def rebuilt_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of all conversations rebuilt on the heads of their hundreds; see ``trie`` and ``rebuilt``."""
    return trie(*rebuilt(encoded(conversations)), local)
