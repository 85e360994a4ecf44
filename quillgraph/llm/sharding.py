"""Resharding by minimum-cost flow.

Rows lie in old shards; new shards take equal numbers of rows, at most one apart. A block is the rows of one old shard
in one size class (powers of two). The flow network sends each block's rows to new shards: staying costs nothing, each
moved row costs the mean bytes of its block. Successive shortest paths give the transfers that move the fewest bytes, up to
the differences within a size class, as rows of one block count alike;
within a block, ranks say which rows go where, and slots follow from the same ranks. So only one window by block and
bucket touches all rows, and the driver sees a histogram of old shards x classes x ``BUCKETS`` cells, whatever the input.

Defined cases: a null text has no bytes; null doc_ids and repeated rows each take their own slot (ties by digest of the
text); fewer rows than shards leave shards empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm._shared import forget, written

BUCKETS = 64


def min_cost_flow(arcs: list[tuple[int, int, int, float]], source: int, sink: int) -> tuple[list[int], float]:
    """Flow on each arc (tail, head, capacity, cost >= 0) of a maximum flow of least cost, and that cost."""
    graph: dict[int, list[int]] = defaultdict(list)
    head, room, cost = [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(head))
        head.append(b)
        room.append(c)
        cost.append(w)
        graph[b].append(len(head))
        head.append(a)
        room.append(0)
        cost.append(-w)
    potential: dict[int, float] = defaultdict(float)
    while True:
        far, via, heap = {source: 0.0}, {}, [(0.0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for e in graph[v]:
                to = head[e]
                if room[e] > 0:
                    new = d + max(0.0, cost[e] + potential[v] - potential[to])
                    if new < far.get(to, float("inf")) - 1e-9:
                        far[to], via[to] = new, e
                        heapq.heappush(heap, (new, to))
        if sink not in far:
            break
        top = max(far.values())
        for v in graph:
            potential[v] += far.get(v, top)
        amount, v = None, sink
        while v != source:
            amount = room[via[v]] if amount is None else min(amount, room[via[v]])
            v = head[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= amount
            room[via[v] ^ 1] += amount
            v = head[via[v] ^ 1]
    flow = [room[2 * k + 1] for k in range(len(arcs))]
    return flow, sum(f * w for f, (*_, w) in zip(flow, arcs, strict=True))


def transfers(blocks: dict[tuple[int, int], tuple[int, float]], shards: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each block (old shard, class) of (rows, bytes), how many rows go to which new shard, the own shard first."""
    total = sum(n for n, _ in blocks.values())
    old = sorted({s for s, _ in blocks})
    keys = sorted(blocks)
    node = {k: 2 + i for i, k in enumerate(keys)}
    pool = 2 + len(keys)
    new = {j: pool + 1 + j for j in range(shards)}
    # larger old shards take the odd rows, as that moves fewest
    rows = {s: sum(blocks[k][0] for k in keys if k[0] == s) for s in old}
    odd = set(sorted(range(shards), key=lambda j: (-rows.get(j, 0), j))[: total % shards])
    arcs = [(0, node[k], blocks[k][0], 0.0) for k in keys]
    keep = [k for k in keys if k[0] < shards]
    arcs += [(node[k], new[k[0]], blocks[k][0], 0.0) for k in keep]
    arcs += [(node[k], pool, blocks[k][0], blocks[k][1] / blocks[k][0]) for k in keys]
    arcs += [(pool, new[j], total, 0.0) for j in range(shards)]
    arcs += [(new[j], 1, total // shards + (j in odd), 0.0) for j in range(shards)]
    flow, _ = min_cost_flow(arcs, 0, 1)
    stays = dict(zip(keep, flow[len(keys) :], strict=False))
    out_of = dict(zip(keys, flow[len(keys) + len(keep) :], strict=False))
    into = [[j, f] for j, f in zip(range(shards), flow[2 * len(keys) + len(keep) :], strict=False) if f]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in keys:
        out[k] = [(k[0], stays[k])] if stays.get(k) else []
        left = out_of[k]
        while left:
            take = min(left, into[0][1])
            out[k].append((into[0][0], take))
            left -= take
            into[0][1] -= take
            if not into[0][1]:
                into.pop(0)
    return out


def resharded(docs: DataFrame, shards: int = 40, old_shards: int = 32, old: str | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every row; with ``carry`` also the whole ``row`` as a struct.

    ``old`` names a column of present shard numbers; without it rows lie by hash of doc_id in ``old_shards``.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    place = F.col(old).cast("int") if old else F.pmod(F.xxhash64(F.col("doc_id")), F.lit(old_shards)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("old_shard"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    rows = rows.withColumn("class", F.length(F.bin("size"))).withColumn("bucket", F.pmod(F.hash("doc_id", "text_crc32"), F.lit(BUCKETS)))
    block = ["old_shard", "class", "bucket"]
    cells = [tuple(r) for r in rows.groupBy(*block).agg(F.count("*"), F.sum("size")).collect()]
    blocks: dict[tuple[int, int], tuple[int, float]] = {}
    for s, c, _, n, b in cells:
        m, x = blocks.get((s, c), (0, 0.0))
        blocks[s, c] = m + n, x + b
    ends: dict[tuple[int, int], list] = {}
    filled: dict[int, int] = defaultdict(int)
    for k, goes in sorted(transfers(blocks, shards).items()):
        at, ends[k] = 0, []
        for j, n in goes:
            ends[k].append((at, at + n, j, filled[j]))
            at += n
            filled[j] += n
    table, before = [], defaultdict(int)
    for s, c, u, n, _ in sorted(cells):
        lo = before[s, c]
        before[s, c] += n
        table.append((s, c, u, lo, [e for e in ends[s, c] if e[0] < lo + n and e[1] > lo]))
    plan = spark.createDataFrame(table, "old_shard int, class int, bucket int, ahead long, goes array<struct<lo:long,hi:long,shard:int,base:long>>")
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(plan), block)  # at most old shards x classes x BUCKETS rows
    placed = placed.withColumn("rank", F.col("rank") - 1 + F.col("ahead")).withColumn("goes", F.filter("goes", lambda e: (e["lo"] <= F.col("rank")) & (F.col("rank") < e["hi"]))[0])
    return placed.select("doc_id", "size", "text_crc32", "old_shard", F.col("goes.shard").alias("shard"), (F.col("goes.base") + F.col("rank") - F.col("goes.lo")).alias("slot"), *(["row"] if carry else []))


#: Rows of one file of a rewritten shard.
FILE_ROWS = 1_000_000


def carried(placed: DataFrame) -> DataFrame:
    """All columns of the rows of ``placed`` (from ``resharded`` with ``carry``), and old_shard, shard and slot, which get a leading
    underscore where a row has columns of these names."""
    taken = {c.lower() for c in placed.select("row.*").columns}
    names = []
    for name in ("old_shard", "shard", "slot"):
        free = name
        while free in taken:
            free = f"_{free}"
        names.append(F.col(name).alias(free))
    return placed.select("row.*", *names)


def rewrite(placed: DataFrame, path: str, layout: tuple[str, str] = ("shard", "slot")) -> list[int]:
    """Put the rows of the shards that change in place of their old files under ``path``, and return their numbers.

    ``layout`` names the columns that hold shard (the partition column of the files) and slot. A row's own columns of these names
    are those of the old files and are replaced; rows with other columns of these names need another layout.

    ``placed`` comes from ``resharded`` with ``carry``. Rows are staged in the shared folder first, as they may come from the files
    that are replaced; a shard goes to as many tasks as it has files. Shards without moves keep their old files.
    """
    moves = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in moves.collect())
    shard, slot = layout
    own = [c for c in placed.select("row.*").columns if c.lower() not in (shard.lower(), slot.lower())]
    rows = placed.where(F.col("shard").isin(affected)).select(*[F.col(f"row.`{c}`") for c in own], F.col("shard").alias(shard), F.col("slot").alias(slot))
    staged = written(rows.repartition(shard, F.floor(F.col(slot) / FILE_ROWS)).sortWithinPartitions(shard, slot))
    left = {r[0] for r in staged.select(shard).distinct().collect()}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    forget(staged)
    jvm, hadoop = placed.sparkSession.sparkContext._jvm, placed.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for number in sorted(set(affected) - left):  # all its rows went elsewhere
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}={number}")
        folder.getFileSystem(hadoop).delete(folder, True)
    return affected
