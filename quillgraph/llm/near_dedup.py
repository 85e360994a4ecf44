"""Near-duplicate documents by a MinHash LSH forest.

Every document's set of distinct word shingles gets ``TREES * DEPTH`` minhashes. Each tree is one sorted order of the
documents by a run of ``DEPTH`` minhashes; a document's candidates are its neighbours in each order, that is those with
the longest common prefix. In sparse regions a common first value is enough, in crowded ones the neighbours share deep
prefixes, so the depth adapts by itself. Crowded regions also compare each member with the region's centre (the member
closest to the majority sketch), which finds the original of a large group of differently edited copies. Candidates are
confirmed on the full shingle sets, strongest first, and those inside one component are not confirmed again.

What neighbours and centres leave is done exactly: in ``DEEP`` trees every crowded region is cut into buckets, deeper only
where it holds more than ``BUCKET`` documents. Of each bucket the documents whose sketch lies near one of another component
are kept, their sets are compared until each bucket is united as far as it goes, and every union is one link. So
a bucket of n members gives at most n - 1 links, no partner is left out, and groups that are one component by then cost nothing.

Equal sets are one class from the start, so groups of copies cost one row each. The forest is probabilistic: a pair at
similarity 0.8 shares no bucket of depth d in any deep tree with probability (1 - 0.8**d)**8, which is 3e-6 for d = 1 and
3e-4 for d = 2, on top of what neighbours find in all sixteen trees.

Defined cases: a null or blank text has the empty set, links with nothing and is kept; fewer words than a shingle form
one shingle; rows without doc_id take no part in linking (component null, kept); repeated rows are each returned; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import chunked, components, forget, fresh, groups, lean, looked_up, trimmed, written

TREES, DEPTH, NEIGHBOURS = 16, 8, 4
#: Trees whose crowded regions are searched exactly, documents of a bucket before it goes deeper, and documents of a group
#: whose sets are compared in one task.
DEEP, BUCKET, GROUP = 8, 4096, 1024
#: Candidates whose sketch puts them this far under the threshold (in standard errors) are not confirmed.
SIGMAS = 5.0
_ROWS = TREES * DEPTH
_MUL = (tx._splitmix(_ROWS, 4242) | np.uint64(1))[:, None]
_XOR = tx._splitmix(_ROWS, 777)[:, None]
_STEP = 4096


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    for first, last, data, offsets in tx.pieces(texts):
        data = tx.LOWER[data]
        start, end, before = tx.words_of(data, offsets, tx.NOT_SPACE)
        hashes = tx.span_hash(tx.prefix_hash(data), start, end)
        grams = tx.windows(hashes, size)
        for k in range(last - first):
            i, j = before[k], before[k + 1]
            if j - i >= size:
                yield np.unique(grams[i : j - size + 1])
            else:
                yield tx.windows(hashes[i:j], int(j - i)) if j > i else hashes[:0]


def minhashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(_ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), _STEP):
        out = np.minimum(out, (((shingles[None, i : i + _STEP] ^ _XOR) * _MUL) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent sums over the set: its identity."""
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(tx.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                n, k1, k2, sig = [], [], [], []
                for s in shingle_sets(b.column(1), size):
                    n.append(len(s))
                    x, y = _key(s)
                    k1.append(x)
                    k2.append(y)
                    sig.append(minhashes(s).astype(">u4").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), b.column(2)], names=["doc_id", "n_shingles", "k1", "k2", "sig", "text_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_key")).mapInArrow(trimmed(run), "doc_id long, n_shingles long, k1 long, k2 long, sig binary, text_key long")


def _trees(batches):
    """(tree, key, node, sketch) of each signature; the sketch keeps two bits of each minhash."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = _matrix(b.column(1), 4 * _ROWS).view(">u4").astype(np.uint32)
        bits = np.packbits(((sig[:, :, None] >> np.array([1, 0], np.uint32)) & 1).astype(np.uint8).reshape(len(sig), -1), axis=1)
        keys = sig.astype(">u4").reshape(len(sig), TREES, DEPTH)
        sketch = pa.Array.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(np.ascontiguousarray(bits).tobytes())]).cast(pa.binary())
        for t in range(TREES):
            key = pa.Array.from_buffers(pa.binary(4 * DEPTH), len(sig), [None, pa.py_buffer(np.ascontiguousarray(keys[:, t]).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), key, b.column(0), sketch], names=["tree", "key", "node", "sketch"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of two-bit sketches given as rows of 64-bit words."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
    return 1 - differ / _ROWS * (4 / 3)


class _Regions:
    """Crowded regions of a stream sorted by (tree, key), as buckets of documents with a near sketch among them."""

    def __init__(self, least: float):
        self.least, self.held = least, []

    def feed(self, tree: np.ndarray, key: np.ndarray, node: np.ndarray, sketch: np.ndarray):
        """(bucket, node, sketch) arrays of the regions that have ended."""
        deep = tree < DEEP
        if not deep.all():
            tree, key, node, sketch = tree[deep], key[deep], node[deep], sketch[deep]
        if not len(tree):
            yield from self.end()
            return
        region = tree.astype(np.int64) << 32 | key[:, 0].astype(np.int64)
        tail = int(np.searchsorted(region, region[-1]))
        if self.held and (tail or self.held[-1][0][-1] != region[0]):
            self.held.append((region[:tail], key[:tail], node[:tail], sketch[:tail]))
            yield from self.end()
        elif tail:
            self.held.append((region[:tail], key[:tail], node[:tail], sketch[:tail]))
            yield from self.end()
        self.held.append((region[tail:], key[tail:], node[tail:], sketch[tail:]))
        size = sum(len(h[0]) for h in self.held)
        if size > 16 * BUCKET:  # a very large region goes deeper anyway; what follows its last change of key waits
            whole = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            for depth in range(1, DEPTH):
                cut = np.flatnonzero((whole[1][1:, : depth + 1] != whole[1][:-1, : depth + 1]).any(axis=1))
                if len(cut):
                    cut = int(cut[-1]) + 1
                    self.held = [[x[cut:] for x in whole]]
                    yield from self._buckets(*(x[:cut] for x in whole), 1)
                    return
            yield _bucket_name(whole[0], whole[1], DEPTH), whole[2], whole[3]
            self.held = []

    def end(self):
        if self.held:
            whole = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held = []
            cut = np.flatnonzero(np.r_[True, whole[0][1:] != whole[0][:-1], True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > NEIGHBOURS + 1:
                    yield from self._buckets(*(x[s:e] for x in whole), 1)

    def _buckets(self, region, key, node, sketch, depth):
        if len(node) <= NEIGHBOURS + 1:  # all its pairs are neighbours
            return
        if len(node) > BUCKET and depth < DEPTH:
            cut = np.flatnonzero(np.r_[True, key[1:, depth] != key[:-1, depth], True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                yield from self._buckets(region[s:e], key[s:e], node[s:e], sketch[s:e], depth + 1)
            return
        near = np.ones(len(node), bool) if len(node) > BUCKET else _near_other(sketch, np.arange(len(node)), self.least)
        if near.any():
            yield _bucket_name(region[near], key[near], depth), node[near], sketch[near]


def _bucket_name(region: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        name = tx.mix(region.astype(np.uint64) + np.uint64(depth))
        for k in range(1, depth):
            name = tx.mix(name * tx._MIXERS[k] + key[:, k].astype(np.uint64))
    return name.view(np.int64)


def _near_other(sketch: np.ndarray, part: np.ndarray, least: float) -> np.ndarray:
    """Which rows have a sketch that is near one of another part."""
    out = np.zeros(len(sketch), bool)
    most = (1 - least) * _ROWS * 3 / 4
    step = max(1, (1 << 20) // max(1, len(sketch)))
    for i in range(0, len(sketch), step):
        differ = np.zeros((min(step, len(sketch) - i), len(sketch)), np.int64)
        for k in range(sketch.shape[1]):
            x = sketch[i : i + step, k, None] ^ sketch[None, :, k]
            differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        out[i : i + step] = ((differ <= most) & (part[i : i + step, None] != part[None])).any(axis=1)
    return out


def _scan(least: float):
    """Candidates in one sorted part: pairs (a, b, score), centres of crowded regions (region, a, sketch, size), and the
    members of buckets (region, a, sketch, size null)."""

    def run(batches):
        carry, regions = None, _Regions(least)

        def members(found):
            for bucket, node, sketch in found:
                raw = np.ascontiguousarray(sketch)
                packed = pa.Array.from_buffers(pa.binary(_ROWS // 4), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                none = pa.nulls(len(node), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node), none, pa.nulls(len(node), pa.float32()), pa.array(bucket), packed, none], names=["a", "b", "score", "region", "sketch", "size"])

        for b in batches:
            if not b.num_rows:
                continue
            tree, node = b.column(0).to_numpy(), b.column(2).to_numpy()
            key, sketch = _matrix(b.column(1), 4 * DEPTH), _matrix(b.column(3), _ROWS // 4).view(np.uint64)
            values = np.ascontiguousarray(key).view(">u4").astype(np.uint32)
            yield from members(regions.feed(tree, values, node, sketch))
            h1 = values[:, 0].astype(np.int64)
            region = tree.astype(np.int64) << 32 | h1
            old = 0
            if carry is not None:
                old = len(carry[0])
                region, node, sketch = np.concatenate([carry[0], region]), np.concatenate([carry[1], node]), np.concatenate([carry[2], sketch])
            pairs = []

            def add(i, j, region=region, node=node, sketch=sketch, pairs=pairs):
                if len(i):
                    s = _similarity(sketch[i], sketch[j])
                    ok = (s >= least) & (node[i] != node[j])
                    pairs.append((node[i][ok], node[j][ok], s[ok]))

            for off in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero(region[:-off] == region[off:])
                add(i[i + off >= old], i[i + off >= old] + off)
            cut = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            hubs = []
            for s, e in zip(cut, np.r_[cut[1:], len(region)], strict=True):
                if e - s > NEIGHBOURS + 1 and e > old:
                    bits = np.unpackbits(sketch[s:e].view(np.uint8).reshape(e - s, -1), axis=1)
                    agree = (bits == (2 * bits.sum(axis=0, dtype=np.int64) >= e - s)).sum(axis=1)
                    hub = s + int(agree.argmax())
                    add(np.full(e - s, hub), np.arange(s, e))
                    hubs.append((int(region[s]), int(node[hub]), sketch[hub].tobytes(), int(e - s)))
            carry = region[-NEIGHBOURS:], node[-NEIGHBOURS:], sketch[-NEIGHBOURS:]
            if pairs:
                a, c, s = (np.concatenate(x) for x in zip(*pairs, strict=True))
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c)), pa.array(s.astype(np.float32)), none, pa.nulls(len(a), pa.binary()), none], names=["a", "b", "score", "region", "sketch", "size"])
            if hubs:
                r, n, k, z = zip(*hubs, strict=True)
                none = pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), none, pa.nulls(len(r), pa.float32()), pa.array(r, pa.int64()), pa.array(k, pa.binary()), pa.array(z, pa.int64())], names=["a", "b", "score", "region", "sketch", "size"])
        yield from members(regions.end())

    return run


#: Centres of one region kept for the exchange between the parts that a crowded region is spread over.
CENTRES = 3


def least_score(threshold: float) -> float:
    match = threshold + (1 - threshold) / 4
    return threshold - SIGMAS * (match * (1 - match) / _ROWS) ** 0.5 * (4 / 3)


def candidates(sigs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b, score) of nodes with signatures, from every tree, and the members (bucket, node, sketch) of crowded buckets."""
    least = least_score(threshold)
    spark = sigs.sparkSession
    forest = sigs.select("node", "sig").mapInArrow(trimmed(_trees), "tree int, key binary, node long, sketch binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(forest.repartitionByRange(parts, "tree", "key").sortWithinPartitions("tree", "key").mapInArrow(trimmed(_scan(least)), "a long, b long, score float, region long, sketch binary, size long"))
    pairs = found.where("region is null").select("a", "b", "score")
    members_of = found.where("region is not null and size is null").select(F.col("region").alias("bucket"), F.col("a").alias("node"), "sketch")
    centres = found.where("size is not null").groupBy("region", "a").agg(F.max("size").alias("size"), F.first("sketch").alias("sketch"))
    several = centres.groupBy("region").agg(F.slice(F.sort_array(F.collect_list(F.struct("size", "a", "sketch")), asc=False), 1, CENTRES).alias("c"), F.count("*").alias("n")).where("n > 1")
    several = written(several.select("region", F.explode("c").alias("c")).select("region", F.col("c.a").alias("centre"), F.col("c.sketch").alias("other")))
    if not several.isEmpty():
        members = forest.select((F.col("tree").cast("long") * (1 << 32) + F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")).alias("region"), "node", "sketch").join(several, "region").where("node <> centre")
        # written first, so that no stage runs two Python workers for one task
        pairs = pairs.unionByName(written(members).mapInArrow(trimmed(_closer(least)), "a long, b long, score float"))
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score")), members_of


def _closer(least: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = _similarity(_matrix(b.column(2), _ROWS // 4).view(np.uint64), _matrix(b.column(4), _ROWS // 4).view(np.uint64))
            x, y = b.column(1).to_numpy()[s >= least], b.column(3).to_numpy()[s >= least]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(s[s >= least].astype(np.float32))], names=["a", "b", "score"])

    return run


def _sets(size: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                sets = list(shingle_sets(b.column(1), size))
                keys = [_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "k1", "k2", "set"])

    return run


def _confirm(numerator: int, denominator: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                keep.append(_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), numerator, denominator))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(least: float):
    """Streams (bucket, node, part, sketch) sorted by bucket and returns the rows near one of another part."""

    def run(batches):
        for bucket, node, part, sketch in groups(batches):
            keep = np.zeros(len(node), bool)
            words = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(node), -1)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 1 and (part[s:e] != part[s]).any():
                    keep[s:e] = _near_other(words[s:e], part[s:e], least)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, node, part)], names=["bucket", "node", "part"])

    return run


def _joined(numerator: int, denominator: int):
    """Streams (bucket, node, part, set) sorted by bucket; one link for each union of two parts of a bucket."""

    def run(batches):
        for bucket, node, part, raw in groups(batches):
            links = ([], [])
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                order = s + np.argsort(node[s:e], kind="stable")
                own, sets = part[order].copy(), [np.frombuffer(raw[k], np.uint64) for k in order]
                size = np.array([len(x) for x in sets], np.int64)
                for i in range(1, e - s):
                    fits = np.flatnonzero((own[:i] != own[i]) & (denominator * np.minimum(size[:i], size[i]) >= numerator * np.maximum(size[:i], size[i])))
                    for j in fits.tolist():
                        if own[j] != own[i] and _alike(sets[j], sets[i], numerator, denominator):
                            links[0].append(node[order[j]])
                            links[1].append(node[order[i]])
                            own[own == own[j]] = own[i]
            if links[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in links], names=["a", "b"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return denominator * common >= numerator * (len(x) + len(y) - common)


#: A table of ids of at most this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _left(crowded: DataFrame, labels: DataFrame, sets_of, numerator: int, denominator: int) -> DataFrame | None:
    """Links between different components inside crowded buckets, or None if no bucket has two with near sketches."""
    parts = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.coalesce("component", "node").alias("part")
    rows = crowded.join(labels, "node", "left").select("bucket", "node", part, "sketch")
    several = rows.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    rows = written(rows.join(several, "bucket", "left_semi"))
    rows = chunked(rows, "bucket", "node", 2 * BUCKET)
    near = written(rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_apart(least_score(numerator / denominator))), "bucket long, node long, part long"))
    if near.isEmpty():
        return None
    sets = sets_of(written(near.select("node").distinct()))
    whole = chunked(near, "bucket", "node", GROUP).join(sets, "node").select("bucket", "node", "part", "set")
    return written(whole.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_joined(numerator, denominator)), "a long, b long").distinct())


def first_of_group(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` but for those of other documents than the first of their group; a row goes by its id and text together."""
    gone_id, gone_text = fresh(docs, "gone_id", "gone_text")
    gone = near_duplicates(docs, shingle, threshold).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_text)).distinct()
    gone = written(gone)
    return docs.join(_small(gone), (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_text)), "left_anti")


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, kept) for every row of ``docs`` (doc_id, text); text_key is the row's text hash.

    Two documents are linked where denominator * |A and B| >= numerator * |A or B|; components are those of the links.
    """
    lean(docs.sparkSession)
    numerator, denominator = threshold
    sketched = written(signatures(docs, shingle))
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    # the other members of the classes are fewer and narrow; signatures and texts stay where they are while these are few
    keys = ["k1", "k2"]
    copies = written(looked_up(sketched.select("doc_id", *keys), classes.where("n > 1").drop("n"), keys, "doc_id", most=BROADCAST_ROWS).where("doc_id <> node").select("doc_id", *keys))
    heads = sketched.where("sig is not null and doc_id is not null").join(_small(copies), ["doc_id", "k1", "k2"], "left_anti").select(F.col("doc_id").alias("node"), "k1", "k2", "sig")
    pairs, crowded = candidates(heads, numerator / denominator)
    pairs, crowded = written(pairs), written(crowded)
    own = heads.select("node", "k1", "k2").distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(_small(nodes), "node", "left_semi")
        keyed = texts.mapInArrow(trimmed(_sets(shingle)), "node long, k1 long, k2 long, set binary")
        # a doc_id that stands on several rows is the node of one of its sets only
        return written(keyed.join(own, ["node", "k1", "k2"], "left_semi").select("node", "set").dropDuplicates(["node"]))

    sets = sets_of(written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))

    def confirmed(some: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        return some.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(trimmed(_confirm(numerator, denominator)), "a long, b long")

    best = pairs.select("score", F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q")))).alias("e")).groupBy("e.p").agg(F.max(F.struct("score", "e.q")).alias("m"))
    first = best.select(F.least("p", "m.q").alias("a"), F.greatest("p", "m.q").alias("b")).distinct()
    links = written(confirmed(first))
    labels = written(components(links))
    named = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
    links = written(links.unionByName(confirmed(rest)))
    labels = written(components(links))
    forget(sets)
    forget(pairs)
    more = _left(crowded, labels, sets_of, numerator, denominator)
    forget(crowded)
    if more is not None:
        labels = written(components(links.unionByName(more)))
    # a document alone in its class and without links is its own component
    parts = classes.join(labels, "node", "left").where("n > 1 or component is not null").select(*keys, F.coalesce("component", "node").alias("c"))
    out = looked_up(sketched.select("doc_id", "n_shingles", *keys, "text_key"), parts, keys, "doc_id", "left", BROADCAST_ROWS)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
