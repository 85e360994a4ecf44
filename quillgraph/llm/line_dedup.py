"""Line deduplication by a segment-partition edit join.

Two lines are linked if their edit distance is at most ``EDITS``. A line is cut into EDITS + 1 segments; within that
distance one segment stays whole, so it stands in the other line near its place. Each distinct line indexes its segments
by its length, and probes those of lines as long or up to EDITS shorter at the few places where a whole segment can lie.
Rows that meet under a key stay if a 64-bit parity sketch of their characters lies close to another's (an edit flips two
bits at most). A key with more than ``CROWD`` rows is split losslessly first: sketches within 2 * EDITS bits agree in one
of 2 * EDITS + 1 parts, so its rows meet by key and part instead.

The lines themselves are then joined to the rows that stay, and each group is united: two lines are compared, by banded
bit-parallel edit distance, only if they aren't yet in one part and a second sketch, of pairs of characters, is close too;
each union is one link. So a group of n near copies gives n - 1 links and not n * n pairs, and no link between two parts
is lost. Groups of more than ``GROUP`` lines are dealt into chunks, and every two chunks are united on their own.

Links make classes; the first line of each class (by doc_id and line number) stays and later ones go. Equal lines are one
class from the start and blank lines always stay. Lines under ``LEAST`` characters are only compared for equality, at any
size of the table: two edits are a large part of so short a line ("Part 1", "Part 2"), so they don't make it a copy.

A line is named by a 64-bit polynomial hash, its sketch and its length together.

Defined cases: a null text has no lines; rows without doc_id come before all others; rows with equal doc_id count as one
document; repeated rows are each returned; extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import chunked, components, fresh, groups, looked_up, written
from quillgraph.llm.repeats import _located, _rows

EDITS = 2
LEAST = 24
CROWD = 64
GROUP = 20_000
#: Lines that stand more than once or are linked: at most so many are broadcast, more are spread by their documents.
BROADCAST_ROWS = 500_000
#: Pairs of sketches that are compared at once.
_BLOCK = 1 << 22
#: 64-bit words of the sketch of pairs of characters.
_WORDS = 4


def _lines(texts: pa.Array):
    """(first, last, prefix hash, code points, start, end, text of the piece, line number) of the lines with a character that is no space."""
    for first, last, data, offsets in tx.pieces(texts):
        if not len(data):
            continue
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        edge = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(tx.mix(points.astype(np.uint64) + np.uint64(1)) * tx.powers(len(points) + 1)[: len(points)], out=prefix[1:])
        breaks = np.flatnonzero(points == 10)
        start = np.sort(np.concatenate([breaks + 1, edge[:-1]]), kind="stable")
        end = np.sort(np.concatenate([breaks, edge[1:]]), kind="stable")
        owner = np.searchsorted(edge, end, side="left") - 1
        solid = np.r_[0, np.cumsum((points > 32))]
        full = np.flatnonzero(solid[end] > solid[start])
        start, end, owner = start[full], end[full], owner[full]
        number = np.searchsorted(breaks, start) - np.searchsorted(breaks, edge[:-1])[owner]
        yield first, last, prefix, points, start, end, owner, number


def _parity(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the number of characters hashed to b in each line."""
    bit = np.left_shift(np.uint64(1), tx.mix(points.astype(np.uint64)) & np.uint64(63))
    run = np.r_[np.uint64(0), np.bitwise_xor.accumulate(bit)]
    return run[end] ^ run[start]


def _pair_parity(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same for pairs of neighbouring characters, in ``_WORDS`` words; an edit changes four bits at most."""
    h = tx.mix(points[:-1].astype(np.uint64) << np.uint64(32) | points[1:].astype(np.uint64))
    out = np.zeros((len(start), _WORDS), np.uint64)
    stop = np.maximum(end - 1, start)
    for k in range(_WORDS):
        bit = np.where((h >> np.uint64(6)) % np.uint64(_WORDS) == k, np.left_shift(np.uint64(1), h & np.uint64(63)), np.uint64(0))
        run = np.r_[np.uint64(0), np.bitwise_xor.accumulate(bit)]
        out[:, k] = run[stop] ^ run[start]
    return out


def _occurrences(batches):
    with np.errstate(over="ignore"):
        for b in batches:
            docs = b.column(0).to_numpy()
            for first, last, prefix, points, start, end, owner, number in _lines(b.column(1)):
                h = tx.span_hash(prefix, start, end)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs[first:last][owner]), pa.array(number.astype(np.int64)), pa.array((end - start).astype(np.int64)), pa.array(_parity(points, start, end).view(np.int64))], names=["line", "doc", "number", "size", "sketch"])


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of each length; the last ones are one longer where it doesn't divide."""
    base, longer = length // (edits + 1), length % (edits + 1)
    plain = edits + 1 - longer
    return i * base + np.maximum(0, i - plain), base + (i >= plain)


def _keys(edits: int, least: int):
    """The keys of the distinct lines of each piece: their own (side 0) and those they probe (side 1)."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                parts = []
                for _, _, prefix, points, start, end, _, _ in _lines(b.column(1)):
                    line = tx.span_hash(prefix, start, end)
                    _, once = np.unique(line, return_index=True)
                    once = once[(end - start)[once] >= least]
                    start, end, line = start[once], end[once], line[once]
                    size, sketch = end - start, _parity(points, start, end)

                    def add(side, length, i, at, width, chosen, prefix=prefix, line=line, sketch=sketch):
                        key = tx.mix(tx.span_hash(prefix, at, at + width) + length.astype(np.uint64) * tx._MIXERS[3] + np.uint64(i) * tx._MIXERS[4])
                        parts.append((key, np.full(len(key), side, np.int8), line[chosen], sketch[chosen]))

                    for i in range(edits + 1):
                        own, width = _segment(size, i, edits)
                        add(0, size, i, start + own, width, slice(None))
                        for less in range(edits + 1):
                            length = size - less
                            p, width = _segment(length, i, edits)
                            lo = np.maximum(np.maximum(p - i, p + less - (edits - i)), 0)
                            hi = np.minimum(np.minimum(p + i, p + less + (edits - i)), size - width)
                            for step in range(2 * edits + 1):
                                # at its own place a line meets those of its length by its own key
                                on = np.flatnonzero((lo + step <= hi) & (length >= least) & ((less > 0) | (lo + step != own)))
                                if len(on):
                                    add(1, length[on], i, start[on] + lo[on] + step, width[on], on)
                if parts:
                    key, side, line, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(side), pa.array(line.view(np.int64)), pa.array(sketch.view(np.int64))], names=["key", "side", "line", "sketch"])

    return run


def _met(edits: int):
    """Streams rows sorted by key and returns those whose sketch is close to another line's under the key (crowd false), and
    all rows of crowds."""

    def run(batches):
        for key, side, line, sketch in groups(batches):
            many = np.ones(len(key), bool)  # keys that stand alone meet nothing
            many[1:-1] = (key[1:-1] == key[:-2]) | (key[1:-1] == key[2:])
            if len(key) > 1:
                many[0], many[-1] = key[0] == key[1], key[-1] == key[-2]
            else:
                many[0] = False
            key, side, line, sketch = (x[many] for x in (key, side, line, sketch))
            if not len(key):
                continue
            order = np.lexsort((side, line, key))
            key, side, line, sketch = (x[order] for x in (key, side, line, sketch))
            new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]  # a line once under a key, as side 0 if it is
            key, side, line, sketch = (x[new] for x in (key, side, line, sketch))
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            size = np.bincount(group)[group]
            crowd = size > CROWD
            close = np.zeros(len(key), bool)
            rows = np.flatnonzero(~crowd & (size > 1))
            off = 1
            while len(rows):
                rows = rows[rows + off < len(key)]
                rows = rows[group[rows] == group[rows + off]]
                near = rows[(np.bitwise_count((sketch[rows] ^ sketch[rows + off]).view(np.uint64)) <= 2 * edits) & (side[rows] & side[rows + off] == 0)]
                close[near] = close[near + off] = True
                off += 1
            keep = close | crowd
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, side, line, sketch, crowd)], names=["key", "side", "line", "sketch", "crowd"])

    return run


def _close(edits: int):
    """Streams rows sorted by group (key and part of a crowd) and returns those whose sketch is close to another's."""

    def run(batches):
        for group, side, line, sketch in groups(batches):
            keep = np.zeros(len(group), bool)
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2:
                    continue
                sk, sd, ln = sketch[s:e].view(np.uint64), side[s:e], line[s:e]
                step = max(1, _BLOCK // (e - s))
                for i in range(0, e - s, step):
                    near = np.bitwise_count(sk[i : i + step, None] ^ sk[None]) <= 2 * edits
                    near &= (sd[i : i + step, None] & sd[None]) == 0
                    near &= ln[i : i + step, None] != ln[None]
                    keep[s + i : s + i + len(near)] |= near.any(axis=1)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(group[keep]), pa.array(line[keep]), pa.array(sketch[keep])], names=["key", "line", "sketch"])

    return run


def _united(edits: int):
    """Streams rows sorted by group and returns one link for each union of two parts of a group."""

    def run(batches):
        for group, line, sketch, said, pairs in groups(batches):
            links = ([], [])
            order = np.lexsort((line, group))
            group, line, sketch, said, pairs = (x[order] for x in (group, line, sketch, said, pairs))
            new = np.r_[True, (group[1:] != group[:-1]) | (line[1:] != line[:-1])]
            group, line, sketch, said, pairs = (x[new] for x in (group, line, sketch.view(np.uint64), said, pairs))
            pairs = np.frombuffer(b"".join(pairs), np.uint64).reshape(-1, _WORDS)
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                part = np.arange(s, e)
                for i in range(1, e - s):
                    near = np.zeros(i, bool)
                    some = np.flatnonzero((np.bitwise_count(sketch[s : s + i] ^ sketch[s + i]) <= 2 * edits) & (part[:i] != part[i]))
                    near[some] = np.bitwise_count(pairs[s + some] ^ pairs[s + i]).sum(axis=1) <= 4 * edits
                    while len(rest := np.flatnonzero(near & (part[:i] != part[i]))):
                        found = next((j for j in rest.tolist() if edit_distance(said[s + j], said[s + i], edits) <= edits), None)
                        if found is None:
                            break
                        near[: found + 1] &= part[: found + 1] == part[found]  # what stands before it was compared
                        links[0].append(line[s + found])
                        links[1].append(line[s + i])
                        part[part == part[found]] = part[i]
            if links[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in links], names=["a", "b"])

    return run


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of two strings, or limit + 1 if it is more.

    Bit vectors hold the vertical differences of the 2 * limit + 1 cells about the diagonal in one column; each
    character of ``b`` updates all of them at once and moves the band down by one cell.
    """
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < len(a) and k < len(b) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    m = len(a)
    if abs(m - len(b)) > limit:
        return limit + 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + limit)
    width = 2 * limit + 1
    band = (1 << width) - 1
    plus, minus, score = band & ~((1 << limit) - 1), 0, min(limit, m)
    for j, c in enumerate(b, 1):
        match = places.get(c, 0) >> (j - 1) & band
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & band
        right_plus, right_minus = (minus | ~(diagonal | plus)) & band, diagonal & plus
        if j + limit <= m:
            score += not diagonal >> (width - 1) & 1
        else:
            r = m - j + limit
            score += (right_plus >> r & 1) - (right_minus >> r & 1)
        below = diagonal >> 1
        plus, minus = (right_minus | ~(below | right_plus)) & band, below & right_plus
    return min(score, limit + 1)


def _texts(batches):
    with np.errstate(over="ignore"):
        for b in batches:
            wanted = b.column(2).to_pylist()
            for first, _, prefix, points, start, end, owner, number in _lines(b.column(1)):
                line, pairs = tx.span_hash(prefix, start, end), _pair_parity(points, start, end)
                sets = {}
                keep = [k for k, (o, n) in enumerate(zip(owner.tolist(), number.tolist(), strict=True)) if n in sets.setdefault(o, set(wanted[first + o]))]
                yield pa.RecordBatch.from_arrays([pa.array(line[keep].view(np.int64)), pa.array([points[start[k] : end[k]].tobytes().decode("utf-32-le") for k in keep], pa.string()), pa.array([x.tobytes() for x in pairs[keep]], pa.binary())], names=["line", "said", "pairs"])


def links(rows: DataFrame, firsts: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """Links (a, b) of distinct lines within ``edits`` of each other that join the same parts as all such pairs do.

    ``firsts``: (line, doc, number) of the first place of each line.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.mapInArrow(_keys(edits, least), "key long, side byte, line long, sketch long")
    met = written(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_met(edits), "key long, side byte, line long, sketch long, crowd boolean"))
    close = met.where("not crowd").select("key", "line", "sketch")
    crowd = met.where("crowd")
    if not crowd.isEmpty():
        cut = 2 * edits + 1
        bits = -(-64 // cut)
        part = F.posexplode(F.array(*[F.shiftrightunsigned("sketch", k * bits).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(cut)]))
        split = crowd.select("key", "side", "line", "sketch", part.alias("part", "value")).select(F.xxhash64("key", "part", "value").alias("key"), "side", "line", "sketch")
        close = close.unionByName(split.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_close(edits), "key long, line long, sketch long"))
    close = written(close)
    close = chunked(close, "key", "line", GROUP)
    used = close.select("line").distinct()
    places = firsts.join(used, "line", "left_semi").select("doc", "number", F.col("number").alias("n"))
    said = written(_located(rows, places).mapInArrow(_texts, "line long, said string, pairs binary").dropDuplicates(["line"]))
    texts = close.join(said, "line").select("key", "line", "sketch", "said", "pairs")
    return written(texts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_united(edits), "a long, b long").distinct())


def duplicate_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row: lines that are not blank, and the sorted numbers (from 0) of those that go."""
    rows = _rows(docs)
    name = ["line", "sketch", "size"]
    occurrences = written(rows.mapInArrow(_occurrences, "line long, doc long, number long, size long, sketch long"))
    firsts = written(occurrences.groupBy(*name).agg(F.min(F.struct("doc", "number")).alias("f"), F.count("*").alias("n")).select(*name, "f.doc", "f.number", "n"))
    classes = components(links(rows, firsts, edits, least)).withColumnRenamed("node", "line")
    united = firsts.join(classes, "line").select(*name, "component", F.struct("doc", "number").alias("f"))
    # only lines with links need their class's first place; all others keep their own
    heads = united.groupBy("component").agg(F.min("f").alias("head"))
    moved = united.join(heads, "component").select(*name, "head")
    # a line that stands once and isn't linked stays, so it needs no look-up
    stay = firsts.join(moved, name, "left").where("n > 1 or head is not null").select(*name, F.coalesce("head", F.struct("doc", "number")).alias("head"))
    judged = looked_up(occurrences, stay, name, "doc", "left", BROADCAST_ROWS)
    judged = judged.withColumn("gone", F.coalesce((F.col("head.doc") != F.col("doc")) | (F.col("head.number") != F.col("number")), F.lit(False)))
    per = judged.select("doc", "number", "gone").distinct().groupBy("doc").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("number")))).alias("removed"))
    ids = rows.select("doc")
    out = ids.join(per, "doc", "left")
    removed = F.coalesce("removed", F.array().cast("array<long>"))
    return out.select(F.when(F.col("doc") >= -(1 << 62), F.col("doc")).alias("doc_id"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; ``found`` comes from ``duplicate_lines``."""
    owner, gone = fresh(docs, "owner", "gone")
    table = found.select(F.col("doc_id").alias(owner), F.col("removed").alias(gone)).dropDuplicates([owner])
    lines = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains(gone, k.cast("long")))
    joined = docs.join(table, F.col("doc_id").cast("long") == F.col(owner), "left")
    return joined.withColumn("text", F.when(F.size(gone) > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))).drop(owner, gone)
