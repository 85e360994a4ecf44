"""Removal of repeated byte strings, exact at every byte.

A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id, or earlier in the same
text. The strings are found through a cover of sampled positions, as in difference-cover suffix sorting, but the sample
is chosen by content: each string's anchor is its least-hashed ``SAMPLE``-byte substring, so equal strings have equal
anchors at equal offsets, and one position in about 35 is sampled instead of the two in three of a period-three cover.
The steps:

1. whole texts that repeat are classes; only the first of each goes on;
2. anchors with their cells (all strings of one anchor, one after another) are sorted by anchor and cell; a cell that
   stands earlier too goes whole; anchors that stand once are dropped;
3. where one anchor has several cells (the ends of repeated passages), the first of each cell is cut into runs of
   ``STRIDE`` strings; of runs whose common bytes stand twice, all strings are named, sorted, and compared with their
   neighbours;
4. the removed strings of each text are united.

All groups are read as sorted streams, so a passage in a third of all texts needs no more memory than another, and rows
are linear in the input. Strings are named by two independent 64-bit hashes, cells by those of the cell and of its anchor.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows without doc_id come before all
others (in the order of a hash of their texts); rows with equal doc_id and text have equal results, rows with equal doc_id and other texts count as one
document; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import looked_up, written

SAMPLE = 32
STRIDE = 8
#: Tables of at most this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_LOW = np.uint64(0xFFFFFFFF)
_NONE = -(1 << 63)


def _identities(batches):
    for b in batches:
        n, k1, k2, whole = [], [], [], []
        for t in b.column(1).to_pylist():
            raw = (t or "").encode()
            d = hashlib.sha256(raw)
            x = d.digest()
            n.append(len(raw))
            k1.append(int.from_bytes(x[:8], "little", signed=True))
            k2.append(int.from_bytes(x[8:16], "little", signed=True))
            whole.append(d.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(whole, pa.string())], names=["doc", "n_bytes", "k1", "k2", "whole"])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(block, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def anchors(prefix: np.ndarray, offsets: np.ndarray, length: int):
    """(text, anchor, first start, last start, anchor's hash) of each cell; positions are those of the buffer."""
    n = len(prefix) - 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = np.arange(n - SAMPLE + 1)
    hashes = tx.span_hash(prefix, at, at + SAMPLE)
    best = (_least((hashes & ~_LOW) | at.astype(np.uint64), length - SAMPLE + 1) & _LOW).astype(np.int64)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    start = tx.positions(offsets[:-1], count)
    text = np.repeat(np.arange(len(count)), count)
    best = best[start]
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (text[1:] != text[:-1])]) if len(best) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(best)] - 1 if len(best) else new
    return text[new], best[new], start[new], start[last], hashes[best[new]]


def _cells(length: int):
    """All cells of a batch; those with an equal earlier one in the batch are ``later`` and go anywhere, so no anchor is crowded."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                docs, parts = b.column(0).to_numpy(), []
                for first, last, data, offsets in tx.pieces(b.column(1)):
                    prefix = tx.prefix_hash(data)
                    text, at, lo, hi, h = anchors(prefix, offsets, length)
                    if len(at):
                        before, after = at - lo, at - hi
                        cell = tx.mix(tx.span_hash(prefix, lo, hi + length) + (before << 16 | after).astype(np.uint64) * tx._MIXERS[7])
                        parts.append((h.view(np.int64), cell.view(np.int64), docs[first:last][text], (at - offsets[text]).astype(np.int64), (before << 16 | after).astype(np.int32)))
                if parts:
                    h, cell, doc, at, reach = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.lexsort((at, doc, cell))
                    equal = np.r_[False, (cell[order][1:] == cell[order][:-1]) & (h[order][1:] == h[order][:-1])]
                    again = equal & np.r_[False, (doc[order][1:] == doc[order][:-1]) & (at[order][1:] == at[order][:-1])]
                    later = np.zeros(len(h), bool)
                    later[order[equal]] = True
                    h = np.where(later, tx.mix((doc * 31 + at).view(np.uint64)).view(np.int64), h)
                    rows = np.ones(len(h), bool)
                    rows[order[again]] = False  # repeated rows of one document
                    yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (h, cell, doc, at, reach, later)], names=["h", "cell", "doc", "at", "reach", "later"])

    return run


def _sorted_cells(batches):
    """Streams rows sorted by (h, cell, doc, at); kind 0: stands earlier too, 1: one of several cells, 2: the only cell."""
    state = seen = None  # [h, cell, pending row or None, more rows?]; the last row

    def out(kind, doc, at, reach):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(at), pa.array(reach)], names=["kind", "doc", "at", "reach"])

    for b in batches:
        if not b.num_rows:
            continue
        h, c, doc, at, reach, later = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        if later.any():
            yield out(0, doc[later], at[later], reach[later])
            h, c, doc, at, reach = (x[~later] for x in (h, c, doc, at, reach))
            if not len(h):
                continue
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        again[0] = (h[0], c[0], doc[0], at[0]) == seen
        seen = h[-1], c[-1], doc[-1], at[-1]
        if again.any():  # repeated rows of one document
            h, c, doc, at, reach = (x[~again] for x in (h, c, doc, at, reach))
            if not len(h):
                continue
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        if state is not None and state[0] == h[0]:
            new_h[0], new_c[0] = False, c[0] != state[1]
        group = np.cumsum(new_h)  # 0: the group that the last batch ended in
        last = int(group[-1])
        rows = np.bincount(group, minlength=last + 1)
        side = new_c & ~new_h
        several = np.bincount(group[side], minlength=last + 1) > 0
        keep = [(0, ~new_c), (1, side)]
        if state is not None:
            if state[2] is not None and several[0]:
                yield out(1, *([x] for x in state[2]))
                state[2] = None
            elif state[2] is not None:
                state[3] = state[3] or rows[0] > 0
                if last:
                    if state[3]:
                        yield out(2, *([x] for x in state[2]))
                    state[2] = None
        heads = np.flatnonzero(new_h)
        if len(heads):
            ended = heads[:-1]
            one, two = np.zeros(len(h), bool), np.zeros(len(h), bool)
            one[ended] = several[group[ended]]
            two[ended] = ~several[group[ended]] & (rows[group[ended]] > 1)
            end = heads[-1]
            one[end] = several[last]
            state = [h[-1], c[-1], None if several[last] else (doc[end], at[end], reach[end]), bool(rows[last] > 1)]
            keep += [(1, one), (2, two)]
        else:
            state[0], state[1] = h[-1], c[-1]
        for kind, mask in keep:
            if mask.any():
                yield out(kind, doc[mask], at[mask], reach[mask])
    if state is not None and state[2] is not None and state[3]:
        yield out(2, *([x] for x in state[2]))


def _cores(length: int):
    """The core of every ``STRIDE`` consecutive offsets of a cell: the bytes that all their strings have in common."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                docs, lists = b.column(0).to_numpy(), [b.column(k).to_pylist() for k in (2, 3)]
                for first, last, data, offsets in tx.pieces(b.column(1)):
                    prefix = tx.prefix_hash(data)
                    size = [len(lists[0][first + k]) for k in range(last - first)]
                    text = np.repeat(np.arange(last - first), size)
                    at = np.concatenate([np.asarray(x, np.int64) for x in lists[0][first:last]]) + offsets[text]
                    reach = np.concatenate([np.asarray(x, np.int64) for x in lists[1][first:last]])
                    far, near = reach >> 16, reach & 0xFFFF
                    many = far // STRIDE - near // STRIDE + 1
                    of = np.repeat(np.arange(len(at)), many)
                    j = tx.positions(near // STRIDE, many)
                    start = at[of] - j * STRIDE
                    key = tx.mix(tx.span_hash(prefix, start, start + length - STRIDE + 1) + j.astype(np.uint64) * tx._MIXERS[9])
                    shift = offsets[text[of]]
                    s0, s1 = at[of] - np.minimum(far[of], j * STRIDE + STRIDE - 1) - shift, at[of] - np.maximum(near[of], j * STRIDE) - shift
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs[first:last][text[of]]), pa.array(s0), pa.array(s1.astype(np.int64))], names=["key", "doc", "s0", "s1"])

    return run


def _shared(batches):
    """Streams rows sorted by key and returns those whose key has another row."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy()
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[1:] | same[:-1]
        fresh = 0 if held is None else 1
        # the row held back was judged by its predecessor; its successor decides the rest
        keep[0] |= fresh and held_kept
        held, held_kept = b.slice(len(key) - 1), bool(keep[-1])
        out = b.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        yield out.select([1, 2, 3])
    if held is not None and held_kept:
        yield held.select([1, 2, 3])


def _strings(length: int):
    """Names, of two hashes, of the strings that start in the given ranges."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                docs, lists = b.column(0).to_numpy(), [b.column(k).to_pylist() for k in (2, 3)]
                for first, last, data, offsets in tx.pieces(b.column(1)):
                    prefix, other = tx.prefix_hash(data), tx.prefix_hash(data, tx.OTHER)
                    text = np.repeat(np.arange(last - first), [len(lists[0][first + k]) for k in range(last - first)])
                    s0, s1 = (np.concatenate([np.asarray(x, np.int64) for x in part[first:last]]) + offsets[text] for part in lists)
                    s = tx.positions(s0, s1 - s0 + 1)
                    of = np.repeat(text, s1 - s0 + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(tx.span_hash(prefix, s, s + length).view(np.int64)), pa.array(tx.span_hash(other, s, s + length, tx.OTHER_INV).view(np.int64)), pa.array(docs[first:last][of]), pa.array(s - offsets[of])], names=["g", "g2", "doc", "s"])

    return run


def _later(length: int):
    """Streams rows sorted by (g, g2, doc, s) and returns all but the first of each string, as spans."""

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            g, g2, doc, s = (b.column(k).to_numpy() for k in range(4))
            same = np.empty(len(g), bool)
            same[1:] = (g[1:] == g[:-1]) & (g2[1:] == g2[:-1])
            same[0] = last is not None and (g[0], g2[0]) == last[:2]
            again = np.zeros(len(g), bool)
            again[1:] = same[1:] & (doc[1:] == doc[:-1]) & (s[1:] == s[:-1])
            again[0] = (g[0], g2[0], doc[0], s[0]) == last
            same &= ~again
            last = g[-1], g2[-1], doc[-1], s[-1]
            if same.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[same]), pa.array(s[same]), pa.array(s[same] + length)], names=["doc", "lo", "hi"])

    return run


def _united(batches):
    for b in batches:
        rows = []
        for doc, text, los, his in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            raw = (text or "").encode()
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, np.asarray(los, np.int64), 1)
            np.add.at(cover, np.asarray(his, np.int64), -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "n_removed", "n_spans", "kept_sha256"])


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast only if the table of ids is small; beyond that the join shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    nameless = F.lit(_NONE) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc"), text.alias("text"))


def _merged(batches):
    """Overlapping spans of each document united."""
    for b in batches:
        los, his = [], []
        for lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.r_[True, lo[1:] > hi[:-1]]
            los.append(lo[new])
            his.append(hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]])
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x.tolist() for x in part], pa.list_(pa.int64())) for part in (los, his))], names=["doc", "a", "b"])


def _located(heads: DataFrame, places: DataFrame, merge: bool = False) -> DataFrame:
    """(doc, text, a, b): the texts with the lists of their places (doc, a, b).

    Few places are broadcast to the texts; else only texts with places are shuffled, as long as their ids are few.
    """
    doc, a, b = places.columns
    lists = places.groupBy(doc).agg(F.collect_list(a).alias("a"), F.collect_list(b).alias("b"))
    lists = written(lists.mapInArrow(_merged, "doc long, a array<long>, b array<long>") if merge else lists)
    size = lists.agg(F.count("*"), F.sum(F.size("a"))).first()
    if (size[1] or 0) <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    elif size[0] <= BROADCAST_ROWS:
        heads = heads.join(F.broadcast(lists.select("doc")), "doc", "left_semi")
    return heads.join(lists, "doc").select("doc", "text", "a", "b")


def removed(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, spans): identity of every row, first doc of each text, and spans (doc, lo, hi) of the first texts to remove."""
    rows = _rows(docs)
    identities = written(rows.mapInArrow(_identities, "doc long, n_bytes long, k1 long, k2 long, whole string"))
    # classes of one text say nothing
    classes = written(identities.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = written(looked_up(identities.select("doc", "k1", "k2"), classes, ["k1", "k2"], "doc", most=BROADCAST_ROWS).where("doc <> first").select("doc").distinct())
    heads = rows.where(F.octet_length("text") >= length).join(_small(copies), "doc", "left_anti")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = heads.mapInArrow(_cells(length), "h long, cell long, doc long, at long, reach int, later boolean")
    kinds = written(cells.repartition(parts, "h").sortWithinPartitions("h", "cell", "doc", "at").mapInArrow(_sorted_cells, "kind int, doc long, at long, reach int"))
    whole = kinds.where("kind = 0").select("doc", (F.col("at") - F.shiftright("reach", 16)).alias("lo"), (F.col("at") - F.col("reach").bitwiseAND(0xFFFF) + length).alias("hi"))
    cores = _located(heads, kinds.where("kind = 1").select("doc", "at", "reach")).mapInArrow(_cores(length), "key long, doc long, s0 long, s1 long")
    ranges = written(cores.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, "doc long, s0 long, s1 long"))
    strings = _located(heads, ranges).mapInArrow(_strings(length), "g long, g2 long, doc long, s long")
    ends = strings.repartition(parts, "g").sortWithinPartitions("g", "g2", "doc", "s").mapInArrow(_later(length), "doc long, lo long, hi long")
    return identities, classes, written(whole.unionByName(ends))


def deduplicated(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    identities, classes, spans = removed(docs, length)
    rows = _rows(docs)
    done = _located(rows, spans, merge=True).mapInArrow(_united, "doc long, n_removed long, n_spans long, kept_sha256 string")
    out = looked_up(identities, classes, ["k1", "k2"], "doc", "left", BROADCAST_ROWS).join(done.dropDuplicates(["doc"]), "doc", "left")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("doc") >= _NONE // 2, F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
