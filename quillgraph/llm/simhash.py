"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of the same bit in the XXH64 hashes of all word shingles. Bit i of a
fingerprint stands for a nonzero vector v(i) of radius + 1 bits, and for each nonzero vector a there is one table, keyed by
the bits with v(i) * a odd. At most ``radius`` differing bits span no more than ``radius`` dimensions, so some a is orthogonal to all
of them and the two fingerprints agree in that table: no pair within the radius is missed, in any table or by chance.

Equal fingerprints are one row from the start. A table's bucket of up to ``CROWD`` fingerprints is compared in one task and gives
a forest of links, not its pairs. A larger one is covered again: its members differ only in the bits that its key leaves out, about half, and the
same kind of masks over those bits cut it into sub-buckets without losing a pair. Every level leaves fewer free bits, so the cutting ends
whatever the data. Crowded buckets are counted before anything is shuffled by bucket.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; fewer words than a shingle form one
shingle; rows without doc_id get a fingerprint and connect nothing but what their fingerprint does, their component_id is the
smallest doc_id among the rows that they reach (null if none has one); repeated rows are each returned; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._shared import components, groups, looked_up, small, trimmed, written
from quillgraph.llm._text import LOWER, NOT_SPACE, pieces, words_of

BITS = 64
#: Fingerprints that are compared with each other in one task.
CROWD = 8192
_SEED = 42
_STEP = 1 << 16  # shingles counted at a time


def _bits_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, shingle: int) -> int:
    """The fingerprint of one text from its words."""
    if not len(start):
        return 0
    words = data.tobytes() if len(start) == 1 else b" ".join([data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    ends = np.cumsum(end - start) + np.arange(len(start))
    starts = ends - (end - start)
    if len(start) == 1:
        words = words[int(start[0]) : int(end[0])]
    size = min(shingle, len(start))
    first, last = starts[: len(start) - size + 1], ends[size - 1 :]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(first), _STEP):
        spans = zip(first[k : k + _STEP].tolist(), last[k : k + _STEP].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(words[a:b], _SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(first)).tolist())


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            out = []
            for first, last, data, offsets in pieces(b.column(1)):
                data = LOWER[data]
                start, end, before = words_of(data, offsets, NOT_SPACE)
                for k in range(last - first):
                    own = slice(before[k], before[k + 1])
                    lo, hi = offsets[k], offsets[k + 1]
                    out.append(_bits_of(data[lo:hi], start[own] - lo, end[own] - lo, shingle))
            bits = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits)], names=["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, bits) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_fingerprints(shingle)), "doc_id long, bits long")


def masks(radius: int, free: int = (1 << BITS) - 1) -> list[int]:
    """The tables' keys over the bits in ``free``: any ``radius`` of those bits stay out of at least one mask.

    The unit vectors are dealt first, so of more than ``radius`` free bits no mask is empty.
    """
    at = [i for i in range(BITS) if free >> i & 1]
    every = range(1, 1 << (radius + 1))
    order = [v for v in every if v.bit_count() == 1] + sorted((v for v in every if v.bit_count() > 1), key=int.bit_count, reverse=True)
    vectors = {i: order[k % len(order)] for k, i in enumerate(at)}
    return [sum(1 << i for i in at if (vectors[i] & a).bit_count() % 2) for a in every]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(table: np.ndarray, bits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A 64-bit name of each bucket (table, bits under its mask)."""
    x = (bits & mask) + table.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dealt(radius: int):
    """(bucket, bits, fixed): each fingerprint once for each table over the bits that ``fixed``, the key so far, leaves out."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                bucket, bits, fixed = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                bits, fixed = bits.view(np.uint64), fixed.view(np.uint64)
                for so_far in np.unique(fixed):
                    of = fixed == so_far
                    for number, mask in enumerate(masks(radius, ~int(so_far) & ((1 << BITS) - 1))):
                        key = _keys(bucket[of].view(np.uint64) + np.uint64(number + 1), bits[of], np.full(int(of.sum()), mask, np.uint64))
                        whole = np.full(len(key), _signed(int(so_far) | mask), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bits[of].view(np.int64)), pa.array(whole)], names=["bucket", "bits", "fixed"])

    return run


def _forest(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of at most ``radius`` bits that unite ``bits`` as far as all such links do; at most one fewer than bits."""
    links, left = [], np.arange(1, len(bits))
    reached = [0]
    while reached or len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
        a = reached.pop()
        near = np.bitwise_count(bits[left] ^ bits[a]) <= radius
        hit = left[near]
        links += [(a, int(b)) for b in hit]
        reached += hit.tolist()
        left = left[~near]
    return links


def _linked(radius: int):
    """(a, b): a forest for each bucket from (bucket, bits) sorted by bucket."""

    def run(batches):
        for bucket, bits in groups(batches):
            bits = bits.view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]  # most buckets of more than one
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            a, b = [bits[near]], [bits[near + 1]]
            for lo, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = np.unique(bits[lo : lo + n])
                found = _forest(own, radius)
                if found:
                    x, y = (np.array(v) for v in zip(*found, strict=True))
                    a.append(own[x])
                    b.append(own[y])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the different fingerprints of ``distinct`` (bits) that connect all that are within ``radius`` bits."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    zero = F.lit(0).cast("long")
    rows, found = distinct.select(zero.alias("bucket"), "bits", zero.alias("fixed")), None
    while True:
        rows = written(rows.mapInArrow(_dealt(radius), "bucket long, bits long, fixed long"))
        crowds = small(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("bucket"))
        shared = rows.join(crowds, "bucket", "left_anti").select("bucket", "bits")
        here = written(shared.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_linked(radius)), "a long, b long").distinct())
        found = here if found is None else found.unionByName(here)
        rows = written(rows.join(crowds, "bucket", "left_semi"))
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; links are fingerprints that differ in at most ``radius`` bits."""
    printed = written(fingerprints(docs, shingle))
    classes = written(printed.groupBy("bits").agg(F.min("doc_id").alias("least")))
    labels = components(links(classes.select("bits"), radius, crowd))
    named = written(classes.join(labels.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = looked_up(named, least, ["component"], "bits").select("bits", "component_id")
    out = looked_up(printed, found, ["bits"], "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
