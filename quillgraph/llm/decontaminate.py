"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the ``window``-word windows of the benchmark items (an item of fewer words is one string). Words are
runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. The search works on word hashes: a shift
table over blocks of two words tells how far a window may jump, blocks with shift 0 select the test strings by the hash
of the window, and the words themselves are compared before an occurrence counts. All parts of a batch advance in step,
so each step is a few whole-array operations.

The test strings travel to the executors in blocks of at most ``PATTERN_BYTES`` of item text; a larger benchmark takes
one pass over the documents for each block, and what the passes find, not the texts, is united by the content of the rows.

Defined cases: a null text has no words and is clean; items without words match nothing; repeated rows are each
returned; equal items both count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import content_key, trimmed, without, written

PATTERN_BYTES = 16 << 20
_PART = 256
_TABLE = 1 << 18
_FOUND = "doc_id long, key1 long, key2 long, n_words long, runs array<long>, items array<string>"


def _words(texts: pa.Array):
    for first, last, data, offsets in tx.pieces(texts):
        data = tx.LOWER[data]
        start, end, before = tx.words_of(data, offsets, tx.ALNUM)
        yield first, last, data, start, end, before, tx.span_hash(tx.prefix_hash(data), start, end)


class Patterns:
    """Shift table, bucket hashes and texts of the test strings of one length."""

    def __init__(self, size: int, strings: dict[bytes, set[str]]):
        self.size, self.strings = size, strings
        self.block = min(2, size)
        joined = list(strings)
        whole = []
        self.shift = np.full(_TABLE, size - self.block + 1, np.int64)
        for *_, start, end, before, hashes in _words(pa.array([x.decode() for x in joined], pa.large_string())):
            blocks = tx.windows(hashes, self.block)
            whole.append(tx.windows(hashes, size)[before[:-1]])
            for at in range(size - self.block + 1):
                np.minimum.at(self.shift, (blocks[before[:-1] + at] % np.uint64(_TABLE)).astype(np.int64), size - self.block - at)
        self.whole = np.unique(np.concatenate(whole))

    def search(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Word positions whose window has the hash of a test string."""
        lengths = np.diff(before) - self.size + 1
        texts = np.flatnonzero(lengths > 0)
        if not len(texts):
            return np.zeros(0, np.int64)
        shift = self.shift[(tx.windows(hashes, self.block) % np.uint64(_TABLE)).astype(np.int64)]
        parts = -(-lengths[texts] // _PART)
        at = tx.positions(np.zeros(len(texts), np.int64), parts) * _PART + np.repeat(before[texts], parts)
        stop = np.minimum(at + _PART, np.repeat(before[texts] + lengths[texts], parts))
        tail, found = self.size - self.block, []
        while len(at):
            step = shift[at + tail]
            zero = at[step == 0]
            if len(zero):
                found.append(zero)
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64)
        at = np.concatenate(found)
        window = np.zeros(len(at), dtype=tx.U64)
        for k in range(self.size):
            window = window + hashes[at + k] * tx._MIXERS[k]
        window = tx.mix(window + np.uint64(self.size))
        slot = np.minimum(np.searchsorted(self.whole, window), len(self.whole) - 1)
        return np.sort(at[self.whole[slot] == window])


def compiled(items: list[tuple[str, str | None]], window: int) -> list[Patterns]:
    strings: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    texts = pa.array([t for _, t in items], pa.large_string())
    for first, last, data, start, end, before, _ in _words(texts):
        raw = data.tobytes()
        for k in range(last - first):
            w = [raw[start[i] : end[i]] for i in range(before[k], before[k + 1])]
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                strings[size][b" ".join(w[i : i + size])].add(items[first + k][0])
    return [Patterns(size, dict(found)) for size, found in sorted(strings.items())]


def _pass(patterns: list[Patterns]):
    """The number of words, hit runs and items of each row for one block of test strings."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                counts, runs, items = [], [], []
                for first, last, data, start, end, before, hashes in _words(b.column(3)):
                    cover, named = np.zeros(len(start) + 1, np.int64), defaultdict(set)
                    for p in patterns:
                        at = p.search(hashes, before)
                        for i, k in zip(at, np.searchsorted(before, at, side="right") - 1, strict=True):
                            owners = p.strings.get(b" ".join(data[start[j] : end[j]].tobytes() for j in range(i, i + p.size)))
                            if owners:
                                named[int(k)] |= owners
                                cover[i] += 1
                                cover[i + p.size] -= 1
                    inside = np.cumsum(cover[:-1]) > 0
                    for k in range(last - first):
                        hit = inside[before[k] : before[k + 1]]
                        counts.append(len(hit))
                        runs.append(np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist() if k in named else [])
                        items.append(sorted(x for x in named.get(k, ()) if x is not None))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "key1", "key2", "n_words", "runs", "items"])

    return run


def _one_list(batches):
    """The runs of several passes over one text as one list of runs that don't overlap."""
    for b in batches:
        out = []
        for runs in b.column(3).to_pylist():
            pairs, flat = sorted(zip(runs[::2], runs[1::2], strict=True)), []
            for lo, hi in pairs:
                if flat and lo <= flat[-1]:
                    flat[-1] = max(flat[-1], hi)
                else:
                    flat += [lo, hi]
            out.append(flat)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64())), b.column(4)], names=["key1", "key2", "n_words", "runs", "items"])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, key1, key2, n_words, runs, items): hit word runs as start, end, start, end ... and the sorted item ids; the keys are
    those of the text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-2 * (total[0] or 0) // PATTERN_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key("text"), F.col("text").alias("text"))
    if blocks == 1:
        return rows.mapInArrow(trimmed(_pass(compiled([tuple(r) for r in items.collect()], window))), _FOUND)
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        part = written(rows.mapInArrow(trimmed(_pass(compiled([tuple(r) for r in block.collect()], window))), _FOUND).where("size(runs) > 0").dropDuplicates(["key1", "key2"]))
        found = part if found is None else found.unionByName(part)
    lists = found.groupBy("key1", "key2").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    lists = lists.mapInArrow(_one_list, "key1 long, key2 long, n_words long, runs array<long>, items array<string>").drop("n_words")
    every = rows.mapInArrow(_pass([]), _FOUND).drop("runs", "items")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return every.join(lists, ["key1", "key2"], "left").select("doc_id", "key1", "key2", "n_words", none("runs", "array<long>"), none("items", "array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated); contaminated: hit words are 1 in ``share`` or more."""
    return _flags(docs, benchmark, window, share).drop("key1", "key2")


def _flags(docs: DataFrame, benchmark: DataFrame, window: int, share: int) -> DataFrame:
    """The rows of ``contamination`` with the key of their text."""
    found = occurrences(docs, benchmark, window)
    n_hit = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))["sum"]
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "key1", "key2")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The uncontaminated rows of ``docs`` with all their columns; ids, shared or missing, play no part."""
    return without(docs, _flags(docs, benchmark, window, share).where("contaminated"), "text")
