"""Ranked lexical search with variable-block-max pruning.

Documents are read once and leave the occurrences of the questions' terms. Their postings are dealt into shards of about
``SHARD`` postings, so a task's memory doesn't grow with the corpus and a frequent term is spread over all shards. In a shard every
term's list (documents in order, each with the term's part of the score, an integer) is cut into blocks of varying length: dynamic programming
picks the boundaries that minimise the sum of block maximum minus part over all postings plus ``BLOCK_COST`` a block. For a
question the boundaries of its terms' blocks split the documents into spans in which the sum of the block maxima bounds every
score. Spans are opened from the highest bound on, and as soon as a bound is under the tenth best score no further span is
opened: exact, as only documents that can't enter are skipped. The best of all shards are merged by a window.

Questions come in blocks of about ``QUESTION_BYTES`` of text, each of which is held by every task.

Defined cases: a document without terms is in no statistic and has no score; an item without terms, or whose terms no document holds, has no
rows; items with the same item_id, or none, are ranked each for itself; rows without doc_id are documents like any other and
come last among equal scores; equal rows are documents of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm._shared import forget, trimmed, written

SHARD = 250_000
QUESTION_BYTES = 4 << 20
BLOCK_COST = 4.0  # in units of the list's mean part: the longer the blocks, the fewer bounds to add and the looser they are
LONGEST = 64  # grains in a block
GRAIN = 4  # postings between possible boundaries
#: Fixed values of the score.
K1, SCALE, B = 1000, 1_000_000_000, 75
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 20


def _counts(text: bytes) -> tuple[Counter, int]:
    """How often each term stands in a text, which is read in steps that end between terms."""
    found, at = Counter(), 0
    while at < len(text):
        end = min(len(text), at + _STEP)
        while end < len(text) and _TERM.match(text, end, end + 1):
            end += 1
        found.update(_TERM.findall(text, at, end))
        at = end
    return found, found.total()


def terms(text: str | None) -> Counter:
    return _counts((text or "").encode().translate(_LOWER))[0]


def _read(known: dict[bytes, int]):
    """(doc_id, place, n, terms, tfs): a row for each document with terms, and its occurrences of the known terms."""

    def run(batches):
        row = 0
        for b in batches:
            ids, places, sizes, which, often = [], [], [], [], []
            for k, value in enumerate(b.column(1)):
                raw = value.as_buffer()
                counts, n = _counts(raw.to_pybytes().translate(_LOWER)) if raw is not None else (None, 0)
                row += 1
                if not n:
                    continue
                held = counts.keys() & known.keys()
                ids.append(k)
                places.append(row)
                sizes.append(n)
                which.append([known[t] for t in held])
                often.append([counts[t] for t in held])
            arrays = [b.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "place", "n", "terms", "tfs"])

    return run


def block_ends(parts: np.ndarray, cost: float = BLOCK_COST) -> np.ndarray:
    """Where the blocks of a list end, so that the sum over blocks of (maximum * length - sum of parts) + cost * mean is least
    among all boundaries at multiples of ``GRAIN`` with at most ``LONGEST`` grains to a block."""
    n = len(parts)
    cuts = np.r_[np.arange(0, n, GRAIN), n]
    if len(cuts) <= 2:
        return cuts[1:]
    peaks = np.maximum.reduceat(parts, cuts[:-1]).astype(np.float64)
    lengths = np.diff(cuts).astype(np.float64)
    unit = cost * float(parts.mean())
    g = len(peaks)
    # the sum of parts is the same for all cuts and is left out
    best, back = np.full(g + 1, np.inf), np.zeros(g + 1, np.int64)
    best[0] = 0.0
    peak, size = np.zeros(LONGEST), np.zeros(LONGEST)  # of the blocks that end here, from the shortest to the longest
    for i in range(g):
        peak = np.maximum(np.r_[0.0, peak[:-1]], peaks[i])
        size = np.r_[0.0, size[:-1]] + lengths[i]
        m = min(i + 1, LONGEST)
        total = best[i - m + 1 : i + 1][::-1] + peak[:m] * size[:m]
        k = int(total.argmin())
        best[i + 1], back[i + 1] = total[k] + unit, i - k
    ends, i = [], g
    while i:
        ends.append(cuts[i])
        i = back[i]
    return np.array(ends[::-1], np.int64)


class _List:
    """A term's postings in a shard: documents, parts of the score, and block bounds as steps over the documents."""

    def __init__(self, docs: np.ndarray, parts: np.ndarray):
        self.docs, self.parts = docs, parts
        ends = block_ends(parts)
        starts = np.r_[0, ends[:-1]]
        high = np.maximum.reduceat(parts, starts)
        # each block's bound holds from its first document to its last; between blocks the term adds nothing
        self.at = np.r_[docs[starts], docs[ends - 1] + 1]
        self.step = np.r_[high, -high]


def best_of(lists: list[tuple[_List, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest-scoring documents and their scores, of equal scores the first documents; lists come with their repeats."""
    at = np.concatenate([x.at for x, _ in lists])
    order = np.argsort(at, kind="stable")
    edges, first = np.unique(at[order], return_index=True)
    bound = np.cumsum(np.concatenate([x.step * r for x, r in lists])[order])[np.r_[first[1:] - 1, len(at) - 1]]
    spans = np.flatnonzero(bound[:-1] > 0)
    spans = spans[np.argsort(-bound[spans], kind="stable")]
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, done, batch = 1, 0, 4 * k
    while done < len(spans):
        now = spans[done : done + batch]
        now = np.sort(now[bound[now] >= low])
        if not len(now):
            break
        done += batch
        batch *= 2
        lo, hi = edges[now], edges[now + 1]
        found, score = [], []
        for x, r in lists:
            a, b = np.searchsorted(x.docs, lo), np.searchsorted(x.docs, hi)
            size = b - a
            some = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
            found.append(x.docs[some])
            score.append(x.parts[some] * r)
        which, inverse = np.unique(np.concatenate(found), return_inverse=True)
        total = np.zeros(len(which), np.int64)
        np.add.at(total, inverse, np.concatenate(score))
        which, total = np.r_[docs, which[total > 0]], np.r_[scores, total[total > 0]]
        top = np.lexsort((which, -total))[:k]
        docs, scores = which[top], total[top]
        if len(top) == k:
            low = int(scores[-1])  # a span with this bound may hold an earlier document of the same score
    return docs, scores


def _searched(questions: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best documents of one shard for every question: (question, doc_id, score)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()  # documents are numbered in the order that breaks ties, null last
        counts = table.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term = table.column("terms").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = 100 - B + B * table.column("n").to_numpy() * n_docs // n_terms
        doc = np.repeat(np.arange(len(counts)), counts)
        parts = weights[term] * (SCALE * tf // (K1 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        term, doc, parts = term[order], doc[order], parts[order]
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        lists = {int(term[a]): _List(doc[a:b], parts[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(term)], strict=True) if weights[term[a]] > 0}
        ids = table.column("doc_id")
        number, who, score = [], [], []
        for q, wanted in enumerate(questions):
            own = [(lists[t], r) for t, r in wanted if t in lists]
            if not own:
                continue
            docs, scores = best_of(own, k)
            number.append(np.full(len(docs), q))
            who.append(docs)
            score.append(scores)
        if not number:
            return pa.table({"question": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.table({"question": pa.array(np.concatenate(number)), "doc_id": ids.take(pa.array(np.concatenate(who))), "score": pa.array(np.concatenate(score))})

    return run


def _block(docs: DataFrame, items: list[tuple[object, str | None]], k: int) -> DataFrame:
    """The ``k`` best documents for each of a block of items, as (question, doc_id, score, rank); question counts the items."""
    spark = docs.sparkSession
    asked = [terms(text) for _, text in items]
    known = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    read = written(rows.mapInArrow(trimmed(_read(known)), "doc_id long, place long, n long, terms array<int>, tfs array<long>"))
    totals = read.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    n_docs, n_terms, postings = (int(x or 0) for x in totals)
    df = np.zeros(len(known), np.int64)  # one row for each term that the block asks for
    for t, n in read.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    questions = [sorted((known[t], r) for t, r in found.items()) for found in asked]
    shards = max(1, -(-postings // SHARD))
    shard = F.pmod(F.xxhash64("doc_id", "place", "n"), F.lit(shards)).cast("int").alias("shard")
    best = read.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs", shard).groupBy("shard").applyInArrow(_searched(questions, weights, max(1, n_docs), max(1, n_terms), k), "question long, doc_id long, score long")
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = written(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    forget(read)
    named = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], "question long, item_id " + _type_of(items))
    return out.join(F.broadcast(named), "question").select("item_id", "rank", "doc_id", "score")  # at most a block of items


def _type_of(items) -> str:
    return "long" if all(item is None or isinstance(item, int) for item, _ in items) else "string"


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each item
    of ``items`` (item_id, text)."""
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-2 * size // QUESTION_BYTES))
    if blocks > 1:
        asked = written(asked)
    out = None
    for number in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = [tuple(r) for r in own.collect()]
        if rows or (number == blocks - 1 and out is None):
            found = _block(docs, rows, k)
            out = found if out is None else out.unionByName(found)
    return out.select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
