"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(t.translate(LOWER) for t in TERM.findall(text or ""))


def brute(docs, items, k):
    counted = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 75 + 75 * c.total() * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in terms(text).items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item if item is not None else -9, k + 1, -9 if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int")
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string")
    out = lexical_search.search(d, q, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(-9 if v is None else v for v in r) for r in out.collect())


def corpus():
    r = random.Random(4)
    words = [f"t{i}" for i in range(60)] + ["É", "été", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, ", ".join(r.choices(words, weights, k=r.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(1000 - i, "T9 t9 t40 same") for i in range(80)] + [(5, docs[5][1]), (5, docs[5][1]), (5, "t40 of another"), (None, "t40 t40"), (None, None), (2000, ""), (2001, " .,;_ \n"), (2002, "t3 " * 90_000)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 12])))) for i in range(20)]
    return docs, items + [(20, "same SAME same"), (20, "t9"), (None, "t40"), (21, None), (22, ""), (23, "never said"), (24, "t0")]


@pytest.mark.parametrize("shard", [lexical_search.SHARD, 200])
def test_equals_scoring_every_document(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    docs, items = corpus()
    assert found(spark, docs, items) == brute(docs, items, 10)


def test_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUESTION_BYTES", 1500)
    docs, items = corpus()
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus()
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_long_text_is_cut_between_terms():
    text = ("word " * 300_000 + "e" * 50).encode()
    counts, n = lexical_search._counts(text)
    assert counts == {b"word": 300_000, b"e" * 50: 1} and n == 300_001


def test_block_ends_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(lexical_search, "GRAIN", 1)
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 10):
        parts = r.integers(1, 50, n)

        def cost(ends):
            return sum(parts[a:b].max() * (b - a) for a, b in zip([0, *ends], ends)) + 4.0 * parts.mean() * len(ends)

        every = [[*[i for i in range(1, n) if mask >> (i - 1) & 1], n] for mask in range(1 << (n - 1))]
        assert math.isclose(cost(lexical_search.block_ends(parts, 4.0).tolist()), min(map(cost, every)))


def test_spans_are_skipped():
    r = np.random.default_rng(3)
    parts = np.where(r.random(20_000) < 0.002, 1000, r.integers(1, 20, 20_000))
    own = lexical_search._List(np.arange(20_000), parts)
    docs, scores = lexical_search.best_of([(own, 1)], 10)
    order = np.lexsort((np.arange(20_000), -parts))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == parts[order].tolist()
    assert len(own.at) < 20_000 / 4
