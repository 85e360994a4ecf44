"""Fuzzy look-ups and vector search against comparing everything with everything."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import clusters, lookup, seeds


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens(text):
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", (text or "").lower()) if len(t) > 2))


def points(token, text):
    allowed = 2 if len(token) >= 7 else 1 if len(token) >= 4 else 0
    if token in (text or "").lower():
        return 2
    return int(allowed > 0 and any(edits(token, w) <= allowed for w in tokens(text)))


def changed(r, word):
    for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
        i = r.randrange(len(word))
        word = r.choice([word[:i] + r.choice("abc") + word[i:], word[:i] + word[i + 1 :] or "a", word[:i] + r.choice("abc") + word[i + 1 :]])
    return word


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_scores_equal_all_pairs(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abc", k=n)) for n in [3, 4, 5, 6, 6, 7, 8, 9, 18, 19, 20, 21, 22, 23, 40, 41] for _ in range(4)]
    rows = [(i, ", ".join(changed(r, w).title() if r.random() < 0.3 else changed(r, w) for w in r.choices(words, k=3))) for i in range(120)] + [(900, None), (901, ""), (902, "the common"), (903, "x" * 5000)]
    asked = [(q, "? ".join(changed(r, w) for w in r.choices(words, k=3))) for q in range(12)] + [(50, "ab"), (51, None), (52, "x" * 60)]
    found = seeds.keyword_scores(spark.createDataFrame(asked, "q_id long, question string"), spark.createDataFrame(rows, "id long, text string"), F.col("text"))
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    want = {(q, i, s) for q, question in asked for i, text in rows if (s := sum(points(t, text) for t in tokens(question)))}
    assert {(x["q_id"], x["id"], x["score"]) for x in found.collect()} == want and len(want) > 50


@pytest.mark.parametrize("bands", [lookup.WORD_BANDS, lookup.NAME_BANDS])
def test_words_within_the_edits_share_a_key(spark, bands):
    r = random.Random(6)
    pairs = []
    for n in [4, 5, 6, 7, 9, 10, 17, 18, 19, 20, 21, 22, 23, 24, 60]:
        for _ in range(12):
            w = "".join(r.choices("abcd", k=n))
            pairs.append((w, changed(r, w)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.arrays_overlap(lookup.asked_keys(F.col("a"), bands), lookup.held_keys(F.col("b"), bands)).alias("met")).collect()
    allowed = lambda n: max((k for k, lo, hi in bands if lo <= n and (hi is None or n <= hi)), default=0)
    near = [x for x in rows if allowed(len(x["a"])) and edits(x["a"], x["b"]) <= allowed(len(x["a"]))]
    assert len(near) > 60 and all(x["met"] for x in near)


def test_identifier_matches_equal_all_pairs(spark):
    names = [f"com.acme.n{k % 3}.Order{w}#{m}" for k, w in enumerate(["Store", "Stores", "Index", "Reader", "Cache"]) for m in ("findAll", "findAl", "loadOrder", "close(int)")]
    names += ["com.acme.OrderStore", "OrderStore", "util.Strings", "loadOrders", "x", "Überschrift.los", "com.acme.n1"]
    forms = seeds.name_forms(spark.createDataFrame([(n.lower(), n, k) for k, n in enumerate(names)], "identity string, name string, ord long"))
    asked = ["Where is OrderStore.findAll called?", "What does loadOrdes() do", "orders in com.acme.n1", "findAll findAl findAlll", "which reader caches strings", "OrderIndexs", "com.acme.OrderStore.close", "plain words only"]
    questions = spark.createDataFrame(list(enumerate(asked)), "q_id long, question string")
    found = seeds.identifier_matches(questions, forms, None)
    assert "CartesianProduct" not in plan(found)
    got = {(x["q_id"], x["identity"]): round(x["score"], 6) for x in found.collect()}
    # the same score over every form and question
    every = forms.crossJoin(F.broadcast(questions))
    code = F.filter(seeds.tx.identifiers(F.col("question")), lambda t: seeds.tx.is_code_like(t))
    best = F.aggregate(F.transform(code, lambda t: seeds.identifier_score(t)), F.lit(0.0), lambda a, s: F.greatest(a, s))
    stems = F.transform("parts", seeds._stem)
    words = F.size(F.filter(seeds._words_outside_code(F.col("question")), lambda w: F.array_contains(stems, seeds._stem(w))))
    scored = every.withColumn("score", best + F.least(F.lit(24), 6 * words)).groupBy("q_id", "identity").agg(F.max("score").alias("score")).where("score >= 6")
    assert got == {(x["q_id"], x["identity"]): round(x["score"], 6) for x in scored.collect()} and len(got) > 30


def vectors(r, n=3000, d=16):
    centres = r.normal(size=(12, d)) * 3
    x = centres[r.integers(0, 12, n)] + r.normal(size=(n, d)) * 0.4
    x[100:160] = x[100]  # ties
    x[200:260] = 0
    return x


def test_nearest_equals_full_scan_and_skips(spark):
    r = np.random.default_rng(1)
    x = vectors(r)
    rows = [(i, v.tolist(), f"name {i}") for i, v in enumerate(x)]
    index = clusters.clustered(spark.createDataFrame(rows, "ord long, embedding array<double>, name string"))
    queries = np.vstack([x[:20], x[100:101], -x[5:6], np.zeros((1, 16))])
    got = {}
    for row in clusters.nearest(index, queries, 7).collect():
        got.setdefault(row["q"], []).append((row["rank"], row["ord"], row["name"], round(row["score"], 9)))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q, v in enumerate(queries):
        score = unit @ (v / max(np.linalg.norm(v), 1e-300))
        want = [(k + 1, int(i), f"name {i}", round(float(score[i]), 9)) for k, i in enumerate(np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:7])]
        assert [g[0] for g in sorted(got[q])] == [w[0] for w in want]
        assert [g[3] for g in sorted(got[q])] == [w[3] for w in want]
        assert {g[1] for g in got[q] if g[3] > want[-1][3]} == {w[1] for w in want if w[3] > want[-1][3]}
    away = clusters.distances(index, clusters._unit(queries[:20]))
    kth = np.array([min(g[3] for g in got[q]) for q in range(20)])
    read = clusters.possible_clusters(index, away, np.sqrt(np.maximum(0, 2 - 2 * kth)) + 1e-6) @ index.sizes
    assert read.mean() < 0.5 * index.sizes.sum()


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [0.9, 0.1, 0.0]), (7, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "ord long, embedding array<double>")
    index = clusters.clustered(df)
    best = [(x["ord"], x["rank"]) for x in clusters.nearest(index, np.array([[1.0, 0.0, 0.0]]), 3).orderBy("rank").collect()]
    assert best == [(1, 1), (3, 2), (6, 3)] or best == [(1, 1), (6, 2), (3, 3)]
    assert clusters.nearest(index, np.array([[1.0, 0.0]]), 1).first()["ord"] == 1
    none = clusters.clustered(df.limit(0))
    assert clusters.nearest(none, np.array([[1.0, 0.0, 0.0]]), 3).collect() == []
    asked = spark.createDataFrame([(8, [0.0, 1.0, 0.0]), (9, None)], "q_id long, vector array<double>")
    assert {x["q_id"] for x in clusters.nearest_of(index, asked, 2).where("rank = 1").collect()} == {8, 9}
    assert clusters.nearest_of(index, asked.limit(0), 2).collect() == []
