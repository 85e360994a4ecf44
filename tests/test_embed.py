"""The embedding plug-in, and what is built with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import vectors as vx
from quillgraph.operators import clusters, embed
from quillgraph.sources import readers
from quillgraph.sources.store import Store


def bucket(word):
    h = 0
    for c in word:
        h = h * 31 + ord(c)
    return h % 64


def test_hash_vectors_equal_counting_word_by_word():
    import re

    texts = ["One two two THREE_3", None, "", "é? x", "a" * 99 + " b", "tail", " lead", "İstanbul ÀB"]
    got = vx.hash_vectors(texts)
    for t, v in zip(texts, got, strict=True):
        counts = np.zeros(64)
        for w in re.findall(r"[a-z0-9_]+", (t or "").lower()):
            counts[bucket(w)] += 1
        assert np.allclose(v, counts / max(np.linalg.norm(counts), 1e-300) if counts.any() else counts)


def test_batches_and_checks():
    sizes = []

    def take(texts):
        sizes.append(len(texts))
        return [[len(t), 1.0] for t in texts]

    assert embed.Embedder(take, batch=4, dimension=2)([str(k) for k in range(10)]).shape == (10, 2) and sizes == [4, 4, 2]
    with pytest.raises(ValueError, match="3 is due"):
        embed.Embedder(take, dimension=3)(["x"])
    with pytest.raises(ValueError, match="for 2 texts"):
        embed.Embedder(lambda texts: [[1.0]])(["x", "y"])
    with pytest.raises(ValueError):
        embed.Embedder(lambda texts: [[1.0] * (k + 1) for k, _ in enumerate(texts)])(["x", "y"])


def test_embedded_rows(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab"), (4, "")], "k long, text string")
    got = {r.k: r.embedding for r in embed.embedded(rows, embed.Embedder(lambda texts: [[len(t), 2.0] for t in texts], batch=1)).collect()}
    assert got == {1: [2.0, 2.0], 2: None, 3: [2.0, 2.0], 4: [0.0, 2.0]}
    assert embed.embedded(rows.limit(0), embed.OFFLINE).collect() == []


def test_index_and_elements(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    docs = readers.demo(spark)
    chunks = embed.build_index(store, "demo", docs, embed.OFFLINE)
    assert chunks.count() == 3 and all(len(r.projection) == 2 and len(r.embedding) == 64 for r in chunks.collect())
    again = embed.build_index(store, "demo", docs.where("doc_idx < 2"), embed.OFFLINE)
    assert again.count() == 2 and store.table("projections", "demo").count() == 1
    asked = spark.createDataFrame([(1, "Sherlock Holmes met John Watson")], "q_id long, question string")
    spot = embed.projected_question(store, "demo", asked, embed.OFFLINE).first()
    assert len(spot.vector) == 64 and np.isfinite([spot.x, spot.y]).all()
    index = clusters.clustered(again.select("id", F.col("ordinal").alias("ord"), "embedding"))
    assert clusters.nearest(index, np.array([spot.vector]), 1).first()["id"] == "demo::chunk-0"

    store.put_entities(spark.createDataFrame([("demo", "Ada", "Person", "wrote", 1), ("demo", "Engine", "Thing", "", 2)], "corpus_id string, name string, type string, description string, ord long"))
    store.upsert("communities", spark.createDataFrame([("demo", "c1", "Title", "Told", 1)], "corpus_id string, community_id string, title string, summary string, ord long"))
    store.put_memberships(spark.createDataFrame([("demo", "c1", "ada::person", 1)], "corpus_id string, community_id string, identity string, ord long"))
    assert embed.embed_elements(store, "demo", embed.OFFLINE) == (0, 0)

    def take(texts):
        return [[float(len(t)), 1.0] for t in texts]

    assert embed.embed_elements(store, "demo", embed.Embedder(take)) == (2, 1)
    said = {r.identity: r.embedding[0] for r in store.table("entity_embeddings", "demo").collect()}
    assert said == {"ada::person": float(len("Ada: wrote")), "engine::thing": float(len("Engine"))}
    assert store.table("community_embeddings", "demo").first().embedding[0] == float(len("Title: Told\nKey members: Ada"))


def test_rows_meet_the_centroids_in_small_parts():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    x, centroids = r.normal(size=(8000, 64)), r.normal(size=(1024, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(list(x), pa.list_(pa.float64()))], names=["ord", "embedding"])
    tracemalloc.start()
    (got,) = clusters._assigned(centroids, 1)([batch])
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (got.column(0).to_numpy() == (unit @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)).all()


def test_texts_are_cut_once_and_stay_where_they_are(spark):
    docs = spark.createDataFrame([("c", k, f"d{k}", "word " * (50 * k)) for k in range(5)], "corpus_id string, doc_idx long, filename string, content string")
    cut = readers.chunks(docs)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "SortMergeJoin" not in plan
    assert sorted(r.ordinal for r in cut.collect()) == list(range(cut.count()))


def test_large_buckets_are_split_by_what_a_task_would_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("c", f"k{k}", k % 8) for k in range(20)], "corpus_id string, id string, key_bucket int")
    assert "REBALANCE_PARTITIONS" in store._dealt("chunks", rows)._jdf.queryExecution().executedPlan().toString()
