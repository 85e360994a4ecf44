"""The embedding plug-in: batches of texts in, vectors of one length out, run inside Arrow batches.

An embedder is one callable from a list of texts to as many vectors, called with at most ``batch`` texts at a time. Equal texts are embedded
once. Elements are embedded only by a semantic embedder: without one, searches match by keywords, and only chunks get vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import vectors as vx
from quillgraph.operators import updates
from quillgraph.operators.tables import written
from quillgraph.sources import readers
from quillgraph.sources.store import Store

BATCH = 32


@dataclass(frozen=True)
class Embedder:
    """``embed`` gives a vector for each text. A ``dimension`` that is set must be that of every vector."""

    embed: Callable[[list[str]], Sequence[Sequence[float]]]
    batch: int = BATCH
    dimension: int | None = None
    semantic: bool = True

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The vectors of any number of texts, embedded batch by batch."""
        if self.batch < 1:
            raise ValueError("a batch holds one text or more")
        out: list[np.ndarray] = []
        for k in range(0, len(texts), self.batch):
            some = texts[k : k + self.batch]
            vectors = [np.asarray(v, np.float32) for v in self.embed(some)]
            if len(vectors) != len(some):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(some)} texts")
            out += vectors
        sizes = {len(v) for v in out}
        if len(sizes) > 1 or self.dimension is not None and sizes - {self.dimension}:
            raise ValueError(f"vectors of {sorted(sizes)} numbers where {self.dimension or 'one length'} is due")
        return np.stack(out) if out else np.zeros((0, self.dimension or 0), np.float32)


#: Counts of hashed words: the same everywhere, and no likeness of meaning.
OFFLINE = Embedder(lambda texts: vx.hash_vectors(texts), batch=4096, dimension=vx.DIMENSIONS, semantic=False)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", vector: str = "embedding") -> DataFrame:
    """``rows`` with the vector of each text; a null text has none. Vectors of different lengths are an error within a task and in the
    store, which checks a corpus as a whole."""
    at = rows.columns.index(text)

    def run(batches):
        size = embedder.dimension
        for b in batches:
            texts = b.column(at).dictionary_encode()
            said = texts.dictionary.to_pylist()
            vectors = embedder(said)
            if len(said):
                if size not in (None, vectors.shape[1]):
                    raise ValueError(f"a vector of {vectors.shape[1]} numbers after one of {size}")
                size = vectors.shape[1]
            flat = pa.array(vectors.reshape(-1), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(said) + 1) * (size or 0), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists.take(texts.indices)], names=[*b.schema.names, vector])

    schema = T.StructType([*rows.schema, T.StructField(vector, T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(run, schema)


def element_vectors(entities: DataFrame, communities: DataFrame, members: DataFrame, edges: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(identity, embedding) and (community_id, embedding) by their texts; empty if the embedder isn't semantic."""
    names = entities.select("identity", updates.embedded_entity_text().alias("text"))
    told = updates.community_texts(communities, members, entities, edges)
    if not embedder.semantic:
        names, told = names.limit(0), told.limit(0)
    return embedded(names, embedder).drop("text"), embedded(told.select("community_id", "text"), embedder).drop("text")


def embed_elements(store: Store, corpus: str, embedder: Embedder) -> tuple[int, int]:
    """Embed the stored entities and communities of a corpus, in place of what was embedded before; returns how many of each."""
    tables = [store.table(t, corpus).drop("corpus_id") for t in ("entities", "communities", "memberships", "relationships")]
    entities, communities = (written(x.withColumn("corpus_id", F.lit(corpus))) for x in element_vectors(*tables, embedder))
    for name, rows in (("entity_embeddings", entities), ("community_embeddings", communities)):
        if not rows.isEmpty():
            store.put_embeddings(name, rows)
    return entities.count(), communities.count()


def build_index(store: Store, corpus: str, documents: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunk the documents of a corpus, embed the chunks, fit the two-axis projection on all of them, store both, and return the chunks as
    stored. An index that was there before is replaced."""
    cut = readers.chunks(documents.where(F.col("corpus_id") == corpus))
    chunks = written(embedded(cut, embedder))
    store.delete_chunks(corpus)
    mean, one, two = vx.projection_model(chunks)
    if len(mean):
        spot = F.array(vx.projected(F.col("embedding"), mean, one), vx.projected(F.col("embedding"), mean, two))
        store.put_chunks(chunks.withColumn("projection", spot))
        numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
        store.upsert("projections", store.spark.range(1).select(F.lit(corpus).alias("corpus_id"), numbers(mean).alias("mean"), numbers(one).alias("pc1"), numbers(two).alias("pc2")))
    return store.table("chunks", corpus)


def projected_question(store: Store, corpus: str, questions: DataFrame, embedder: Embedder) -> DataFrame:
    """``questions`` (q_id, question) with vector and its spot (x, y) in the corpus's stored projection."""
    asked = embedded(questions, embedder, "question", "vector").crossJoin(F.broadcast(store.table("projections", corpus).select("mean", "pc1", "pc2")))  # one row
    centred = F.zip_with("vector", "mean", lambda x, m: x.cast("double") - m)
    return asked.select(*questions.columns, "vector", vx.dot(centred, F.col("pc1")).alias("x"), vx.dot(centred, F.col("pc2")).alias("y"))
