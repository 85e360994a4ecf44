"""The streamed extraction fold against the fold of all mentions at once, over restarts."""

import random

import pytest

pytest.importorskip("google.protobuf")

from quillgraph.operators import updates
from quillgraph.streaming import elements

ENTITIES = "corpus_id string, name string, type string, description string, unit_ids array<string>, attributes map<string,string>, at long"
EDGES = "corpus_id string, source string, source_type string, type string, target string, target_type string, description string, unit_ids array<string>, weight long, at long"


def mentions():
    r = random.Random(11)
    names = ["Ada", "ADA", "ada ", "Charles", "Engine", "Engines", "London", "Mary Ann"]
    entities, edges = [], []
    for at in range(240):
        unit = [f"u{at // 3}"]
        entities.append(("c", r.choice(names), r.choice(["Person", "Person", "Concept", "Place"]), r.choice([f"Fact {r.randrange(30)}. Then {r.randrange(5)}.", "open end", "", None]), r.choice([unit, unit + ["extra"], [], None]), r.choice([{}, None, {"k": str(at), " ": "x"}, {"born": str(r.randrange(3))}]), at))
        edges.append(("c", r.choice(names), "Person", r.choice(["met", "Met", "built"]), r.choice([*names, "Nobody", "nobody"]), r.choice(["Concept", "Thing"]), f"said {at}", r.choice([unit, []]), r.choice([1, 3]), at))
    entities.append(("other", "Ada", "Person", "Elsewhere.", ["u"], {}, 0))
    return entities, [*edges, ("other", "Ada", "Person", "met", "Zoe", "Person", "", ["u"], 4, 0)]


def run(df, make, path, found):
    query = make(df).writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.mode("append").parquet(found)).option("checkpointLocation", path).start()
    query.processAllAvailable()
    query.stop()


def plain(df, *columns):
    return sorted(repr([sorted(x.items()) if isinstance(x, dict) else x for x in row]) for row in df.select(*columns).collect())


def test_stream_equals_batch_fold_over_restarts(spark, tmp_path):
    entities, edges = mentions()
    cuts = [0, 7, 100, 241]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for rows, schema, name, make in ((entities, ENTITIES, "entities", lambda s: elements.entity_changes(s, 60)), (edges, EDGES, "edges", elements.relationship_changes)):
            spark.createDataFrame(rows[lo:hi], schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in/{name}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/{name}")
            run(stream, make, f"{tmp_path}/check/{name}", f"{tmp_path}/out/{name}")
    changes, links = spark.read.parquet(f"{tmp_path}/out/entities"), spark.read.parquet(f"{tmp_path}/out/edges")
    assert {"entity-extracted", "entity-retyped"} == {x.event for x in changes.select("event").distinct().collect()}
    now = elements.current_entities(changes).cache()
    for corpus in ("c", "other"):
        told = [spark.createDataFrame([x for x in rows if x[0] == corpus], schema).drop("corpus_id") for rows, schema in ((entities, ENTITIES), (edges, EDGES))]
        merged, relations, _ = updates.folded(*told, 60)
        of = f"corpus_id = '{corpus}'"
        columns = ["identity", "name", "type", "description", "unit_ids", "attributes", "ord"]
        assert plain(now.where(of), *columns) == plain(merged, *columns)
        columns = ["src_id", "tgt_id", "type", "source", "source_type", "target", "target_type", "description", "weight", "ord"]
        assert plain(elements.current_relationships(links, now).where(of), *columns) == plain(relations, *columns)
