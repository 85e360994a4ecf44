"""Model tasks, retrieval compositions, summaries, updates and comparisons on small graphs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import lenient_json as lj
from quillgraph.operators import community, compare, graph, model, retrieval, seeds, updates
from quillgraph.sources.store import Store


@pytest.fixture(scope="module")
def g(spark):
    people = [("Ada Byron", "Person", ["u1", "u2"]), ("Charles", "Person", ["u2"]), ("Engine", "Product", ["u2", "u3"]), ("London", "Location", ["u4"]), ("Paris", "Location", []), ("Loom", "Product", ["u5"])]
    entities = spark.createDataFrame([(f"{n.lower()}::{t.lower()}", n, t, f"{n} stands here", u, {"kind": t}, k) for k, (n, t, u) in enumerate(people)], "identity string, name string, type string, description string, unit_ids array<string>, attributes map<string,string>, ord long")
    id_of = {n: f"{n.lower()}::{t.lower()}" for n, t, _ in people}
    links = [("Ada Byron", "worked_with", "Charles", 5, ["u2"]), ("Charles", "built", "Engine", 4, ["u3"]), ("Charles", "lived_in", "London", 1, ["u4"]), ("Loom", "inspired", "Engine", 2, ["u5"])]
    edges = spark.createDataFrame([(id_of[a], t, id_of[b], a, "T", b, "T", "", u, w, k) for k, (a, t, b, w, u) in enumerate(links)], "src_id string, type string, tgt_id string, source string, source_type string, target string, target_type string, description string, unit_ids array<string>, weight long, ord long")
    units = spark.createDataFrame([(f"u{k}", f"Text of unit {k}.", f"doc{k % 2}", k) for k in range(1, 6)], "id string, text string, document_name string, ord long")
    members = spark.createDataFrame([("community-1", id_of[n], k) for k, n in enumerate(("Ada Byron", "Charles", "Engine"))] + [("community-2", id_of[n], 10 + k) for k, n in enumerate(("London", "Paris", "Loom"))], "community_id string, identity string, ord long")
    communities = spark.createDataFrame([("community-1", "Engines", "Ada Byron and Charles made the Engine."), ("community-2", "Places", "London, Paris and a Loom.")], "community_id string, title string, summary string")
    return retrieval.Graph(entities, edges, units, communities, members)


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions, 1)), "q_id long, question string")


def items(df):
    return [(r.kind, r.identifier) for r in df.orderBy("q_id", "number").collect()]


def test_typed_json_reads():
    o = {"a": " x ", "n": "3.5", "l": ["p", "", 4, {}], "o": {"k": 1}, "b": True, "i": float("inf")}
    assert (lj.text_of(o, "a"), lj.text_of(o, "b"), lj.text_of(o, "o"), lj.text_of(o, "none")) == ("x", "true", "", "")
    assert lj.texts_of(o, "l") == ["p", "4"] and lj.texts_of(o, "a") == ["x"] and lj.objects_of(o, "o") == [{"k": 1}] and lj.objects_of(o, "l") == [{}]
    assert (lj.number_of(o, "n"), lj.number_of(o, "a"), lj.number_of(o, "b"), lj.number_of(o, "i")) == (3.5, None, None, None)


def test_corrective_retry_and_gleaning():
    said = []

    def client(request):
        said.append(request)
        replies = ["no json here", '{"entities":[{"name":"Ada","type":"person"}],"relationships":[{"source":"Ada","target":""}]}', '{"entities":[{"name":"ADA","type":"Person"},{"name":"Bob","type":"x"}]}', '{"entities":[{"name":"bob","type":"x"}]}']
        return replies[len(said) - 1]

    found = model.Model(client, gleanings=5).extract("Ada met Bob.")
    assert [x["name"] for x in found["entities"]] == ["Ada", "Bob"] and found["relationships"] == []
    assert len(said) == 4 and "no JSON object" in said[1].messages[2][1] and said[2].messages[-1] == ("user", model.GLEAN)
    with pytest.raises(model.ReplyError):
        model.Model(lambda r: "{}", retries=1).summary([{"name": "a", "type": "b"}], [])
    none = model.Model()
    assert none.extract("x") == {"entities": [], "relationships": []} and none.summary([{"name": "a", "type": "b"}], []) is None and none.answer("q", []) is None
    assert none.sub_questions("why", [{"title": "", "summary": "S"}]) == ["why Community summary: S"] and none.description("x", "n" * 1200) == "n" * 1000
    half = model.Model(lambda r: '{"subQuestions":["one"]}')
    assert half.sub_questions("why", [{"title": "t", "summary": "S"}, {"title": "", "summary": "T"}]) == ["one", "why Community summary: T"]
    points = model.Model(lambda r: '{"points":[{"community":2,"point":"p","score":140},{"community":9,"point":"x","score":1},{"community":1,"point":"","score":3}]}')
    assert points.points("q", [{"community_id": "a", "title": "", "summary": ""}, {"community_id": "b", "title": "", "summary": ""}]) == [("b", "p", 100)]
    assert model.Model(lambda r: '{"answer":"*NOT_IN_CONTEXT*."}').answer("q", []) == (True, "")
    assert model.Model(lambda r: '{"verdict":"v"}').verdict("q", "a", "b", "f", "plain") == ("v", "LLM") and none.verdict("q", "a", "b", "f", "plain") == ("plain", "RULES")
    assert model.stats_lines(30, 25, {"kind": [("a", 3), ("b", 2)]}) == ["30 members, 25 of them listed", "by kind: a (3), b (2)"] and model.stats_lines(3, 3, {}) == []


def test_extraction_isolates_failures_and_stamps_units(spark):
    def chatty(request):
        text = request.messages[0][1]
        if "boom" in text:
            raise RuntimeError("no service")
        return json.dumps({"entities": [{"name": "ada", "type": "person", "description": "d"}], "relationships": [{"source": "ada", "sourceType": "Person", "type": "", "target": "Bob", "targetType": "zzz", "description": ""}]})

    units = spark.createDataFrame([("u1", "fine", 1), ("u2", "boom", 2), ("u3", None, 3)], "id string, text string, ord long")
    rows = model.extracted(units, model.Model(chatty))
    entities, edges, failures = model.stamped(rows)
    assert [(r.name, r.type, r.unit_ids) for r in entities.collect()] == [("ada", "Person", ["u1"])]
    assert [(r.source, r.type, r.target, r.target_type, r.weight) for r in edges.collect()] == [("ada", "related_to", "Bob", "Concept", 1)]
    assert [(r.unit_id, "no service" in r.message) for r in failures.collect()] == [("u2", True)]
    with pytest.raises(Exception, match="no service"):
        model.extracted(units, model.Model(chatty), isolate=False).collect()
    merged, links, retyped = updates.folded(entities.unionByName(entities.withColumns({"name": F.lit("Ada"), "type": F.lit("Event"), "at": F.col("at") + 9})).unionByName(entities.withColumns({"name": F.lit("ADA"), "type": F.lit("Event"), "at": F.col("at") + 19})), edges)
    assert [(r.identity, r.name) for r in merged.collect()] == [("ada::event", "ada")]
    assert [(r.src_id, r.tgt_id) for r in links.collect()] == [("ada::event", "bob::concept")]
    assert [tuple(r) for r in retyped.collect()] == [("ada", "Person", "Event")]


def test_overflowing_descriptions(spark):
    def shorter(request):
        return '{"description":"short"}' if "flaky" not in request.messages[0][1] else "?"

    rows = spark.createDataFrame([("a", "A", "x" * 700 + ".", 1), ("a", "A", "y" * 700 + ".", 2), ("b", "B", "small.", 1), ("c", "flaky", "z" * 1200, 1)], "identity string, name string, description string, at long")
    got = {r.identity: r.description for r in model.overflowing(rows, model.Model(shorter)).collect()}
    assert got == {"a": "short", "c": "z" * 1000}


def test_local_context_and_matchers(spark, g):
    q = asked(spark, "What did Charles build?", "zzz")
    found = retrieval.local(q, g)
    assert items(found)[:4] == [("ENTITY", "charles::person"), ("RELATIONSHIP", "ada byron::person->worked_with->charles::person"), ("RELATIONSHIP", "charles::person->built->engine::product"), ("RELATIONSHIP", "charles::person->lived_in->london::location")]
    texts = {r.identifier: r.text for r in found.collect()}
    assert texts["u2"] == "Text of unit 2." and texts["charles::person"] == "Charles (Person): Charles stands here"
    assert {r.q_id: r.status for r in retrieval.status(q, found).collect()} == {1: "MATCHED", 2: "NO_MATCH"}
    none = retrieval.Graph(g.entities, g.relationships, g.units, g.communities.limit(0), g.memberships.limit(0))
    assert {r.status for r in retrieval.status(q, found.limit(0), none).collect()} == {"NO_COMMUNITIES"}
    chain = retrieval.chained(retrieval.by_identifier, retrieval.by_keyword)
    assert {r.identity for r in chain(q, g, 3).collect()} >= {"charles::person"}
    assert seeds.validated(retrieval.fused(retrieval.by_keyword, retrieval.by_keyword)(q, g, 2)).where("rank = 1").first().identity == "charles::person"
    bad = retrieval.by_keyword(q, g, 3).withColumn("score", F.lit(float("nan")))
    with pytest.raises(Exception, match="finite"):
        seeds.validated(bad).collect()


def test_expansion_orders(spark, g):
    start = spark.createDataFrame([(1, "charles::person", 1.0, 1)], "q_id long, identity string, score double, rank int")
    kinds = lambda **o: [r.identifier.split("->")[1] for r in graph.expand(start, g.relationships, graph.Budget(neighbours=False, **o)).where("kind = 'RELATIONSHIP'").orderBy("hop", "pos").collect()]
    assert kinds(order="WEIGHT_ASC") == ["lived_in", "built", "worked_with"]
    assert kinds(order="STORED") == ["worked_with", "built", "lived_in"]
    assert kinds(columns=[F.asc("type")]) == ["built", "lived_in", "worked_with"]
    assert kinds(order="NEW_NODES_FIRST", hops=2)[:3] == ["worked_with", "built", "lived_in"]


def test_global_context_shares_no_unit(spark, g):
    found = retrieval.global_(asked(spark, "Engine and London"), g)
    rows = items(found)
    assert {i for k, i in rows if k == "COMMUNITY"} == {"community-1", "community-2"}
    units = [i for k, i in rows if k == "TEXT_UNIT"]
    assert len(units) == len(set(units)) == 4 and set(units) == {"u2", "u3", "u4", "u5"}
    assert {(r.community_id, r.unit_id): r.score for r in retrieval.community_units(g).collect()} == {("community-1", "u1"): 1, ("community-1", "u2"): 8, ("community-1", "u3"): 5, ("community-2", "u4"): 1, ("community-2", "u5"): 1}
    assert {(r.community_id, r.identity) for r in updates.key_members(g.memberships, g.relationships, 1).collect()} == {("community-1", "charles::person"), ("community-2", "london::location")}


def test_drift_falls_back_and_warns(spark, g):
    def failing(request):
        raise RuntimeError("down")

    q = asked(spark, "Who made the Engine?")
    spawned = retrieval.branches(q, g, model.Model(failing)).collect()
    assert [(r.branch, r.community_id, "down" in r.warning) for r in spawned] == [(1, "community-1", True)] and spawned[0].sub_question.endswith("made the Engine.")
    lost = model.Model(lambda r: '{"subQuestions":["qqq zzz"]}')
    rows = items(retrieval.drift(q, g, lost))  # a sub-question without seeds starts from those of the question
    assert rows[0] == ("COMMUNITY", "community-1") and ("ENTITY", "engine::product") in rows and len(rows) == len(set(rows))


def test_answers_by_a_model(spark, g):
    def client(request):
        if request.purpose != "ANSWER":
            return model.offline(request)
        if "Paris" in request.messages[0][1].split("Question:")[-1]:
            return "not json"
        numbers = [x.split("]")[0][1:] for x in request.messages[0][1].splitlines() if "Source passage" in x]
        return json.dumps({"answer": f"Yes [1] and [{numbers[-1]}]."})

    q = asked(spark, "What did Charles build?", "zzz", "Paris")
    for mode in ("LOCAL", "GLOBAL", "MAP_REDUCE", "DRIFT"):
        found, context = retrieval.answered(mode, q, g, model.Model(client))
        rows = {r.q_id: r for r in found.collect()}
        last = context.where("q_id = 1 and kind = 'TEXT_UNIT'").orderBy(F.desc("number")).first().identifier
        assert rows[1].status == "ANSWERED" and rows[1].answer == "Yes and [1]." and rows[1].cited == [last], mode
        assert rows[2].status == "NO_CONTEXT" and rows[3].status == "FAILED", mode
    with pytest.raises(ValueError, match="unknown mode"):
        retrieval.answered("SQL", q, g, model.Model())


def test_summaries_reuse_fail_and_stop(spark, g):
    members = g.memberships.join(g.entities.drop("ord"), "identity")
    stored = spark.createDataFrame([], "content_hash string, title string, summary string")

    def client(request):
        if "London" in request.messages[0][1]:
            raise RuntimeError("down")
        return '{"title":"one two three four five six seven","summary":"told"}'

    rows = {r.community_id: r for r in community.summarised(members, g.relationships, stored, model.Model(client)).collect()}
    assert (rows["community-1"].status, rows["community-1"].title, rows["community-1"].summary) == ("GENERATED", "one two three four five six", "told")
    assert rows["community-2"].status == "FAILED" and rows["community-2"].summary.startswith("This community centers on London") and "down" in rows["community-2"].error
    known = spark.createDataFrame([(rows["community-2"].content_hash, "T", "S")], stored.schema)
    again = {r.community_id: (r.status, r.title) for r in community.summarised(members, g.relationships, known, model.Model(client), most=0).collect()}
    assert again["community-2"] == ("REUSED", "T") and again["community-1"][0] == "SKIPPED_BUDGET"
    late = community.summarised(members, g.relationships, stored, model.Model(client), seconds=-1)
    assert {r.status for r in late.collect()} == {"SKIPPED_BUDGET"}
    assert community.outcome(late).first().outcome == "PARTIAL" and community.outcome(late.limit(0)).first().outcome == "EMPTY"
    assert {r.status for r in community.summarised(members, g.relationships, stored, model.Model()).collect()} == {"DETERMINISTIC"}


def test_time_budget_is_kept(spark, g):
    def slow(request):
        time.sleep(3)
        return '{"title":"t","summary":"s"}'

    base = g.memberships.join(g.entities.drop("ord"), "identity")
    members = None
    for k in range(8):
        one = base.withColumn("community_id", F.concat("community_id", F.lit(f"-{k}"))).withColumn("name", F.concat("name", F.lit(str(k))))
        members = one if members is None else members.unionByName(one)
    stored = spark.createDataFrame([], "content_hash string, title string, summary string")
    rows = community.summarised(members, g.relationships, stored, model.Model(slow), seconds=0.3, parallelism=2).groupBy("status").count().collect()
    counts = {r.status: r["count"] for r in rows}
    assert sum(counts.values()) == 16 and counts.get("GENERATED", 0) <= 2 and counts["SKIPPED_BUDGET"] >= 14


def stored_graph(spark, g, path):
    store = Store(spark, str(path))
    here = F.lit("c").alias("corpus_id")
    tables = {
        "text_units": g.units.select(here, "id", "document_name", F.lit(0).alias("ordinal"), "text", F.create_map(F.lit("source"), F.when(F.col("id").isin("u3", "u4"), "b").otherwise("a")).alias("attributes"), "ord"),
        "entities": g.entities.select(here, "*").where("name <> 'Loom'"),
        "relationships": g.relationships.select(here, "*").withColumns({"source_type": F.initcap(F.substring_index("src_id", "::", -1)), "target_type": F.initcap(F.substring_index("tgt_id", "::", -1))}),
        "communities": g.communities.select(here, "*").limit(0),
        "memberships": g.memberships.select(here, "*").limit(0),
    }
    detect = lambda nodes, edges: community.detected(nodes, edges)
    embed = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    return store, tables, updates.import_whole(store, "c", tables, detect=detect, embed=embed)


def test_import_remove_replace_and_recompute(spark, g, tmp_path):
    store, tables, counts = stored_graph(spark, g, tmp_path / "g")
    assert counts["entities"] == 6 and counts["relationships"] == 4 and counts["communities"] >= 2  # the loom came as the end of an edge
    assert store.table("entity_embeddings", "c").count() == 6 and store.table("community_embeddings", "c").count() == counts["communities"]
    assert {r.unit_id for r in store.mentions("c").collect()} == {"u1", "u2", "u3", "u4"}
    removed, added = updates.replace_source(store, "c", "b", {k: (v if k != "relationships" else v.where("type = 'built'")) for k, v in tables.items() if k != "entities"} | {"entities": tables["entities"].where("name = 'Paris'")})
    assert removed["units"] == 2 and removed["entities"] == 1 and removed["edges"] == 2  # london, and the edges that cite only its source
    left = {r.identity: r.unit_ids for r in store.table("entities", "c").collect()}
    assert "london::location" not in left and left["engine::product"] == ["u2"] and added["entities"] >= 1
    assert {r.type for r in store.table("relationships", "c").collect()} == {"worked_with", "built", "inspired"}
    told = []
    first = community.recomputed(store, "c", model.Model(model.offline), least=1, progress=lambda kind, data: told.append(kind))
    assert first["outcome"] == "COMPLETE" and first["generated"] == first["communities"] and told[-1] == "ingestion-complete" and told.count("community-detected") == first["communities"]
    again = community.recomputed(store, "c", model.Model(model.offline), least=1, detector=lambda ids, edges: [list(range(len(ids)))])
    assert again["communities"] == len(left) and store.violations().isEmpty()
    one = store.table("communities", "c").count()
    assert community.recomputed(store, "c", model.Model(), least=1)["communities"] == first["communities"] != one


def test_read_graph_files(spark, g, tmp_path):
    g.entities.drop("ord").write.json(str(tmp_path / "entities"))
    tables = updates.read_graph(spark, str(tmp_path), "x", "json")
    assert tables["entities"].count() == 6 and tables["relationships"].isEmpty() and tables["entities"].first().corpus_id == "x"


def test_store_traces_cache_and_retype(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    step = lambda *ids: spark.createDataFrame([("c", t, 0, "ENTITY") for t in ids], "corpus_id string, trace_id string, step_no int, kind string")
    store.put_trace(step("t1"), most=2)
    store.put_trace(step("t2"), most=2)
    assert store.trace("c", "t1").count() == 1  # a read keeps it
    store.put_trace(step("t3"), most=2)
    assert {r.trace_id for r in store.table("trace_steps", "c").collect()} == {"t1", "t3"}
    people = spark.createDataFrame([("c", "Ada", "Person", 0), ("c", "Ada", "Robot", 1)], "corpus_id string, name string, type string, ord long")
    store.put_entities(people)
    first = store.cached("entities", "c")
    assert store.cached("entities", "c") is first and store.cached("entities", "c", seconds=0) is not first
    store.retype("c", "ada::person", "Ada", "Robot")
    assert [r.identity for r in store.table("entities", "c").collect()] == ["ada::robot"] and store.violations().isEmpty()
    store.put_memberships(spark.createDataFrame([("c", " ", "bob::person", 0)], "corpus_id string, community_id string, identity string, ord long"))
    assert store.table("communities", "c").first().summary == "Community cluster" and store.table("entities", "c").where("name = 'bob'").first().type == "Person"
    chunks = spark.createDataFrame([("c", "k1", "t", None, [1.0], [1.0]), ("c", "k2", "t", "d", [1.0], [1.0])], "corpus_id string, id string, text string, document_name string, embedding array<float>, projection array<double>")
    store.put_chunks(chunks)
    store.delete_chunks("c", "d")
    assert [r.id for r in store.table("chunks", "c").collect()] == ["k1"]


def test_comparison_with_vector_search(spark, g):
    q = asked(spark, "What did Charles build?", "zzz")
    context = retrieval.local(q, g)
    chunks = spark.createDataFrame([("c1", "doc0", "of  unit 2."), ("c2", None, "Text of unit"), ("c3", "doc1", "elsewhere"), ("c4", "doc0", " ")], "id string, document_name string, text string")
    ranking = spark.createDataFrame([(1, f"c{k}", k, k < 5) for k in range(1, 5)], "q_id long, chunk_id string, rank int, used boolean")
    cited = spark.createDataFrame([(1, "u2")], "q_id long, unit_id string")
    rows, passages = compare.compared(q, context, ranking, chunks, g.units, cited)
    assert {r.chunk_id: (r.shared, r.cited) for r in passages.collect()} == {"c1": (True, True), "c2": (True, True), "c3": (False, False), "c4": (False, False)}
    by = {r.q_id: r for r in rows.collect()}
    assert (by[1].passages, by[1].shared, by[2].passages) == (4, 2, 0)
    assert by[1].verdict.endswith("2 of the 4 passages Vector Search retrieved were also read by GraphRAG.")
    assert by[2].verdict == "Both sides retrieved passages from the same number of distinct documents (0). Both sides retrieved the same number of context items (0). Vector Search retrieved no passages to compare."
    uses = compare.uses_of("Vector", spark.createDataFrame([("c1", 1), ("c3", 2)], "passage string, rank int"), spark.createDataFrame([("c1",)], "passage string"), spark.createDataFrame([("c1", 1)], "passage string, citation int"))
    inside = spark.createDataFrame([("c1", "u2")], "chunk_id string, unit_id string")
    table = {r.passage: r for r in compare.evidence(compare.as_units(uses, inside), uses).collect()}
    assert table["u2"].cited_by == 1 and table["u2"].n == 1 and table["c3"].in_context_of == 0
    clock = compare.Clock()
    clock.timed("llm", lambda: time.sleep(0.02))()
    timing = clock.timing()
    assert timing["llm_calls"] == 1 and timing["llm_ms"] >= 15 and timing["total_ms"] >= timing["llm_ms"] + timing["retrieval_ms"] - 2
    assert [r.line for r in compare.log_lines(spark.createDataFrame([(1, None)], "q_id long, error string")).collect()] == ['{"q_id":1,"error":null}']
    runs = compare.compare_all({"Local": lambda: context, "Vector": lambda: 1 / 0, "None": lambda: context.limit(0)})
    assert [r["outcome"] for r in runs] == ["ANSWERED", "FAILED", "NO_ANSWER"]
    steps = spark.createDataFrame([("t", 0, "COMMUNITY"), ("t", 1, "SUB_QUESTION_SPAWNED"), ("v", 0, "VECTOR_CHUNK")], "trace_id string, step_no int, kind string")
    assert {r.trace_id: r.mode for r in compare.modes(steps).collect()} == {"t": "DRIFT", "v": "VECTOR"}


def test_writes_touch_the_buckets_of_their_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "b"), buckets=16)
    named = lambda ids: spark.createDataFrame([("c", f"N{k}", "T", f"about {k}", k) for k in ids], "corpus_id string, name string, type string, description string, ord long")
    store.put_entities(named(range(200)))
    edges = spark.createDataFrame([("c", f"n{k}::t", "r", f"n{k + 1}::t", f"N{k}", "T", f"N{k + 1}", "T", 1, k) for k in range(199)], "corpus_id string, src_id string, type string, tgt_id string, source string, source_type string, target string, target_type string, weight long, ord long")
    store.upsert("relationships", edges)

    def files(table):
        return {str(f) for f in (tmp_path / "b" / table).rglob("*.parquet")}

    before = files("entities")
    store.put_entities(named([7]).withColumn("description", F.lit("new")))
    after = files("entities")
    assert len(after - before) == 1 and len(before - after) == 1 and len(before) == 16
    assert {r.description for r in store.table("entities", "c").where("name = 'N7'").collect()} == {"new"} and store.table("entities", "c").count() == 200
    before = files("relationships")
    store.retype("c", "n7::t", "Seven", "Number")
    assert len(files("relationships") - before) <= 4
    assert {(r.src_id, r.tgt_id) for r in store.table("relationships", "c").where("source = 'Seven' or target = 'Seven'").collect()} == {("n6::t", "seven::number"), ("seven::number", "n8::t")}
    before = files("relationships")
    store.delete_entities("c", spark.createDataFrame([("n100::t",)], "identity string"))
    assert len(files("relationships") - before) <= 4 and store.table("relationships", "c").count() == 197 and store.table("entities", "c").count() == 199
    assert store.violations().isEmpty()


def test_roles_of_steps_in_every_mode(spark):
    runs = {
        "local": ["ENTITY", "ENTITY", "RELATIONSHIP", "ENTITY"],
        "read": ["ENTITY", "RELATIONSHIP", "TEXT_UNIT", "TEXT_UNIT"],
        "global": ["COMMUNITY", "TEXT_UNIT", "COMMUNITY"],
        "drift": ["COMMUNITY", "COMMUNITY", "SUB_QUESTION_SPAWNED", "ENTITY", "RELATIONSHIP", "ENTITY", "SUB_QUESTION_SPAWNED", "ENTITY", "SYNTHESIS"],
        "none": ["COMMUNITY", "SYNTHESIS"],
        "vector": ["VECTOR_QUERY_EMBEDDED", "VECTOR_CHUNK", "VECTOR_CHUNK", "SYNTHESIS"],
    }
    names = {"drift": ["a", "b", "b", "", "", "", "c", "", ""]}
    steps = spark.createDataFrame([(t, 10 * k, kind, names[t][k] if t in names else str(k), "") for t, kinds in runs.items() for k, kind in enumerate(kinds)], "trace_id string, step_no int, kind string, identifier string, label string")
    got = {}
    for r in compare.staged(steps).orderBy("trace_id", "place").collect():
        got.setdefault((r.trace_id, r.mode), []).append((r.role, r["rank"]))
    assert got["local", "LOCAL"] == [("SEED", 1), ("SEED", 2), ("HOP", 1), ("END", 1)]
    assert got["read", "LOCAL"] == [("SEED", 1), ("FACT", 1), ("PASSAGE", 1), ("PASSAGE", 2)]
    assert got["global", "GLOBAL"] == [("COMMUNITY", 1), ("PASSAGE", 1), ("COMMUNITY", 2)]
    assert got["drift", "DRIFT"] == [("COMMUNITY", None), ("COMMUNITY", 1), ("SPAWN", 1), ("SEED", 1), ("HOP", 1), ("END", 1), ("SPAWN", 1), ("SEED", 1), ("SYNTHESIS", 1)]
    assert [x[0] for x in got["none", "DRIFT"]] == ["COMMUNITY", "SYNTHESIS"] and got["vector", "VECTOR"][1:3] == [("CHUNK", 1), ("CHUNK", 2)]
    phases = [(r.title, r.start, r.end) for r in compare.segments(steps).where("trace_id = 'drift'").orderBy("start").collect()]
    assert phases == [("Community pass", 0, 2), ("Branch 1 of 2", 2, 6), ("Branch 2 of 2", 6, 8), ("Synthesis", 8, 9)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_read_where_they_lie(spark, g):
    """Only edges that touch the frontier go on, and of texts only those of what was picked."""
    start = spark.createDataFrame([(1, "charles::person"), (2, "loom::product")], "q_id long, identity string")
    near = graph.from_frontier(g.relationships, start)
    assert sorted((r.q_id, r.ord) for r in near.collect()) == [(1, 0), (1, 1), (1, 2), (2, 3)]
    assert "ExistingRDD" not in _plan(near)
    picked = spark.createDataFrame([(1, 1, "RELATIONSHIP", "charles::person->built->engine::product", 1.0, 1)], "q_id long, number int, kind string, identifier string, score double, hop int")
    told = retrieval.with_texts(picked, g)
    assert [r.text for r in told.collect()] == ["Charles -[built]-> Engine"] and "LeftSemi" in _plan(told)


def test_candidates_are_dealt_once_for_all_questions(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)]
    rows = spark.createDataFrame([(k, " ".join(words[: k + 1])) for k in range(80)] + [(3, " ".join(words[:4]))], "ord long, name string")
    scored = seeds.keyword_scores(asked(spark, " ".join(words), words[5], " ".join(words[:70])), rows, F.col("name"))
    assert "hashpartitioning(q_id" not in _plan(scored)
    got = {(r.q_id, r.ord): r.score for r in scored.collect()}
    assert scored.count() == len(got)
    for q, few in ((1, words), (2, words[5:6]), (3, words[:70])):
        for k in range(80):
            have = words[: k + 1]
            near = lambda t: any(len(t) == len(w) and sum(a != b for a, b in zip(t, w, strict=True)) <= (1 if len(t) < 7 else 2) for w in have)
            want = sum(2 if t in have else 1 if near(t) else 0 for t in few)
            assert got.get((q, k), 0) == want


def test_branches_and_questions_look_for_seeds_together(spark, g):
    calls = []

    def matcher(questions, graph_, limit):
        calls.append(1)
        return retrieval.by_keyword(questions, graph_, limit)

    assert retrieval.drift(asked(spark, "What did Ada make?"), g, matcher=matcher).count() > 1 and len(calls) == 1


def test_internal_edges_are_found_once_for_a_global_context(spark, g, monkeypatch):
    calls, inner = [], graph.internal_edges
    monkeypatch.setattr(graph, "internal_edges", lambda *a: calls.append(1) or inner(*a))
    assert retrieval.global_(asked(spark, "What did Ada make?"), g).count() > 1 and len(calls) == 1


def test_kinds_that_nobody_knows_need_no_look_up(spark):
    edges = spark.createDataFrame([("a::x", "b::y"), ("a::x", "c::x"), ("a::x", "a::x"), ("d::z", "a::x"), (None, "a::x")], "src_id string, tgt_id string")
    known = spark.createDataFrame([("a::x",), ("e::x",)], "identity string")
    missing = spark.createDataFrame([("b::y",), ("c::x",), ("d::z",)], "identity string")
    kept = graph.complete_edges(edges, missing, known)
    assert sorted(str(r.src_id) for r in kept.collect()) == sorted(str(r.src_id) for r in graph.complete_edges(edges, missing).collect()) == ["None", "a::x"]
