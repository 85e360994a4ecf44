import pytest
from pyspark.sql import functions as F

from quillgraph.functions import lenient_json, maps
from quillgraph.functions import text as tx
from quillgraph.functions import vectors as vx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_keyword_score(spark):
    score = lambda q, c: one(spark, tx.keyword_score(tx.tokens(F.col("q")), F.col("c")), q=q, c=c)
    assert score("Who is Sherlock Holmes?", "Sherlock Holmes") == 4
    assert score("Shelock", "Sherlock") > 0
    assert score("abc", "abd") == 0


def test_identifiers(spark):
    norm = lambda s: one(spark, tx.normalized_identifier(F.col("s")), s=s)
    parts = lambda s: one(spark, tx.identifier_parts(F.col("s")), s=s)
    assert norm("com.acme.OrderService#placeOrder(Order)") == "com.acme.orderservice.placeorder"
    assert norm("Outer$Inner") == "outer.inner"
    assert parts("getHTTPResponseCode") == ["get", "http", "response", "code"]
    assert parts("utf8 base64 v2") == ["utf", "base", "64"]
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, tx.identifiers(F.col("s")), s="Who calls a.B#c(x, y) or Q::z?") == ["Who", "calls", "a.B#c(x, y)", "or", "Q::z"]
    assert [one(spark, tx.is_code_like(F.col("s")), s=s) for s in ("placeOrder", "Order", "a_b", "x", "Q::z")] == [True, False, True, False, True]


def test_citations():
    units = [3, 4, 5]
    resolve = lambda s: tx.resolve_citations(s, units)[0]
    assert resolve("Both [5, 3] and [2, 4] and [1,6].") == "Both [1, 2] and [3] and."
    assert resolve("All three [4-6].") == "All three [1, 2]."
    assert resolve("Both [4; 5] but not [1; 6], then [3;4-5].") == "Both [1, 2] but not, then [3, 1, 2]."
    assert tx.resolve_citations(None, units) == ("", [])


def test_splitters():
    assert [len(x) for x in tx.chunk_texts("x" * 700)] == [500, 200]
    pieces = tx.unit_texts("x" * 15000)
    assert max(map(len, pieces)) <= 6000
    assert sum(map(len, pieces)) == 15000 + (len(pieces) - 1) * 600
    assert tx.unit_texts(" \n") == [] and tx.chunk_texts(None) == []
    text = "a" * 4000 + "\n\n" + "b" * 4000
    assert tx.unit_texts(text)[0] == "a" * 4000 + "\n\n"
    words = ("word. " * 2000).strip()
    units = tx.unit_texts(words)
    assert units[0].endswith(". ") and all(u.startswith("word.") for u in units)


def test_first_sentences_and_name_keys():
    assert tx.first_sentences_of("Mr. Holmes met J. Watson. He left. Then.", 1) == "Mr. Holmes met J. Watson."
    assert tx.first_sentences_of("e.g. this one! Two.", 2) == "e.g. this one! Two."
    assert tx.name_key_of("“Sherlock   Holmes”,") == "sherlock holmes"
    assert tx.name_key_of("ﬁle") == "file"
    assert tx.name_key_of("!!") == "!!"


def test_sentences_excerpts_locators(spark):
    assert one(spark, tx.sentences(F.col("s")), s="One. Two!  Three? ") == ["One.", "Two!", "Three?"]
    assert one(spark, tx.excerpt(F.col("s"), 5), s=" ab  cdef ") == "ab cd…"
    assert tuple(one(spark, tx.locator_struct(F.col("s")), s="src/A.java:12-3")) == ("src/A.java", 12, 12)
    assert one(spark, tx.locator_text(tx.locator_struct(F.col("s"))), s="a:3-9") == "a:3-9"
    assert one(spark, tx.not_in_context(F.col("s")), s='"NOT_IN_CONTEXT".')


def test_maps(spark):
    attrs = maps.attributes(F.create_map(F.lit(" b "), F.lit("1"), F.lit(""), F.lit("2"), F.lit("a"), F.lit("3")))
    assert one(spark, F.to_json(attrs)) == '{"a":"3","b":"1"}'
    a, b = F.create_map(F.lit("k"), F.lit("1")), F.create_map(F.lit("k"), F.lit("2"), F.lit("j"), F.lit("3"))
    assert one(spark, F.to_json(maps.union_attributes(a, b))) == '{"j":"3","k":"1"}'
    assert one(spark, maps.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit(" "), F.lit("c")))) == ["b", "a", "c"]
    assert one(spark, maps.entity_type(F.col("s")), s=" person ") == "Person"
    assert one(spark, maps.entity_type(F.col("s")), s="thing") == "Concept"
    assert one(spark, maps.corpus_name(F.array(*map(F.lit, "abcde")))) == "a, b, c +2 more"


def test_vectors(spark):
    assert one(spark, vx.bucket(F.lit("holmes"))) == 54 == vx._bucket_of("holmes")
    assert one(spark, vx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, vx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert sum(x * x for x in one(spark, vx.hash_embedding(F.col("s")), s="the cat the")) == pytest.approx(1, abs=1e-6)
    assert sum(one(spark, vx.hash_embedding(F.col("s")), s=" ")) == 0


@pytest.mark.parametrize(
    ("said", "read"),
    [
        ('Sure:\n```json\n{"a": 1}\n```', '{"a":1}'),
        ("{'a': 'x', b: [1, 2,], }", '{"a":"x","b":[1,2]}'),
        ('{"a": "x" "b": true', '{"a":"x","b":true}'),
        ('{"a": {"b": [1, {"c": "d', '{"a":{"b":[1,{"c":"d"}]}}'),
        ("no object", None),
        (None, None),
        ("{" * 2000, None),
    ],
)
def test_lenient_json(said, read):
    found = lenient_json.parse_object(said)
    assert (found is None if read is None else lenient_json.to_json(found) == read)


def test_attributes_are_worked_out_once_a_row(spark):
    a = F.create_map(F.lit(" b "), F.lit("1"), F.lit("b"), F.lit("2"), F.lit(""), F.lit("x"), F.lit("a"), F.lit(None).cast("string"))
    rows = spark.range(1).select(maps.union_attributes(maps.attributes(a), F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("3"))).alias("m"))
    assert rows.first().m == {"b": "1", "c": "3"}
    assert rows._jdf.queryExecution().analyzed().toString().count("map_entries") == 2  # one for each map that is put in order


def test_hash_vectors_take_little_memory():
    import tracemalloc

    texts = ["some words of a text, told again " * 400] * 300
    tracemalloc.start()
    got = vx.hash_vectors(texts)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert (got == vx.hash_vectors(texts[:1])).all()
