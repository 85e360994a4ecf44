"""Queries over vectors, texts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import lenient_json
from quillgraph.functions import text as tx
from quillgraph.functions import vectors as vx
from quillgraph.operators import answers, embed, seeds
from quillgraph.operators.tables import shared_dir, written
from quillgraph.plans.trade import table
from quillgraph.sources import readers
from quillgraph.sources.store import Store

TOP, RANKED = 5, 12


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question's vector: the one of the first embedded row."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(1).cast("long").alias("q_id"), F.col("embedding").alias("vector"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), "embedding", "label")


def q01_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = answers.vector_ranking(_query_vector(spark, sf_dir), _embedded(spark, sf_dir), TOP, TOP)
    return ranked.select(F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_RANKED = f"ranked AS (SELECT e.vec_id, {_COS} AS s, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
Q01 = f"WITH {_RANKED} SELECT vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"


def q02_vector_ranking12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = answers.vector_ranking(_query_vector(spark, sf_dir), _embedded(spark, sf_dir), RANKED, TOP)
    return ranked.select(F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), "rank", "used")


Q02 = f"WITH {_RANKED} SELECT vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank, rank <= 5 AS used FROM ranked WHERE rank <= 12"


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("docs").alias("corpus_id"), F.col("doc_id").alias("doc_idx"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), F.col("text").alias("content"))


def q04_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.chunks(corpus_documents(spark, sf_dir)).select("ordinal", F.col("document_name").alias("document"), F.md5("text").alias("digest"))


_CHUNKS = r"""RECURSIVE cut AS (
  SELECT doc_id, text, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS len, 0 AS n FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, pos + len, CASE WHEN pos + len - 1 + 500 >= length(text) THEN length(text) - (pos + len) + 1
      WHEN strpos(reverse(substr(text, pos + len, 500)), ' ') BETWEEN 1 AND 249 THEN 501 - strpos(reverse(substr(text, pos + len, 500)), ' ') ELSE 500 END, n + 1
  FROM cut WHERE pos + len <= length(text)),
chunked AS (SELECT doc_id, n, trim(substr(text, pos, len), e' \n\t\r') AS piece FROM cut WHERE len > 0),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id, n) - 1 AS ordinal, doc_id, piece FROM chunked WHERE piece <> '')
"""
Q04 = f"WITH {_CHUNKS} SELECT ordinal, 'doc-' || CAST(doc_id AS VARCHAR) AS document, md5(piece) AS digest FROM numbered"


def q05_textunit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.text_units(corpus_documents(spark, sf_dir)).select("id", "ordinal", F.length("text").alias("size"), F.md5("text").alias("digest"))


#: One step of the recursion cuts the next unit of every document; places count from 0.
Q05 = r"""WITH RECURSIVE u AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, -1 AS n, false AS over FROM documents WHERE trim(text, e' \n\t\r') <> ''
  UNION ALL SELECT doc_id, text, a, cut, n + 1, cut = length(text) AND a + 6000 >= length(text) FROM (
    SELECT *, CASE WHEN a + 6000 >= length(text) THEN length(text)
        WHEN regexp_matches(back, '\s[.!?]') THEN a + 6000 - length(regexp_extract(back, '^((?s:.*?))\s[.!?]', 1))
        WHEN regexp_matches(back[:3000], '\s') THEN a + 6000 - length(regexp_extract(back, '^(\S*)\s', 1)) ELSE a + 6000 END AS cut FROM (
      SELECT doc_id, text, n, a, reverse(substr(text, a + 3000, 3001)) AS back FROM (
        SELECT doc_id, text, n, CASE WHEN n < 0 THEN 0 WHEN regexp_matches(substr(text, b - 600, 1), '\s') OR NOT regexp_matches(tail, '\s') THEN b - 600
            ELSE b - 600 + length(regexp_extract(tail, '^\S*\s')) END AS a
        FROM (SELECT *, substr(text, b - 599, 600) AS tail FROM u) WHERE NOT over))))
SELECT 'docs::doc-' || doc_id || '::tu-' || n AS id, n AS ordinal, CAST(b - a AS INTEGER) AS size, md5(substr(text, a + 1, b - a)) AS digest FROM u WHERE n >= 0"""


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.chunks(corpus_documents(spark, sf_dir)).withColumn("embedding", vx.hash_embedding(F.col("text"))).withColumn("ord", F.col("ordinal"))


def q06_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    return _chunk_vectors(spark, sf_dir).select("ordinal", F.array_join(tenths, ",").alias("vector"))


_VECTORS = """tok AS (SELECT ordinal, unnest(list_filter(string_split_regex(lower(piece), '\\W+'), lambda t: t <> '')) AS t FROM numbered),
hashed AS (SELECT ordinal, list_reduce(list_prepend(0, list_transform(string_split(t, ''), lambda c: ascii(c))), lambda a, c: (a * 31 + c) % 64) AS b FROM tok),
cells AS (SELECT ordinal, b, count(*) AS n FROM hashed GROUP BY ALL),
norms AS (SELECT ordinal, sqrt(sum(n * n)) AS norm FROM cells GROUP BY ordinal),
dims AS (SELECT ordinal, d, coalesce(n, 0) / coalesce(norm, 1) AS v FROM numbered CROSS JOIN range(64) r(d) LEFT JOIN cells USING (ordinal) LEFT JOIN norms USING (ordinal) WHERE coalesce(b, d) = d OR true),
vecs AS (SELECT o.ordinal, list(coalesce(c.n, 0) / coalesce(norm, 1) ORDER BY d) AS v FROM numbered o CROSS JOIN range(64) r(d) LEFT JOIN cells c ON c.ordinal = o.ordinal AND c.b = d LEFT JOIN norms m ON m.ordinal = o.ordinal GROUP BY o.ordinal)"""
_VECTORS = "\n".join(x for x in _VECTORS.split("\n") if not x.startswith("dims"))
Q06 = f"WITH {_CHUNKS}, {_VECTORS} SELECT ordinal, array_to_string(list_transform(v, lambda x: CAST(round(CAST(x AS FLOAT) * 1000) AS INTEGER)), ',') AS vector FROM vecs"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("q_id"), F.col("text").alias("question"), vx.hash_embedding(F.col("text")).alias("vector"))


def q07_hash_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each benchmark question over all chunks, and how many chunks it was compared with."""
    vectors = written(_chunk_vectors(spark, sf_dir).select("id", "ord", "embedding"))
    ranked = answers.vector_ranking(_asked(spark, sf_dir), vectors, TOP, TOP)
    return ranked.groupBy("q_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"), F.round(F.min("score"), 4).alias("fifth"))


Q07 = f"""WITH {_CHUNKS}, {_VECTORS},
qt AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\W+'), lambda t: t <> '')) AS t FROM benchmark),
qh AS (SELECT item_id, list_reduce(list_prepend(0, list_transform(string_split(t, ''), lambda c: ascii(c))), lambda a, c: (a * 31 + c) % 64) AS b FROM qt),
qc AS (SELECT item_id, b, count(*) AS n FROM qh GROUP BY ALL),
qv AS (SELECT item_id, list(coalesce(n, 0) ORDER BY d) AS q FROM (SELECT item_id FROM benchmark) CROSS JOIN range(64) r(d) LEFT JOIN qc USING (item_id) WHERE false OR true GROUP BY item_id),
qw AS (SELECT i.item_id, list(CAST(coalesce(c.n, 0) AS DOUBLE) ORDER BY d) AS q FROM (SELECT DISTINCT item_id FROM benchmark) i CROSS JOIN range(64) r(d) LEFT JOIN qc c ON c.item_id = i.item_id AND c.b = d GROUP BY i.item_id),
sc AS (SELECT item_id, ordinal, coalesce(nullif(list_cosine_similarity(CAST(v AS DOUBLE[]), q), CAST('nan' AS DOUBLE)), 0) AS s FROM vecs, qw),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, ordinal) AS r FROM sc)
SELECT item_id AS q_id, count(*) AS n, round(max(s), 4) AS best, round(min(s), 4) AS fifth FROM rk WHERE r <= 5 GROUP BY item_id"""
Q07 = "\n".join(x for x in Q07.split("\n") if not x.startswith("qv AS"))


def q92_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index of all documents, built into a store and read back: chunks with their vectors and spots."""
    store = Store(spark, shared_dir(spark))
    chunks = embed.build_index(store, "docs", corpus_documents(spark, sf_dir), embed.OFFLINE)
    milli = lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1000).cast("int")), ",")
    size = F.round(F.sqrt(F.pow(F.col("projection")[0], 2) + F.pow(F.col("projection")[1], 2)), 3)
    return chunks.select("ordinal", F.md5("text").alias("digest"), milli("embedding").alias("vector"), size.alias("away"))


def _axes_sql(vectors: str, key: str) -> str:
    """CTEs for two axes of the vectors ``v`` of a table by thirty power steps each, and every row's place ``x``, ``y`` on them."""
    centre = "list_transform(range(1, 65), lambda d: v[d] - m[d])"
    return f"""mean AS (SELECT list(a ORDER BY d) AS m FROM (SELECT d, avg(CAST(v[d] AS DOUBLE)) AS a FROM {vectors}, range(1, 65) r(d) GROUP BY d)),
pairs AS (SELECT i, j, avg(CAST(v[i] AS DOUBLE) * v[j]) - any_value(m[i]) * any_value(m[j]) AS c FROM {vectors}, mean, range(1, 65) r(i), range(1, 65) s(j) GROUP BY i, j),
cov AS MATERIALIZED (SELECT list(l ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS l FROM pairs GROUP BY i)),
p1 AS (SELECT 0 AS k, list_transform(range(64), lambda i: 1 / sqrt(CAST(64 AS DOUBLE))) AS a UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT k, list_transform(c, lambda l: list_inner_product(l, a)) AS w FROM p1, cov WHERE k < 30)),
one AS MATERIALIZED (SELECT a AS f FROM p1 WHERE k = 30),
p2 AS (SELECT 0 AS k, list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END / sqrt(CAST(64 AS DOUBLE))) AS a UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (
  SELECT k, list_transform(range(1, 65), lambda i: w[i] - list_inner_product(w, f) * f[i]) AS w FROM (SELECT k, f, list_transform(c, lambda l: list_inner_product(l, a)) AS w FROM p2, cov, one WHERE k < 30))),
spots AS (SELECT {key}, list_inner_product({centre}, f) AS x, list_inner_product({centre}, a) AS y FROM {vectors}, mean, one, p2 WHERE k = 30)"""


Q92 = f"""WITH {_CHUNKS}, {_VECTORS}, vf AS MATERIALIZED (SELECT ordinal, list_transform(v, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v FROM vecs), {_axes_sql("vf", "ordinal")}
SELECT ordinal, md5(piece) AS digest, array_to_string(list_transform(v, lambda x: CAST(round(x * 1000) AS INTEGER)), ',') AS vector, round(sqrt(x * x + y * y), 3) AS away FROM numbered JOIN vf USING (ordinal) JOIN spots USING (ordinal)"""


def q03_vector_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline answers to all benchmark questions: chunk, embed, rank, join the passages."""
    docs = readers.chunks(corpus_documents(spark, sf_dir))
    chunks = written(embed.embedded(docs, embed.OFFLINE).withColumn("ord", F.col("ordinal")))
    asked = _asked(spark, sf_dir)
    ranked = written(answers.vector_ranking(asked, chunks.select("id", "ord", "embedding")))
    return answers.vector_answers(asked, ranked, chunks.select("id", "text")).select("q_id", "answer")


_SINGLE = "CAST(CAST({0} AS FLOAT[]) AS DOUBLE[])"
Q03 = Q07.partition("sc AS (")[0] + f"""qn AS (SELECT item_id, list_transform(q, lambda x: x / coalesce(nullif(sqrt(list_inner_product(q, q)), 0), 1)) AS q FROM qw),
sc AS (SELECT item_id, ordinal, coalesce(nullif(round(list_cosine_similarity({_SINGLE.format("v")}, {_SINGLE.format("q")}), 12), CAST('nan' AS DOUBLE)), 0) AS s FROM vecs, qn),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, ordinal) AS r FROM sc)
SELECT item_id AS q_id, '{answers.VECTOR_LEAD}' || string_agg(piece, chr(10) || '---' || chr(10) ORDER BY r) AS answer FROM rk JOIN numbered USING (ordinal) WHERE r <= 5 GROUP BY item_id"""


def q08_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(found), " ")).alias("digest"))


Q08 = "SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS t FROM documents)"


def q16_semantic_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label centroids as entities; every embedded row's label centroid ranking for the first row's vector."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    centre = rows.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("embedding"))
    named = centre.select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("identity"), "embedding", F.col("label").cast("long").alias("ord"))
    return seeds.semantic_matches(_query_vector(spark, sf_dir), named, 3).select("identity", F.round("score", 6).alias("score"), "rank")


Q16 = """WITH x AS (SELECT label, d, avg(CAST(embedding[d] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(d) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY d) AS v FROM x GROUP BY label),
s AS (SELECT label, list_cosine_similarity(v, CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS s FROM c),
r AS (SELECT label, row_number() OVER (ORDER BY s DESC, label) AS rank FROM s)
SELECT 'label-' || CAST(label AS VARCHAR) AS identity, round(1.0 / rank, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


def q57_pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    mean, one, two = vx.projection_model(rows)
    return rows.select("vec_id", F.round(vx.projected(F.col("embedding"), mean, one), 4).alias("x"), F.round(vx.projected(F.col("embedding"), mean, two), 4).alias("y"))


Q57 = f"""WITH RECURSIVE vf AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {_axes_sql("vf", "vec_id")}
SELECT vec_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM spots"""


def q58_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.md5("text").alias("digest"), F.length("text").alias("size"))


def q59_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tx.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"), tx.excerpt(F.col("text")).alias("excerpt"))


Q59 = r"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', e'\\1\x01', 'g'), e'\x01'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM s)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, '|')) AS digest, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 200) || '…' ELSE flat END AS excerpt FROM f"""


def q66_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, damaged in several ways, repaired and read."""
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    kind = F.pmod("event_id", F.lit(5))
    inner = F.expr("substring(props, 2, length(props) - 2)")
    damaged = (
        F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("{"), inner, F.lit(",}")))
        .when(kind == 2, F.replace("props", F.lit('"'), F.lit("'")))
        .when(kind == 3, F.concat(F.lit("{"), F.replace(inner, F.lit('"'), F.lit(""))))
        .otherwise(F.col("props"))
    )
    value = F.get_json_object(lenient_json.repaired(damaged), "$.k")
    return rows.select("event_id", value.cast("long").alias("k"))


Q66 = "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"

QUERIES = {n: f for n, f in globals().items() if n[:1] == "q" and n[1:3].isdigit()}
SQL = {"q01_vector_topk": Q01, "q02_vector_ranking12": Q02, "q03_vector_answer": Q03, "q04_chunk_documents": Q04, "q05_textunit_split": Q05, "q06_hash_embed": Q06, "q07_hash_embed_search": Q07, "q08_tokenize": Q08, "q16_semantic_seed": Q16, "q57_pca_projection": Q57, "q59_sentences": Q59, "q66_lenient_json": Q66, "q92_vector_index": Q92}
