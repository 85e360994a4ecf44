"""A graph over the order tables: customers, suppliers, parts, nations and regions with weighted edges, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import maps

_KIND, _EDGE = 10**10, 10**9

#: At most this many suppliers are broadcast to the edges; more are joined by a shuffle.
SUPPLIERS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identity, name, type, description, unit_ids, attributes, ord); the order is by type and key."""

    def rows(t: str, number: int, kind: str, key: str, name, attribute, nation) -> DataFrame:
        unit = F.array(F.concat(F.lit("nation-"), F.col(nation).cast("string"))) if nation else F.array().cast("array<string>")
        return table(spark, sf_dir, t).select(name.alias("name"), F.lit(kind).alias("type"), unit.alias("unit_ids"), F.create_map(F.lit("group"), attribute.cast("string")).alias("attributes"), (F.lit(number) * _KIND + F.col(key)).cast("long").alias("ord"))

    part = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    out = rows("customer", 0, "Customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment"), "c_nationkey")
    out = out.unionByName(rows("nation", 1, "Nation", "n_nationkey", F.col("n_name"), F.col("n_regionkey"), "n_nationkey"))
    out = out.unionByName(rows("part", 2, "Part", "p_partkey", part, F.col("p_brand"), None))
    out = out.unionByName(rows("region", 3, "Region", "r_regionkey", F.col("r_name"), F.col("r_name"), None))
    out = out.unionByName(rows("supplier", 4, "Supplier", "s_suppkey", F.col("s_name"), F.col("s_nationkey"), "s_nationkey"))
    return out.select(maps.identity(F.col("name"), F.col("type")).alias("identity"), "name", "type", F.lit("").alias("description"), "unit_ids", "attributes", "ord")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, type, tgt_id, source, source_type, target, target_type, description, unit_ids, weight, ord).

    Order lines are dealt once by the customer and once by the part, and counted and named where they lie then.
    """
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    bought = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").repartition("o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("weight"))
    supplied = lines.select("l_suppkey", "l_partkey").repartition("l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    customers, suppliers = t("customer").select("c_custkey", "c_name", "c_nationkey"), t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    parts = t("part").select("p_partkey", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("p"))
    nations, regions = t("nation"), t("region")
    sellers = F.broadcast(suppliers) if suppliers.count() <= SUPPLIERS else suppliers

    def edge(rows: DataFrame, number: int, kind: str, source: tuple[str, str, str], target: tuple[str, str, str], weight) -> DataFrame:
        (sk, sn, st), (tk, tn, tt) = source, target
        ord_ = F.lit(number) * F.lit(10**18) + F.col(sk).cast("long") * _EDGE + F.col(tk).cast("long")
        return rows.select(F.col(sn).alias("source"), F.lit(st).alias("source_type"), F.lit(kind).alias("type"), F.col(tn).alias("target"), F.lit(tt).alias("target_type"), weight.cast("long").alias("weight"), ord_.alias("ord"))

    one = F.lit(1)
    buyer, seller = ("o_custkey", "c_name", "Customer"), ("l_suppkey", "s_name", "Supplier")
    out = edge(bought.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")), 0, "BUYS_FROM", buyer, seller, F.col("weight"))
    out = out.unionByName(edge(supplied.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")), 1, "SUPPLIES", seller, ("l_partkey", "p", "Part"), F.col("weight")))
    out = out.unionByName(edge(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")), 2, "LOCATED_IN", ("c_custkey", "c_name", "Customer"), ("n_nationkey", "n_name", "Nation"), one))
    out = out.unionByName(edge(suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")), 3, "LOCATED_IN", ("s_suppkey", "s_name", "Supplier"), ("n_nationkey", "n_name", "Nation"), one))
    out = out.unionByName(edge(nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")), 4, "PART_OF", ("n_nationkey", "n_name", "Nation"), ("r_regionkey", "r_name", "Region"), one))
    ids = {"src_id": maps.identity(F.col("source"), F.col("source_type")), "tgt_id": maps.identity(F.col("target"), F.col("target_type"))}
    return out.withColumns(ids).withColumn("description", F.lit("")).withColumn("unit_ids", F.array(F.lower("type")))


SQL = """
ents AS (
  SELECT lower(name) || '::' || lower(type) AS identity, name, type, grp, nk, ord FROM (
    SELECT c_name AS name, 'Customer' AS type, c_mktsegment AS grp, c_nationkey AS nk, CAST(c_custkey AS BIGINT) AS ord FROM customer
    UNION ALL SELECT n_name, 'Nation', CAST(n_regionkey AS VARCHAR), n_nationkey, 10000000000 + n_nationkey FROM nation
    UNION ALL SELECT p_name || '#' || CAST(p_partkey AS VARCHAR), 'Part', p_brand, NULL, 20000000000 + p_partkey FROM part
    UNION ALL SELECT r_name, 'Region', r_name, NULL, 30000000000 + r_regionkey FROM region
    UNION ALL SELECT s_name, 'Supplier', CAST(s_nationkey AS VARCHAR), s_nationkey, 40000000000 + s_suppkey FROM supplier)),
rels AS (
  SELECT lower(source) || '::' || lower(source_type) AS src_id, type, lower(target) || '::' || lower(target_type) AS tgt_id, source, source_type, target, target_type, weight, ord FROM (
    SELECT c_name AS source, 'Customer' AS source_type, 'BUYS_FROM' AS type, s_name AS target, 'Supplier' AS target_type, weight, o_custkey * 1000000000 + l_suppkey AS ord
      FROM (SELECT o_custkey, l_suppkey, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    UNION ALL SELECT s_name, 'Supplier', 'SUPPLIES', p_name || '#' || CAST(p_partkey AS VARCHAR), 'Part', weight, 1000000000000000000 + l_suppkey * 1000000000 + l_partkey
      FROM (SELECT l_suppkey, l_partkey, count(*) AS weight FROM lineitem GROUP BY ALL) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT c_name, 'Customer', 'LOCATED_IN', n_name, 'Nation', 1, 2000000000000000000 + c_custkey * 1000000000 + n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT s_name, 'Supplier', 'LOCATED_IN', n_name, 'Nation', 1, 3000000000000000000 + s_suppkey * 1000000000 + n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, 'Nation', 'PART_OF', r_name, 'Region', 1, 4000000000000000000 + CAST(n_nationkey AS BIGINT) * 1000000000 + r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey))
"""

#: A batch of questions about the graph.
QUESTIONS = (
    (1, "Who buys from Supplier#000000007?"),
    (2, "Where is Customer#000000011 located?"),
    (3, "What belongs to the AFRICA region?"),
    (4, "Which nation is NATION_3 part of"),
    (5, "small ring supplies"),
    (6, "Tell me about Custmer#000000012 and EUROP"),
    (7, "zzz qqq"),
)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "q_id long, question string")


QUESTIONS_SQL = "questions AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{q}')" for k, q in QUESTIONS) + ") AS t(q_id, question))"
TOKENS_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: length(t) > 2))"
ALLOW_SQL = "CASE WHEN length(tok) >= 7 THEN 2 WHEN length(tok) >= 4 THEN 1 ELSE 0 END"


def scores_sql(candidates: str, text: str, keys: str) -> str:
    """CTE ``kw`` (q_id, keys, score): keyword scores of the rows of ``candidates``."""
    words = TOKENS_SQL.format("t")
    return f"""
cand AS (SELECT {keys}, t, {words} AS words FROM (SELECT {keys}, {text} AS t FROM {candidates})),
qtok AS (SELECT q_id, unnest({TOKENS_SQL.format('question')}) AS tok FROM questions),
kw AS (SELECT q_id, {keys}, CAST(sum(CASE WHEN contains(lower(t), tok) THEN 2 WHEN ({ALLOW_SQL}) > 0 AND
    list_bool_or(list_prepend(false, list_transform(words, lambda w: levenshtein(tok, w) <= ({ALLOW_SQL})))) THEN 1 ELSE 0 END) AS BIGINT) AS score
  FROM qtok, cand GROUP BY ALL HAVING score > 0)"""
