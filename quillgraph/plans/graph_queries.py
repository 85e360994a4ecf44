"""Queries over the trade graph: scores, seeds, reads, merges, communities, answers, comparisons and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import maps
from quillgraph.functions import text as tx
from quillgraph.operators import answers, community, compare, graph, merge, seeds
from quillgraph.operators.tables import written
from quillgraph.plans import trade
from quillgraph.plans.trade import QUESTIONS_SQL, table
from quillgraph.sources import store

E, R = trade.entities, trade.relationships
_G = "WITH " + trade.SQL.strip()
_KW = f"{_G}, {QUESTIONS_SQL}, {trade.scores_sql('ents', chr(39).join(['name || ', ' ', ' || type']), 'identity, ord')}"
_RANKED = f"{_KW}, ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, ord) AS rank FROM kw)"
SQL: dict[str, str] = {}


def q09_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E(spark, sf_dir).select("identity", "name", "type")
    return seeds.keyword_scores(trade.questions(spark), rows, F.concat_ws(" ", "name", "type")).groupBy("q_id", "score").agg(F.count("*").alias("n")).select("q_id", F.col("score").cast("long").alias("score"), "n")


SQL["q09_keyword_score"] = f"{_KW} SELECT q_id, score, count(*) AS n FROM kw GROUP BY ALL"


def q10_keyword_seed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.keyword_matches(trade.questions(spark), E(spark, sf_dir), 3).select("q_id", "identity", "score", "rank")


SQL["q10_keyword_seed_topk"] = f"{_RANKED} SELECT q_id, identity, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3"


def q11_best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = seeds.keyword_scores(trade.questions(spark), E(spark, sf_dir).select("identity", "name", "type", "ord"), F.concat_ws(" ", "name", "type"))
    return scored.groupBy("q_id").agg(F.max_by("identity", F.struct("score", -F.col("ord"))).alias("identity"))


SQL["q11_best_seed"] = f"{_RANKED} SELECT q_id, identity FROM ranked WHERE rank = 1"


def q12_identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("com.acme."), F.regexp_replace("p_type", " ", ""), F.lit("Service#get"), F.initcap(F.split("p_name", " ")[0]), F.lit("V2(int)"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalized_identifier(name).alias("normalized"), F.array_join(tx.identifier_parts(F.regexp_replace(name, r"\(.*$", "")), " ").alias("parts"))


SQL["q12_identifier_parts"] = r"""WITH n AS (SELECT p_partkey, 'com.acme.' || replace(p_type, ' ', '') || 'Service#get' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || 'V2' AS name FROM part),
m AS (SELECT p_partkey, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g') AS s FROM n),
p AS (SELECT p_partkey, name, list_filter(list_transform(string_split_regex(s, '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2) AS l FROM m)
SELECT p_partkey, lower(replace(name, '#', '.')) AS normalized, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS parts FROM p"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic code names: one method per supplier and one class per nation."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("com.acme.n"), F.col("s_nationkey").cast("string"), F.lit(".SupplierStore#find"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("name"), F.col("s_suppkey").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("com.acme.NationIndex"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("ord"))
    rows = s.unionByName(n)
    return rows.select(F.lower("name").alias("identity"), "name", "ord")


_CODE = """code AS (SELECT lower(name) AS identity, name, ord FROM (SELECT 'com.acme.n' || CAST(s_nationkey AS VARCHAR) || '.SupplierStore#find' || lpad(CAST(s_suppkey AS VARCHAR), greatest(3, 3), '0') AS name, s_suppkey AS ord FROM supplier
  UNION ALL SELECT 'com.acme.NationIndex' || CAST(n_nationkey AS VARCHAR), n_nationkey + 1000000 FROM nation))"""
_TOKENS13 = ("SupplierStore", "SupplierStore.find007", "com.acme.nationindex3", "NationIndex3", "acme", "find011", "com.acme.n5")


def q13_identifier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(t,) for t in _TOKENS13], "token string")
    forms = seeds.name_forms(_code(spark, sf_dir).select("identity", "name", "ord"))
    scored = forms.crossJoin(F.broadcast(asked)).withColumn("score", seeds.identifier_score(F.col("token"))).where("score > 0")
    return scored.groupBy("token", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))


def parts_sql(text: str) -> str:
    """Distinct lower-case parts of a code name, two characters and more."""
    for cut in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        text = rf"regexp_replace({text}, '{cut}', '\1 \2', 'g')"
    return f"list_distinct(list_filter(list_transform(string_split_regex({text}, '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2))"


#: Best score of the token ``tok`` (lower case: norm; own: its parts; share: of them in ``parts``) against a name.
IDENTIFIER_SQL = """CASE WHEN norm = '' THEN 0 WHEN norm = full_name THEN 100 WHEN ends_with(full_name, '.' || norm) THEN 90 + CASE WHEN ends_with(kept, '.' || tok) THEN 5 ELSE 0 END
  WHEN NOT many AND list_contains(seg[ahead + 1:], norm) THEN 50 WHEN many AND starts_with(full_name, norm || '.') THEN 30 WHEN NOT many AND list_contains(seg[:ahead], norm) THEN 3
  ELSE greatest(CASE WHEN NOT many AND length(norm) >= 5 AND levenshtein(norm, seg[-1]) <= CASE WHEN length(norm) >= 10 THEN 2 ELSE 1 END THEN 40 - 10 * levenshtein(norm, seg[-1]) ELSE 0 END, CASE WHEN len(own) >= 2 AND share >= 0.5 THEN 25 * share ELSE 0 END) END"""
FORMS_SQL = rf"""f AS (SELECT identity, replace(name, '#', '.') AS kept, lower(replace(name, '#', '.')) AS full_name FROM code),
g AS (SELECT *, string_split(full_name, '.') AS seg, list_position(list_transform(string_split(kept, '.'), lambda s: regexp_matches(s, '[A-Z]')), true) - 1 AS ahead FROM f),
p AS (SELECT *, {parts_sql("array_to_string(string_split(kept, '.')[ahead + 1:], ' ')")} AS parts FROM g)"""
SQL["q13_identifier_score"] = f"""WITH {_CODE}, {FORMS_SQL}, t AS (SELECT *, unnest([{", ".join(repr(t) for t in _TOKENS13)}]) AS tok FROM p),
n AS (SELECT *, lower(tok) AS norm, contains(tok, '.') AS many, {parts_sql("tok")} AS own FROM t), o AS (SELECT *, len(list_intersect(own, parts)) / greatest(len(own), 1) AS share FROM n)
SELECT token, score, count(*) AS n FROM (SELECT tok AS token, round(CAST({IDENTIFIER_SQL} AS DOUBLE), 6) AS score FROM o) WHERE score > 0 GROUP BY ALL"""


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("q_id"), F.lower("c_name").alias("identity"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("ord"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    t = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").cast("long").alias("q_id"), F.lower("c_name").alias("identity"), F.col("cents").cast("double").alias("score"), F.col("c_custkey").alias("ord"))
    return seeds.ranking(c, 20), seeds.ranking(t, 20)


_TWO = """WITH o AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1),
a AS (SELECT * FROM (SELECT c_nationkey AS q_id, lower(c_name) AS identity, c_acctbal AS score, c_custkey AS ord, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 20),
b AS (SELECT * FROM (SELECT c_nationkey AS q_id, lower(c_name) AS identity, CAST(cents AS DOUBLE) AS score, c_custkey AS ord, row_number() OVER (PARTITION BY c_nationkey ORDER BY cents DESC, c_custkey) AS rank FROM customer JOIN o ON c_custkey = o_custkey) WHERE rank <= 20)"""


def q14_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = seeds.reciprocal_ranks(*_two_rankings(spark, sf_dir))
    return fused.select("q_id", "identity", F.round("score", 9).alias("score"))


SQL["q14_rrf_fusion"] = f"{_TWO} SELECT CAST(q_id AS BIGINT) AS q_id, identity, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"


def q15_weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_rankings(spark, sf_dir)
    return seeds.weighted_sum([(a, 0.7), (b, 0.3)]).select("q_id", "identity", F.round("score", 6).alias("score"))


SQL["q15_weighted_fusion"] = f"""{_TWO}, u AS (SELECT *, 0.7 AS w FROM a UNION ALL SELECT *, 0.3 FROM b),
n AS (SELECT *, max(score) OVER (PARTITION BY q_id, w) AS hi, min(score) OVER (PARTITION BY q_id, w) AS lo FROM u)
SELECT CAST(q_id AS BIGINT) AS q_id, identity, round(sum(w * CASE WHEN hi = lo THEN 1.0 WHEN lo >= 0 THEN score / hi ELSE (score - lo) / (hi - lo) END), 6) AS score FROM n GROUP BY ALL"""


def q17_first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = E(spark, sf_dir).select("identity", "name", "ord").crossJoin(F.broadcast(trade.questions(spark))).where(F.contains("question", F.col("name")))
    first = seeds.ranking(exact.select("q_id", "identity", F.length("name").cast("double").alias("score"), "ord"), 3)
    return seeds.first_non_empty(first, seeds.keyword_matches(trade.questions(spark), E(spark, sf_dir), 3)).select("q_id", "identity", "priority", "rank")


SQL["q17_first_non_empty"] = f"""{_RANKED}, ex AS (SELECT q_id, identity, row_number() OVER (PARTITION BY q_id ORDER BY length(name) DESC, ord) AS rank FROM ents, questions WHERE contains(question, name)),
u AS (SELECT q_id, identity, 0 AS priority, rank FROM ex WHERE rank <= 3 UNION ALL SELECT q_id, identity, 1, rank FROM ranked WHERE rank <= 3)
SELECT q_id, identity, CAST(priority AS INTEGER) AS priority, CAST(rank AS INTEGER) AS rank FROM u QUALIFY priority = min(priority) OVER (PARTITION BY q_id)"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.keyword_matches(trade.questions(spark), E(spark, sf_dir), 3).select("identity")


def q20_entities_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_identity(E(spark, sf_dir), _ids(spark, sf_dir)).select("identity", "name", "type")


SQL["q20_entities_by_identity"] = f"{_RANKED} SELECT identity, name, type FROM ents WHERE identity IN (SELECT identity FROM ranked WHERE rank <= 3)"


def q21_relationships_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touching(R(spark, sf_dir), _ids(spark, sf_dir)).select("src_id", "type", "tgt_id", "weight")


SQL["q21_relationships_touching"] = f"{_RANKED}, ids AS (SELECT identity FROM ranked WHERE rank <= 3) SELECT src_id, type, tgt_id, weight FROM rels WHERE src_id IN (SELECT identity FROM ids) OR tgt_id IN (SELECT identity FROM ids)"


def q22_edge_filter_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.accepted(R(spark, sf_dir), exclude=["located_in"], least_weight=2)
    frontier = _ids(spark, sf_dir).distinct().select(F.lit(1).cast("long").alias("q_id"), "identity")
    out = graph.from_frontier(edges, frontier, "OUTGOING").withColumn("direction", F.lit("OUTGOING"))
    into = graph.from_frontier(edges, frontier, "INCOMING").withColumn("direction", F.lit("INCOMING"))
    return out.unionByName(into).select("direction", "src_id", "type", "tgt_id", "weight")


SQL["q22_edge_filter_direction"] = f"""{_RANKED}, ids AS (SELECT DISTINCT identity FROM ranked WHERE rank <= 3), f AS (SELECT * FROM rels WHERE lower(type) <> 'located_in' AND weight >= 2)
SELECT 'OUTGOING' AS direction, src_id, type, tgt_id, weight FROM f WHERE src_id IN (SELECT identity FROM ids) UNION ALL SELECT 'INCOMING', src_id, type, tgt_id, weight FROM f WHERE tgt_id IN (SELECT identity FROM ids)"""


def q23_local_one_hop_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.local_answers(trade.questions(spark), E(spark, sf_dir), R(spark, sf_dir))


_HOP = f"""near AS (SELECT q_id, question, rels.* FROM ranked JOIN questions USING (q_id) JOIN rels ON src_id = identity OR tgt_id = identity WHERE rank = 1),
hcand AS (SELECT DISTINCT ord, source || ' ' || replace(type, '_', ' ') || ' ' || target AS t FROM near),
hw AS (SELECT ord, t, {trade.TOKENS_SQL.format('t')} AS words FROM hcand),
hs AS (SELECT near.q_id, near.ord, sum(CASE WHEN contains(lower(t), tok) THEN 2 WHEN ({trade.ALLOW_SQL}) > 0 AND list_bool_or(list_prepend(false, list_transform(words, lambda w: levenshtein(tok, w) <= ({trade.ALLOW_SQL})))) THEN 1 ELSE 0 END) AS hop
  FROM near JOIN hw ON hw.ord = near.ord JOIN qtok ON qtok.q_id = near.q_id GROUP BY ALL HAVING hop > 0),
hb AS (SELECT q_id, ord FROM hs QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY hop DESC, ord) = 1)"""
SQL["q23_local_one_hop_answer"] = f"""{_RANKED}, {_HOP}
SELECT q.q_id, CASE WHEN e.identity IS NULL THEN 'NO_MATCH' WHEN r.ord IS NULL THEN 'SEED' ELSE 'HOP' END AS status, e.identity AS seed, r.src_id || '->' || r.type || '->' || r.tgt_id AS edge_key,
  CASE WHEN e.identity IS NULL THEN '{answers.LOCAL_NONE}' WHEN r.ord IS NULL THEN '{answers.LOCAL_SEED}' || e.name || ' (' || e.type || ').' ELSE '{answers.LOCAL_HOP}' || r.source || ' ' || lower(replace(r.type, '_', ' ')) || ' ' || r.target || '.' END AS answer
FROM questions q LEFT JOIN (SELECT q_id, identity FROM ranked WHERE rank = 1) s USING (q_id) LEFT JOIN ents e ON e.identity = s.identity LEFT JOIN hb USING (q_id) LEFT JOIN rels r ON r.ord = hb.ord"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.keyword_matches(trade.questions(spark), E(spark, sf_dir), 3)


def q24_expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand(_matches(spark, sf_dir), R(spark, sf_dir), graph.ANSWER_CONTEXT).where("kind = 'RELATIONSHIP'").select("q_id", "identifier", "score")


SQL["q24_expand_1hop"] = f"""{_RANKED}, c AS (SELECT DISTINCT q_id, rels.ord, src_id || '->' || rels.type || '->' || tgt_id AS identifier, weight FROM ranked JOIN rels ON src_id = identity OR tgt_id = identity WHERE rank <= 3)
SELECT q_id, identifier, CAST(weight AS DOUBLE) AS score FROM c QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY weight DESC, ord) <= 10"""


def q25_expand_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand(_matches(spark, sf_dir), R(spark, sf_dir), graph.Budget(hops=2)).select("q_id", "kind", "identifier", "score", "hop")


def _hop_sql(hop: int, frontier: str, before: str) -> str:
    """CTEs of one hop: candidate edges ``c`` in order, and the pass ``h`` over them, which takes or skips one edge a step."""
    return f"""c{hop} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY weight DESC, ord) AS i FROM (
    SELECT DISTINCT f.q_id, src_id, tgt_id, src_id || '->' || rels.type || '->' || tgt_id AS edge_key, weight, rels.ord FROM {frontier} f JOIN rels ON src_id = f.identity OR tgt_id = f.identity) x
  WHERE NOT EXISTS (SELECT 1 FROM {before} b WHERE b.q_id = x.q_id AND list_contains(b.keys, x.edge_key))),
h{hop} AS (SELECT q_id, CAST(0 AS BIGINT) AS i, known, keys, 0 AS here, 0 AS used, CAST([] AS VARCHAR[]) AS new, CAST(NULL AS VARCHAR) AS edge_key, CAST(0 AS DOUBLE) AS weight FROM {before}
  UNION ALL SELECT q_id, i, list_concat(known, new), CASE WHEN fits THEN list_append(keys, edge_key) ELSE keys END, here + CAST(fits AS INTEGER), used + len(new), new, CASE WHEN fits THEN edge_key END, weight
  FROM (SELECT *, CASE WHEN fits THEN fresh[:greatest(0, 100 - len(known))] ELSE [] END AS new FROM (SELECT *, len(fresh) <= 10 - used AS fits FROM (
    SELECT h.q_id, c.i, known, keys, here, used, c.edge_key, CAST(c.weight AS DOUBLE) AS weight,
      list_filter(CASE WHEN src_id = tgt_id THEN [src_id] ELSE [src_id, tgt_id] END, lambda x: NOT list_contains(known, x)) AS fresh
    FROM h{hop} h JOIN c{hop} c ON c.q_id = h.q_id AND c.i = h.i + 1 WHERE here < 25 AND len(keys) < 50)))),
e{hop} AS (SELECT q_id, arg_max(known, i) AS known, arg_max(keys, i) AS keys FROM h{hop} GROUP BY q_id),
n{hop} AS (SELECT q_id, unnest(new) AS identity FROM h{hop})"""


SQL["q25_expand_2hop"] = f"""WITH RECURSIVE {_RANKED[len("WITH ") :]}, s AS (SELECT q_id, identity, score FROM ranked WHERE rank <= 3),
e0 AS (SELECT q_id, list(identity) AS known, CAST([] AS VARCHAR[]) AS keys FROM s GROUP BY q_id), {_hop_sql(1, "s", "e0")}, {_hop_sql(2, "n1", "e1")}
SELECT q_id, 'ENTITY' AS kind, identity AS identifier, CAST(score AS DOUBLE) AS score, 0 AS hop FROM s
UNION ALL SELECT q_id, 'RELATIONSHIP', edge_key, weight, 1 FROM h1 WHERE edge_key IS NOT NULL UNION ALL SELECT q_id, 'ENTITY', identity, 0, 1 FROM n1
UNION ALL SELECT q_id, 'RELATIONSHIP', edge_key, weight, 2 FROM h2 WHERE edge_key IS NOT NULL UNION ALL SELECT q_id, 'ENTITY', identity, 0, 2 FROM n2"""


def q26_unit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = _matches(spark, sf_dir).join(E(spark, sf_dir).select("identity", "unit_ids"), "identity")
    edges = graph.from_frontier(R(spark, sf_dir), picked.select("q_id", "identity")).select("q_id", F.col("ord").alias("at"), "unit_ids", "weight")
    ranked = graph.unit_ranking(trade.questions(spark), picked.select("q_id", F.col("ord").alias("at"), "unit_ids"), picked.limit(0).select("q_id", F.col("ord").alias("at"), "unit_ids"), edges)
    return ranked.select("q_id", "unit_id", "score")


SQL["q26_unit_ranking"] = f"""{_RANKED}, u AS (SELECT q_id, 'nation-' || CAST(nk AS VARCHAR) AS unit_id, 1 AS w FROM ranked JOIN ents USING (identity) WHERE rank <= 3 AND nk IS NOT NULL
  UNION ALL SELECT q_id, lower(type), weight FROM (SELECT DISTINCT q_id, rels.ord, rels.type, weight FROM ranked JOIN rels ON src_id = identity OR tgt_id = identity WHERE rank <= 3))
SELECT q_id, unit_id, CAST(sum(w) AS BIGINT) AS score FROM u GROUP BY ALL"""


def q27_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, known = R(spark, sf_dir), E(spark, sf_dir).where("type <> 'Part' and type <> 'Region'")
    edges = written(edges.select("src_id", "source", "source_type", "type", "tgt_id", "target", "target_type", "ord"))
    missing = graph.missing_endpoints(edges, known)
    kept = graph.complete_edges(edges, missing, known)
    return missing.groupBy("type").agg(F.count("*").alias("n")).unionByName(kept.groupBy(F.concat(F.lit("kept:"), F.col("type")).alias("type")).agg(F.count("*").alias("n")))


SQL["q27_missing_endpoints"] = f"""{_G}, known AS (SELECT identity FROM ents WHERE type NOT IN ('Part', 'Region')), ends AS (SELECT src_id AS i, source_type AS t FROM rels UNION SELECT tgt_id, target_type FROM rels)
SELECT t AS type, count(*) AS n FROM ends WHERE i NOT IN (SELECT identity FROM known) GROUP BY t
UNION ALL SELECT 'kept:' || type, count(*) FROM rels WHERE src_id IN (SELECT identity FROM known) AND tgt_id IN (SELECT identity FROM known) GROUP BY type"""


def q28_import_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as one imported edge, parallel ones merged by summed weight."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_id"), F.col("l_returnflag").alias("type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tgt_id"), F.lit(1).cast("long").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    rows = rows.withColumns({"source": F.col("src_id"), "target": F.col("tgt_id"), "source_type": F.lit("S"), "target_type": F.lit("P"), "description": F.lit("")})
    merged = merge.merge_relationships(rows, "sum")
    return merged.select("src_id", F.lower("type").alias("kind"), "tgt_id", "weight")


SQL["q28_import_merge_edges"] = "SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src_id, lower(l_returnflag) AS kind, 'p' || CAST(l_partkey AS VARCHAR) AS tgt_id, count(*) AS weight FROM lineitem GROUP BY ALL"


def _sourced(spark: SparkSession, sf_dir: str):
    units = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("source"))
    no_source = F.lit(None).cast("string")
    entities = E(spark, sf_dir).withColumn("source", no_source).select("identity", "source", "unit_ids", "type")
    edges = R(spark, sf_dir).where("type in ('BUYS_FROM', 'LOCATED_IN', 'PART_OF')").select("src_id", "tgt_id", no_source.alias("source"), "unit_ids", "ord")
    members = entities.where("type = 'Customer'").select(F.get("unit_ids", 0).alias("community_id"), "identity")
    return units, entities, edges, members


def q29_remove_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = merge.remove_source(*_sourced(spark, sf_dir), "region-1")
    out = None
    for what in ("units", "entities", "edges", "orphans", "updated_entities", "stale_communities"):
        one = effect[what].agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


SQL["q29_remove_source"] = f"""{_G}, gone AS (SELECT 'nation-' || CAST(n_nationkey AS VARCHAR) AS u FROM nation WHERE n_regionkey = 1),
re AS (SELECT identity, type, nk FROM ents WHERE nk IS NOT NULL AND 'nation-' || CAST(nk AS VARCHAR) IN (SELECT u FROM gone)),
ed AS (SELECT * FROM rels WHERE type IN ('BUYS_FROM', 'LOCATED_IN', 'PART_OF')),
dead AS (SELECT * FROM ed WHERE src_id IN (SELECT identity FROM re) OR tgt_id IN (SELECT identity FROM re)),
lef AS (SELECT * FROM ed WHERE ord NOT IN (SELECT ord FROM dead)),
touched AS (SELECT src_id AS i FROM dead UNION SELECT tgt_id FROM dead),
orph AS (SELECT i FROM touched WHERE i NOT IN (SELECT identity FROM re) AND i NOT IN (SELECT src_id FROM lef) AND i NOT IN (SELECT tgt_id FROM lef) AND i NOT IN (SELECT identity FROM ents WHERE nk IS NOT NULL))
SELECT 'units' AS what, count(*) AS n FROM gone UNION ALL SELECT 'entities', count(*) FROM re UNION ALL SELECT 'edges', count(*) FROM dead UNION ALL SELECT 'orphans', count(*) FROM orph
UNION ALL SELECT 'updated_entities', 0 UNION ALL SELECT 'stale_communities', count(DISTINCT nk) FROM re WHERE type = 'Customer'"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"))


_SENT = r"""WITH s AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', e'\\1\x01', 'g'), e'\x01') AS p FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, pos, trim(sentence) AS sentence, list_filter(list_transform(regexp_extract_all(sentence, '(?:^|\s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})', 1), lambda x: trim(x)), lambda x: length(x) > 1 AND x NOT IN ('The', 'A', 'An')) AS l FROM s),
n AS (SELECT doc_id, pos, sentence, list_filter(l, lambda x, i: list_position(l, x) = i) AS names FROM f)"""


def q30_offline_extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.extracted_entities(_units(spark, sf_dir)).select("unit_id", "identity", "type", F.md5("description").alias("digest"))


SQL["q30_offline_extract_entities"] = f"""{_SENT}, m AS (SELECT doc_id, pos, sentence, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM n),
t AS (SELECT *, CASE WHEN regexp_matches(lower(name), 'holmes|watson|morstan') THEN 'Person' ELSE 'Concept' END AS type FROM m)
SELECT CAST(doc_id AS VARCHAR) AS unit_id, lower(name) || '::' || lower(type) AS identity, type, md5(sentence) AS digest FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name), type ORDER BY pos, k) = 1"""


def q31_offline_extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.extracted_edges(_units(spark, sf_dir)).select("unit_id", "pos", "source", "type", "target")


SQL["q31_offline_extract_edges"] = f"""{_SENT} SELECT CAST(doc_id AS VARCHAR) AS unit_id, CAST(pos AS INTEGER) AS pos, names[1] AS source,
  CASE WHEN contains(lower(sentence), ' met ') THEN 'met' WHEN contains(lower(sentence), ' visited ') THEN 'visited' WHEN contains(lower(sentence), ' helped ') THEN 'helped' WHEN contains(lower(sentence), ' chased ') THEN 'chased' WHEN contains(lower(sentence), ' told ') THEN 'told' ELSE 'related_to' END AS type, names[-1] AS target
FROM n WHERE len(names) >= 2"""


def q32_name_key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as mentions, brands as their types: first name and majority type by key."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit('"'), F.initcap("p_name"), F.lit('!"')).alias("name"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("at"))
    return merge.resolved_names(rows).select("name_key", "canonical", "type", "n")


SQL["q32_name_key_resolution"] = """WITH m AS (SELECT p_name AS k, '"' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || '!"' AS name, p_brand AS type, p_partkey AS seen FROM part),
t AS (SELECT k, type, count(*) AS n, min(seen) AS first FROM m GROUP BY ALL)
SELECT k AS name_key, (SELECT arg_min(name, seen) FROM m WHERE m.k = t.k) AS canonical, arg_max(type, n * 1000000000 - first) AS type, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY k"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.extracted_entities(_units(spark, sf_dir)).select("identity", "name", "type", "description", F.array("unit_id").alias("unit_ids"), F.create_map().cast("map<string,string>").alias("attributes"), F.col("ord").alias("at"))


def q33_merge_unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mentions(spark, sf_dir)
    units = rows.select("identity", "at", F.explode("unit_ids").alias("u")).groupBy("identity").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "u"))), lambda x: x["u"]).alias("l"))
    return units.select("identity", F.size("l").cast("long").alias("weight"), F.md5(F.array_join("l", ",")).alias("digest"))


SQL["q33_merge_unit_ids"] = f"""{_SENT}, m AS (SELECT DISTINCT doc_id, lower(nm) || '::' || CASE WHEN regexp_matches(lower(nm), 'holmes|watson|morstan') THEN 'person' ELSE 'concept' END AS identity FROM (SELECT doc_id, unnest(names) AS nm FROM n))
SELECT identity, count(*) AS weight, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM m GROUP BY identity"""


def q34_merge_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_entities(_mentions(spark, sf_dir)).select("identity", "name", "type", F.length("description").alias("size"), F.md5("description").alias("digest"), F.size("unit_ids").alias("n_units"))


#: One step of the recursion takes the next sentence of every entity that has one.
SQL["q34_merge_descriptions"] = rf"""{_SENT.replace("WITH s AS", "WITH RECURSIVE s AS", 1)}, m AS (SELECT doc_id, pos, sentence, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM n),
t AS (SELECT *, CASE WHEN regexp_matches(lower(name), 'holmes|watson|morstan') THEN 'Person' ELSE 'Concept' END AS type FROM m),
e AS (SELECT doc_id, lower(name) || '::' || lower(type) AS identity, name, type, sentence FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name), type ORDER BY pos, k) = 1),
g AS (SELECT identity, arg_min(name, doc_id) AS name, arg_min(type, doc_id) AS type, count(*) AS n_units FROM e GROUP BY identity),
o AS (SELECT identity, row_number() OVER (PARTITION BY identity ORDER BY doc_id) AS part, sentence FROM e WHERE trim(sentence) <> ''),
l AS (SELECT identity, part, unnest(p) AS said, generate_subscripts(p, 1) AS k FROM (SELECT identity, part, string_split(regexp_replace(sentence, '([.!?])\s+', e'\\1\x01', 'g'), e'\x01') AS p FROM o WHERE part > 1)),
a AS MATERIALIZED (SELECT identity, row_number() OVER (PARTITION BY identity ORDER BY part, k) AS i, row_number() OVER (PARTITION BY identity, part ORDER BY k) = 1 AS first, trim(said) AS said FROM l WHERE trim(said) <> ''),
r AS (SELECT identity, CAST(0 AS BIGINT) AS i, trim(sentence) AS out, false AS shut, CAST([] AS VARCHAR[]) AS have FROM o WHERE part = 1
  UNION ALL SELECT identity, i, CASE WHEN adds THEN out || ' ' || said ELSE out END, shut OR (fresh AND NOT adds), CASE WHEN adds THEN list_append(have, lower(said)) ELSE have END
  FROM (SELECT *, fresh AND length(out) + 1 + length(said) <= 1000 AS adds FROM (SELECT *, NOT shut AND NOT list_contains(have, lower(said)) AS fresh FROM (
    SELECT r.identity, a.i, a.said, out, CASE WHEN first THEN length(out) >= 1000 ELSE shut END AS shut,
      CASE WHEN first THEN list_transform(string_split(regexp_replace(out, '([.!?])\s+', e'\\1\x01', 'g'), e'\x01'), lambda x: lower(trim(x))) ELSE have END AS have
    FROM r JOIN a ON a.identity = r.identity AND a.i = r.i + 1 AND length(out) < 1000)))),
d AS (SELECT identity, arg_max(out, i)[:1000] AS description FROM r GROUP BY identity)
SELECT identity, name, type, CAST(length(coalesce(description, '')) AS INTEGER) AS size, md5(coalesce(description, '')) AS digest, CAST(n_units AS INTEGER) AS n_units FROM g LEFT JOIN d USING (identity)"""


def q35_attribute_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = F.create_map(F.lit(" segment "), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit(""), F.lit("x"))
    b = F.create_map(F.lit("nation"), F.lit("none"), F.lit("key"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", F.to_json(maps.union_attributes(maps.attributes(a), b)).alias("attributes"))


SQL["q35_attribute_union"] = """SELECT c_custkey, '{"key":"' || CAST(c_custkey AS VARCHAR) || '","nation":"' || CAST(c_nationkey AS VARCHAR) || '","segment":"' || c_mktsegment || '"}' AS attributes FROM customer"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R(spark, sf_dir).where("type = 'LOCATED_IN'")


def q40_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = E(spark, sf_dir).select("identity", "ord")
    return community.connected(nodes, _located(spark, sf_dir)).select("identity", "component")


SQL["q40_connected_components"] = f"""{_G}, g AS (SELECT e.identity, e.ord, CASE WHEN e.type IN ('Customer', 'Supplier', 'Nation') THEN (SELECT min(x.ord) FROM ents x WHERE x.nk = e.nk) END AS c FROM ents e)
SELECT identity, coalesce(c, ord) AS component FROM g"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E(spark, sf_dir).where(F.size("unit_ids") > 0).select("identity", F.get("unit_ids", 0).alias("community"), "ord", "name", "type", "attributes")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nations(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("community"), F.col("n_regionkey").cast("string").alias("r")), "community")
    parts = F.array(F.struct(F.lit(0).alias("level"), F.concat("community", F.lit("/"), "type").alias("community")), F.struct(F.lit(1).alias("level"), F.col("community").alias("community")), F.struct(F.lit(2).alias("level"), F.concat(F.lit("region-"), "r").alias("community")))
    return rows.select("identity", F.explode(parts).alias("p")).select("p.level", "p.community", "identity")


def q41_louvain_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = R(spark, sf_dir).where("type in ('BUYS_FROM', 'LOCATED_IN')").withColumn("corpus_id", F.lit("trade"))
    nodes = E(spark, sf_dir).where("type in ('Customer', 'Supplier', 'Nation')").withColumn("corpus_id", F.lit("trade"))
    return community.detected(nodes, edges).select("level", "community", "identity")


def q42_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = R(spark, sf_dir).where("type in ('BUYS_FROM', 'LOCATED_IN')")
    return community.modularity(_nations(spark, sf_dir).select("identity", "community"), edges).select(F.round("modularity", 9).alias("modularity"))


SQL["q42_modularity"] = f"""{_G}, e AS (SELECT a.nk AS ca, b.nk AS cb, weight FROM rels JOIN ents a ON a.identity = src_id JOIN ents b ON b.identity = tgt_id WHERE rels.type IN ('BUYS_FROM', 'LOCATED_IN')),
m AS (SELECT CAST(sum(weight) AS DOUBLE) AS m FROM e), s AS (SELECT c, CAST(sum(weight) AS DOUBLE) AS k FROM (SELECT ca AS c, weight FROM e UNION ALL SELECT cb, weight FROM e) GROUP BY c)
SELECT round((SELECT sum(weight) FROM e WHERE ca = cb) / m - (SELECT sum(k * k) FROM s) / (4 * m * m), 9) AS modularity FROM m"""


def q43_hierarchy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = community.selected(_levels(spark, sf_dir), most=60)
    return found.groupBy("level", "community").agg(F.count("*").alias("n"))


SQL["q43_hierarchy_select"] = f"""{_G}, b AS (SELECT identity, nk, type, n_regionkey AS r FROM ents JOIN nation ON n_nationkey = nk),
l AS (SELECT identity, 'region-' || CAST(r AS VARCHAR) AS c2, 'nation-' || CAST(nk AS VARCHAR) AS c1, 'nation-' || CAST(nk AS VARCHAR) || '/' || type AS c0, count(*) OVER (PARTITION BY r) AS n2, count(*) OVER (PARTITION BY nk) AS n1 FROM b),
p AS (SELECT CASE WHEN n2 <= 60 THEN 2 WHEN n1 <= 60 THEN 1 ELSE 0 END AS level, CASE WHEN n2 <= 60 THEN c2 WHEN n1 <= 60 THEN c1 ELSE c0 END AS community FROM l)
SELECT CAST(level AS INTEGER) AS level, community, count(*) AS n FROM p GROUP BY ALL"""


def q44_community_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.numbered(_nations(spark, sf_dir).select("identity", "community"), E(spark, sf_dir), least=60).select("community_id", "community", "n")


SQL["q44_community_number"] = f"""{_G} SELECT 'community-' || CAST(row_number() OVER (ORDER BY min(ord)) AS VARCHAR) AS community_id, 'nation-' || CAST(nk AS VARCHAR) AS community, count(*) AS n FROM ents WHERE nk IS NOT NULL GROUP BY nk HAVING count(*) >= 60"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).withColumnRenamed("community", "community_id")


def q45_internal_edges_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.strongest_edges(R(spark, sf_dir), _members(spark, sf_dir)).select("community_id", "src_id", "type", "tgt_id", "weight", "n")


_INNER = f"{_G}, inside AS (SELECT 'nation-' || CAST(a.nk AS VARCHAR) AS community_id, rels.* FROM rels JOIN ents a ON a.identity = src_id JOIN ents b ON b.identity = tgt_id AND a.nk = b.nk)"
SQL["q45_internal_edges_top30"] = f"{_INNER} SELECT community_id, src_id, type, tgt_id, weight, CAST(row_number() OVER (PARTITION BY community_id ORDER BY weight DESC, ord) AS INTEGER) AS n FROM inside QUALIFY n <= 30"


def q46_community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.statistics(_members(spark, sf_dir), "group")


SQL["q46_community_stats"] = f"{_G} SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, 'group' AS attribute, grp AS value, count(*) AS n FROM ents WHERE nk IS NOT NULL GROUP BY ALL"


def q47_deterministic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.described(_members(spark, sf_dir))


_COMM = f"""{_G}, h AS (SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, list(name ORDER BY ord) AS l FROM ents WHERE nk IS NOT NULL GROUP BY nk),
comm AS (SELECT community_id, list_filter(l[1:25], lambda x, i: list_position(l[1:25], x) = i)[1] || coalesce(' & ' || list_filter(l[1:25], lambda x, i: list_position(l[1:25], x) = i)[2], '') AS title, 'This community centers on ' || array_to_string(l[1:4], ', ') || '.' AS summary FROM h)"""
SQL["q47_deterministic_titles"] = f"{_COMM} SELECT community_id, title, summary FROM comm"


def q48_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = community.capped(_members(spark, sf_dir), "community_id", community.MEMBERS, "ord").withColumn("description", F.lit(""))
    return community.content_hashes(head, graph.internal_edges(R(spark, sf_dir), _members(spark, sf_dir)))


SQL["q48_content_hash"] = f"""{_INNER},
mem AS (SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, identity FROM ents WHERE nk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nk ORDER BY ord) <= 25),
lines AS (SELECT community_id, 'E|' || identity || '|' AS line FROM mem UNION ALL SELECT community_id, 'R|' || src_id || '|' || type || '|' || tgt_id || '|' || CAST(weight AS VARCHAR) || '|' FROM inside)
SELECT community_id, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS content_hash FROM lines GROUP BY community_id"""


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.described(_members(spark, sf_dir))


_CKW = f"{_COMM}, {QUESTIONS_SQL}, {trade.scores_sql('comm', chr(39).join(['title || ', ' ', ' || summary']), 'community_id')}, cr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, community_id) AS rank FROM kw)"


def q50_global_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.community_scores(trade.questions(spark), _communities(spark, sf_dir)).where("rank <= 3").select("q_id", "community_id", F.col("score").cast("long").alias("score"), "rank")


SQL["q50_global_keyword_topk"] = f"{_CKW} SELECT q_id, community_id, score, CAST(rank AS INTEGER) AS rank FROM cr WHERE rank <= 3"


def q51_global_member_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = answers.global_scores(trade.questions(spark), _communities(spark, sf_dir), _members(spark, sf_dir), _matches(spark, sf_dir))
    return scored.select("q_id", "community_id", F.round("score", 6).alias("score"))


SQL["q51_global_member_score"] = f"""{_CKW}, ec AS (SELECT identity, ord, name || ' ' || type AS t, {trade.TOKENS_SQL.format("name || ' ' || type")} AS words, nk FROM ents),
ek AS (SELECT q_id, identity, ord, nk, sum(CASE WHEN contains(lower(t), tok) THEN 2 WHEN ({trade.ALLOW_SQL}) > 0 AND list_bool_or(list_prepend(false, list_transform(words, lambda w: levenshtein(tok, w) <= ({trade.ALLOW_SQL})))) THEN 1 ELSE 0 END) AS s FROM qtok, ec GROUP BY ALL HAVING s > 0),
top AS (SELECT * FROM ek QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s DESC, ord) <= 3),
ms AS (SELECT q_id, 'nation-' || CAST(nk AS VARCHAR) AS community_id, CAST(sum(s) AS DOUBLE) AS ms FROM top WHERE nk IS NOT NULL GROUP BY ALL),
b AS (SELECT q_id, community_id, CAST(score AS DOUBLE) AS kw, ms FROM kw FULL JOIN ms USING (q_id, community_id))
SELECT q_id, community_id, round(coalesce(kw / max(kw) OVER (PARTITION BY q_id), 0) + coalesce(ms / max(ms) OVER (PARTITION BY q_id), 0), 6) AS score FROM b"""


def q52_global_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    scored = answers.global_scores(trade.questions(spark), _communities(spark, sf_dir), members, _matches(spark, sf_dir)).where("rank <= 3")
    weights = graph.internal_weight(R(spark, sf_dir), members)
    return answers.members_of_interest(scored, members, _matches(spark, sf_dir), weights)


def q53_drift_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.drift_candidates(trade.questions(spark), _communities(spark, sf_dir)).select("q_id", "community_id", "branch", "sub_question")


SQL["q53_drift_candidates"] = f"""{_CKW}, best AS (SELECT q_id, community_id FROM kw QUALIFY rank() OVER (PARTITION BY q_id ORDER BY score DESC) = 1)
SELECT q_id, community_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY community_id) AS INTEGER) AS branch, question || ' Community summary: ' || summary AS sub_question FROM best JOIN comm USING (community_id) JOIN questions USING (q_id)"""


def q54_drift_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _matches(spark, sf_dir), seeds.keyword_matches(trade.questions(spark), E(spark, sf_dir).where("type <> 'Part'"), 5)
    items = a.withColumn("branch", F.lit(1)).unionByName(b.withColumn("branch", F.lit(2)))
    return answers.first_of_each(items, F.col("identity"), "branch", "rank").select("q_id", "identity", "branch", "rank")


SQL["q54_drift_union"] = f"""{_RANKED}, np AS (SELECT q_id, identity, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, ord) AS rank FROM kw JOIN (SELECT identity FROM ents WHERE type <> 'Part') USING (identity)),
u AS (SELECT q_id, identity, 1 AS branch, rank FROM ranked WHERE rank <= 3 UNION ALL SELECT q_id, identity, 2, rank FROM np WHERE rank <= 5)
SELECT q_id, identity, CAST(branch AS INTEGER) AS branch, CAST(rank AS INTEGER) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY q_id, identity ORDER BY branch, rank) = 1"""


def q55_map_reduce_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by a deterministic stand-in for a model: the length of each summary modulo 101."""
    ranked = answers.community_scores(trade.questions(spark), _communities(spark, sf_dir))
    return answers.map_points(trade.questions(spark), ranked, lambda q, rows: [(c, t, len(t) % 101) for c, t in rows]).select("q_id", "community_id", "score", "n")


SQL["q55_map_reduce_points"] = f"{_CKW} SELECT q_id, community_id, CAST(length(summary) % 101 AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY length(summary) % 101 DESC, rank) AS INTEGER) AS n FROM cr JOIN comm USING (community_id) WHERE rank <= 30 AND length(summary) % 101 > 0 QUALIFY n <= 20"


def q49_global_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.global_answers(trade.questions(spark), _communities(spark, sf_dir))


SQL["q49_global_answers"] = f"{_CKW} SELECT q.q_id, cr.community_id, CASE WHEN cr.community_id IS NULL THEN '{answers.GLOBAL_NONE}' ELSE '{answers.GLOBAL_LEAD}' || summary END AS answer FROM questions q LEFT JOIN (SELECT * FROM cr WHERE rank = 1) cr USING (q_id) LEFT JOIN comm USING (community_id)"


def q56_citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers with numbers from each benchmark item resolved against the units 3 to 5."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Both ["), F.pmod("item_id", F.lit(7)).cast("string"), F.lit(", 3] and [2-5]; then [9].")).alias("said"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(answer=[tx.resolve_citations(s, [3, 4, 5])[0] for s in pdf["said"]])[["item_id", "answer"]]

    return rows.mapInPandas(run, "item_id long, answer string")


SQL["q56_citation_resolve"] = """SELECT item_id, 'Both ' || CASE item_id % 7 WHEN 4 THEN '[1, 2] and [2, 1, 3]' WHEN 5 THEN '[1, 2] and [2, 3, 1]' ELSE '[1] and [1, 2, 3]' END || '; then.' AS answer FROM benchmark"""


def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.lit(1).cast("long").alias("q_id"), "doc_id", "text").where("text is not null")
    units = docs.select("q_id", F.col("doc_id").cast("string").alias("unit_id"), F.col("doc_id").cast("string").alias("document"), "text")
    lines = docs.select("q_id", F.col("doc_id").cast("string").alias("document"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.select("q_id", F.concat_ws("-", "document", "k").alias("chunk_id"), "document", "text"), units


def q60_containment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, units = _passages(spark, sf_dir)
    return compare.contained(chunks, units).groupBy("unit_id").agg(F.count("*").alias("n"))


SQL["q60_containment_overlap"] = r"""WITH c AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS said FROM documents), u AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS unit_id, count(*) AS n FROM c JOIN u USING (doc_id) WHERE said <> '' AND contains(whole, said) GROUP BY doc_id"""


def q90_containment_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sentences as chunks without a document against all documents as units; every second item is also asked within the
    document of its number, which mostly doesn't hold it."""
    said = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.sentences(F.col("text"))).alias("k", "text"))
    lone = said.select(F.lit(1).cast("long").alias("q_id"), F.concat_ws("-", "item_id", "k").alias("chunk_id"), F.lit(None).cast("string").alias("document"), "text")
    bound = said.where("item_id % 2 = 0").select(F.lit(1).cast("long").alias("q_id"), F.concat_ws("-", F.lit("own"), "item_id", "k").alias("chunk_id"), F.col("item_id").cast("string").alias("document"), "text")
    _, units = _passages(spark, sf_dir)
    return compare.contained(lone.unionByName(bound), units).select("chunk_id", "unit_id")


SQL["q90_containment_across"] = r"""WITH b AS (SELECT item_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM benchmark),
c AS (SELECT item_id, unnest(range(len(l))) AS k, unnest(l) AS said FROM b), s AS (SELECT item_id, k, trim(regexp_replace(said, '\s+', ' ', 'g')) AS said FROM c),
u AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM documents WHERE text IS NOT NULL)
SELECT item_id || '-' || k AS chunk_id, unit_id FROM s JOIN u ON contains(whole, said) UNION ALL SELECT 'own-' || item_id || '-' || k, unit_id FROM s JOIN u ON unit_id = CAST(item_id AS VARCHAR) AND contains(whole, said) WHERE item_id % 2 = 0"""


def q61_compare_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as comparisons: line counts as items, suppliers and parts as documents."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("gd"), F.countDistinct("l_returnflag").alias("vd"), F.count("*").alias("gi"), F.countDistinct("l_linestatus").alias("vi"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("p"), F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 1).otherwise(0)).alias("s"))
    c = F.col
    return rows.select("l_orderkey", compare.verdict({"mode": F.lit("LOCAL"), "documents": (c("gd"), c("vd")), "items": (c("gi"), c("vi")), "passages": c("p"), "shared": c("s")}).alias("verdict"))


SQL["q61_compare_stats"] = """WITH r AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS gd, count(DISTINCT l_returnflag) AS vd, count(*) AS gi, count(DISTINCT l_linestatus) AS vi, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN gd = vd THEN 'Both sides retrieved passages from the same number of distinct documents (' || gd || ').' ELSE CASE WHEN gd > vd THEN 'GraphRAG (LOCAL)' ELSE 'Vector Search' END || ' retrieved passages from more distinct documents (' || greatest(gd, vd) || ' vs ' || least(gd, vd) || ').' END
 || ' ' || CASE WHEN gi = vi THEN 'Both sides retrieved the same number of context items (' || gi || ').' ELSE CASE WHEN gi > vi THEN 'GraphRAG (LOCAL)' ELSE 'Vector Search' END || ' retrieved more context items (' || greatest(gi, vi) || ' vs ' || least(gi, vi) || ').' END
 || ' ' || CASE WHEN p = 0 THEN 'Vector Search retrieved no passages to compare.' ELSE s || ' of the ' || p || ' passages Vector Search retrieved ' || CASE WHEN s = 1 THEN 'was' ELSE 'were' END || ' also read by GraphRAG.' END AS verdict FROM r"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as uses: the part is the passage, the order's priority the method."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    use = F.when(F.col("l_returnflag") == "A", "CITED").when(F.col("l_returnflag") == "N", "IN_CONTEXT").otherwise("RANKED_BELOW_CUTOFF")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").cast("string").alias("passage"), F.col("o_orderpriority").alias("method"), use.alias("use"), F.when(use == "CITED", F.col("l_linenumber")).alias("citation"), F.col("l_linenumber").alias("rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))


def q62_evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _uses(spark, sf_dir)
    return compare.evidence(uses, uses.select("method").distinct()).select("passage", "cited_by", "in_context_of", "n")


SQL["q62_evidence_matrix"] = """WITH u AS (SELECT CAST(l_partkey AS VARCHAR) AS passage, o_orderpriority AS method, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 3 ELSE 2 END AS lv, l_orderkey * 10 + l_linenumber AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT passage, method, max(lv) AS lv, min(seen) AS seen FROM u GROUP BY ALL), r AS (SELECT passage, count(*) FILTER (lv = 4) AS cited_by, count(*) FILTER (lv = 3) AS in_context_of, min(seen) AS first FROM m GROUP BY passage)
SELECT passage, cited_by, in_context_of, CAST(row_number() OVER (ORDER BY cited_by DESC, in_context_of, first, passage) AS INTEGER) AS n FROM r"""


def q63_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _uses(spark, sf_dir).withColumn("outcome", F.when(F.col("rank") == 7, "FAILED").otherwise("ANSWERED"))
    return rows.groupBy("method", compare.diagnosis(F.col("outcome"), F.col("use")).alias("stage")).agg(F.count("*").alias("n"))


SQL["q63_diagnosis"] = "SELECT o_orderpriority AS method, CASE WHEN l_linenumber = 7 THEN 'failed' WHEN l_returnflag = 'A' THEN 'cited' WHEN l_returnflag = 'N' THEN 'generation' ELSE 'ranking' END AS stage, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
_KINDS = {"click": "ENTITY", "view": "RELATIONSHIP", "purchase": "SUB_QUESTION_SPAWNED", "error": "SYNTHESIS"}


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace steps: a user's events are one trace."""
    kind = F.lit("TEXT_UNIT")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step_no"), kind.alias("kind"), F.lit("").alias("label"))


_STEPS = "WITH s AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step_no, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'TEXT_UNIT' END AS kind FROM events)"


def q64_trace_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.footprint(_steps(spark, sf_dir))


SQL["q64_trace_footprint"] = f"{_STEPS} SELECT trace_id, kind, count(*) AS n FROM s GROUP BY ALL"


def q65_trace_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.phases(_steps(spark, sf_dir)).groupBy("trace_id", "phase").agg(F.count("*").alias("n"))


SQL["q65_trace_phases"] = f"{_STEPS}, p AS (SELECT trace_id, CASE WHEN count(*) FILTER (kind = 'SYNTHESIS') OVER w > 0 THEN -1 ELSE count(*) FILTER (kind = 'SUB_QUESTION_SPAWNED') OVER w END AS phase FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY step_no ROWS UNBOUNDED PRECEDING)) SELECT trace_id, CAST(phase AS INTEGER) AS phase, count(*) AS n FROM p GROUP BY ALL"


#: Kinds of the steps of four sorts of traces, by type of event.
_KINDS_OF = (_KINDS, {"click": "COMMUNITY", "view": "TEXT_UNIT", "signup": "COMMUNITY"}, {"click": "COMMUNITY", "view": "RELATIONSHIP", "purchase": "SUB_QUESTION_SPAWNED", "signup": "TEXT_UNIT"}, {"click": "ENTITY", "view": "RELATIONSHIP", "purchase": "ENTITY", "error": "TEXT_UNIT"}, {"click": "VECTOR_CHUNK", "view": "VECTOR_CHUNK", "signup": "VECTOR_CHUNK"})


def q91_trace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of all modes: a user's events are dealt to four traces, the number of a trace gives its sort; every fourth says its mode."""
    events = table(spark, sf_dir, "events").withColumn("trace", F.col("user_id") * 4 + F.col("event_id") % 4)
    sort = F.col("trace") % 5
    kind = F.when((sort == 4) & (F.col("step_no") == 1), "VECTOR_QUERY_EMBEDDED")
    for k, kinds in enumerate(_KINDS_OF):
        for event, v in kinds.items():
            kind = kind.when((sort == k) & (F.col("event_type") == event), v)
    kind = kind.otherwise(F.when(sort == 3, "RELATIONSHIP").otherwise("SYNTHESIS"))
    rows = events.withColumn("step_no", F.row_number().over(Window.partitionBy("trace").orderBy("ts", "event_id")))
    steps = rows.select(F.col("trace").cast("string").alias("trace_id"), "step_no", kind.alias("kind"), (F.col("event_id") % 7).cast("string").alias("identifier"), F.when(F.col("trace") % 4 == 1, "GLOBAL").alias("hint"))
    return compare.segments(steps).select("trace_id", "mode", "title", "start", "end")


_SORTS_SQL = "CASE WHEN k = 4 AND step_no = 1 THEN 'VECTOR_QUERY_EMBEDDED' " + " ".join(f"WHEN k = {k} AND event_type = '{e}' THEN '{v}'" for k, kinds in enumerate(_KINDS_OF) for e, v in kinds.items()) + " WHEN k = 3 THEN 'RELATIONSHIP' ELSE 'SYNTHESIS' END"
SQL["q91_trace_segments"] = f"""WITH e AS (SELECT user_id * 4 + event_id % 4 AS trace, event_id, ts, event_type FROM events),
o AS (SELECT *, trace % 5 AS k, row_number() OVER (PARTITION BY trace ORDER BY ts, event_id) AS step_no FROM e),
s AS (SELECT trace, step_no - 1 AS i, {_SORTS_SQL} AS kind FROM o),
f AS (SELECT trace, count(*) AS n, arg_min(kind, i) AS first, coalesce(min(i) FILTER (kind = 'SYNTHESIS'), count(*)) AS said, min(i) FILTER (kind = 'SUB_QUESTION_SPAWNED') AS spawn, count(*) FILTER (kind = 'SUB_QUESTION_SPAWNED') AS branches,
  coalesce(min(i) FILTER (kind <> 'ENTITY'), count(*)) AS seeds, bool_or(kind = 'TEXT_UNIT') AS read, bool_or(kind = 'SYNTHESIS') AS ended FROM s GROUP BY trace),
g AS (SELECT f.*, coalesce((SELECT min(i) FROM s WHERE s.trace = f.trace AND i >= seeds AND kind <> 'RELATIONSHIP'), n) AS edges,
  CASE WHEN first = 'VECTOR_QUERY_EMBEDDED' THEN 'VECTOR' WHEN spawn IS NOT NULL THEN 'DRIFT' WHEN trace % 4 = 1 THEN 'GLOBAL' WHEN first = 'COMMUNITY' THEN CASE WHEN ended THEN 'DRIFT' ELSE 'GLOBAL' END ELSE 'LOCAL' END AS mode FROM f),
p AS (SELECT trace, mode, 'Embed the question' AS title, 0 AS a, least(1, said) AS b FROM g WHERE mode = 'VECTOR' UNION ALL SELECT trace, mode, 'Nearest chunks', least(1, said), said FROM g WHERE mode = 'VECTOR'
  UNION ALL SELECT trace, mode, 'Synthesis', said, n FROM g WHERE mode IN ('VECTOR', 'DRIFT') UNION ALL SELECT trace, mode, 'Community pass', 0, CASE WHEN mode = 'GLOBAL' THEN n ELSE coalesce(spawn, said) END FROM g WHERE mode IN ('GLOBAL', 'DRIFT')
  UNION ALL SELECT trace, mode, 'Seed entities', 0, seeds FROM g WHERE mode = 'LOCAL' UNION ALL SELECT trace, mode, 'Graph facts', seeds, edges FROM g WHERE mode = 'LOCAL' AND read
  UNION ALL SELECT trace, mode, 'Source passages', edges, n FROM g WHERE mode = 'LOCAL' AND read UNION ALL SELECT trace, mode, 'Relationship hop', seeds, n FROM g WHERE mode = 'LOCAL' AND NOT read
  UNION ALL SELECT trace, mode, 'Branch ' || row_number() OVER w || ' of ' || branches, i, greatest(coalesce(lead(i) OVER w, said), i + 1) FROM s JOIN g USING (trace) WHERE mode = 'DRIFT' AND kind = 'SUB_QUESTION_SPAWNED' WINDOW w AS (PARTITION BY trace ORDER BY i))
SELECT CAST(trace AS VARCHAR) AS trace_id, mode, title, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM p WHERE b > a"""


def q69_trace_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.branches(_steps(spark, sf_dir)).select("trace_id", "branch", "start", "end", "label")


SQL["q69_trace_branches"] = f"""{_STEPS}, e AS (SELECT *, coalesce(min(step_no) FILTER (kind = 'SYNTHESIS') OVER w, max(step_no) OVER w + 1) AS fin FROM s WINDOW w AS (PARTITION BY trace_id)),
b AS (SELECT *, row_number() OVER w AS k, lead(step_no) OVER w AS nx FROM e WHERE kind = 'SUB_QUESTION_SPAWNED' WINDOW w AS (PARTITION BY trace_id ORDER BY step_no))
SELECT trace_id, CAST(k AS INTEGER) AS branch, step_no AS start, CAST(least(coalesce(nx, fin), fin) AS INTEGER) AS "end", 'Sub-question ' || CAST(k AS VARCHAR) AS label FROM b"""


def q67_corpus_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "READY").when(F.col("event_type") == "error", "FAILED").otherwise("BUILDING")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("corpus_id"), status.alias("status"), F.struct("ts", "event_id").alias("at"))
    return store.latest_status(changes).select("corpus_id", "status")


SQL["q67_corpus_registry"] = "SELECT CAST(user_id AS VARCHAR) AS corpus_id, CASE arg_max(event_type, ts * 1 ) WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END AS status FROM (SELECT user_id, event_type, epoch_us(ts) AS ts FROM events) GROUP BY user_id"


def q68_event_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").otherwise("entity-extracted")
    rows = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).cast("string").alias("corpus_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("props").alias("data"))
    return store.event_buffer(rows).select("corpus_id", "seq", "type")


SQL["q68_event_buffer"] = """WITH e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS corpus_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'entity-extracted' END AS type FROM events),
f AS (SELECT *, max(seq) FILTER (type = 'error') OVER (PARTITION BY corpus_id) AS fin FROM e)
SELECT corpus_id, seq, type FROM f WHERE fin IS NULL OR seq > fin QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY seq DESC) <= 5000"""

QUERIES = {n: f for n, f in globals().items() if n[:1] == "q" and n[1:3].isdigit()}
