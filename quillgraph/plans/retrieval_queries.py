"""Queries over compositions: context of each mode, answers by a model, imports, updates, summaries and the query gate."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import lenient_json
from quillgraph.operators import answers, community, compare, graph, merge, model, retrieval, seeds, updates
from quillgraph.operators.tables import shared_dir, written
from quillgraph.plans import graph_queries as gq
from quillgraph.plans import trade
from quillgraph.plans.trade import table
from quillgraph.sources.store import Store
from quillgraph.streaming import fold

SQL: dict[str, str] = {}
_G, E, R = gq._G, gq.E, gq.R


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a text unit of its region's document."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("About "), "n_name", F.lit(".")).alias("text"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("document_name"), F.col("n_nationkey").cast("long").alias("ord"))


def trade_graph(spark: SparkSession, sf_dir: str) -> retrieval.Graph:
    """The trade graph with its derived tables written once, as every step of a retrieval reads them."""
    entities, edges = written(E(spark, sf_dir)), written(R(spark, sf_dir))
    members = entities.where(F.size("unit_ids") > 0).select(F.get("unit_ids", 0).alias("community_id"), "identity", "ord", "name", "type", "description", "attributes")
    return retrieval.Graph(entities, edges, _units(spark, sf_dir), written(community.described(members)), written(members))


def q70_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_prefix(E(spark, sf_dir), " SUPPLIER#00000000").select("identity", "name")


SQL["q70_prefix_search"] = f"{_G} SELECT identity, name FROM ents WHERE starts_with(lower(name), 'supplier#00000000')"


def q71_unit_citing_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.citing(E(spark, sf_dir), _units(spark, sf_dir)).select("unit_id", "identity")


SQL["q71_unit_citing_entities"] = f"{_G} SELECT 'nation-' || CAST(nk AS VARCHAR) AS unit_id, identity FROM ents WHERE nk IS NOT NULL"


def q72_graph_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    rows = graph.payload(g.entities, g.relationships.where("type <> 'SUPPLIES'"), g.communities, g.memberships, g.units)
    return rows.select("kind", "id", F.md5("data").alias("digest"))


SQL["q72_graph_payload"] = f"""{gq._COMM}, ms AS (SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, '["' || string_agg(identity, '","' ORDER BY ord) || '"]' AS l FROM ents WHERE nk IS NOT NULL GROUP BY nk)
SELECT 'entity' AS kind, identity AS id, md5('{{"name":"' || name || '","type":"' || type || '","description":"","sources":[' || coalesce('"region-' || CAST(n_regionkey AS VARCHAR) || '"', '') || ']}}') AS digest FROM ents LEFT JOIN nation ON n_nationkey = nk
UNION ALL SELECT 'relationship', src_id || '->' || type || '->' || tgt_id, md5('{{"source":"' || src_id || '","target":"' || tgt_id || '","type":"' || type || '","weight":' || CAST(weight AS VARCHAR) || '}}') FROM rels WHERE type <> 'SUPPLIES'
UNION ALL SELECT 'community', community_id, md5('{{"title":"' || title || '","summary":"' || summary || '","members":' || l || '}}') FROM comm JOIN ms USING (community_id)"""


def q73_community_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.community_units(trade_graph(spark, sf_dir)).select("community_id", "unit_id", "score")


SQL["q73_community_units"] = f"""{gq._INNER}, u AS (SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, 'nation-' || CAST(nk AS VARCHAR) AS unit_id, 1 AS w FROM ents WHERE nk IS NOT NULL UNION ALL SELECT community_id, lower(type), weight FROM inside)
SELECT community_id, unit_id, CAST(sum(w) AS BIGINT) AS score FROM u GROUP BY ALL"""


def q74_key_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.key_members(gq._members(spark, sf_dir), R(spark, sf_dir))


_KEYS = f"""{gq._INNER}, iw AS (SELECT community_id, identity, sum(weight) AS w FROM (SELECT community_id, src_id AS identity, weight FROM inside UNION ALL SELECT community_id, tgt_id, weight FROM inside) GROUP BY ALL),
keyed AS (SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, e.identity, name, row_number() OVER (PARTITION BY nk ORDER BY coalesce(w, 0) DESC, ord) AS n FROM ents e LEFT JOIN iw ON iw.identity = e.identity AND iw.community_id = 'nation-' || CAST(nk AS VARCHAR) WHERE nk IS NOT NULL QUALIFY n <= 5)"""
SQL["q74_key_members"] = f"{_KEYS} SELECT community_id, identity, CAST(n AS INTEGER) AS n FROM keyed"


def q75_community_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    return updates.community_texts(g.communities, g.memberships, g.entities, g.relationships).select("community_id", F.md5("text").alias("digest"))


SQL["q75_community_texts"] = f"""{_KEYS}, h AS (SELECT 'nation-' || CAST(nk AS VARCHAR) AS community_id, list(name ORDER BY ord) AS l FROM ents WHERE nk IS NOT NULL GROUP BY nk),
comm AS (SELECT community_id, list_filter(l[1:25], lambda x, i: list_position(l[1:25], x) = i)[1] || coalesce(' & ' || list_filter(l[1:25], lambda x, i: list_position(l[1:25], x) = i)[2], '') AS title, 'This community centers on ' || array_to_string(l[1:4], ', ') || '.' AS summary FROM h)
SELECT community_id, md5(title || ': ' || summary || chr(10) || 'Key members: ' || (SELECT string_agg(name, ', ' ORDER BY n) FROM keyed k WHERE k.community_id = c.community_id)) AS digest FROM comm c"""


def q76_context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as context items: return flags as kinds, parts as identifiers, ship dates as documents."""
    kind = F.when(F.col("l_returnflag") == "R", "TEXT_UNIT").when(F.col("l_returnflag") == "A", "ENTITY").otherwise("SYNTHESIS")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q_id"), kind.alias("kind"), F.col("l_suppkey").cast("string").alias("identifier"), F.col("l_linestatus").alias("document"))
    return compare.context_stats(rows)


SQL["q76_context_stats"] = """WITH r AS (SELECT DISTINCT l_orderkey AS q_id, l_returnflag AS f, l_suppkey AS i, l_linestatus AS d FROM lineitem WHERE l_returnflag IN ('R', 'A'))
SELECT q_id, count(DISTINCT (f, i)) AS items, count(DISTINCT d) FILTER (f = 'R') AS documents FROM r GROUP BY q_id"""


def q77_summary_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary run in which the even nations are known from before and the budget is five."""
    g = trade_graph(spark, sf_dir)
    head = community.capped(g.memberships, "community_id", community.MEMBERS, "ord")
    hashes = community.content_hashes(head, community.strongest_edges(g.relationships, g.memberships.select("community_id", "identity")))
    known = hashes.where("cast(substring_index(community_id, '-', -1) as int) % 2 = 0").select("content_hash", F.lit("old").alias("title"), F.lit("told before").alias("summary"))
    return community.outcome(community.summarised(g.memberships, g.relationships, written(known), model.Model(model.offline), most=5))


SQL["q77_summary_outcome"] = f"""{_G}, n AS (SELECT count(DISTINCT nk) AS a, count(DISTINCT nk) FILTER (nk % 2 = 0) AS r FROM ents WHERE nk IS NOT NULL)
SELECT a AS communities, least(5, a - r) AS "generated", r AS reused, CAST(0 AS BIGINT) AS deterministic, CAST(0 AS BIGINT) AS failed, a - r - least(5, a - r) AS skipped_budget, CASE WHEN a - r > 5 THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome FROM n"""


def q78_query_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions to the corpora of their customers; segments give modes and states."""
    o = table(spark, sf_dir, "orders")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("local", " Global", "DRIFT", "vector", "sql", "")]), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    asked = o.select(F.col("o_orderkey").alias("q_id"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise("who?").alias("question"), mode.alias("mode"), F.col("o_custkey").cast("string").alias("corpus_id"))
    state = F.when(F.col("c_custkey") % 5 == 0, "BUILDING").when(F.col("c_custkey") % 5 == 1, "FAILED").otherwise("READY")
    known = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("corpus_id"), state.alias("status"))
    return retrieval.gate(asked, known, offline=True)


SQL["q78_query_gate"] = """WITH q AS (SELECT o_orderkey AS q_id, CASE WHEN o_orderkey % 11 = 0 THEN 'blank question' WHEN o_orderkey % 6 IN (4, 5) THEN 'unknown mode' WHEN o_custkey % 7 = 0 OR c_custkey IS NULL THEN 'unknown corpus'
  WHEN o_custkey % 5 = 0 THEN 'corpus is building' WHEN o_custkey % 5 = 1 THEN 'corpus failed' WHEN o_orderkey % 6 = 3 THEN 'needs an embedder' ELSE 'ok' END AS reason FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT q_id, CAST(CASE WHEN reason = 'ok' THEN 200 WHEN reason IN ('blank question', 'unknown mode') THEN 400 WHEN reason = 'unknown corpus' THEN 404 ELSE 409 END AS INTEGER) AS code, reason FROM q"""

#: Questions on code names, with their code tokens and plain words spelt out for the SQL.
_ASKED = (
    (1, "Which SupplierStore.find007 writes supplier rows?", ["SupplierStore.find007"], ["writes", "supplier", "rows"]),
    (2, "list nationindex stores near NationIndex3", ["NationIndex3"], ["list", "nationindex", "stores", "near"]),
    (3, "nothing fitting here", [], ["nothing", "fitting"]),
)


def q79_identifier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([x[:2] for x in _ASKED], "q_id long, question string")
    forms = seeds.name_forms(gq._code(spark, sf_dir).select("identity", "name", "ord"))
    return seeds.identifier_matches(asked, forms, None).select("q_id", "identity", "score")


_VALUES79 = ", ".join(f"({k}, {t!r}, {w!r})" for k, _, t, w in _ASKED).replace("[]", "CAST([] AS VARCHAR[])")
SQL["q79_identifier_seeds"] = rf"""WITH {gq._CODE}, asked(q_id, toks, words) AS (VALUES {_VALUES79}), {gq.FORMS_SQL},
t AS (SELECT p.*, q_id, words, unnest(CASE WHEN len(toks) = 0 THEN [''] ELSE toks END) AS tok FROM asked, p),
n AS (SELECT *, lower(tok) AS norm, contains(tok, '.') AS many, {gq.parts_sql("tok")} AS own FROM t), o AS (SELECT *, len(list_intersect(own, parts)) / greatest(len(own), 1) AS share FROM n),
b AS (SELECT q_id, identity, words, parts, max({gq.IDENTIFIER_SQL}) AS best FROM o GROUP BY ALL)
SELECT CAST(q_id AS BIGINT) AS q_id, identity, CAST(best + least(24, 6 * len(list_filter(words, lambda w: list_contains(list_transform(parts, lambda x: regexp_replace(x, '(...)s$', '\1')), regexp_replace(w, '(...)s$', '\1'))))) AS DOUBLE) AS score FROM b WHERE score >= 6"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    asked, entities = trade.questions(spark), written(E(spark, sf_dir))
    return asked, [lambda q, k: seeds.keyword_matches(q, entities, k), lambda q, k: seeds.keyword_matches(q, entities.where("type <> 'Part'"), k)]


def q80_hybrid_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, matchers = _two(spark, sf_dir)
    return seeds.validated(seeds.hybrid_matches(asked, matchers, 5)).select("q_id", "identity", F.round("score", 9).alias("score"), "rank")


SQL["q80_hybrid_seeds"] = f"""{gq._RANKED}, np AS (SELECT q_id, identity, ord, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, ord) AS rank FROM kw JOIN (SELECT identity FROM ents WHERE type <> 'Part') USING (identity)),
u AS (SELECT q_id, identity, ord, 1.0 / (60 + rank) AS part FROM ranked WHERE rank <= 20 UNION ALL SELECT q_id, identity, ord, 1.0 / (60 + rank) FROM np WHERE rank <= 20),
s AS (SELECT q_id, identity, min(ord) AS ord, sum(part) AS score FROM u GROUP BY ALL)
SELECT q_id, identity, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""


def q81_local_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.local(trade.questions(spark), trade_graph(spark, sf_dir)).select("q_id", "number", "kind", "identifier", F.md5("text").alias("digest"))


_LOCAL = f"""{gq._RANKED}, ed AS (SELECT q_id, identifier, source, type, target, row_number() OVER (PARTITION BY q_id ORDER BY weight DESC, ord) AS n FROM (SELECT DISTINCT q_id, rels.ord, rels.source, rels.type, rels.target, src_id || '->' || rels.type || '->' || tgt_id AS identifier, weight FROM ranked JOIN rels ON src_id = identity OR tgt_id = identity WHERE rank <= 3) QUALIFY n <= 10),
un AS (SELECT q_id, nk, row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, min(rank)) AS n FROM ranked JOIN ents USING (identity) WHERE rank <= 3 AND nk IS NOT NULL GROUP BY q_id, nk),
it AS (SELECT q_id, 0 AS stage, rank AS n, 'ENTITY' AS kind, identity AS identifier, name || ' (' || type || ')' AS text FROM ranked JOIN ents USING (identity) WHERE rank <= 3
  UNION ALL SELECT q_id, 1, n, 'RELATIONSHIP', identifier, source || ' -[' || type || ']-> ' || target FROM ed
  UNION ALL SELECT q_id, 2, n, 'TEXT_UNIT', 'nation-' || CAST(nk AS VARCHAR), 'About ' || n_name || '.' FROM un JOIN nation ON n_nationkey = nk WHERE n <= 5),
ctx AS (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY stage, n) AS INTEGER) AS number, kind, identifier, text FROM it)"""
SQL["q81_local_context"] = f"{_LOCAL} SELECT q_id, number, kind, identifier, md5(text) AS digest FROM ctx"


def q82_global_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.global_(trade.questions(spark), trade_graph(spark, sf_dir)).select("q_id", "kind", "identifier")


_TOP = f"""{gq._CKW}, ec AS (SELECT identity, ord, nk, name || ' ' || type AS t, {trade.TOKENS_SQL.format("name || ' ' || type")} AS words FROM ents),
ek AS (SELECT q_id, identity, ord, nk, sum(CASE WHEN contains(lower(t), tok) THEN 2 WHEN ({trade.ALLOW_SQL}) > 0 AND list_bool_or(list_prepend(false, list_transform(words, lambda w: levenshtein(tok, w) <= ({trade.ALLOW_SQL})))) THEN 1 ELSE 0 END) AS s FROM qtok, ec GROUP BY ALL HAVING s > 0),
top AS (SELECT * FROM ek QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s DESC, ord) <= {{limit}}),
ms AS (SELECT q_id, 'nation-' || CAST(nk AS VARCHAR) AS community_id, CAST(sum(s) AS DOUBLE) AS ms FROM top WHERE nk IS NOT NULL GROUP BY ALL),
b AS (SELECT q_id, community_id, CAST(score AS DOUBLE) AS kw, ms FROM kw FULL JOIN ms USING (q_id, community_id)),
sc AS (SELECT q_id, community_id, coalesce(kw / max(kw) OVER (PARTITION BY q_id), 0) + coalesce(ms / max(ms) OVER (PARTITION BY q_id), 0) AS score FROM b),
pick AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, community_id) <= 3),
inside AS (SELECT 'nation-' || CAST(x.nk AS VARCHAR) AS community_id, rels.* FROM rels JOIN ents x ON x.identity = src_id JOIN ents y ON y.identity = tgt_id AND x.nk = y.nk),
iw AS (SELECT community_id, identity, sum(weight) AS w FROM (SELECT community_id, src_id AS identity, weight FROM inside UNION ALL SELECT community_id, tgt_id, weight FROM inside) GROUP BY ALL),
mi AS (SELECT pick.q_id, pick.community_id, e.identity, row_number() OVER (PARTITION BY pick.q_id, pick.community_id ORDER BY coalesce(s, 0) DESC, coalesce(w, 0) DESC, e.ord) AS n FROM pick JOIN ents e ON pick.community_id = 'nation-' || CAST(e.nk AS VARCHAR)
  LEFT JOIN top ON top.q_id = pick.q_id AND top.identity = e.identity LEFT JOIN iw ON iw.community_id = pick.community_id AND iw.identity = e.identity QUALIFY n <= 5)"""
SQL["q82_global_retrieval"] = f"""{_TOP.format(limit=10)}
SELECT q_id, 'COMMUNITY' AS kind, community_id AS identifier FROM pick UNION ALL SELECT q_id, 'TEXT_UNIT', community_id FROM pick UNION ALL SELECT q_id, 'ENTITY', identity FROM mi"""
#: The members of interest that the engine's older query returns.
SQL["q52_global_context"] = f"{_TOP.format(limit=3)} SELECT q_id, community_id, identity, CAST(n AS INTEGER) AS n FROM mi"


def q83_drift_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.drift(trade.questions(spark), trade_graph(spark, sf_dir), model.Model(model.offline)).select("q_id", "number", "kind", "identifier")


def _for(subs: str, ctes: str, *names: str) -> str:
    """CTEs that read ``questions``, made to read ``subs`` instead, under names of their own."""
    for name in ("questions", *names):
        ctes = re.sub(rf"\b{name}\b", subs if name == "questions" else f"{subs}_{name}", ctes)
    return ctes


_TIED = "best AS (SELECT q_id, community_id FROM kw QUALIFY rank() OVER (PARTITION BY q_id ORDER BY score DESC) = 1), tied AS (SELECT q_id, community_id, row_number() OVER (PARTITION BY q_id ORDER BY community_id) AS branch FROM best)"
_AFTER = len(f"{_G}, {trade.QUESTIONS_SQL}, ")
_SUBS = f"""{gq._CKW}, {_TIED}, subs AS (SELECT q_id * 1000 + branch AS q_id, q_id AS asked, branch, community_id, 'What of ' || title || ': ' || summary AS question FROM tied JOIN comm USING (community_id) WHERE branch <= {retrieval.BRANCHES}),
{_for("subs", _LOCAL[_AFTER:], "cand", "qtok", "kw", "ranked", "ed", "un", "it", "ctx")},
every AS (SELECT asked AS q_id, branch, number AS n, kind, identifier FROM subs_ctx JOIN subs USING (q_id) UNION ALL SELECT asked, branch, 0, 'COMMUNITY', community_id FROM subs),
firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY q_id, kind, identifier ORDER BY branch, n) = 1),
dctx AS (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY branch, n) AS INTEGER) AS number, kind, identifier FROM firsts)"""
SQL["q83_drift_context"] = f"{_SUBS} SELECT q_id, number, kind, identifier FROM dctx"


def q93_drift_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a model: branches at the communities that tie at the best score, and the first whose local answer is a relationship."""
    g = trade_graph(spark, sf_dir)
    return answers.drift_answers(trade.questions(spark), g.communities, g.entities, g.relationships)


SQL["q93_drift_answers"] = f"""{gq._CKW}, {_TIED}, subs AS (SELECT q_id * 1000 + branch AS q_id, q_id AS asked, branch, question || ' Community summary: ' || summary AS question FROM tied JOIN comm USING (community_id) JOIN questions USING (q_id)),
{_for("subs", gq._RANKED[_AFTER:] + ", " + gq._HOP, "cand", "qtok", "kw", "ranked", "near", "hcand", "hw", "hs", "hb")},
told AS (SELECT asked, branch, source || ' ' || lower(replace(rels.type, '_', ' ')) || ' ' || target || '.' AS said FROM subs_hb JOIN subs USING (q_id) JOIN rels ON rels.ord = subs_hb.ord),
firsts AS (SELECT asked AS q_id, min(branch) AS branch, arg_min(said, branch) AS said FROM told GROUP BY asked)
SELECT q.q_id, CAST(branch AS INTEGER) AS branch, CASE WHEN said IS NOT NULL THEN '{answers.DRIFT_LEAD}{answers.LOCAL_HOP}' || said WHEN q.q_id IN (SELECT asked FROM subs) THEN '{answers.DRIFT_NONE}' ELSE '{answers.GLOBAL_NONE}' END AS answer FROM questions q LEFT JOIN firsts USING (q_id)"""


def q94_synthesised_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a deterministic model to the communities, members and passages of each question."""
    found, _ = retrieval.answered("GLOBAL", trade.questions(spark), trade_graph(spark, sf_dir), model.Model(model.offline))
    return found.select("q_id", "status", "answer", F.array_join("cited", ",").alias("cited"))


SQL["q94_synthesised_global"] = f"""{_TOP.format(limit=10)}, f AS (SELECT q_id, arg_min(community_id, n) AS first, count(*) + (SELECT count(DISTINCT (identity, 0)) FROM mi WHERE mi.q_id = p.q_id) + count(*) AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, community_id) AS n FROM pick) p GROUP BY q_id)
SELECT q.q_id, CASE WHEN items IS NULL THEN 'NO_CONTEXT' ELSE 'ANSWERED' END AS status, 'From ' || items || ' items [1].' AS answer, coalesce(first, '') AS cited FROM questions q LEFT JOIN f USING (q_id)"""


def q95_synthesised_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a deterministic model to the union of each question's branches."""
    found, _ = retrieval.answered("DRIFT", trade.questions(spark), trade_graph(spark, sf_dir), model.Model(model.offline))
    return found.select("q_id", "status", "answer", F.array_join("cited", ",").alias("cited"))


SQL["q95_synthesised_drift"] = f"""{_SUBS}, f AS (SELECT q_id, count(*) AS items, arg_min(identifier, number) FILTER (kind = 'TEXT_UNIT') AS first FROM dctx GROUP BY q_id)
SELECT q.q_id, CASE WHEN items IS NULL THEN 'NO_CONTEXT' WHEN first IS NULL THEN 'NOT_IN_CONTEXT' ELSE 'ANSWERED' END AS status, CASE WHEN first IS NOT NULL THEN 'From ' || items || ' items [1].' END AS answer, coalesce(first, '') AS cited FROM questions q LEFT JOIN f USING (q_id)"""


def q84_synthesised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a deterministic model to the local context of each question."""
    found, _ = retrieval.answered("LOCAL", trade.questions(spark), trade_graph(spark, sf_dir), model.Model(model.offline), budget=graph.Budget(hops=1, relationships=10, per_hop=None, new_nodes=None, nodes=None, units=5, member_units=False))
    return found.select("q_id", "status", F.array_join("cited", ",").alias("cited"))


SQL["q84_synthesised_answers"] = f"""{_LOCAL}, c AS (SELECT q_id, count(*) AS items, arg_min(identifier, number) FILTER (kind = 'TEXT_UNIT') AS first FROM ctx GROUP BY q_id)
SELECT q.q_id, CASE WHEN c.items IS NULL THEN 'NO_CONTEXT' WHEN first IS NULL THEN 'NOT_IN_CONTEXT' ELSE 'ANSWERED' END AS status, coalesce(first, '') AS cited FROM questions q LEFT JOIN c USING (q_id)"""


def q85_map_reduce_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = retrieval.answered("MAP_REDUCE", trade.questions(spark), trade_graph(spark, sf_dir), model.Model(model.offline))
    return found.select("q_id", "status", "answer")


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.groupBy(F.lit(what).alias("what"), F.col("type")).agg(F.count("*").alias("n")) for what, df in tables.items()]
    return written(reduce(DataFrame.unionByName, rows))


def _imported(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, shared_dir(spark))
    here = F.lit("trade").alias("corpus_id")
    region = F.create_map(F.lit("source"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")))
    units = table(spark, sf_dir, "nation").select(here, F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("n").alias("document_name"), F.col("n_nationkey").cast("int").alias("ordinal"), F.col("n_name").alias("text"), region.alias("attributes"))
    entities = E(spark, sf_dir).select(here, "identity", "name", "type", "description", "unit_ids", F.create_map().cast("map<string,string>").alias("attributes"), "ord")
    edges = R(spark, sf_dir).where("type in ('BUYS_FROM', 'LOCATED_IN', 'PART_OF')").select(here, "*")
    members = entities.where("type = 'Customer'").select(here, F.get("unit_ids", 0).alias("community_id"), "identity", "ord")
    empty = spark.createDataFrame([], "corpus_id string, community_id string, title string, summary string, attributes map<string,string>, ord long")
    updates.import_whole(store, "trade", {"text_units": units, "entities": entities.where("type <> 'Region'"), "relationships": edges, "communities": empty, "memberships": members})
    return store


def q86_import_whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph without its regions imported into a new store: regions come back as ends of edges."""
    store = _imported(spark, sf_dir)
    read = store.table("relationships", "trade")
    rows = _counted({"entities": store.table("entities", "trade"), "relationships": read, "members": store.table("memberships", "trade").withColumnRenamed("community_id", "type")})
    return rows


SQL["q86_import_whole_graph"] = f"""{_G} SELECT 'entities' AS what, type, count(*) AS n FROM ents WHERE type <> 'Region' OR identity IN (SELECT tgt_id FROM rels WHERE type = 'PART_OF') GROUP BY type
UNION ALL SELECT 'relationships', type, count(*) FROM rels WHERE type IN ('BUYS_FROM', 'LOCATED_IN', 'PART_OF') GROUP BY type
UNION ALL SELECT 'members', 'nation-' || CAST(nk AS VARCHAR), count(*) FROM ents WHERE type = 'Customer' GROUP BY nk"""


def q87_remove_source_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the imported trade graph without the units of one region."""
    store = _imported(spark, sf_dir)
    updates.remove_source(store, "trade", "region-1")
    return _counted({"entities": store.table("entities", "trade"), "relationships": store.table("relationships", "trade"), "units": store.table("text_units", "trade").withColumn("type", F.lit("unit")), "members": store.table("memberships", "trade").withColumnRenamed("community_id", "type")})


SQL["q87_remove_source_from_store"] = f"""{_G}, gone AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1),
en AS (SELECT * FROM ents WHERE type <> 'Region' OR identity IN (SELECT tgt_id FROM rels WHERE type = 'PART_OF')), ed AS (SELECT * FROM rels WHERE type IN ('BUYS_FROM', 'LOCATED_IN', 'PART_OF')),
re AS (SELECT identity FROM en WHERE nk IN (SELECT k FROM gone)),
dead AS (SELECT * FROM ed WHERE src_id IN (SELECT identity FROM re) OR tgt_id IN (SELECT identity FROM re)), lef AS (SELECT * FROM ed WHERE ord NOT IN (SELECT ord FROM dead)),
orph AS (SELECT i FROM (SELECT src_id AS i FROM dead UNION SELECT tgt_id FROM dead) WHERE i NOT IN (SELECT identity FROM re) AND i NOT IN (SELECT src_id FROM lef) AND i NOT IN (SELECT tgt_id FROM lef) AND i NOT IN (SELECT identity FROM en WHERE nk IS NOT NULL)),
stay AS (SELECT * FROM en WHERE identity NOT IN (SELECT identity FROM re) AND identity NOT IN (SELECT i FROM orph))
SELECT 'entities' AS what, type, count(*) AS n FROM stay GROUP BY type UNION ALL SELECT 'relationships', type, count(*) FROM lef GROUP BY type
UNION ALL SELECT 'units', 'unit', count(*) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'members', 'nation-' || CAST(nk AS VARCHAR), count(*) FROM stay WHERE type = 'Customer' GROUP BY nk"""


def q96_removed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements themselves that a removal of one region's units leaves in the store."""
    store = _imported(spark, sf_dir)
    updates.remove_source(store, "trade", "region-1")
    kind = lambda name, *key: store.table(name, "trade").select(F.lit(name).alias("what"), F.concat_ws("->", *key).alias("key"))
    weighed = store.table("relationships", "trade").select(F.lit("relationships").alias("what"), F.concat_ws("->", "src_id", "type", "tgt_id", F.col("weight").cast("string")).alias("key"))
    rows = [kind("entities", "identity"), weighed, kind("text_units", "id"), kind("memberships", "community_id", "identity"), kind("communities", "community_id")]
    return written(reduce(DataFrame.unionByName, rows))


SQL["q96_removed_contents"] = f"""{SQL["q87_remove_source_from_store"].partition("SELECT 'entities' AS what, type")[0]} SELECT 'entities' AS what, identity AS key FROM stay
UNION ALL SELECT 'relationships', src_id || '->' || type || '->' || tgt_id || '->' || weight FROM lef UNION ALL SELECT 'text_units', 'nation-' || n_nationkey FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT 'memberships', 'nation-' || nk || '->' || identity FROM stay WHERE type = 'Customer' UNION ALL SELECT DISTINCT 'communities', 'nation-' || nk FROM ents WHERE type = 'Customer' AND nk NOT IN (SELECT k FROM gone)"""


def q97_graph_against_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's local context against a vector ranking: six passages about nations by the question's number, five of them used, every
    second without a document."""
    g = trade_graph(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    region = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")))
    chunks = nation.select(F.concat(F.lit("chunk-"), F.col("n_nationkey").cast("string")).alias("id"), region.alias("document_name"), F.concat(F.lit("About "), "n_name", F.lit(".")).alias("text"))
    ranks = trade.questions(spark).select("q_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"))
    ranking = ranks.select("q_id", F.concat(F.lit("chunk-"), ((F.col("q_id") * 7 + F.col("rank")) % 25).cast("string")).alias("chunk_id"), "rank", (F.col("rank") <= 5).alias("used"))
    context = written(retrieval.local(trade.questions(spark), g))
    rows, _ = compare.compared(trade.questions(spark), context, ranking, chunks, g.units)
    return rows.select("q_id", "graph_items", "graph_documents", "vector_documents", "passages", "shared", F.md5("verdict").alias("verdict"))


SQL["q97_graph_against_vector"] = f"""{_LOCAL}, gi AS (SELECT q_id, count(*) AS a, count(DISTINCT n_regionkey) FILTER (kind = 'TEXT_UNIT') AS b FROM ctx LEFT JOIN nation ON identifier = 'nation-' || n_nationkey GROUP BY q_id),
used AS (SELECT q_id, (q_id * 7 + r) % 25 AS k FROM questions, range(1, 6) t(r)),
vi AS (SELECT u.q_id, count(DISTINCT n_regionkey) FILTER (k % 2 = 0) AS c, count(*) AS d, count(x.identifier) AS e FROM used u JOIN nation ON n_nationkey = k LEFT JOIN ctx x ON x.q_id = u.q_id AND x.kind = 'TEXT_UNIT' AND x.identifier = 'nation-' || k GROUP BY u.q_id),
f AS (SELECT q.q_id, coalesce(a, 0) AS gi, coalesce(b, 0) AS gd, c AS vd, d AS vi, e AS s FROM questions q LEFT JOIN gi USING (q_id) JOIN vi USING (q_id))
SELECT q_id, gi AS graph_items, gd AS graph_documents, vd AS vector_documents, vi AS passages, s AS shared, md5(
  CASE WHEN gd = vd THEN 'Both sides retrieved passages from the same number of distinct documents (' || gd || ').' ELSE CASE WHEN gd > vd THEN 'GraphRAG (LOCAL)' ELSE 'Vector Search' END || ' retrieved passages from more distinct documents (' || greatest(gd, vd) || ' vs ' || least(gd, vd) || ').' END
  || ' ' || CASE WHEN gi = vi THEN 'Both sides retrieved the same number of context items (' || gi || ').' ELSE CASE WHEN gi > vi THEN 'GraphRAG (LOCAL)' ELSE 'Vector Search' END || ' retrieved more context items (' || greatest(gi, vi) || ' vs ' || least(gi, vi) || ').' END
  || ' ' || s || ' of the ' || vi || ' passages Vector Search retrieved ' || CASE WHEN s = 1 THEN 'was' ELSE 'were' END || ' also read by GraphRAG.') AS verdict FROM f"""


def q88_extraction_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mentions with their brands as types, order lines as edges to them: names resolved, edges re-keyed and merged."""
    name = F.concat(F.lit('"'), F.initcap("p_name"), F.lit('!"'))
    p = table(spark, sf_dir, "part")
    none = F.create_map().cast("map<string,string>")
    mentions = p.select(name.alias("name"), F.col("p_brand").alias("type"), F.lit("").alias("description"), F.array(F.col("p_partkey").cast("string")).alias("unit_ids"), none.alias("attributes"), F.col("p_partkey").cast("long").alias("at"))
    lines = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    edges = lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.lit("Seller").alias("source_type"), F.lit("sells").alias("type"), name.alias("target"), F.col("p_brand").alias("target_type"), F.lit("").alias("description"), F.array(F.col("l_orderkey").cast("string")).alias("unit_ids"), F.lit(1).cast("long").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    _, merged, _ = updates.folded(mentions, edges)
    return merged.select("src_id", "tgt_id", "weight")


SQL["q88_extraction_fold"] = """WITH m AS (SELECT p_partkey, p_name AS k, '"' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || '!"' AS name, p_brand AS type FROM part),
t AS (SELECT k, type, count(*) AS n, min(p_partkey) AS first FROM m GROUP BY ALL), r AS (SELECT k, arg_max(type, n * 1000000000 - first) AS type FROM t GROUP BY k), c AS (SELECT k, arg_min(name, p_partkey) AS name FROM m GROUP BY k)
SELECT 's' || CAST(l_suppkey AS VARCHAR) || '::seller' AS src_id, lower(c.name) || '::' || lower(r.type) AS tgt_id, count(DISTINCT l_orderkey) AS weight FROM lineitem JOIN m ON p_partkey = l_partkey JOIN r ON r.k = m.k JOIN c ON c.k = m.k GROUP BY ALL"""


def q89_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", lenient_json.field_text("props", F.lit("k")).alias("k"))


SQL["q89_json_fields"] = "SELECT event_id, coalesce(props->>'$.k', '') AS k FROM events"

def q98_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers told as a number, a text, a list or objects, in damaged JSON, read as each of the three."""
    n, sort = F.get_json_object("props", "$.k"), F.pmod("event_id", F.lit(5))
    told = (
        F.when(sort == 0, F.concat(F.lit("{'v': "), n, F.lit(".5,}")))
        .when(sort == 1, F.concat(F.lit('Here: {"v": " '), n, F.lit(' "}')))
        .when(sort == 2, F.concat(F.lit('{v: ["a", '), n, F.lit(', "", true, null, {"x": 1}]')))
        .when(sort == 3, F.concat(F.lit('{"v": [{"id": '), n, F.lit('}, "no object", {"id": "b"}]}')))
        .otherwise(F.concat(F.lit('{"v": {"id": '), n, F.lit("}}")))
    )
    read = table(spark, sf_dir, "events").select("event_id", lenient_json.field_values(told, F.lit("v")).alias("r"))
    return read.select("event_id", "r.number", F.array_join("r.texts", "|").alias("texts"), F.array_join("r.objects", "|").alias("objects"))


SQL["q98_json_values"] = """WITH e AS (SELECT event_id, event_id % 5 AS s, props->>'$.k' AS k FROM events)
SELECT event_id, CASE s WHEN 0 THEN CAST(k AS DOUBLE) + 0.5 WHEN 1 THEN CAST(k AS DOUBLE) END AS number,
  CASE s WHEN 0 THEN k || '.5' WHEN 1 THEN k WHEN 2 THEN 'a|' || k || '|true' WHEN 3 THEN 'no object' ELSE '' END AS texts,
  CASE s WHEN 2 THEN '{"x":1}' WHEN 3 THEN '{"id":' || k || '}|{"id":"b"}' WHEN 4 THEN '{"id":' || k || '}' ELSE '' END AS objects FROM e"""


def q99_frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that extraction would be told as hints: the most mentioned, earlier ones first among equals."""
    found = merge.extracted_entities(gq._units(spark, sf_dir)).select("name", "at")
    return merge.frequent_names(found).select("name", "n")


SQL["q99_frequent_names"] = f"""{gq._SENT}, m AS (SELECT doc_id, pos, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM n),
e AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos, k) = 1)
SELECT name, count(*) AS n FROM e GROUP BY name ORDER BY n DESC, min((doc_id, pos, k)) LIMIT 50"""

def q100_extraction_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events of extracting every document, a corpus for each language; documents without a full stop count as failed."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("corpus_id"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), "text")
    failed = docs.where("instr(text, '.') = 0").select("corpus_id", F.col("id").alias("unit_id"), F.lit("no sentence").alias("message"))
    return fold.extraction_progress(docs, failed)


SQL["q100_extraction_progress"] = """SELECT lang AS corpus_id, row_number() OVER w AS seq, 'text-unit-extracted' AS type,
  '{"id":"' || doc_id || '","done":' || row_number() OVER w || ',"total":' || count(*) OVER (PARTITION BY lang) || CASE WHEN NOT contains(text, '.') THEN ',"error":"no sentence"' ELSE '' END || '}' AS data
FROM documents WHERE lang IS NOT NULL WINDOW w AS (PARTITION BY lang ORDER BY doc_id)"""

QUERIES = {n: f for n, f in globals().items() if n[:1] == "q" and n[1:3].isdigit()}
__all__ = ["QUERIES", "SQL"]
