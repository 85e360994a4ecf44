"""Retrieval as context items, and answers that a model writes from them: local, global, map-reduce and branching modes.

A context item is (q_id, number, kind, identifier, label, text, score, hop), numbered from 1 in each question. All steps run
for a batch of questions at once; only the model sees one question at a time, with the few items of its context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import answers, graph, seeds
from quillgraph.operators.model import Model, ReplyError
from quillgraph.operators.tables import small, written

#: Communities of a global context with their members and units, and branches of a branching one.
COMMUNITIES, MEMBERS, UNITS, BRANCHES = 3, 5, 2, 3
ITEM_COLUMNS = ("q_id", "number", "kind", "identifier", "label", "text", "score", "hop")
_ANSWER = "q_id long, status string, answer string, cited array<string>, reason string"


@dataclass(frozen=True)
class Graph:
    """The tables of one corpus; ``units`` have (id, text, document_name)."""

    entities: DataFrame
    relationships: DataFrame
    units: DataFrame
    communities: DataFrame
    memberships: DataFrame


#: A seed matcher: questions (q_id, question), a graph and a limit to (q_id, identity, score, ord, rank).
Matcher = Callable[[DataFrame, Graph, int], DataFrame]


def by_keyword(questions: DataFrame, g: Graph, limit: int) -> DataFrame:
    return seeds.keyword_matches(questions, g.entities, limit)


def by_identifier(questions: DataFrame, g: Graph, limit: int) -> DataFrame:
    return seeds.identifier_matches(questions, seeds.name_forms(g.entities), limit)


def chained(*matchers: Matcher) -> Matcher:
    """For each question the first matcher that finds anything."""
    return lambda questions, g, limit: seeds.first_non_empty(*(m(questions, g, limit) for m in matchers))


def fused(*matchers: Matcher) -> Matcher:
    """Reciprocal rank fusion of the first max(limit, 20) of each matcher."""
    return lambda questions, g, limit: seeds.hybrid_matches(questions, [lambda q, k, m=m: m(q, g, k) for m in matchers], limit)


# -- context ---------------------------------------------------------------------------------------------------------------


def with_texts(items: DataFrame, g: Graph) -> DataFrame:
    """``items`` with label and text by kind and identifier; only the texts of what was picked are read. A reached node without
    a stored entity gets its name from its identity."""
    items = written(items)
    picked = small(items.select("kind", "identifier").distinct())
    e = g.entities.select(F.lit("ENTITY").alias("kind"), F.col("identity").alias("identifier"), F.col("name").alias("label"), graph.entity_text().alias("text"))
    wanted = picked.where("kind = 'RELATIONSHIP'").select(F.col("identifier").alias("edge_key"))
    r = graph.keyed(g.relationships).join(wanted, "edge_key", "left_semi").groupBy("edge_key").agg(F.min_by(F.struct(graph.edge_label().alias("label"), graph.edge_text().alias("text")), "ord").alias("x"))
    r = r.select(F.lit("RELATIONSHIP").alias("kind"), F.col("edge_key").alias("identifier"), "x.label", "x.text")
    u = g.units.select(F.lit("TEXT_UNIT").alias("kind"), F.col("id").alias("identifier"), F.coalesce("document_name", F.lit("")).alias("label"), "text")
    c = g.communities.select(F.lit("COMMUNITY").alias("kind"), F.col("community_id").alias("identifier"), F.col("title").alias("label"), F.concat_ws(": ", F.nullif(F.trim("title"), F.lit("")), "summary").alias("text"))
    known = e.unionByName(r).unionByName(u).unionByName(c).join(picked, ["kind", "identifier"], "left_semi")
    out = items.join(known, ["kind", "identifier"], "left")
    stub = F.substring_index("identifier", "::", 1)
    return out.withColumns({"label": F.coalesce("label", stub), "text": F.coalesce("text", stub)}).select(*ITEM_COLUMNS)


def local(questions: DataFrame, g: Graph, matcher: Matcher = by_keyword, budget: graph.Budget = graph.ANSWER_CONTEXT) -> DataFrame:
    """Context items of a bounded expansion from each question's seeds."""
    return with_texts(answers.local_context(questions, matcher(questions, g, budget.seeds), g.relationships, g.entities, g.units, budget), g)


def _around(picked: DataFrame, g: Graph) -> tuple[Graph, DataFrame]:
    """The graph with the members of the picked communities only, and the edges inside these, found once for all that is told of them."""
    g = replace(g, memberships=g.memberships.join(small(picked.select("community_id").distinct()), "community_id", "left_semi"))
    return g, written(graph.internal_edges(g.relationships, g.memberships))


def community_units(g: Graph, inside: DataFrame | None = None) -> DataFrame:
    """(community_id, unit_id, score, pos): units by 1 for each citing member and the weight of each internal relationship, ties to
    the first seen; members come before relationships. ``inside``: the internal edges, where they are known."""
    cited = g.memberships.select("community_id", "identity", F.col("ord").alias("at")).join(g.entities.select("identity", "unit_ids"), "identity")
    rows = cited.select("community_id", F.lit(0).alias("stage"), "at", F.posexplode("unit_ids").alias("p", "unit_id"), F.lit(1).cast("long").alias("w"))
    inside = graph.internal_edges(g.relationships, g.memberships) if inside is None else inside
    rows = rows.unionByName(inside.select("community_id", F.lit(1).alias("stage"), F.col("ord").alias("at"), F.posexplode("unit_ids").alias("p", "unit_id"), F.col("weight").cast("long").alias("w")))
    ranked = rows.groupBy("community_id", "unit_id").agg(F.sum("w").alias("score"), F.min(F.struct("stage", "at", "p")).alias("first"))
    pos = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("score"), "first"))
    return ranked.select("community_id", "unit_id", "score", pos.alias("pos"))


def _passages(picked: DataFrame, g: Graph, inside: DataFrame, most: int) -> DataFrame:
    """(q_id, rank, unit_id): the best units of each picked community (q_id, community_id, rank), none twice in a question."""
    ranked = community_units(g, inside).join(g.units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi")
    # a question with k communities can lose at most (k - 1) * most of a community's first units to the others
    room = F.lit(most) * F.count("*").over(Window.partitionBy("q_id"))
    rows = picked.withColumn("room", room).join(ranked, "community_id").where(F.col("pos") <= F.col("room"))
    return answers.units_not_taken(rows.select("q_id", "rank", "pos", "unit_id"), most)


def global_(questions: DataFrame, g: Graph, matcher: Matcher = by_keyword, top: int = COMMUNITIES) -> DataFrame:
    """For each of a question's best communities its item, its members of interest and its units."""
    matches = written(matcher(questions, g, 10))
    picked = answers.global_scores(questions, g.communities, g.memberships, matches).where(F.col("rank") <= top)
    picked = written(picked.select("q_id", "community_id", "score", "rank"))
    near, inside = _around(picked, g)
    listed = answers.members_of_interest(picked, near.memberships, matches, graph.end_weights(inside), MEMBERS)
    units = _passages(picked, near, inside, UNITS)
    rows = picked.select("q_id", F.lit("COMMUNITY").alias("kind"), F.col("community_id").alias("identifier"), "score", "rank", F.lit(0).alias("stage"), F.lit(1).alias("n"))
    zero = F.lit(0.0).alias("score")
    rows = rows.unionByName(listed.join(picked.select("q_id", "community_id", "rank"), ["q_id", "community_id"]).select("q_id", F.lit("ENTITY").alias("kind"), F.col("identity").alias("identifier"), zero, "rank", F.lit(1).alias("stage"), "n"))
    rows = rows.unionByName(units.select("q_id", F.lit("TEXT_UNIT").alias("kind"), F.col("unit_id").alias("identifier"), zero, "rank", F.lit(2).alias("stage"), F.row_number().over(Window.partitionBy("q_id", "rank").orderBy("unit_id")).alias("n")))
    return with_texts(_numbered(rows, F.struct("kind", "identifier"), "rank", "stage", "n").withColumn("hop", F.lit(0)), g)


def _numbered(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in a question, numbered in ``order``."""
    first = answers.first_of_each(rows, key, *order)
    return first.withColumn("number", F.row_number().over(Window.partitionBy("q_id").orderBy(*order)))


def branches(questions: DataFrame, g: Graph, model: Model = Model(), most: int = BRANCHES) -> DataFrame:
    """(q_id, branch, community_id, sub_question, warning, sub_id): a follow-up question for each best community; where the model
    fails the deterministic ones stand, with a warning."""
    found = answers.drift_candidates(questions, g.communities).where(F.col("branch") <= most)
    rows = found.join(questions.select("q_id", "question"), "q_id").join(g.communities.select("community_id", "title", "summary"), "community_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("branch")
        warning, said = None, pdf["sub_question"].tolist()
        if model.can("SUB_QUESTIONS"):
            try:
                said = model.sub_questions(pdf["question"].iloc[0], pdf[["title", "summary"]].to_dict("records"))
            except Exception as e:
                warning = str(e)[:200]
        return pdf.assign(sub_question=said, warning=warning)[["q_id", "branch", "community_id", "sub_question", "warning"]]

    out = rows.groupBy("q_id").applyInPandas(run, "q_id long, branch int, community_id string, sub_question string, warning string")
    return written(out.withColumn("sub_id", F.monotonically_increasing_id()))


def drift(questions: DataFrame, g: Graph, model: Model = Model(), matcher: Matcher = by_keyword, budget: graph.Budget = graph.ANSWER_CONTEXT) -> DataFrame:
    """The distinct union of the local contexts of each question's branches, in the order of the branches; a branch whose
    sub-question has no seeds starts from those of the question."""
    spawned = branches(questions, g, model)
    asked = spawned.select(F.col("sub_id").alias("q_id"), F.col("sub_question").alias("question"))
    # questions and their sub-questions look for seeds together
    every = asked.withColumn("sub", F.lit(True)).unionByName(questions.select("q_id", "question", F.lit(False).alias("sub")))
    every = written(every.withColumn("n", F.monotonically_increasing_id()))
    hits = matcher(every.select(F.col("n").alias("q_id"), "question"), g, budget.seeds).withColumnRenamed("q_id", "n")
    hits = written(hits.join(every.select("n", "q_id", "sub"), "n").drop("n"))
    own = spawned.select("sub_id", "q_id").join(hits.where("not sub"), "q_id").drop("q_id").withColumnRenamed("sub_id", "q_id")
    start = written(seeds.first_non_empty(hits.where("sub"), own).drop("priority"))
    found = answers.local_context(asked, start, g.relationships, g.entities, g.units, budget)
    back = spawned.select(F.col("sub_id"), F.col("q_id").alias("asked_by"), "branch", "community_id")
    rows = found.withColumnRenamed("q_id", "sub_id").join(back, "sub_id").select(F.col("asked_by").alias("q_id"), "kind", "identifier", "score", "hop", "branch", F.col("number").alias("n"))
    heads = spawned.select("q_id", F.lit("COMMUNITY").alias("kind"), F.col("community_id").alias("identifier"), F.lit(0.0).alias("score"), F.lit(0).alias("hop"), "branch", F.lit(0).alias("n"))
    return with_texts(_numbered(rows.unionByName(heads), F.struct("kind", "identifier"), "branch", "n"), g)


def status(questions: DataFrame, context: DataFrame, g: Graph | None = None) -> DataFrame:
    """(q_id, status): MATCHED, NO_MATCH, or NO_COMMUNITIES where a mode over communities (``g``) has none."""
    none = "NO_COMMUNITIES" if g is not None and g.communities.isEmpty() else "NO_MATCH"
    hit = context.select("q_id").distinct().withColumn("hit", F.lit(True))
    return questions.select("q_id").join(hit, "q_id", "left").select("q_id", F.when(F.col("hit"), "MATCHED").otherwise(none).alias("status"))


# -- answers by a model ----------------------------------------------------------------------------------------------------


def synthesised(questions: DataFrame, context: DataFrame, model: Model) -> DataFrame:
    """(q_id, status, answer, cited, reason): what the model writes from each question's items, its markers checked against the
    source passages and renumbered; status ANSWERED, NOT_IN_CONTEXT, NO_CONTEXT or FAILED."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        items = pdf[pdf["number"] > 0]
        q_id, question = pdf["q_id"].iloc[0], pdf["question"].iloc[0]
        out = lambda *x: pd.DataFrame([(q_id, *x)], columns=["q_id", "status", "answer", "cited", "reason"])
        if items.empty:
            return out("NO_CONTEXT", None, [], "nothing was retrieved")
        try:
            found = model.answer(question, items[["number", "kind", "text"]].to_dict("records"))
        except Exception as e:
            return out("FAILED", None, [], str(e)[:500])
        if found is None:
            return out("FAILED", None, [], "no model")
        if found[0]:
            return out("NOT_IN_CONTEXT", None, [], "the context doesn't answer the question")
        units = items[items["kind"] == "TEXT_UNIT"]
        said, used = tx.resolve_citations(found[1], units["number"].tolist())
        name = dict(zip(units["number"], units["identifier"], strict=True))
        return out("ANSWERED", said, [name[k] for k in used], None)

    rows = questions.select("q_id", "question").join(context.select("q_id", "number", "kind", "identifier", "text"), "q_id", "left").withColumn("number", F.coalesce("number", F.lit(0)))
    return rows.groupBy("q_id").applyInPandas(run, _ANSWER)


def map_reduce_context(questions: DataFrame, g: Graph, model: Model, matcher: Matcher = by_keyword) -> DataFrame:
    """Items of a map-reduce answer: the best points about communities, then passages of the communities they come from."""
    ranked = answers.global_scores(questions, g.communities, g.memberships, matcher(questions, g, 10)).join(g.communities.select("community_id", "title", "summary"), "community_id")

    def score(question: str, rows: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
        return model.points(question, [{"community_id": c, "title": "", "summary": s} for c, s in rows])

    points = written(answers.map_points(questions, ranked, score))
    first = answers.passage_communities(points)
    first = written(first.select("q_id", "community_id", F.col("k").alias("rank")))
    units = _passages(first, *_around(first, g), UNITS)
    said = points.select("q_id", F.lit("COMMUNITY").alias("kind"), F.concat_ws("#", "community_id", "n").alias("identifier"), F.col("community_id").alias("label"), "text", F.col("score").cast("double").alias("score"), F.lit(0).alias("stage"), "n")
    read = units.join(g.units.select(F.col("id").alias("unit_id"), "text", F.coalesce("document_name", F.lit("")).alias("label")), "unit_id")
    read = read.select("q_id", F.lit("TEXT_UNIT").alias("kind"), F.col("unit_id").alias("identifier"), "label", "text", F.lit(0.0).alias("score"), F.lit(1).alias("stage"), F.row_number().over(Window.partitionBy("q_id").orderBy("rank", "unit_id")).alias("n"))
    return _numbered(said.unionByName(read), F.struct("kind", "identifier"), "stage", "n").withColumn("hop", F.lit(0)).select(*ITEM_COLUMNS)


def answered(mode: str, questions: DataFrame, g: Graph, model: Model, matcher: Matcher = by_keyword, budget: graph.Budget = graph.ANSWER_CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(answers, context) of a mode: LOCAL, GLOBAL, MAP_REDUCE or DRIFT; the context is written once and read by both."""
    if mode == "LOCAL":
        context = local(questions, g, matcher, replace(budget, neighbours=True))
    elif mode == "GLOBAL":
        context = global_(questions, g, matcher)
    elif mode == "MAP_REDUCE":
        context = map_reduce_context(questions, g, model, matcher)
    elif mode == "DRIFT":
        context = drift(questions, g, model, matcher, budget)
    else:
        raise ValueError(f"unknown mode: {mode}")
    context = written(context)
    return synthesised(questions, context, model), context


def gate(questions: DataFrame, registry: DataFrame, offline: bool = False) -> DataFrame:
    """(q_id, code, reason) of questions (q_id, question, mode, corpus_id): 200, or why a question can't be asked.

    400 for a blank question or an unknown mode, 404 for an unknown corpus, 409 for one that isn't ready or a mode that needs a model.
    """
    rows = questions.join(registry.select("corpus_id", F.col("status").alias("state")), "corpus_id", "left")
    mode = F.upper(F.trim(F.coalesce("mode", F.lit(""))))
    reason = (
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "blank question")
        .when(~mode.isin("LOCAL", "GLOBAL", "DRIFT", "VECTOR"), "unknown mode")
        .when(F.col("state").isNull(), "unknown corpus")
        .when(F.col("state") == "BUILDING", "corpus is building")
        .when(F.col("state") == "FAILED", "corpus failed")
        .when(F.lit(offline) & (mode == "VECTOR"), "needs an embedder")
    )
    code = F.when(reason.isNull(), 200).when(reason.isin("blank question", "unknown mode"), 400).when(reason == "unknown corpus", 404).otherwise(409)
    return rows.select("q_id", code.alias("code"), F.coalesce(reason, F.lit("ok")).alias("reason"))


__all__ = ["Graph", "Matcher", "ReplyError", "answered", "branches", "by_identifier", "by_keyword", "chained", "community_units", "drift", "fused", "gate", "global_", "local", "map_reduce_context", "status", "synthesised", "with_texts"]
