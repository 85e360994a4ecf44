"""Retrieval and deterministic answers for batches of questions: vector, local, global and branching modes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import clusters, graph, seeds
from quillgraph.operators.tables import small, written

TOP, RANKED = 5, 12
MAP_COMMUNITIES, MAP_BATCH, POINTS, PASSAGE_COMMUNITIES = 30, 5, 20, 5

#: Answer sentences.
VECTOR_LEAD = "Based on the retrieved text passages: "
VECTOR_NONE = "No relevant chunks were found for this question."
LOCAL_NONE = "No graph-grounded local match was found for this corpus yet. Try asking about a named entity or relationship visible in the graph."
LOCAL_HOP = "In this corpus graph, "
LOCAL_SEED = "In this corpus graph, the closest local match is "
GLOBAL_LEAD = "Across the corpus, the strongest signal is that "
GLOBAL_NONE = "The corpus has Community summaries, but none of them clearly match that question yet. Try asking about a named person, place, or event."
DRIFT_LEAD = "DRIFT matched a relevant Community and then grounded the answer locally: "
DRIFT_NONE = "DRIFT matched a relevant Community, but its spawned sub-question did not find a graph-grounded local match yet."


# -- vector ----------------------------------------------------------------------------------------------------------------


def vector_ranking(questions: DataFrame, chunks: DataFrame, ranked: int = RANKED, used: int = TOP) -> DataFrame:
    """(q_id, chunk_id, ord, score, rank, used): the chunks most similar to each question (q_id, vector); texts stay out.

    ``chunks`` (id, ord, embedding) are clustered once; see ``clusters`` for what a search reads of them.
    """
    found = clusters.nearest_of(clusters.clustered(chunks.select(F.col("id").alias("chunk_id"), "ord", "embedding")), questions, ranked)
    return found.withColumn("used", F.col("rank") <= used)


def vector_answers(questions: DataFrame, ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, answer): the used chunk texts joined in rank order; only those texts are read."""
    used = ranking.where("used").join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    lists = used.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    out = questions.select("q_id").join(lists, "q_id", "left")
    return out.select("q_id", F.when(F.size("texts") > 0, F.concat(F.lit(VECTOR_LEAD), F.array_join("texts", "\n---\n"))).otherwise(VECTOR_NONE).alias("answer"))


# -- local -----------------------------------------------------------------------------------------------------------------


def keyword_column(question: Column, text: Column) -> Column:
    return tx.keyword_score(tx.tokens(question), text)


def local_answers(questions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, status, seed, edge_key, answer): best keyword seed, its best edge, and the sentence that states it."""
    best = seeds.keyword_matches(questions, entities, 1).join(questions, "q_id")
    named = best.join(entities.select("identity", "name", F.col("type").alias("kind")), "identity").select("q_id", "question", "identity", "name", "kind")
    hops = graph.one_hop(named, edges, keyword_column)
    hop = F.concat(F.lit(LOCAL_HOP), F.col("source"), F.lit(" "), F.lower(F.replace("type", F.lit("_"), F.lit(" "))), F.lit(" "), F.col("target"), F.lit("."))
    hops = graph.keyed(hops).select("q_id", "edge_key", hop.alias("hop_answer"))
    out = questions.select("q_id").join(named.drop("question"), "q_id", "left").join(hops, "q_id", "left")
    seed = F.concat(F.lit(LOCAL_SEED), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(")."))
    status = F.when(F.col("identity").isNull(), "NO_MATCH").when(F.col("edge_key").isNull(), "SEED").otherwise("HOP")
    return out.select("q_id", status.alias("status"), F.col("identity").alias("seed"), "edge_key", F.coalesce("hop_answer", F.when(F.col("identity").isNotNull(), seed), F.lit(LOCAL_NONE)).alias("answer"))


def local_context(questions: DataFrame, matches: DataFrame, edges: DataFrame, entities: DataFrame, units: DataFrame, budget: graph.Budget = graph.ANSWER_CONTEXT) -> DataFrame:
    """(q_id, number, kind, identifier, score, hop): expansion items, then the best units, numbered for a prompt."""
    items = small(graph.expand(matches, edges, budget))  # meets entities and edges where these lie
    nodes = items.where("kind <> 'RELATIONSHIP'").join(entities.select(F.col("identity").alias("identifier"), "unit_ids"), "identifier")
    at = (F.col("hop").cast("long") * 1_000_000 + F.col("pos")).alias("at")
    start, other = (nodes.where(c).select("q_id", at, "unit_ids") for c in ("hop = 0", "hop > 0"))
    taken = items.where("kind = 'RELATIONSHIP'").join(graph.keyed(edges).select(F.col("edge_key").alias("identifier"), "unit_ids", "weight"), "identifier").select("q_id", at, "unit_ids", "weight")
    ranked = graph.unit_ranking(questions, start, other, taken, budget.member_units).join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi")
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "first"))).where(F.col("n") <= budget.units)
    listed = items.where("kind <> 'NODE'").select("q_id", "kind", "identifier", "score", "hop", F.col("hop").alias("stage"), "pos")
    listed = listed.unionByName(ranked.select("q_id", F.lit("TEXT_UNIT").alias("kind"), F.col("unit_id").alias("identifier"), F.col("score").cast("double").alias("score"), F.lit(-1).alias("hop"), F.lit(1 << 20).alias("stage"), F.col("n").cast("long").alias("pos")))
    return listed.withColumn("number", F.row_number().over(Window.partitionBy("q_id").orderBy("stage", "pos"))).drop("stage", "pos")


# -- global ----------------------------------------------------------------------------------------------------------------


def community_text() -> Column:
    return F.concat_ws(" ", "title", "summary")


def community_scores(questions: DataFrame, communities: DataFrame) -> DataFrame:
    """(q_id, community_id, score, rank): keyword score of title and summary, ties by id."""
    scored = seeds.keyword_scores(questions, communities.select("community_id", "title", "summary"), community_text())
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "community_id")
    return scored.select("q_id", "community_id", "summary", "score", F.row_number().over(w).alias("rank"))


def global_answers(questions: DataFrame, communities: DataFrame) -> DataFrame:
    best = community_scores(questions, communities).where("rank = 1")
    out = questions.select("q_id").join(best, "q_id", "left")
    return out.select("q_id", "community_id", F.when(F.col("community_id").isNotNull(), F.concat(F.lit(GLOBAL_LEAD), F.col("summary"))).otherwise(GLOBAL_NONE).alias("answer"))


def global_scores(questions: DataFrame, communities: DataFrame, members: DataFrame, matches: DataFrame) -> DataFrame:
    """(q_id, community_id, score, rank): keyword score over the best one, plus summed member scores over the best sum.

    ``members``: (community_id, identity); ``matches``: (q_id, identity, score) of seeds, the best of each identity counts.
    """
    words = community_scores(questions, communities).select("q_id", "community_id", F.col("score").cast("double").alias("kw"))
    top = matches.groupBy("q_id", "identity").agg(F.max("score").alias("score"))
    sums = members.select("community_id", "identity").distinct().join(top, "identity").groupBy("q_id", "community_id").agg(F.sum("score").alias("ms"))
    both = words.join(sums, ["q_id", "community_id"], "full_outer")
    w = Window.partitionBy("q_id")
    share = lambda c: F.coalesce(F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)), F.lit(0.0))
    scored = both.withColumn("score", share("kw") + share("ms")).where("score > 0").select("q_id", "community_id", "score")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "community_id")))


def members_of_interest(picked: DataFrame, members: DataFrame, matches: DataFrame, weights: DataFrame, most: int = 5) -> DataFrame:
    """(q_id, community_id, identity, n): members by seed score, internal weight and stored order; read after communities are picked."""
    top = matches.groupBy("q_id", "identity").agg(F.max("score").alias("seed"))
    rows = picked.select("q_id", "community_id").join(members.select("community_id", "identity", "ord"), "community_id").join(top, ["q_id", "identity"], "left").join(weights, ["community_id", "identity"], "left")
    w = Window.partitionBy("q_id", "community_id").orderBy(F.desc(F.coalesce("seed", F.lit(0.0))), F.desc(F.coalesce("weight", F.lit(0))), "ord")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("q_id", "community_id", "identity", "n")


def units_not_taken(candidates: DataFrame, most: int = 2) -> DataFrame:
    """(q_id, rank, unit_id): up to ``most`` units of each community in rank order, none taken by an earlier one.

    ``candidates``: (q_id, rank, pos, unit_id). The rule is sequential over the few communities of one question.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for rank, rows in pdf.sort_values(["rank", "pos"]).groupby("rank", sort=True):
            count = 0
            for u in rows["unit_id"]:
                if count == most:
                    break
                if u not in taken:
                    taken.add(u)
                    out.append((pdf["q_id"].iloc[0], rank, u))
                    count += 1
        return pd.DataFrame(out, columns=["q_id", "rank", "unit_id"])

    return candidates.groupBy("q_id").applyInPandas(pick, "q_id long, rank int, unit_id string")


def map_points(questions: DataFrame, ranked: DataFrame, score: Callable[[str, list[str]], list[tuple[str, str, int]]]) -> DataFrame:
    """(q_id, community_id, text, score, n): points of the first communities in batches, the best twenty.

    ``ranked``: (q_id, community_id, summary, rank); ``score(question, [(id, text)])`` returns points (id, text, 0..100).
    """
    rows = ranked.where(F.col("rank") <= MAP_COMMUNITIES).join(questions.select("q_id", "question"), "q_id").withColumn("batch", F.floor((F.col("rank") - 1) / MAP_BATCH))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        found = score(pdf["question"].iloc[0], list(zip(pdf["community_id"], pdf["summary"], strict=True)))
        order = {c: r for c, r in zip(pdf["community_id"], pdf["rank"], strict=True)}
        out = [(pdf["q_id"].iloc[0], c, t, min(100, max(0, int(s))), int(order[c]), k) for k, (c, t, s) in enumerate(found) if c in order]
        return pd.DataFrame(out, columns=["q_id", "community_id", "text", "score", "rank", "pos"])

    points = rows.groupBy("q_id", "batch").applyInPandas(run, "q_id long, community_id string, text string, score int, rank int, pos int")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "rank", "pos")
    return points.where("score > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= POINTS).select("q_id", "community_id", "text", "score", "n")


def passage_communities(points: DataFrame, most: int = PASSAGE_COMMUNITIES) -> DataFrame:
    first = points.groupBy("q_id", "community_id").agg(F.min("n").alias("first"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("q_id").orderBy("first"))).where(F.col("k") <= most).select("q_id", "community_id", "k")


# -- branching -------------------------------------------------------------------------------------------------------------


def sub_question(question: Column, summary: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(F.trim(question), F.lit("")), F.concat(F.lit("Community summary: "), summary)))


def drift_candidates(questions: DataFrame, communities: DataFrame) -> DataFrame:
    """(q_id, community_id, branch, sub_question): all communities that tie at the best score, by id."""
    scored = community_scores(questions, communities)
    best = scored.withColumn("tie", F.rank().over(Window.partitionBy("q_id").orderBy(F.desc("score")))).where("tie = 1").join(questions.select("q_id", "question"), "q_id")
    branch = F.row_number().over(Window.partitionBy("q_id").orderBy("community_id"))
    return best.select("q_id", "community_id", branch.alias("branch"), sub_question(F.col("question"), F.col("summary")).alias("sub_question"))


def drift_answers(questions: DataFrame, communities: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, branch, answer): the first branch whose local answer rests on a relationship."""
    branches = written(drift_candidates(questions, communities).withColumn("sub_id", F.monotonically_increasing_id()))
    asked = branches.select(F.col("sub_id").alias("q_id"), F.col("sub_question").alias("question"))
    local = local_answers(asked, entities, edges).where("status = 'HOP'").select(F.col("q_id").alias("sub_id"), "answer").join(branches.select("sub_id", "q_id", "branch"), "sub_id")
    first = local.groupBy("q_id").agg(F.min("branch").alias("branch"), F.min_by("answer", "branch").alias("local"))
    out = questions.select("q_id").join(branches.select("q_id").distinct().withColumn("any", F.lit(True)), "q_id", "left").join(first, "q_id", "left")
    return out.select("q_id", "branch", F.when(F.col("local").isNotNull(), F.concat(F.lit(DRIFT_LEAD), F.col("local"))).when(F.col("any"), DRIFT_NONE).otherwise(GLOBAL_NONE).alias("answer"))


def first_of_each(items: DataFrame, key: Column, *order: str) -> DataFrame:
    """Distinct union of context items by key, the first one wins."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy("q_id", key).orderBy(*order))).where("_n = 1").drop("_n")
