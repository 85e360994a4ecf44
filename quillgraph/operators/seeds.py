"""Seed matchers: which entities a batch of questions starts from, and how rankings are fused.

Every matcher returns (q_id, identity, score, ord, rank). Keyword and identifier matchers go through an inverted index: questions and
names meet under equal keys (see ``lookup``), and only what meets is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import clusters, lookup
from quillgraph.operators.tables import small, written

RRF_K = 60
#: Tokens of a question that are counted in one number.
BITS = 31
#: Identifier scores.
EXACT, SUFFIX, CASE_BONUS, SEGMENT, PREFIX, PACKAGE, FUZZY, PARTS, WORD, MOST_WORDS, LEAST = 100, 90, 5, 50, 30, 3, 40, 25, 6, 24, 6


def ranking(scored: DataFrame, limit: int | None = None) -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "ord")))
    return out.where(F.col("rank") <= limit) if limit else out


def keyword_scores(questions: DataFrame, candidates: DataFrame, text: Column, words: DataFrame | None = None) -> DataFrame:
    """(q_id, candidate columns, score) with score > 0: 2 for each question token that the text contains, else 1 for one within its edits
    of a word of the text.

    A token longer than two characters that stands in a text stands in one of its words, so tokens are looked up in the dictionary of
    all words (``words``, precomputed by ``lookup.words_of``), and words lead to the candidates. Equal candidates are one.

    Candidates are dealt once, not once for each question that a common word leads to them: a question's tokens are bits, the upper half for
    those that the text contains, so what a candidate scores is counted in its own task.
    """
    asked = written(questions.select("q_id", F.explode(tx.tokens(F.col("question"))).alias("tok")).distinct())
    hits = lookup.matching_words(asked, lookup.words_of(candidates, text) if words is None else words)
    numbered = asked.withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy("tok")) - 1)
    bit = F.expr(f"shiftleft(1L, n % {BITS}) | if(points = 2, shiftleft(1L, {BITS} + n % {BITS}), 0L)")
    hits = small(hits.join(numbered, "tok").groupBy("q_id", F.floor(F.col("n") / BITS).alias("block"), "word").agg(F.bit_or(bit).alias("bits")))
    rows = candidates.repartition(*candidates.columns).withColumn("word", F.explode(tx.tokens(text))).join(hits, "word")
    blocks = rows.groupBy("q_id", "block", *candidates.columns).agg(F.bit_count(F.bit_or("bits")).alias("score"))
    return blocks.groupBy("q_id", *candidates.columns).agg(F.sum("score").cast("int").alias("score"))


def keyword_matches(questions: DataFrame, entities: DataFrame, limit: int | None = 3) -> DataFrame:
    scored = keyword_scores(questions, entities.select("identity", "name", "type", "ord"), F.concat_ws(" ", "name", "type"))
    return ranking(scored.select("q_id", "identity", F.col("score").cast("double").alias("score"), "ord"), limit)


def semantic_matches(questions: DataFrame, vectors: DataFrame, limit: int = 3) -> DataFrame:
    """Nearest entities by cosine; the score is 1 / rank. ``questions``: (q_id, vector); ``vectors``: (identity, embedding, ord)."""
    return clusters.nearest_of(clusters.clustered(vectors.select("identity", "embedding", "ord")), questions, limit).withColumn("score", 1.0 / F.col("rank"))


def name_forms(entities: DataFrame) -> DataFrame:
    """(identity, ord, normalized, kept, member, package, parts) for each name of each entity; precompute once a corpus."""
    names = F.array(F.col("name"), *[F.col("attributes")[k] for k in ("qualifiedName", "simpleName", "signature")]) if "attributes" in entities.columns else F.array("name")
    rows = entities.select("identity", "ord", F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (F.trim(n) != "")))).alias("one"))
    cut = F.regexp_replace(F.trim("one"), r"(?s)\(.*$", "")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"::|[#$/]", "."), r"\.+", "."), r"^\.|\.$", "")
    pieces = F.split(kept, r"\.")
    # leading segments before the first with a capital are the package; without such a segment there is none
    capital = F.array_position(F.transform(pieces, lambda s: s.rlike("[A-Z]")), True)
    ahead = F.when(capital > 0, capital - 1).otherwise(0).cast("int")
    lower = lambda a: F.transform(a, lambda s: F.lower(s))
    member = F.slice(pieces, ahead + 1, F.greatest(F.size(pieces), F.lit(1)))
    return rows.select("identity", "ord", tx.normalized_identifier(F.col("one")).alias("normalized"), kept.alias("kept"), lower(member).alias("member"), lower(F.slice(pieces, 1, ahead)).alias("package"), tx.identifier_parts(F.array_join(member, " ")).alias("parts"))


def identifier_score(token: Column, forms: dict[str, Column] | None = None) -> Column:
    """Score of one code-like token against one name form."""
    f = forms or {k: F.col(k) for k in ("normalized", "kept", "member", "package", "parts")}
    norm = tx.normalized_identifier(token)
    pieces = tx.segments(norm)
    single = F.size(pieces) == 1
    plain = F.regexp_replace(F.regexp_replace(F.trim(token), r"(?s)\(.*$", ""), r"::|[#$/]", ".")
    bonus = F.when(F.endswith(f["kept"], F.concat(F.lit("."), plain)), CASE_BONUS).otherwise(0)
    limit = F.when(F.length(norm) >= 10, 2).otherwise(1)
    last = F.element_at(F.split(f["normalized"], r"\."), -1)
    distance = F.levenshtein(norm, last)
    fuzzy = F.when(single & (F.length(norm) >= 5) & (distance <= limit), FUZZY - 10 * distance).otherwise(0)
    own = tx.identifier_parts(plain)
    share = F.size(F.array_intersect(own, f["parts"])) / F.greatest(F.size(own), F.lit(1))
    parts = F.when((F.size(own) >= 2) & (share >= 0.5), PARTS * share).otherwise(0.0)
    return (
        F.when(norm == "", 0.0)
        .when(norm == f["normalized"], float(EXACT))
        .when(F.endswith(f["normalized"], F.concat(F.lit("."), norm)), (SUFFIX + bonus).cast("double"))
        .when(single & F.array_contains(f["member"], norm), float(SEGMENT))
        .when(~single & F.startswith(f["normalized"], F.concat(norm, F.lit("."))), float(PREFIX))
        .when(single & F.array_contains(f["package"], norm), float(PACKAGE))
        .otherwise(F.greatest(fuzzy.cast("double"), parts))
    )


def _words_outside_code(question: Column) -> Column:
    """The distinct plain words of the tokens that aren't code-like; parts of a code name are no words of the question."""
    plain = F.filter(tx.identifiers(question), lambda t: ~tx.is_code_like(t))
    return tx.plain_words(F.array_join(plain, " "))


def _stem(word: Column) -> Column:
    return F.regexp_replace(word, "(?<=...)s$", "")


def _kinds(**keys: Column) -> Column:
    """Keys of several kinds in one list."""
    return F.array_distinct(F.concat(*[lookup.tagged(kind, k) for kind, k in keys.items()]))


def _form_keys() -> Column:
    """Every key under which a name form can be found: whole, from a dot on, up to a dot, by segment, by part, by word, by deletions."""
    pieces = F.split("normalized", r"\.")
    inner = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.transform(inner, lambda i: F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "."))
    starts = F.transform(inner, lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "."))
    near = lookup.held_keys(F.element_at(pieces, -1), lookup.NAME_BANDS)
    return _kinds(whole=F.array("normalized"), end=ends, start=starts, member=F.col("member"), package=F.col("package"), near=near, part=F.col("parts"), word=F.transform("parts", _stem))


def _token_keys(token: Column) -> Column:
    norm = tx.normalized_identifier(token)
    none = F.array().cast("array<string>")
    one = lambda when: F.when((norm != "") & when, F.array(norm)).otherwise(none)
    single = F.size(tx.segments(norm)) == 1
    own = tx.identifier_parts(F.regexp_replace(F.regexp_replace(F.trim(token), r"(?s)\(.*$", ""), r"::|[#$/]", "."))
    near = F.when(single, lookup.asked_keys(norm, lookup.NAME_BANDS)).otherwise(none)
    return _kinds(whole=one(F.lit(True)), end=one(F.lit(True)), start=one(~single), member=one(single), package=one(single), near=near, part=F.when(F.size(own) >= 2, own).otherwise(none))


def identifier_matches(questions: DataFrame, forms: DataFrame, limit: int | None = 3) -> DataFrame:
    """Entities whose names match code-like tokens and plain words of each question, score 6 and more.

    Name forms and questions meet under equal keys; each pair that meets is scored once.
    """
    asked = questions.select("q_id", F.filter(tx.identifiers(F.col("question")), lambda t: tx.is_code_like(t)).alias("code"), _words_outside_code(F.col("question")).alias("words"))
    keys = F.concat(F.flatten(F.transform("code", _token_keys)), _kinds(word=F.transform("words", _stem)))
    wanted = small(asked.select("q_id", F.explode(F.array_distinct(keys)).alias("key")))
    met = forms.withColumn("key", F.explode(_form_keys())).join(wanted, "key").dropDuplicates(["q_id", "identity", "kept", "normalized"])
    pairs = met.drop("key").join(asked, "q_id")
    best = F.aggregate(F.transform("code", lambda t: identifier_score(t)), F.lit(0.0), lambda a, s: F.greatest(a, s))
    stems = F.transform("parts", _stem)
    words = F.size(F.filter("words", lambda w: F.array_contains(stems, _stem(w))))
    score = best + F.least(F.lit(MOST_WORDS), WORD * words)
    scored = pairs.withColumn("score", score).groupBy("q_id", "identity").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))
    return ranking(scored.where(F.col("score") >= LEAST), limit)


def normalized_scores(matches: DataFrame) -> DataFrame:
    """Scores scaled to 1 for the best of each question: all equal 1, else s / best from 0 up, else between worst and best."""
    w = Window.partitionBy("q_id")
    best, worst = F.max("score").over(w), F.min("score").over(w)
    scaled = F.when(best == worst, 1.0).when(worst >= 0, F.col("score") / best).otherwise((F.col("score") - worst) / (best - worst))
    return matches.withColumn("score", scaled)


def reciprocal_ranks(*rankings: DataFrame, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), rank from 1."""
    rows = None
    for m in rankings:
        one = m.select("q_id", "identity", (1.0 / (k + F.col("rank"))).alias("part"), "ord")
        rows = one if rows is None else rows.unionByName(one)
    return ranking(rows.groupBy("q_id", "identity").agg(F.sum("part").alias("score"), F.min("ord").alias("ord")), limit)


def weighted_sum(parts: list[tuple[DataFrame, float]], limit: int | None = None) -> DataFrame:
    rows = None
    for m, weight in parts:
        one = normalized_scores(m).select("q_id", "identity", (F.col("score") * weight).alias("part"), "ord")
        rows = one if rows is None else rows.unionByName(one)
    return ranking(rows.groupBy("q_id", "identity").agg(F.sum("part").alias("score"), F.min("ord").alias("ord")), limit)


def hybrid_matches(questions: DataFrame, matchers: list, limit: int = 3) -> DataFrame:
    """Fuse matchers (callables of (questions, limit)) by reciprocal rank over their first max(limit, 20) candidates."""
    return reciprocal_ranks(*(m(questions, max(limit, 20)) for m in matchers), limit=limit)


def first_non_empty(*rankings: DataFrame) -> DataFrame:
    """For each question the first ranking that has any match."""
    rows = None
    for priority, m in enumerate(rankings):
        one = m.select("q_id", "identity", "score", "ord", "rank", F.lit(priority).alias("priority"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("first", F.min("priority").over(Window.partitionBy("q_id"))).where("priority = first").drop("first")


def validated(matches: DataFrame) -> DataFrame:
    """Fails if a score is null or not finite, or an order breaks the best-first contract."""
    w = Window.partitionBy("q_id").orderBy("rank")
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")) & F.coalesce(F.lag("score").over(w) >= F.col("score"), F.lit(True))
    return matches.withColumn("score", F.when(fine, F.col("score")).otherwise(F.raise_error(F.lit("a matcher's scores must be finite and best first"))))
