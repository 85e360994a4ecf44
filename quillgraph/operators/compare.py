"""Comparison of retrieval modes and reading of retrieval traces."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import overlap
from quillgraph.operators.tables import ranked_globally, small, written

LISTS = 16
#: Different chunks of a document up to which they are one list.
LIST = 4096
CONTEXT_KINDS = ("ENTITY", "RELATIONSHIP", "COMMUNITY", "TEXT_UNIT")
#: Uses of a passage by a method, strongest last.
USES = ("NOT_RETRIEVED", "RANKED_BELOW_CUTOFF", "IN_CONTEXT", "CITED")


def contained(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """(q_id, chunk_id, unit_id): chunks whose text stands in a unit's text, white space collapsed, in the same document.

    A chunk without a document is compared with all units of its question's context. ``chunks``: (q_id, chunk_id, document, text);
    ``units``: (q_id, unit_id, document, text). A document's few chunks meet each of its units as one list. Chunks of a document with more
    than ``LIST`` different ones, and those without a document, are first looked up by fingerprints (see ``overlap``), so a unit meets
    only chunks that share one with it; every pair is then compared by text.
    """
    c = chunks.select("q_id", "chunk_id", F.coalesce("document", F.lit("")).alias("document"), tx.collapsed(F.col("text")).alias("said")).where("said <> ''")
    u = units.select("q_id", "unit_id", F.coalesce("document", F.lit("")).alias("document"), tx.collapsed(F.col("text")).alias("whole"))
    said = written(c.groupBy("q_id", "document", "said").agg(F.collect_list("chunk_id").alias("ids")))
    many = said.where("document <> ''").groupBy("q_id", "document").agg(F.count("*").alias("n")).where(F.col("n") > LIST).select("q_id", "document")
    many = small(many)
    few = said.where("document <> ''").join(many, ["q_id", "document"], "left_anti").groupBy("q_id", "document").agg(F.collect_list(F.struct("said", "ids")).alias("list"))
    out = few.join(u, ["q_id", "document"]).select("q_id", "unit_id", _inside())
    rest = said.where("document = ''").drop("document")
    if not rest.isEmpty():
        out = out.unionByName(_looked_up(rest, u.drop("document"), ["q_id"]))
    if not many.isEmpty():
        out = out.unionByName(_looked_up(said.join(many, ["q_id", "document"], "left_semi"), u, ["q_id", "document"]))
    return out.select("q_id", F.explode("ids").alias("chunk_id"), "unit_id")


def _inside() -> Column:
    """The ids of the list's texts that the whole contains."""
    return F.flatten(F.transform(F.filter("list", lambda x: F.contains(F.col("whole"), x["said"])), lambda x: x["ids"])).alias("ids")


#: Marks that are looked for where the texts lie; with more, the texts list all of theirs.
ANCHORS = 1_000_000


def _looked_up(said: DataFrame, units: DataFrame, scope: list[str]) -> DataFrame:
    """(q_id, unit_id, ids) through fingerprints that chunk and unit share."""
    said = said.withColumn("key", F.xxhash64(*scope, "said"))
    anchors = written(overlap.anchors(said.select(*scope, "key", "said"), "said"))
    sizes = [r[0] for r in anchors.where("size > 0").select("size").distinct().collect()]  # at most five
    marks = small(anchors.select("mark").distinct(), ANCHORS + 1)
    few = marks.limit(ANCHORS + 1).toPandas()["mark"].to_numpy()  # a number each
    prints = overlap.fingerprints(units.select(*scope, "unit_id", "whole"), "whole", sorted(sizes), few if len(few) <= ANCHORS else None)
    met = prints.join(small(anchors.select(*scope, "key", "mark")), [*scope, "mark"]).select(*scope, "unit_id", "key").distinct()
    # of a unit with very many chunks the lists stay bounded
    part = F.pmod(F.xxhash64("key"), F.lit(LISTS)).alias("part")
    lists = met.join(said, [*scope, "key"]).groupBy(*scope, "unit_id", part).agg(F.collect_list(F.struct("said", "ids")).alias("list"))
    return lists.join(units, [*scope, "unit_id"]).select("q_id", "unit_id", _inside())


#: Sentences of the verdict by what is compared and how it comes out.
VERDICTS = {
    "documents": {"tie": "Both sides retrieved passages from the same number of distinct documents ({a}).", "graph": "GraphRAG ({mode}) retrieved passages from more distinct documents ({a} vs {b}).", "vector": "Vector Search retrieved passages from more distinct documents ({b} vs {a})."},
    "items": {"tie": "Both sides retrieved the same number of context items ({a}).", "graph": "GraphRAG ({mode}) retrieved more context items ({a} vs {b}).", "vector": "Vector Search retrieved more context items ({b} vs {a})."},
    "overlap": {"none": "Vector Search retrieved no passages to compare.", "one": "{b} of the {a} passages Vector Search retrieved was also read by GraphRAG.", "many": "{b} of the {a} passages Vector Search retrieved were also read by GraphRAG."},
}


def _filled(template: str, **slots: Column) -> Column:
    pieces = re.split(r"(\{\w+\})", template)
    return F.concat(*[slots[x[1:-1]].cast("string") if x.startswith("{") else F.lit(x) for x in pieces if x])


def verdict(facts: dict[str, Column]) -> Column:
    """Three sentences from the columns mode, documents and items of both sides (a pair each), passages and shared."""
    said = []
    for what in ("documents", "items"):
        a, b = facts[what]
        outcome = F.element_at(F.array(*[F.lit(x) for x in ("vector", "tie", "graph")]), (F.signum(a - b) + 2).cast("int"))
        table = F.create_map(*[x for how, text in VERDICTS[what].items() for x in (F.lit(how), _filled(text, a=a, b=b, mode=facts["mode"]))])
        said.append(table[outcome])
    passages, shared = facts["passages"], facts["shared"]
    outcome = F.when(passages == 0, "none").when(shared == 1, "one").otherwise("many")
    said.append(F.create_map(*[x for how, text in VERDICTS["overlap"].items() for x in (F.lit(how), _filled(text, a=passages, b=shared))])[outcome])
    return F.array_join(F.array(*said), " ")


def evidence(uses: DataFrame, answered: DataFrame) -> DataFrame:
    """(passage, marks, cited_by, in_context_of, n): strongest use of each passage by each method.

    ``uses``: (passage, method, use, citation, rank, at). Order: cited by most, then in context of fewest, then first seen, then by passage.
    """
    level = F.array_position(F.array(*[F.lit(u) for u in USES]), F.col("use"))
    marks = uses.withColumn("level", level).groupBy("passage", "method").agg(F.max("level").alias("level"), F.array_sort(F.collect_set("citation")).alias("citations"), F.min("rank").alias("rank"), F.min("at").alias("at"))
    rows = marks.groupBy("passage").agg(
        F.array_sort(F.collect_list(F.struct("method", "level", "citations", "rank"))).alias("marks"),
        F.count_if(F.col("level") == 4).alias("cited_by"),
        F.count_if(F.col("level") == 3).alias("in_context_of"),
        F.min("at").alias("first"),
    )
    return ranked_globally(rows, "n", F.desc("cited_by"), F.col("in_context_of").asc(), F.col("first").asc(), F.col("passage").asc())


def summary(runs: list[dict], cited: int, by_all: int, by_one: int) -> str:
    """Which methods answered, the fastest and slowest run, and how much cited evidence they share."""
    named = lambda what: [r["method"] for r in runs if r["outcome"] == what]
    listed = lambda x: " and ".join([", ".join(x[:-1]), x[-1]] if len(x) > 1 else x)
    answered, none, failed = named("ANSWERED"), named("NO_ANSWER"), named("FAILED")
    first = f"{len(answered)} of {len(runs)} methods answered"
    first += f"; no answer from {listed(none)}" if none else ""
    first += f"; {listed(failed)} failed" if failed else ""
    out = [first + "."]
    timed = [r for r in runs if r["outcome"] != "FAILED"]
    if len(timed) > 1:
        fast, slow = min(timed, key=lambda r: r["ms"]), max(timed, key=lambda r: r["ms"])
        out.append(f"Fastest: {fast['method']} ({fast['ms']} ms); slowest: {slow['method']} ({slow['ms']} ms).")
    if not cited:
        out.append("No answer cites a passage.")
    else:
        more = f"; {by_all} by every method that answered, {by_one} by only one." if len(answered) > 1 else "."
        out.append(f"{cited}{' passage is' if cited == 1 else ' passages are'} cited{more}")
    return " ".join(out)


def compare_all(methods: dict[str, Callable[[], DataFrame]]) -> list[dict]:
    """Run every method; a failure stays with its method. Each result is (method, outcome, ms, rows or error)."""
    out = []
    for name, run in methods.items():
        begun = time.perf_counter()
        try:
            rows = written(run())  # the rows stay in the shared folder
            outcome = {"outcome": "NO_ANSWER" if rows.isEmpty() else "ANSWERED", "rows": rows}
        except Exception as e:
            outcome = {"outcome": "FAILED", "error": str(e)[:500]}
        out.append({"method": name, "ms": round(1000 * (time.perf_counter() - begun)), **outcome})
    return out


def diagnosis(outcome: Column, use: Column) -> Column:
    """The stage at which an expected passage got lost."""
    return F.when(outcome == "FAILED", "failed").when(use == "CITED", "cited").when(use == "IN_CONTEXT", "generation").when(use == "RANKED_BELOW_CUTOFF", "ranking").otherwise("retrieval")


def footprint(steps: DataFrame) -> DataFrame:
    return steps.groupBy("trace_id", "kind").agg(F.count("*").alias("n"))


def branches(steps: DataFrame) -> DataFrame:
    """(trace_id, branch, start, end, label): steps of each spawned sub-question, up to the next one or the synthesis."""
    w = Window.partitionBy("trace_id")
    spawn = F.col("kind") == "SUB_QUESTION_SPAWNED"
    marked = steps.withColumn("end_at", F.coalesce(F.min(F.when(F.col("kind") == "SYNTHESIS", F.col("step_no"))).over(w), F.max("step_no").over(w) + 1)).where(spawn)
    order = w.orderBy("step_no")
    ends = F.least(F.coalesce(F.lead("step_no").over(order), F.col("end_at")), F.col("end_at"))
    number = F.row_number().over(order)
    label = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Sub-question "), number.cast("string")))
    return marked.select("trace_id", number.alias("branch"), F.col("step_no").alias("start"), ends.alias("end"), label.alias("label"))


def phases(steps: DataFrame) -> DataFrame:
    """Each step with its mode's phase: the running number of sub-questions spawned, 0 before the first, -1 from the synthesis on."""
    order = Window.partitionBy("trace_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    spawned = F.sum(F.when(F.col("kind") == "SUB_QUESTION_SPAWNED", 1).otherwise(0)).over(order)
    done = F.sum(F.when(F.col("kind") == "SYNTHESIS", 1).otherwise(0)).over(order)
    return steps.withColumn("phase", F.when(done > 0, -1).otherwise(spawned).cast("int"))


MODES = ("LOCAL", "GLOBAL", "DRIFT", "VECTOR")


def modes(steps: DataFrame, hint: str = "hint") -> DataFrame:
    """(trace_id, mode) from the kinds of steps in their order, and the mode that a trace says it has, in column ``hint`` if there is one."""
    told = F.max(hint) if hint in steps.columns else F.lit(None).cast("string")
    has = lambda k: F.max(F.col("kind") == k)
    facts = steps.groupBy("trace_id").agg(F.min_by("kind", "step_no").alias("first"), has("SUB_QUESTION_SPAWNED").alias("spawned"), has("SYNTHESIS").alias("ended"), told.alias("told"))
    # a run of branches that spawned none still ends in a synthesis, which a look at communities alone doesn't
    by_kind = F.when(F.col("first") == "COMMUNITY", F.when(F.col("ended"), "DRIFT").otherwise("GLOBAL")).otherwise("LOCAL")
    mode = F.when(F.col("first").isin("VECTOR_QUERY_EMBEDDED", "VECTOR_CHUNK"), "VECTOR").when(F.col("spawned"), "DRIFT").when(F.col("told").isin(*MODES), F.col("told")).otherwise(by_kind)
    return facts.select("trace_id", mode.alias("mode"))


def staged(steps: DataFrame, hint: str = "hint") -> DataFrame:
    """``steps`` (trace_id, step_no, kind, identifier) with mode, place (from 0), branch, role and rank.

    A state machine over each trace's steps in order, as running counts. ``branch``: the sub-question that a step belongs to, 0 before the
    first, -1 from the synthesis on, null outside DRIFT. ``role``: what a step does in its mode; ``rank``: its number among those
    of its role in its branch, and for a community of a DRIFT run the branch that it spawned, if any.
    """
    whole = Window.partitionBy("trace_id")
    order = whole.orderBy("step_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    kind = lambda k: F.col("kind") == k
    count = lambda test, w: F.sum(F.when(test, 1).otherwise(0)).over(w)
    rows = steps.join(modes(steps, hint), "trace_id").withColumn("place", F.row_number().over(order) - 1)
    drift = F.col("mode") == "DRIFT"
    over = count(kind("SYNTHESIS"), so_far) > 0
    rows = rows.withColumn("branch", F.when(drift, F.when(over, -1).otherwise(count(kind("SUB_QUESTION_SPAWNED"), so_far))).cast("int"))
    walk = Window.partitionBy("trace_id", "branch").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("trace_id", "branch")
    stepping = kind("SUB_QUESTION_SPAWNED") & drift
    rows = rows.withColumn("past_", count((F.col("kind") != "ENTITY") & ~stepping, walk)).withColumn("read_", F.max(kind("TEXT_UNIT")).over(every))
    local = F.when(F.col("past_") == 0, "SEED").when(kind("RELATIONSHIP"), F.when(F.col("read_"), "FACT").otherwise("HOP")).when(kind("ENTITY"), "END").when(kind("TEXT_UNIT"), "PASSAGE").otherwise("OTHER")
    seen = F.when(kind("COMMUNITY"), "COMMUNITY")
    role = (
        F.when(F.col("mode") == "VECTOR", F.when(kind("VECTOR_QUERY_EMBEDDED"), "QUERY").when(kind("VECTOR_CHUNK"), "CHUNK").when(kind("SYNTHESIS"), "SYNTHESIS").otherwise("OTHER"))
        .when(F.col("mode") == "GLOBAL", seen.when(kind("TEXT_UNIT"), "PASSAGE").otherwise("OTHER"))
        .when(drift, F.when(F.col("branch") == -1, "SYNTHESIS").when(stepping, "SPAWN").when(F.col("branch") == 0, seen.otherwise("OTHER")).otherwise(local))
        .otherwise(local)
    )
    rows = rows.withColumn("role", role)
    same = Window.partitionBy("trace_id", "branch", "role").orderBy("step_no")
    spawned = F.min(F.when(stepping, F.col("branch"))).over(Window.partitionBy("trace_id", "identifier"))
    rank = F.when(drift & (F.col("role") == "COMMUNITY"), spawned).otherwise(F.row_number().over(same))
    return rows.withColumn("rank", rank.cast("int")).drop("past_", "read_")


def segments(steps: DataFrame, hint: str = "hint") -> DataFrame:
    """(trace_id, mode, title, start, end): the phases of each trace as half-open ranges of places, for every mode."""
    rows = staged(steps, hint)
    first = lambda test: F.min(F.when(test, F.col("place")))
    kind = lambda k: F.col("kind") == k
    order = Window.partitionBy("trace_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("past_", F.sum(F.when(kind("ENTITY"), 0).otherwise(1)).over(order) > 0)
    facts = rows.groupBy("trace_id", "mode").agg(
        F.count("*").alias("n"), first(F.col("past_")).alias("seeds"), first(F.col("past_") & (F.col("kind") != "RELATIONSHIP")).alias("edges"),
        F.max(kind("TEXT_UNIT")).alias("read"), first(kind("SYNTHESIS")).alias("said"), first(kind("SUB_QUESTION_SPAWNED")).alias("spawn"), F.sum(F.when(kind("SUB_QUESTION_SPAWNED"), 1).otherwise(0)).alias("branches"),
    )
    n = F.col("n")
    seeds, edges, said = F.coalesce("seeds", n), F.coalesce("edges", n), F.coalesce("said", n)
    phase = lambda title, start, end: F.struct(F.lit(title).alias("title"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    zero = F.lit(0)
    local = F.when(F.col("read"), F.array(phase("Seed entities", zero, seeds), phase("Graph facts", seeds, edges), phase("Source passages", edges, n))).otherwise(F.array(phase("Seed entities", zero, seeds), phase("Relationship hop", seeds, n)))
    vector = F.array(phase("Embed the question", zero, F.least(F.lit(1), said)), phase("Nearest chunks", F.least(F.lit(1), said), said), phase("Synthesis", said, n))
    drift = F.array(phase("Community pass", zero, F.coalesce("spawn", said)), phase("Synthesis", said, n))
    every = F.when(F.col("mode") == "VECTOR", vector).when(F.col("mode") == "GLOBAL", F.array(phase("Community pass", zero, n))).when(F.col("mode") == "DRIFT", drift).otherwise(local)
    plain = facts.select("trace_id", "mode", F.explode(every).alias("p")).select("trace_id", "mode", "p.*")
    spawns = rows.where(kind("SUB_QUESTION_SPAWNED") & (F.col("mode") == "DRIFT")).join(facts.select("trace_id", "n", "said", "branches"), "trace_id")
    by_place = Window.partitionBy("trace_id").orderBy("place")
    title = F.concat(F.lit("Branch "), F.row_number().over(by_place).cast("string"), F.lit(" of "), F.col("branches").cast("string"))
    ends = F.greatest(F.coalesce(F.lead("place").over(by_place), said), F.col("place") + 1)
    out = plain.unionByName(spawns.select("trace_id", "mode", title.alias("title"), F.col("place").cast("long").alias("start"), ends.cast("long").alias("end")))
    return out.where("end > start")


# -- one graph mode against vector search ----------------------------------------------------------------------------------


def context_stats(items: DataFrame) -> DataFrame:
    """(q_id, items, documents): distinct context items by kind and identifier, and distinct documents of the passages.

    ``items``: (q_id, kind, identifier, document); only entities, relationships, communities and units are context.
    """
    own = items.where(F.col("kind").isin(*CONTEXT_KINDS)).select("q_id", "kind", "identifier", "document").distinct()
    document = F.when(F.col("kind") == "TEXT_UNIT", F.nullif(F.trim("document"), F.lit("")))
    return own.groupBy("q_id").agg(F.countDistinct("kind", "identifier").alias("items"), F.countDistinct(document).alias("documents"))


def compared(questions: DataFrame, context: DataFrame, ranking: DataFrame, chunks: DataFrame, units: DataFrame, cited: DataFrame | None = None, mode: str = "LOCAL") -> tuple[DataFrame, DataFrame]:
    """(comparison, passages) of a graph context with the used chunks of a vector ranking.

    ``context``: (q_id, kind, identifier, label); ``ranking``: (q_id, chunk_id, rank, used); ``chunks``: (id, document_name, text);
    ``units``: (id, document_name, text); ``cited``: (q_id, unit_id). A passage is shared if one of the context's units holds its
    text; ``cited`` in the result says whether a citation of the answer lies in such a unit.
    """
    read = context.where("kind = 'TEXT_UNIT'").select("q_id", F.col("identifier").alias("id")).join(units.select("id", "document_name", "text"), "id").select("q_id", F.col("id").alias("unit_id"), F.col("document_name").alias("document"), "text")
    used = ranking.where("used").select("q_id", "chunk_id", "rank").join(chunks.select(F.col("id").alias("chunk_id"), F.col("document_name").alias("document"), "text"), "chunk_id")
    inside = contained(used.select("q_id", "chunk_id", "document", "text"), read)
    marks = inside.join(cited.select("q_id", "unit_id").distinct().withColumn("c_", F.lit(True)), ["q_id", "unit_id"], "left") if cited is not None else inside.withColumn("c_", F.lit(False))
    marks = marks.groupBy("q_id", "chunk_id").agg(F.lit(True).alias("shared"), F.max(F.coalesce("c_", F.lit(False))).alias("cited"))
    passages = used.join(marks, ["q_id", "chunk_id"], "left").select("q_id", "chunk_id", "rank", "document", F.coalesce("shared", F.lit(False)).alias("shared"), F.coalesce("cited", F.lit(False)).alias("cited"))
    graph_side = context_stats(context.select("q_id", "kind", "identifier", F.col("label").alias("document"))).withColumnsRenamed({"items": "graph_items", "documents": "graph_documents"})
    vector_side = passages.groupBy("q_id").agg(F.countDistinct(F.nullif(F.trim("document"), F.lit(""))).alias("vector_documents"), F.count("*").alias("passages"), F.count_if("shared").alias("shared"))
    rows = questions.select("q_id").join(graph_side, "q_id", "left").join(vector_side, "q_id", "left").na.fill(0)
    c = F.col
    facts = {"mode": F.lit(mode), "documents": (c("graph_documents"), c("vector_documents")), "items": (c("graph_items"), c("passages")), "passages": c("passages"), "shared": c("shared")}
    return rows.withColumn("verdict", verdict(facts)), passages


def uses_of(method: str, passages: DataFrame, in_context: DataFrame | None = None, cited: DataFrame | None = None) -> DataFrame:
    """(passage, method, use, citation, rank, at) of one method for ``evidence``: what it ranked (passage, rank), had in its context
    (passage) and cited (passage, citation)."""
    use = lambda rows, name, citation=None: rows.select("passage", F.lit(method).alias("method"), F.lit(name).alias("use"), (citation if citation is not None else F.lit(None)).cast("int").alias("citation"), (F.col("rank") if "rank" in rows.columns else F.lit(None)).cast("int").alias("rank"), F.coalesce(F.col("rank") if "rank" in rows.columns else F.lit(None), F.lit(0)).cast("long").alias("at"))
    out = use(passages, "RANKED_BELOW_CUTOFF")
    if in_context is not None:
        out = out.unionByName(use(in_context, "IN_CONTEXT"))
    return out if cited is None else out.unionByName(use(cited, "CITED", F.col("citation")))


def as_units(uses: DataFrame, inside: DataFrame) -> DataFrame:
    """Uses of chunks told as uses of the units that hold them (chunk_id, unit_id); chunks in no unit stand for themselves."""
    first = inside.groupBy("chunk_id").agg(F.min("unit_id").alias("unit_id"))
    return uses.join(first, F.col("passage") == F.col("chunk_id"), "left").withColumn("passage", F.coalesce("unit_id", "passage")).drop("chunk_id", "unit_id")


class Clock:
    """Times of a run's stages: model and embedding calls are measured, retrieval is the rest."""

    def __init__(self):
        self.begun = time.perf_counter()
        self.seconds, self.calls = {"embedding": 0.0, "llm": 0.0}, {"embedding": 0, "llm": 0}

    def timed(self, stage: str, call: Callable) -> Callable:
        def run(*args, **more):
            begun = time.perf_counter()
            try:
                return call(*args, **more)
            finally:
                self.seconds[stage] += time.perf_counter() - begun
                self.calls[stage] += 1

        return run

    def timing(self) -> dict[str, int]:
        whole = time.perf_counter() - self.begun
        ms = lambda s: max(0, round(1000 * s))
        return {"total_ms": ms(whole), "retrieval_ms": ms(whole - sum(self.seconds.values())), "embedding_ms": ms(self.seconds["embedding"]), "embedding_calls": self.calls["embedding"], "llm_ms": ms(self.seconds["llm"]), "llm_calls": self.calls["llm"]}


def log_lines(runs: DataFrame) -> DataFrame:
    """(line): one JSON object a comparison run, keys in the order of its columns; written with ``write.text``."""
    return runs.select(F.to_json(F.struct(*runs.columns), {"ignoreNullFields": "false"}).alias("line"))
