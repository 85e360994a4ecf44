"""Language models as a plug-in: tasks, prompts, reply readers, a corrective retry, gleaning and their Spark forms.

A client is any callable that takes a ``Request`` and returns the reply text; it is pickled to the workers, where Arrow
batches of units, communities or questions are sent to it. Without a client every task has a deterministic result, so each
pipeline runs offline too.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import lenient_json as lj
from quillgraph.functions import maps

PURPOSES = ("EXTRACTION", "COMMUNITY_SUMMARY", "SUB_QUESTIONS", "ANSWER", "VERDICT", "DESCRIPTION_SUMMARY", "COMMUNITY_POINTS")
DESCRIPTION, ITEM, TITLE_WORDS, STATS_VALUES = 1000, 2000, 6, 6
SENTINEL = "NOT_IN_CONTEXT"
_TEXT = {"type": "string"}


def _shape(**fields) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields)}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


#: The JSON Schema of each task's reply.
SCHEMAS = {
    "EXTRACTION": _shape(entities=_list(_shape(name=_TEXT, type=_TEXT, description=_TEXT)), relationships=_list(_shape(source=_TEXT, sourceType=_TEXT, type=_TEXT, target=_TEXT, targetType=_TEXT, description=_TEXT))),
    "COMMUNITY_SUMMARY": _shape(title=_TEXT, summary=_TEXT),
    "SUB_QUESTIONS": _shape(subQuestions=_list(_TEXT)),
    "ANSWER": _shape(answer=_TEXT, notInContext={"type": "boolean"}),
    "VERDICT": _shape(verdict=_TEXT),
    "DESCRIPTION_SUMMARY": _shape(description=_TEXT),
    "COMMUNITY_POINTS": _shape(points=_list(_shape(community={"type": "integer"}, point=_TEXT, score={"type": "number"}))),
}
#: What each task asks for, ahead of its material.
TASKS = {
    "EXTRACTION": "List every entity that the passage names and every relation that it states between them. Allowed types: {types}. Use full names, keep one spelling, describe each in one sentence of the passage's facts.",
    "COMMUNITY_SUMMARY": "Give this group of linked elements a title of six words at most and a summary of two to four sentences about what links them.",
    "SUB_QUESTIONS": "For each numbered group write one narrower question that the group can answer, {n} in all and in order.",
    "ANSWER": f"Answer from the numbered context alone. Mark claims with the numbers of source passages, like [2]. If nothing in it answers, reply {SENTINEL} and set notInContext.",
    "VERDICT": "In three short sentences at most, say how the two answers differ and which retrieved material explains it.",
    "DESCRIPTION_SUMMARY": f"Unite these notes on one element in at most {DESCRIPTION} characters, the weightiest facts first and none twice.",
    "COMMUNITY_POINTS": "For each numbered group that helps with the question write key points and score each from 0 (no help) to 100 (full answer).",
}
GLEAN = "Some entities or relations are still missing. Reply with those alone, in the same form."


@dataclass(frozen=True)
class Request:
    purpose: str
    messages: tuple[tuple[str, str], ...]
    schema: str


class ReplyError(RuntimeError):
    """A reply that could not be read after all attempts."""


def _shortened(text: str | None, most: int) -> str:
    return (text or "").strip()[:most]


def _numbered(lines: list[str]) -> str:
    return "\n".join(f"[{k}] {line}" for k, line in enumerate(lines, 1)) or "(none)"


def _titled(row: dict) -> str:
    title = (row.get("title") or "").strip()
    return (f"{title}: " if title else "") + _shortened(row.get("summary"), ITEM)


def short_title(title: str) -> str:
    return " ".join(title.split()[:TITLE_WORDS])


def stats_lines(members: int, listed: int, counts: dict[str, list[tuple[str, int]]]) -> list[str]:
    """How large a group is and how it divides, for a prompt; the commonest values of each attribute."""
    if not counts and members <= listed:
        return []
    out = [f"{members} members" + (f", {listed} of them listed" if members > listed else "")]
    for key, values in sorted(counts.items()):
        shown = ", ".join(f"{v} ({n})" for v, n in values[:STATS_VALUES])
        out.append(f"by {key}: {shown}" + (f" and {len(values) - STATS_VALUES} more" if len(values) > STATS_VALUES else ""))
    return out


@dataclass
class Model:
    """Tasks over one client. ``retries``: further attempts after a reply that can't be read; ``gleanings``: further rounds of
    an extraction; ``off``: purposes that the client isn't asked for."""

    client: Callable[[Request], str] | None = None
    retries: int = 1
    gleanings: int = 0
    off: frozenset[str] = frozenset()
    calls: list[tuple[str, float]] = field(default_factory=list)

    def can(self, purpose: str) -> bool:
        return self.client is not None and purpose not in self.off

    def _sent(self, request: Request) -> str:
        begun = time.perf_counter()
        try:
            return self.client(request) or ""
        finally:
            self.calls.append((request.purpose, time.perf_counter() - begun))

    def ask(self, purpose: str, material: str, read: Callable[[dict], object | None], **slots) -> tuple[object, tuple[tuple[str, str], ...]]:
        """The value that ``read`` finds in the reply, and the conversation; a failed reply is answered with what was wrong."""
        schema = json.dumps(SCHEMAS[purpose])
        said = (("user", f"{TASKS[purpose].format(**slots)}\nReply with one JSON object: {schema}\n\n{material}"),)
        for _ in range(self.retries + 1):
            reply = self._sent(Request(purpose, said, schema))
            said += (("assistant", reply),)
            found = lj.parse_object(reply)
            value = None if found is None else read(found)
            if value is not None:
                return value, said
            fault = "no JSON object" if found is None else "a JSON object without the required fields"
            said += (("user", f"That was {fault}. Reply with one JSON object of this schema and no other text: {schema}"),)
        raise ReplyError(f"{purpose}: unusable after {self.retries + 1} attempts: {' '.join(reply.split())[:200]}")

    # -- tasks -------------------------------------------------------------------------------------------------------------

    def extract(self, text: str, types: tuple[str, ...] = maps.ENTITY_TYPES, known: tuple[str, ...] = ()) -> dict[str, list[dict]]:
        """{"entities": [...], "relationships": [...]} of a passage, with ``gleanings`` further rounds while they find anything new."""
        if not self.can("EXTRACTION") or not (text or "").strip():
            return {"entities": [], "relationships": []}
        hints = f"Known names: {'; '.join(known)}\n" if known else ""
        first, said = self.ask("EXTRACTION", f"{hints}Passage:\n{text}", _extraction, types=", ".join(types))
        found: dict[tuple, dict] = {}
        grown = _added(found, first)
        for _ in range(self.gleanings):
            if not grown:
                break
            said += (("user", GLEAN),)
            reply = self._sent(Request("EXTRACTION", said, json.dumps(SCHEMAS["EXTRACTION"])))
            more = _extraction(lj.parse_object(reply) or {})
            if more is None:
                break
            said += (("assistant", reply),)
            grown = _added(found, more)
        return {what: [x for k, x in found.items() if k[0] == what] for what in ("entities", "relationships")}

    def summary(self, members: list[dict], edges: list[dict], stats: list[str] = ()) -> tuple[str, str] | None:
        """Title and summary of a group; None without a client."""
        if not self.can("COMMUNITY_SUMMARY") or not members:
            return None
        facts = lambda x: f": {_shortened(x['description'], 400)}" if (x.get("description") or "").strip() else ""
        listed = [f"{m['name']} ({m['type']}){facts(m)}" for m in members]
        linked = [f"{e['source']} -[{e['type']}]-> {e['target']}{facts(e)}" for e in edges]
        material = "\n".join([*stats, "Members:", _numbered(listed), "Relationships:", _numbered(linked)])
        read = lambda o: (short_title(lj.text_of(o, "title")), lj.text_of(o, "summary")) if lj.text_of(o, "summary") else None
        return self.ask("COMMUNITY_SUMMARY", material, read)[0]

    def sub_questions(self, question: str, communities: list[dict]) -> list[str]:
        """One question for each community (title, summary); the deterministic ones fill up what a reply leaves out."""
        plain = [" ".join(x for x in ((question or "").strip(), f"Community summary: {c['summary']}") if x) for c in communities]
        if not self.can("SUB_QUESTIONS") or not communities:
            return plain
        found, _ = self.ask("SUB_QUESTIONS", f"Question: {question}\nGroups:\n{_numbered([_titled(c) for c in communities])}", lambda o: lj.texts_of(o, "subQuestions") or None, n=len(communities))
        return [*found[: len(plain)], *plain[len(found) :]]

    def points(self, question: str, communities: list[dict]) -> list[tuple[str, str, int]]:
        """(community_id, text, score 0..100) of one batch of communities."""
        if not self.can("COMMUNITY_POINTS") or not communities:
            return []

        def read(o: dict) -> list | None:
            if "points" not in o:
                return None
            out = []
            for p in lj.objects_of(o, "points"):
                k, said = int(lj.number_of(p, "community") or 0), lj.text_of(p, "point")
                if 1 <= k <= len(communities) and said:
                    out.append((communities[k - 1]["community_id"], said, min(100, max(0, round(lj.number_of(p, "score") or 0)))))
            return out

        return self.ask("COMMUNITY_POINTS", f"Groups:\n{_numbered([_titled(c) for c in communities])}\nQuestion: {question}", read)[0]

    def answer(self, question: str, items: list[dict]) -> tuple[bool, str] | None:
        """(not in context, text) from numbered items (number, kind, text); None without a client."""
        if not self.can("ANSWER"):
            return None
        label = {"TEXT_UNIT": "Source passage", "ENTITY": "Entity", "RELATIONSHIP": "Relationship", "COMMUNITY": "Community summary"}
        lines = "\n".join(f"[{i['number']}] {label.get(i['kind'], i['kind'])}: {_shortened(i['text'], ITEM)}" for i in items) or "(no context)"

        def read(o: dict):
            said = lj.text_of(o, "answer")
            missing = o.get("notInContext") is True or said.strip(" \"'`*.!").upper() == SENTINEL
            return (True, "") if missing else (False, said) if said else None

        return self.ask("ANSWER", f"Context:\n{lines}\nQuestion: {question}", read)[0]

    def verdict(self, question: str, graph_answer: str, vector_answer: str, facts: str, plain: str) -> tuple[str, str]:
        """(verdict, RULES or LLM): ``plain`` is the verdict by rules, which stands without a client."""
        if not self.can("VERDICT"):
            return plain, "RULES"
        material = f"Facts: {facts}\nQuestion: {question}\nGraphRAG:\n{_shortened(graph_answer, ITEM)}\nVector Search:\n{_shortened(vector_answer, ITEM)}"
        return self.ask("VERDICT", material, lambda o: lj.text_of(o, "verdict") or None)[0], "LLM"

    def description(self, name: str, notes: str) -> str:
        if not self.can("DESCRIPTION_SUMMARY") or not (notes or "").strip():
            return (notes or "")[:DESCRIPTION]
        return self.ask("DESCRIPTION_SUMMARY", f"Element: {name}\nNotes:\n{notes.strip()}", lambda o: lj.text_of(o, "description")[:DESCRIPTION] or None)[0]


def _extraction(o: dict) -> dict[str, list[dict]] | None:
    if not {"entities", "relationships"} & o.keys():
        return None
    entities = [{k: lj.text_of(x, k) for k in ("name", "type", "description")} for x in lj.objects_of(o, "entities")]
    edges = [{k: lj.text_of(x, k) for k in ("source", "sourceType", "type", "target", "targetType", "description")} for x in lj.objects_of(o, "relationships")]
    return {"entities": [x for x in entities if x["name"]], "relationships": [x | {"type": x["type"] or "related_to"} for x in edges if x["source"] and x["target"]]}


def _added(found: dict[tuple, dict], more: dict[str, list[dict]]) -> bool:
    """Put new elements into ``found``; was there any?"""
    before = len(found)
    for what, names in (("entities", ("name", "type")), ("relationships", ("source", "sourceType", "type", "target", "targetType"))):
        for x in more[what]:
            found.setdefault((what, *(x[n].lower() for n in names)), x)
    return len(found) > before


# -- over tables -----------------------------------------------------------------------------------------------------------

_RECORD = "unit_id string, ord long, pos int, kind string, name string, type string, target string, source_type string, target_type string, description string, error string"


def extracted(units: DataFrame, model: Model, types: tuple[str, ...] = maps.ENTITY_TYPES, known: tuple[str, ...] = (), isolate: bool = True) -> DataFrame:
    """Records of every unit (id, text, ord), as they came: kind entity (name, type, description), relationship (name -> target)
    or failure (error). A failing unit stops the run unless ``isolate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for b in batches:
            rows = []
            for uid, text, at in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    found = model.extract(text, types, known)
                except Exception as e:
                    if not isolate:
                        raise
                    rows.append((uid, at, 0, "failure", None, None, None, None, None, (text or "")[:200], str(e)[:500]))
                    continue
                rows += [(uid, at, k, "entity", x["name"], x["type"], None, None, None, x["description"], None) for k, x in enumerate(found["entities"])]
                rows += [(uid, at, k, "relationship", x["source"], x["type"], x["target"], x["sourceType"], x["targetType"], x["description"], None) for k, x in enumerate(found["relationships"])]
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 8]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return units.select("id", "text", "ord").mapInArrow(run, _RECORD)


def stamped(records: DataFrame, types: tuple[str, ...] = maps.ENTITY_TYPES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, failures) of ``extracted``: types normalised, each with the unit that it stands in and weight 1."""
    kind = lambda c: maps.entity_type(F.coalesce(F.col(c), F.lit("")), types)
    cut = F.substring(F.coalesce(F.trim("description"), F.lit("")), 1, DESCRIPTION)
    at = (F.col("ord") * (1 << 20) + F.col("pos")).alias("at")
    unit = F.array("unit_id").alias("unit_ids")
    entities = records.where("kind = 'entity'").select("unit_id", F.trim("name").alias("name"), kind("type").alias("type"), cut.alias("description"), unit, F.create_map().cast("map<string,string>").alias("attributes"), at)
    edges = records.where("kind = 'relationship'").select("unit_id", F.trim("name").alias("source"), kind("source_type").alias("source_type"), F.trim("type").alias("type"), F.trim("target").alias("target"), kind("target_type").alias("target_type"), cut.alias("description"), unit, F.lit(1).cast("long").alias("weight"), at)
    failures = records.where("kind = 'failure'").select("unit_id", F.col("description").alias("passage"), F.col("error").alias("message"))
    return entities, edges, failures


def offline(request: Request) -> str:
    """A deterministic client for runs without a model: each task's reply follows from its last message alone."""
    said = request.messages[0][1]
    material = said.split("\n\n", 1)[-1]
    lines = [x.split("] ", 1)[1] for x in material.splitlines() if x.startswith("[") and "] " in x]
    numbers = [x[1:].split("]", 1)[0] for x in material.splitlines() if "] Source passage: " in x]
    reply = {
        "EXTRACTION": {"entities": [], "relationships": []},
        "COMMUNITY_SUMMARY": {"title": " ".join(lines[0].split()[:3]) if lines else "Group", "summary": f"{len(lines)} elements, first {lines[0]}." if lines else "An empty group."},
        "SUB_QUESTIONS": {"subQuestions": [f"What of {x}" for x in lines]},
        "ANSWER": {"answer": f"From {len(lines)} items [{numbers[0]}]." if numbers else SENTINEL, "notInContext": not numbers},
        "VERDICT": {"verdict": "Both sides answered."},
        "DESCRIPTION_SUMMARY": {"description": " ".join(material.split("Notes:\n")[-1].split())[:200]},
        "COMMUNITY_POINTS": {"points": [{"community": k, "point": x[:80], "score": len(x) % 101} for k, x in enumerate(lines, 1)]},
    }
    return json.dumps(reply[request.purpose])


def overflowing(rows: DataFrame, model: Model, group: str = "identity", limit: int = DESCRIPTION, isolate: bool = True) -> DataFrame:
    """(group, description): one description for each element whose notes (group, name, description, at) together exceed ``limit``.

    The model gets the notes in order, up to eight times the limit; without it, or where it fails, the merged text is cut.
    """
    distinct = rows.where(F.trim("description") != "").groupBy(group, "description").agg(F.min("at").alias("at"), F.min("name").alias("name"))
    total = distinct.groupBy(group).agg(F.sum(F.length("description") + 1).alias("size")).where(F.col("size") > limit).select(group)
    ordered = distinct.join(total, group).repartition(group).sortWithinPartitions(group, "at", "description").select(group, "name", "description")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, name, notes, size = None, None, [], 0

        def done():
            whole = "\n".join(notes)
            try:
                said = model.description(name, whole)
            except ReplyError:
                if not isolate:
                    raise
                said = whole[:limit]
            return pd.DataFrame([(now, said)], columns=[group, "description"])

        for pdf in batches:
            for key, n, text in pdf.itertuples(index=False):
                if key != now:
                    if notes:
                        yield done()
                    now, name, notes, size = key, n, [], 0
                if size < 8 * limit:
                    notes.append(text)
                    size += len(text) + 1
        if notes:
            yield done()

    return ordered.mapInPandas(run, f"{group} string, description string")
