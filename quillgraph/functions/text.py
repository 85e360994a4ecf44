"""Text functions: tokens, sentences, excerpts, identifiers, splitters, name keys and citation markers.

Column functions take and return columns and stay in the JVM. Splitters that depend on where the last piece ended, name
keys (Unicode NFKC) and citation renumbering are Arrow-batched pandas functions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_SIZE, UNIT_OVERLAP, UNIT_LEAST = 6000, 600, 3000
CHUNK_SIZE, CHUNK_LEAST = 500, 250
EXCERPT = 200
#: Question words that don't name an element of a graph.
STOP_WORDS = (
    "the", "and", "for", "from", "with", "what", "which", "where", "who", "whom", "whose", "how", "why",
    "when", "does", "did", "doe", "are", "was", "were", "been", "being", "has", "have", "had", "can",
    "could", "should", "would", "will", "call", "calls", "called", "calling", "caller", "callers", "use",
    "uses", "used", "using", "method", "methods", "class", "classes", "function", "functions", "type",
    "types", "this", "that", "these", "those", "there", "here", "into", "onto", "about", "all", "any",
    "show", "find", "list", "code", "implement", "implements", "implemented", "implementation", "not",
    "its", "it's", "our", "your", "their", "them", "they", "then", "than", "also", "via", "per", "each",
)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits longer than two, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def edit_allowance(token: Column) -> Column:
    return F.when(F.length(token) >= 7, 2).when(F.length(token) >= 4, 1).otherwise(0)


def token_score(token: Column, candidate: Column, words: Column) -> Column:
    """2 if the candidate contains the token, else 1 if one of its words is within the token's edit allowance, else 0."""
    limit = edit_allowance(token)
    near = F.exists(words, lambda w: F.levenshtein(token, w) <= limit)
    return F.when(F.contains(F.lower(candidate), token), 2).when((limit > 0) & near, 1).otherwise(0)


def keyword_score(query_tokens: Column, candidate: Column) -> Column:
    words = tokens(candidate)
    return F.aggregate(query_tokens, F.lit(0), lambda s, t: s + token_score(t, candidate, words))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    flat = collapsed(text)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def first_chars(text: Column, size: int) -> Column:
    return F.substring(F.trim(text), 1, size)


def normalized_identifier(name: Column) -> Column:
    cut = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"(?s)\(.*$", "")
    dotted = F.regexp_replace(cut, r"::|[#$/]", ".")
    return F.lower(F.regexp_replace(F.regexp_replace(dotted, r"\.+", "."), r"^\.|\.$", ""))


def segments(normalized: Column) -> Column:
    return F.filter(F.split(normalized, r"\."), lambda s: s != "")


def identifier_parts(name: Column) -> Column:
    """Distinct lower-case words of a camel-case, acronym or digit-separated name, two letters or more."""
    marked = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.array_distinct(F.filter(F.transform(F.split(marked, "[^A-Za-z0-9]+"), lambda p: F.lower(p)), lambda p: F.length(p) >= 2))


def is_code_like(token: Column) -> Column:
    return (F.length(token) >= 2) & (token.rlike(r"[.#(_$]|::") | token.rlike(r"^.+[A-Z]"))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::|#)[A-Za-z_$][A-Za-z0-9_$]*)*(?:\([^()]*\))?"), F.lit(0))


def plain_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)), lambda w: ~w.isin(*STOP_WORDS))


def locator_struct(text: Column) -> Column:
    """path[:start[-end]] as (path, start_line, end_line); 0 means the whole file, and an end before the start is the start."""
    pattern = r"^(.*?)(?::(\d+)(?:-(\d+))?)?$"
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int"), F.lit(0))
    start = number(2)
    end = F.when(start == 0, 0).otherwise(F.greatest(start, number(3)))
    return F.struct(F.regexp_extract(text, pattern, 1).alias("path"), start.alias("start_line"), end.alias("end_line"))


def locator_text(locator: Column) -> Column:
    start, end = locator["start_line"], locator["end_line"]
    return F.concat(locator["path"], F.when(start > 0, F.concat(F.lit(":"), start.cast("string"))).otherwise(""), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""))


def not_in_context(answer: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(answer), r"^[\"'`*\s.]+|[\"'`*\s.!]+$", "")) == "NOT_IN_CONTEXT"


def deterministic_title(names: Column) -> Column:
    """First two distinct names joined by an ampersand, six words at most."""
    distinct = F.slice(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")), 1, 2)
    joined = F.array_join(distinct, " & ")
    return F.when(F.size(distinct) == 0, "Related entities").otherwise(F.array_join(F.slice(F.split(joined, r"\s+"), 1, 6), " "))


def fallback_summary(names: Column, distinct: bool = False) -> Column:
    named = F.filter(names, lambda n: F.trim(n) != "")
    named = F.slice(F.array_distinct(named) if distinct else named, 1, 4)
    return F.when(F.size(named) == 0, "A small connected cluster of related entities.").otherwise(F.concat(F.lit("This community centers on "), F.array_join(named, ", "), F.lit(".")))


# -- splitters -----------------------------------------------------------------------------------------------------------

_PARAGRAPH = re.compile(r"\n\n|\r\n\r\n")


def chunk_texts(text: str | None, size: int = CHUNK_SIZE, least: int = CHUNK_LEAST) -> list[str]:
    """Greedy pieces of up to ``size`` characters, cut after the last space beyond ``least`` where there is one."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            space = text.rfind(" ", at + least + 1, end)
            end = space + 1 if space > 0 else end
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        at = end
    return out


def unit_texts(text: str | None, size: int = UNIT_SIZE, overlap: int = UNIT_OVERLAP, least: int = UNIT_LEAST) -> list[str]:
    """Overlapping windows that end at a paragraph, else a sentence, else a word, and start at a word."""
    out, at, text = [], 0, text or ""
    if not text.strip():
        return out
    while True:
        if at + size >= len(text):
            out.append(text[at:])
            return out
        window, floor = at + size, at + least
        cut = max((m.end() for m in _PARAGRAPH.finditer(text, at, window)), default=-1)
        if cut <= floor:
            places = [i for i in range(window - 1, floor - 1, -1) if text[i].isspace()]
            cut = next((i + 1 for i in places if text[i - 1] in ".!?"), places[0] + 1 if places else window)
        out.append(text[at:cut])
        start = cut - overlap
        if not text[start - 1].isspace():
            start = next((i + 1 for i in range(start, cut) if text[i].isspace()), start)
        at = start


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(text: pd.Series) -> pd.Series:
    return text.map(chunk_texts)


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_units(text: pd.Series) -> pd.Series:
    return text.map(unit_texts)


#: A period after these, or after a single capital, ends no sentence.
_ABBREVIATIONS = {
    "mr", "mrs", "ms", "dr", "st", "prof", "sr", "jr", "rev", "capt", "col", "gen", "lt", "sgt",
    "mt", "no", "vs", "etc", "e.g", "i.e", "cf", "approx",
}


def first_sentences_of(text: str | None, count: int) -> str:
    """Text up to its ``count``-th sentence end; abbreviations and single initials end none."""
    text, seen = text or "", 0
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        word = re.search(r"(?:[^\W\d_]|\.)*$", text[: m.start()])[0] if m[0] == "." else ""
        if word and (word.lower() in _ABBREVIATIONS or len(word) == 1 and word.isupper()):
            continue
        seen += 1
        if seen == count:
            return text[: m.end()].strip()
    return text.strip()


def first_sentences(text: Column, count: int) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: first_sentences_of(t, count))

    return run(text)


def name_key_of(name: str | None) -> str:
    """NFKC, outer punctuation and symbols off, white space collapsed, lower case; the plain name if nothing is left."""
    outer = lambda c: unicodedata.category(c)[0] in "PS"
    folded = unicodedata.normalize("NFKC", name or "")
    lo, hi = 0, len(folded)
    while lo < hi and outer(folded[lo]):
        lo += 1
    while hi > lo and outer(folded[hi - 1]):
        hi -= 1
    key = re.sub(r"\s+", " ", folded[lo:hi]).strip().lower()
    return key or (name or "").strip().lower()


@F.pandas_udf(T.StringType())
def name_key(name: pd.Series) -> pd.Series:
    return name.map(name_key_of)


_ENTRY = r"\s*\d+(?:\s*[-–]\s*\d+)?\s*"
_MARKER = re.compile(rf"([ \t]*)\[({_ENTRY}(?:[,;]{_ENTRY})*)\]")


def resolve_citations(text: str | None, unit_numbers: list[int]) -> tuple[str, list[int]]:
    """Renumber the markers that cite ``unit_numbers`` by first appearance and drop the others; (text, cited in order)."""
    known, order = set(int(n) for n in unit_numbers), {}

    def numbers(body: str) -> list[int]:
        out = []
        for part in re.split(r"[,;]", body):
            ends = [int(x) for x in re.split(r"[-–]", part)]
            if len(ends) == 2 and 0 <= ends[1] - ends[0] <= 100:
                out += range(ends[0], ends[1] + 1)
            else:
                out.append(ends[0])
        return out

    def put(m: re.Match) -> str:
        cited = []
        for n in numbers(m[2]):
            if n in known:
                new = order.setdefault(n, len(order) + 1)
                if new not in cited:
                    cited.append(new)
        return f"{m[1]}[{', '.join(map(str, cited))}]" if cited else ""

    return _MARKER.sub(put, text or ""), list(order)
