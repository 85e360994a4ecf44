"""Attribute maps, unit id lists and other values that records normalise on the way in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types in their canonical spelling; the last one takes everything else.
ENTITY_TYPES = ("Person", "Organization", "Product", "Technology", "Version", "Event", "Location", "Concept")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it; written out, nested uses multiply."""
    return F.transform(F.array(value), use)[0]


def attributes(column: Column) -> Column:
    """Trimmed keys in order; blank keys and null values go, and of equal keys the first stays."""
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.transform(F.coalesce(F.map_entries(column), empty), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: e["key"].isNotNull() & (e["key"] != "") & e["value"].isNotNull())

    def ordered(some: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(some, lambda e: e["key"])))
        return _once(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.filter(some, lambda e: e["key"] == k)[0]["value"])))

    return _once(kept, ordered)


def union_attributes(first: Column, second: Column) -> Column:
    """All keys of both maps; values of the first win."""
    return _once(first, lambda own: attributes(F.map_concat(own, F.map_filter(second, lambda k, _: ~F.map_contains_key(own, k)))))


def ordered_union(*lists: Column) -> Column:
    """Distinct ids in the order of their first appearance, blanks dropped."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*(F.coalesce(x, empty) for x in lists))
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (F.trim(x) != "")))


def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def contains_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def without(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def entity_type(column: Column, allowed: tuple[str, ...] = ENTITY_TYPES) -> Column:
    found = F.lit(allowed[-1].strip())
    for name in reversed(allowed):
        found = F.when(F.lower(F.trim(column)) == name.strip().lower(), name.strip()).otherwise(found)
    return found


def identity(name: Column, kind: Column) -> Column:
    return F.concat(F.lower(F.trim(name)), F.lit("::"), F.lower(F.coalesce(F.trim(kind), F.lit("unknown"))))


def edge_key(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit("->"), kind, F.lit("->"), target)


def corpus_name(names: Column) -> Column:
    """Default name of a corpus from its file names."""
    more = F.size(names) - 3
    return (
        F.when(F.size(names) == 0, "Untitled Corpus")
        .when(more <= 0, F.array_join(names, ", "))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" +"), more.cast("string"), F.lit(" more")))
    )


def element_source(attrs: Column, path: Column, document: Column | None = None) -> Column:
    """The source of an element: its attribute, else its locator's path, else (for units) its document."""
    choices = [F.nullif(F.trim(attrs["source"]), F.lit("")), F.nullif(F.trim(path), F.lit(""))]
    return F.coalesce(*choices, *([F.nullif(F.trim(document), F.lit(""))] if document is not None else []))
