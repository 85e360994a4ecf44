"""Containment through fingerprints against looking everywhere."""

import random

import numpy as np
import pytest

from quillgraph.operators import compare, overlap


def texts():
    r = random.Random(8)
    units = [(1 + i % 2, f"u{i}", f"d{i % 5}" if i % 3 else None, " ".join("".join(r.choices("abé", k=r.choice([1, 2, 5]))) for _ in range(r.choice([1, 10, 80])))) for i in range(40)]
    units += [(1, "none", "d1", None), (1, "blank", "d1", "  "), (1, "spaced", "d2", "so   it\n is said here, in \t short")]
    chunks = []
    for i in range(160):
        q, _, d, t = units[r.randrange(40)]
        lo = r.randrange(len(t))
        chunks.append((q, f"c{i}", r.choice([d, None, "d3", "elsewhere"]), t[lo : lo + r.choice([1, 2, 3, 7, 8, 15, 22, 23, 24, 60])]))
    return units, [*chunks, (1, "same", None, chunks[0][3]), (1, "same too", None, chunks[0][3]), (1, "null", None, None), (1, "blank", "d1", " "), (2, "spaced", None, "it is said here,  in short"), (1, "spaced", None, "it is said here,  in short"), (1, "absent", None, "nobody wrote this sentence anywhere at all")]


@pytest.mark.parametrize("most", [compare.LIST, 1])
def test_contained_equals_looking_everywhere(spark, monkeypatch, most):
    monkeypatch.setattr(compare, "LIST", most)
    units, chunks = texts()
    flat = lambda t: " ".join((t or "").split())
    want = sorted((q, c, u) for q, c, d, t in chunks for p, u, e, whole in units if q == p and flat(t) and flat(t) in flat(whole) and (not d or d == e))
    got = compare.contained(spark.createDataFrame(chunks, "q_id long, chunk_id string, document string, text string"), spark.createDataFrame(units, "q_id long, unit_id string, document string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_anchor_is_among_the_marks_of_any_text_around_it():
    r = np.random.default_rng(0)
    for _ in range(300):
        whole = r.integers(97, 101, r.integers(1, 200)).astype(np.uint8)
        lo = int(r.integers(0, len(whole)))
        part = whole[lo : lo + int(r.integers(1, 80))]
        mark, size = overlap._anchor(part)
        assert mark in overlap._marks(whole, [size] if size else [])


@pytest.mark.parametrize("most", [compare.ANCHORS, 0])
def test_contained_with_marks_looked_for_and_with_all(spark, monkeypatch, most):
    monkeypatch.setattr(compare, "ANCHORS", most)
    test_contained_equals_looking_everywhere(spark, monkeypatch, 1)


@pytest.mark.parametrize("together", [overlap.TOGETHER, 40])
def test_wanted_marks_are_those_of_all_marks(spark, monkeypatch, together):
    monkeypatch.setattr(overlap, "TOGETHER", together)
    units, _ = texts()
    sizes = [1, 2, 4, 8, 16]
    every = [(u, int(m)) for _, u, _, t in units for m in overlap._marks(np.frombuffer((t or "").encode(), np.uint8), sizes)]
    some = np.array(sorted({m for _, m in every})[::3])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([u for _, u, _, _ in units]), pa.array([t for *_, t in units])], names=["unit_id", "whole"])
    found = [tuple(r.values()) for b in overlap._matched(batch, 1, ["unit_id"], sizes, overlap._Wanted(some)) for r in b.to_pylist()]
    assert sorted(found) == sorted(x for x in every if x[1] in set(some.tolist())) and found
    rows = spark.createDataFrame([(u, t) for _, u, _, t in units], "unit_id string, whole string")
    assert sorted(tuple(r) for r in overlap.fingerprints(rows, "whole", sizes, some).collect()) == sorted(found)
