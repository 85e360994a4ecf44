"""SimHash fingerprints and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from quillgraph.llm import simhash

SCHEMA = "doc_id long, text string, bits string, component string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(values):
    """The place of the first value that each distinct value is connected with."""
    values, up = sorted(set(values)), {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    return {v: find(v) for v in values}


def brute(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    of, least = parts([f for _, f in prints]), {}
    for d, f in prints:
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return sorted((d if d is not None else -9, f"{f:016x}", least.get(of[f], -9)) for d, f in prints)


def documents():
    r = random.Random(3)
    words = [f"w{i}é" for i in range(300)]
    base = [" ".join(r.choices(words, k=r.choice([1, 3, 4, 5, 60, 200]))) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 260):
        w = base[r.randrange(8) + 40].split()
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, ("  " if i % 2 else "\n").join(w)))
    rows += [(300 + i, None if i % 2 else " \t\n") for i in range(50)]
    rows += [(None, base[41]), (None, "nobody else says this at all today"), (7, "other text with the id of another row"), (3, base[3]), (3, base[3])]
    return rows + [(400, "ONE Word"), (401, "one wORD"), (402, " ".join(r.choices(words, k=70_000)))]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 40])
def test_equals_all_pairs(spark, crowd):
    rows = documents()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(df, crowd=crowd)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(-9 if v is None else v for v in r) for r in out.collect()) == brute(rows)


def test_masks_cover_every_radius():
    r = random.Random(1)
    for free in ((1 << 64) - 1, 0x00FF00FF00FF00FF, 0b1011011):
        at = [i for i in range(64) if free >> i & 1]
        masks = simhash.masks(4, free)
        assert len(masks) == 31 and all(m and m & ~free == 0 for m in masks)
        for _ in range(500):
            differ = sum(1 << i for i in r.sample(at, 4))
            assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 60])
def test_crowded_region_loses_no_link(spark, crowd):
    r = random.Random(9)
    center = r.getrandbits(64)
    values = {center} | {center ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 5, 7, 9]))) for _ in range(150)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long"), crowd=crowd).collect()
    up = {v: v for v in values}
    find = lambda x: x if up[x] == x else find(up[x])
    mask = (1 << 64) - 1
    for a, b in found:
        assert ((a ^ b) & mask).bit_count() <= 4
        up[find(a & mask)] = find(b & mask)
    want = parts(values)
    assert len({(find(v), want[v]) for v in values}) == len({find(v) for v in values}) == len(set(want.values()))


def test_forest_of_a_bucket():
    bits = np.array([0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) + 1], np.uint64)
    assert len(simhash._forest(bits, 4)) == 7 and len(simhash._forest(np.array([0, (1 << 6) - 1], np.uint64), 4)) == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
