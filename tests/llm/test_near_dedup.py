import random
import re

from quillgraph.llm import near_dedup
from quillgraph.llm.near_dedup import near_duplicates


def brute(rows, size=4):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string")
    assert sorted(map(tuple, near_duplicates(df).drop("text_key").collect())) == brute(rows)


def test_matches_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randint(3, 160))
        for _ in range(r.choice([1, 1, 2, 6, 20])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one"), (1006, "É one two three"), (1007, "é one two three")]
    r.shuffle(rows)
    check(spark, rows)


def test_star_of_edited_copies_meets_in_its_original(spark):
    r = random.Random(2)
    base = [f"v{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        w = list(base)
        for k in r.sample(range(0, 300, 5), r.choice([2, 5, 8])):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_empty_table_and_rows_without_id(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(rows).drop("text_key").collect()), key=str)
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False), (None, 2, None, True)]


def test_crowded_families_lose_no_link(spark):
    """Families whose members are nearly alike but mostly under the threshold, with a few linked pairs hidden in them."""
    r = random.Random(8)
    rows = []
    for f in range(2):
        base = [f"b{f}_{i}" for i in range(200)]
        for _ in range(130):
            w = list(base)
            for k in r.sample(range(0, 200, 5), 7):  # two members are about 0.7 alike
                w[k] = f"x{len(rows)}_{k}"
            rows.append((len(rows), " ".join(w)))
            if r.random() < 0.1:  # a copy of the member with one more word changed
                w = list(w)
                w[r.randrange(0, 200, 5)] = f"y{len(rows)}"
                rows.append((len(rows), " ".join(w)))
    held = near_dedup.BUCKET, near_dedup.GROUP
    try:
        for near_dedup.BUCKET, near_dedup.GROUP in (held, (40, 25)):
            check(spark, rows)
    finally:
        near_dedup.BUCKET, near_dedup.GROUP = held


def test_very_long_texts_and_clashing_names(spark):
    words = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, words, 1, 1, 1), (2, words + " end", 2, 2, 2), (3, "short", 3, 3, 3)]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bucket int, part int, k1 int")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
