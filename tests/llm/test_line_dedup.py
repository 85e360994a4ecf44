import random

from quillgraph.llm import line_dedup
from quillgraph.llm.line_dedup import duplicate_lines, edit_distance, without_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choices("abc", k=r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choices("abcd", k=r.randint(0, 1))
        b = "".join(b) if r.random() < 0.8 else "".join(r.choices("abc", k=r.randint(0, 12)))
        for limit in (1, 2, 3):
            assert edit_distance(a, b, limit) == min(distance(a, b), limit + 1), (a, b, limit)


def brute(rows, edits, least):
    occurrences = [(i, k, line) for i, t in sorted(rows) for k, line in enumerate((t or "").split("\n")) if any(ord(c) > 32 for c in line)]
    lines = sorted({x[2] for x in occurrences})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if len(a) >= least and len(b) >= least and abs(len(a) - len(b)) <= edits and edit_distance(a, b, edits) <= edits:
                root[find(b)] = find(a)
    seen, gone, count = set(), {i: [] for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)
    for i, k, line in occurrences:
        count[i] += 1
        if find(line) in seen:
            gone[i].append(k)
        seen.add(find(line))
    return sorted((i, count[i], len(gone[i]), gone[i]) for i, _ in rows)


def test_matches_brute_force(spark):
    r = random.Random(3)
    bases = ["".join(r.choices("abcdefg é", k=r.randint(10, 60))) for _ in range(30)]
    hot = "".join(r.choices("abcdefgh ", k=50))
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 8)):
            line = list(r.choice(bases) if r.random() < 0.6 else hot)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randint(0, len(line))
                line[k : k + r.randint(0, 1)] = r.choices("xyzé", k=r.randint(0, 1))
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "short"), (104, "short\nshort"), (105, "shorT")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, line string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = duplicate_lines(df, edits=2, least=24)
        assert sorted((a, b, c, list(d)) for a, b, c, d in found.collect()) == brute(rows, 2, 24)
        kept = {x.doc_id: x.text for x in without_lines(df, found).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    gone = {x[0]: x[3] for x in brute(rows, 2, 24)}
    for i, t in rows:
        assert kept[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))


def test_empty_table(spark):
    assert duplicate_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_crowds_and_large_groups_lose_no_link_and_give_few(spark):
    r = random.Random(7)
    hot = "".join(r.choices("abcdefgh ", k=60))
    rows, n = [], 0
    for i in range(60):  # near copies of one line, within two edits of each other or further apart
        lines = []
        for _ in range(4):
            line = list(hot)
            for _ in range(r.choice([1, 1, 2, 3, 5])):
                line[r.randrange(20, 60)] = r.choice("ijklmnop")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
        n += 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = line_dedup.CROWD, line_dedup.GROUP
    try:
        for line_dedup.CROWD, line_dedup.GROUP in ((64, 20_000), (5, 20_000), (5, 30)):
            assert sorted((a, b, c, list(d)) for a, b, c, d in duplicate_lines(df).collect()) == brute(rows, 2, 24)
        line_dedup.CROWD, line_dedup.GROUP = held
        places = spark.createDataFrame([(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))], "doc long, number long, said string")
        whole = line_dedup._rows(df)
        firsts = whole.mapInArrow(line_dedup._occurrences, "line long, doc long, number long, size long, sketch long").dropDuplicates(["line"])
        assert line_dedup.links(whole, firsts).count() <= 15 * places.select("said").distinct().count()
    finally:
        line_dedup.CROWD, line_dedup.GROUP = held


def test_clashing_names_and_long_texts(spark):
    line = "a line of some length that is said again and again " * 3
    long = "\n".join(f"{k} {line}{k * 7919}" for k in range(4_000))
    rows = [(1, long, 5, 6), (2, long, 7, 8), (None, line, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _owner int")
    found = {x.doc_id: x for x in duplicate_lines(df).collect()}
    assert found[2].n_removed == 4_000 and found[None].n_removed == 0
    out = without_lines(df, duplicate_lines(df))
    assert out.columns == df.columns
    assert {x.doc_id: x.text for x in out.collect()}[2] == ""
