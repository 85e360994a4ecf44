import hashlib
import random

from quillgraph.llm.repeats import deduplicated


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.5:
                p = r.choice(passages)
                a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
                parts.append(p[a:b] if r.random() < 0.7 else p)
            else:
                parts.append(" ".join(word() for _ in range(r.randint(1, 60))))
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(5)]
    rows += [(300, "a" * 400), (301, "ab" * 200), (302, None), (303, ""), (304, "x" * 99), (305, "x" * 100), (306, "x" * 101), (307, "é" * 120), (308, rows[3][1] + " " + rows[3][1])]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame([(i, t, 1) for i, t in shuffled], "doc_id long, text string, doc int")
    assert sorted(map(tuple, deduplicated(df, 100).collect())) == brute(rows, 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # streams in many small batches
    try:
        assert sorted(map(tuple, deduplicated(df, 100).collect())) == brute(rows, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_repeated_rows(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "".join(chr(97 + k * k % 26) for k in range(150)) + "".join(map(str, range(60)))
    got = deduplicated(spark.createDataFrame([(5, text), (5, text), (9, text), (None, "q" + text[:40])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == sorted([(5, brute([(5, text)], 100)[0][2])] * 2 + [(9, len(text)), (-1, 0)])
