import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quillgraph.llm import _text as tx
from quillgraph.llm import decontaminate, quality, secrets_scan


def test_decontamination_matches_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["é", "ß9"]
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice([w, w.upper()]) for w in r.choices(words, k=n))
    items = [(k, say(r.choice([0, 1, 3, 13, 14, 40]))) for k in range(12)] + [(90, None), (91, "W1 w2, w3"), (92, "w1 w2 w3")]
    docs = []
    for i in range(150):
        parts = [say(r.randint(0, 60))]
        if r.random() < 0.6:
            parts.append(r.choice(items)[1] or "")
            parts.append(say(r.randint(0, 700)))
        docs.append((i, " | ".join(parts)))
    docs += [(500, None), (501, "--")]

    def split(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for k, it in items:
            p = split(it)
            m = min(13, len(p))
            wins = {tuple(p[j : j + m]) for j in range(len(p) - m + 1)} if p else set()
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in wins:
                    hit |= set(range(j, j + m))
                    found.add(str(k))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in decontaminate.contamination(d, b).collect()}
    assert got == want
    before = decontaminate.PATTERN_BYTES
    decontaminate.PATTERN_BYTES = 400  # several passes
    try:
        assert {x.doc_id: tuple(x)[1:] for x in decontaminate.contamination(d, b).collect()} == want
    finally:
        decontaminate.PATTERN_BYTES = before
    assert {x.doc_id for x in decontaminate.clean(d, b).collect()} == {i for i, x in want.items() if not x[4]}
    assert decontaminate.contamination(d.limit(0), b).collect() == []


def test_items_without_id_are_found_and_not_named(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"ahead {passage} behind", "n"), (2, "nothing of it", "n")], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(None, passage), (7, "nothing of it"), (None, None)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated, got[1].items_sha256) == (13, 0, True, hashlib.sha256(b"").hexdigest())
    assert (got[2].n_hit, got[2].n_items) == (3, 1)
    assert [x.doc_id for x in decontaminate.clean(docs, items).collect()] == []


def test_base_counts_match_brute_force():
    r = random.Random(2)
    texts = ["", " \n ", "a"]
    for _ in range(200):
        lines = ["".join(r.choices(["ab ", "é ", "# ", "x", "\t", "<y> ", "z z z z z z z z "], k=r.randint(0, 12))) for _ in range(r.randint(0, 6))]
        texts.append("\n".join(lines + r.choices(lines, k=2) if lines else lines))
    got = quality.base_counts(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {j for k in range(len(words) - 7) if wins[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert row.tolist() == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)]


def stream(text):
    """The signs of a text as the model counts them, from plain strings."""
    raw = re.sub(rb"[\x20\x09-\x0D]+", b" ", re.sub(rb"[0-9]", b"0", (text or "").encode())).lstrip(b" ")
    return raw if not raw or raw.endswith(b" ") else raw + b" "


def brute_model(texts, order):
    """Modified Kneser-Ney probabilities from plain dictionaries."""
    top = Counter()
    for t in texts:
        s = b" " * (order - 1) + stream(t)
        for k in range(order - 1, len(s)):
            top[s[k - order + 1 : k + 1]] += 1
    levels, wider = {}, set()
    for k in range(order, 0, -1):
        counts = top if k == order else Counter(g[1:] for g in wider)
        wider = set(counts)
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else 0.5 * i for i in (1, 2, 3)}
        by = {}
        for g, c in counts.items():
            by.setdefault(g[:-1], []).append(c)
        levels[k] = (counts, d, by)

    def p(g):
        if not g:
            return 1 / 256
        counts, d, by = levels[len(g)]
        mine = by.get(g[:-1])
        if not mine:
            return p(g[1:])
        cut = lambda c: d[min(c, 3)]
        own = max(counts.get(g, 0) - cut(counts[g]), 0) / sum(mine) if g in counts else 0
        return own + sum(map(cut, mine)) / sum(mine) * p(g[1:])

    return p


def brute_traits(text):
    """Fold and well-formedness of a text."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if not words:
        return 0, False
    least = min(int(tx.mix(tx.span_hash(tx.prefix_hash(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)])))[0]) for w in words)
    marks = sum(c < 128 and chr(c).isprintable() and not chr(c).isalnum() and c != 32 for w in words for c in w)
    return least >> 7 & 1, len(words) >= 20 and 2 * marks <= len(words)


def prose(r, lexicon, n):
    return ". ".join(" ".join([r.choice(lexicon).capitalize(), *r.choices(lexicon, k=r.randint(5, 9))]) for _ in range(n)) + "."


def lexicon(seed, consonants, vowels):
    r = random.Random(seed)
    syllables = [a + b for a in consonants for b in vowels]
    return ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(400)]


def judge_rows():
    r = random.Random(9)
    one, two = lexicon(1, "bdgklmnprst", "aeiou"), lexicon(2, "cfhjqvwxyz", ("é", "ou", "ä"))
    rows = [(i, prose(r, one, r.choice([4, 12, 30])), "xx") for i in range(150)] + [(200 + i, prose(r, two, 12), "yy") for i in range(60)]
    junk = [" ".join("".join(r.choices("QZX#7~^", k=6)) for _ in range(80)), " | ".join(r.choices(one, k=80)), prose(r, two, 12), " ".join(f"{w}{r.choice(['***', '$$$', '###'])}" for w in r.choices(one, k=80)), "".join(chr(r.randint(97, 122)) if r.random() < 0.84 else " " for _ in range(600))]
    rows += [(900 + i, t, "xx") for i, t in enumerate(junk)]
    rows += [(910 + i, prose(r, one, 4)[:260] + " ".join(r.choices(junk[0].split(), k=30)), "xx") for i in range(3)]
    return [*rows, (950, "too short", "xx"), (951, None, "xx"), (952, " ".join(["same eight words stand here again and again"] * 20), "xx"), (953, prose(r, one, 12), None), (0, rows[0][1], "xx"), (954, " \n\t ", "yy")]


def test_verdicts_match_brute_force(spark):
    rows = judge_rows()
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, lang string, formed int, key1 string")
    held = quality.MODEL_ROWS
    got = sorted(quality.judged(docs).collect(), key=lambda x: (x.doc_id, x.n_words))
    quality.MODEL_ROWS = 2000  # several blocks
    try:
        blocked = sorted(quality.judged(docs).collect(), key=lambda x: (x.doc_id, x.n_words))
    finally:
        quality.MODEL_ROWS = held
    assert len(got) == len(blocked) == len(rows)
    want = {}
    for lang in ("xx", "yy", ""):
        mine = [(i, t) for i, t, x in rows if (x or "") == lang]
        trait = {t: brute_traits(t) for _, t in mine}
        models = {f: brute_model([t for _, t in mine if trait[t] == (f, True)], quality.ORDER) for f in (0, 1)}
        taught = {f: any(trait[t] == (f, True) for _, t in mine) for f in (0, 1)}
        ppl = {}
        for t in trait:
            s = stream(t)
            if s and taught[1 - trait[t][0]]:
                full = b" " * (quality.ORDER - 1) + s
                ppl[t] = -sum(math.log(models[1 - trait[t][0]](full[k - quality.ORDER + 1 : k + 1])) for k in range(quality.ORDER - 1, len(full))) / len(s)
        base = {t: x for t, x in zip(trait, quality.base_counts(pa.array(list(trait))).tolist(), strict=True)}
        failed = {t: n[0] < 20 or 100 * n[4] > 30 * n[0] for t, n in base.items()}
        fine = [t for t in ppl if trait[t][1] and not failed[t]]
        middle = lambda xs: (sorted(math.floor(x * quality.CELLS) for x in xs)[(len(xs) + 1) // 2 - 1] + 0.5) / quality.CELLS
        reach = lambda t: math.sqrt(1 + quality.SPREAD / len(stream(t)))
        if fine:
            m = middle([ppl[t] for t in fine])
            s = max(1.4826 * middle([abs(ppl[t] - m) / reach(t) for t in fine]), quality.LEAST_DEVIATION)
        for i, t in mine:
            inside = t not in ppl or not fine or m - quality.BELOW * s * reach(t) <= ppl[t] <= m + quality.ABOVE * s * reach(t)
            want.setdefault(i, []).append((ppl.get(t), not failed[t] and inside))
    for run in (got, blocked):
        for x in run:
            p, kept = next(w for w in want[x.doc_id])
            assert x.kept == kept, (x, p)
            assert (x.log_ppl is None) == (p is None) and (p is None or math.isclose(x.log_ppl, p, rel_tol=1e-5)), (x, p)
    kept = {x.doc_id: x.kept for x in got}
    assert all(kept[i] for i in [*range(150), *range(200, 260), 953])
    assert not any(kept[i] for i in [*range(900, 905), *range(910, 913), 950, 951, 952, 954])
    assert not any(x.base_failed for x in got if 900 <= x.doc_id < 913)
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_a_very_long_text_is_judged_as_a_whole(spark):
    r = random.Random(11)
    one = lexicon(1, "bdgklmnprst", "aeiou")
    rows = [(i, prose(r, one, 20), "xx") for i in range(40)] + [(100, prose(r, one, 60_000), "xx"), (101, prose(r, one, 30_000) + " ".join("".join(r.choices("QZX7", k=6)) for _ in range(300_000)), "xx")]
    got = {x.doc_id: x for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in [*range(40), 100]) and not got[101].kept and not got[101].base_failed


def test_filters_take_only_the_judged_rows_of_shared_and_missing_ids(spark):
    r = random.Random(10)
    lexicon = ["".join(r.choices("bdgklmnprst", k=1) + r.choices("aeiou", k=1)) + x for x in ("ba", "ko", "mi", "rul") for _ in range(60)]
    fine = [" ".join(r.choices(lexicon, k=60)) for _ in range(30)]
    rows = [(None if k % 3 == 0 else 7, t, "xx", k) for k, t in enumerate(fine)] + [(None, "too short", "xx", 100), (7, "too short too", "xx", 101), (7, None, None, 102)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int")
    assert sorted(x.row for x in quality.good(docs).collect()) == list(range(30))
    tests = spark.createDataFrame([(1, fine[0]), (2, fine[1])], "item_id long, text string")
    assert sorted(x.row for x in decontaminate.clean(docs, tests).collect()) == [*range(2, 30), 100, 101, 102]


def test_secret_scan(spark):
    r = random.Random(3)
    key = "".join(r.choices("0123456789abcdef", k=40))
    loose = ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48)) for _ in range(40)]
    rows = [(1, f"é API_KEY = '{key}' and AKIA{'A1' * 8} end"), (2, "token: short"), (3, None), (4, "paſsword=abcdefgh1 ToKeN:=abcdefgh1"), (5, "plain_identifier_names_stand_here_1 " * 3), (6, key)]
    rows += [(100 + k, f"value {x} here") for k, x in enumerate(loose)]
    got = {x.doc_id: x for x in secrets_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == f"assign:2:{2 + len('API_KEY = ') + 1 + 40},hex:13:53,access:{rows[0][1].index('AKIA')}:{rows[0][1].index('AKIA') + 20}"
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    assert got[2].spans == got[3].spans == got[5].spans == "" and got[6].spans == "hex:0:40"
    assert got[4].spans == "assign:19:35"
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    found = [got[100 + k].spans == f"random:6:{6 + 48}" for k in range(40)]
    assert sum(found) >= 36
    assert secrets_scan.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_secret_cut_counts_strings_and_not_copies(spark):
    cell = lambda t: secrets_scan.battery(t, secrets_scan.encoding(t))
    r = random.Random(4)
    draw = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=28)) + "q7"
    common = next(t for t in iter(draw, "") if cell(t) >= 0.6)
    names = []
    while len(names) < 40:  # ordinary names: low p-values that are not quite zero
        t = "".join(r.choices("aeionrst", k=22)) + "".join(r.choices("0123456789", k=8))
        if secrets_scan.FLOOR <= cell(t) < 0.3:
            names.append(t)
    rows = [(k, f"{common} text") for k in range(120)] + [(1000 + k, f"{t} text") for k, t in enumerate(names)]
    got = {x.doc_id: x.spans for x in secrets_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[1000 + k] for k in range(40))
    assert all(secrets_scan.cuts({3: {10: n}}) == {} for n in (1, 29, 30, 1000))


def test_secret_scan_finds_letters_digits_and_short_keys_but_no_words(spark):
    r = random.Random(12)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [(lower, 40), (upper + lower, 60), ("0123456789", 24), (upper + lower + "0123456789", 18)]
    keys = [["".join(r.choices(a, k=n)) for _ in range(300)] for a, n in kinds]
    syllables = [a + b for a in "bdgklmnprst" for b in "aeiou"]
    words = ["".join(r.choices(syllables, k=r.choice([4, 5, 6, 7, 8]))) for _ in range(6000)]
    rows = [(k * 400 + i, f"at {x} on") for k, part in enumerate(keys) for i, x in enumerate(part)] + [(5000 + k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(300)]
    got = {x.doc_id: x.spans for x in secrets_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (_, n) in enumerate(kinds):
        assert sum(got[k * 400 + i] == f"random:3:{3 + n}" for i in range(300)) >= 240, k
    assert sum(got[5000 + k].count("random") for k in range(300)) <= 60


def brute_p(token, alphabet):
    """The combined p-value of the three tests from their textbook formulas."""
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    n, size = len(token), len(alphabet)
    x = [alphabet.index(c) for c in token]
    chi = sum((x.count(k) - n / size) ** 2 / (n / size) for k in range(size))
    df = size - 1
    shape = df / (df * (n - 1) / n)
    tests = [tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df * shape))) / math.sqrt(2 / (9 * df * shape)))]
    high = [v >= size / 2 for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs, mean = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False)), 1 + 2 * a * b / n
        tests.append(2 * tail(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))))
    else:
        tests.append(2.0 ** (1 - n))
    m = sum(x) / n
    power = sum((v - m) ** 2 for v in x)
    tests.append(2 * tail(abs(sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False)) / power + 1 / n) * math.sqrt(n)) if power else 2.0 ** (1 - n))
    s = -sum(math.log(min(1.0, max(p, 1e-300))) for p in tests)
    return math.exp(-s) * (1 + s + s * s / 2)


def test_secret_scan_matches_brute_force(spark):
    r = random.Random(21)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(r.choices(["ba", "ko", "mi", "rul", "Te", "_", "9"], k=r.randint(3, 7)))
    draw = lambda a, n: "".join(r.choices(a, k=n))
    makers = [word, word, lambda: draw(base62, r.choice([14, 30, 50, 120])), lambda: draw("0123456789abcdef", r.choice([20, 31, 40])), lambda: f"{r.choice(['API-KEY', 'api_key', 'Passwd', 'token', 'SECRET'])}{r.choice(['', chr(34)])}{r.choice([':', ' = ', '=  ', ' '])}{r.choice(['', chr(39)])}{draw(base62 + '+/_.=-', r.choice([5, 8, 30]))}", lambda: "AKIA" + draw("ABC123", r.choice([8, 16])), lambda: "é ſ\n"]
    rows = [(k, r.choice([" ", "", ","]).join(r.choice(makers)() for _ in range(r.randint(1, 12)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, " ".join(draw(base62, 40) for _ in range(30)) * 20), (402, rows[0][1]), (None, rows[1][1])]
    patterns = [(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8), (r"(AKIA[A-Z0-9]+)", 16), (r"([0-9a-f]+)", 32)]
    found, cells = [], {}
    for i, t in rows:
        t = t or ""
        base = [(m.start(), k, m.end()) for k, (p, least) in enumerate(patterns) for m in re.finditer(p, t) if len(m[1]) >= least]
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{8,}", t):
            kind = next((k for k, (_, a) in enumerate(secrets_scan.ALPHABETS) if set(m[0]) <= set(a)), None)
            if kind is None or any(s < m.end() and m.start() < e for s, _, e in base):
                continue
            p = brute_p(m[0], secrets_scan.ALPHABETS[kind][1])
            cell = (kind, sum(len(m[0]) >= b for b in secrets_scan.BANDS))
            if p >= secrets_scan.FLOOR:
                cells.setdefault(cell, {})[m[0]] = min(99, int(p * 100))
                more.append((m.start(), m.end(), cell, min(99, int(p * 100))))
        found.append((i, sorted(base), more))
    cut = {}
    for cell, strings in cells.items():
        ks = list(strings.values())
        upper, top = sum(k >= 50 for k in ks), sum(k >= 75 for k in ks)
        if upper - 2 * top > 2 * math.sqrt(upper):
            continue
        fits = [k for k in range(100) if (above := sum(x >= k for x in ks)) and above - 2 * upper * (1 - max(secrets_scan.FLOOR, k / 100)) <= secrets_scan.RATE * above]
        if fits:
            cut[cell] = fits[0]
    want = []
    for i, base, more in found:
        named = [f"{secrets_scan.KINDS[k]}:{s}:{e}" for s, k, e in base]
        every = sorted(base + [(s, 3, e) for s, e, cell, k in more if k >= cut.get(cell, 100)])
        want.append((i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(f"{secrets_scan.KINDS[k]}:{s}:{e}" for s, k, e in every)))
    got = [tuple(x) for x in secrets_scan.digest(spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, base int")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum("random" in x[5] for x in want) > 50


def test_menus_go_and_texts_of_two_languages_stay(spark, monkeypatch):
    r = random.Random(14)
    one, two = lexicon(3, "bdgklmnprst", "aeiou"), lexicon(4, "cfhjqvwxyz", ("é", "ou", "ä"))
    rows = [(i, prose(r, one, r.choice([12, 30, 60])), "xx") for i in range(150)] + [(200 + i, prose(r, two, 12), "yy") for i in range(150)]
    rows += [(400 + i, prose(r, one, 30) + " " + prose(r, two, 10 + 2 * i), "xx") for i in range(2)]
    rows += [(500 + i, prose(r, one, 5) + "\n" + " | ".join(w.capitalize() + "," if k % 2 else w for k, w in enumerate(r.choices(one, k=70))), "xx") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = lambda: {x.doc_id: x for x in quality.judged(docs).collect()}
    got = judged()
    assert len(got) == len(rows) and not any(x.base_failed for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {500, 501, 502, 503}
    monkeypatch.setattr(quality, "MODEL_ROWS", 2000)  # several blocks
    assert {i: x.kept for i, x in judged().items()} == {i: x.kept for i, x in got.items()}
    monkeypatch.setattr(quality, "MIXED", quality.ABOVE)  # by one language alone
    assert not judged()[401].kept
