"""The conversation trie against nested dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, id string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    sequences = {c: tuple(turns.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + t[zlib.crc32(str(c).encode()) % 6 :]) for c, t in turns.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def built(spark, rows, local):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = prefix_trie.rebuilt_trie(df, local)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(90), 100, 101, 205, 300, 399]:  # 205 has no head of its hundred
        n = r.choice([1, 2, 3, 5, 8, 20])
        for k in range(n):
            rows.append((c, k if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "é\U0001f600", "", None])))
    rows += [(c, k, "user", "same") for c in range(400, 480) for k in range(12)]  # a hot group of equal conversations
    rows += [(c, 12, "user", f"own {c}") for c in range(400, 440)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie")]
    rows += [(None, k, "user", "no conversation") for k in range(30)]
    return rows + [(300, k, "user", "long " * 2000) for k in range(20, 30)]


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 40, 1])
def test_equals_brute_force(spark, local):
    rows = conversations()
    assert built(spark, rows, local) == brute(rows)


def test_empty_tables(spark):
    assert built(spark, [], prefix_trie.LOCAL) == []
    assert built(spark, [(None, 1, "user", "x")], prefix_trie.LOCAL) == []


def test_turnless_conversations_end_at_the_root(spark):
    alone = [(c, 0, "user", "x") for c in range(101, 120)]  # there is no conversation 100
    got = built(spark, alone, prefix_trie.LOCAL)
    assert got == brute(alone)
    assert got[0][1:4] == (0, -1, 19)
