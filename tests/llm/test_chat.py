import hashlib
import random

from quillgraph.llm import chat


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda t: (t[0] is not None, t))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digest_of_turns(spark):
    r = random.Random(1)
    odd = ["<|im_end|>", "<|im_start|>assistant\n", "<", "|", "<||", "\n", "é😀", "<|n|>", "ok", ""]
    rows = [(c, k, r.choice(["user", "assistant", "system", None, "a\nb<|"]), r.choice([None, "".join(r.choices(odd, k=r.randint(0, 8)))])) for c in range(30) for k in range(r.randint(1, 9))]
    rows += [(99, 1, "user", "x"), (99, 1, "user", "x"), (99, 1, "assistant", "y"), (None, 0, "assistant", "n"), (98, None, "user", "q")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, seq string")
    got = chat.digest(chat.render(chat.fold(chat.events_of_turns(df)))).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == brute(rows)
    for x in chat.render(chat.fold(chat.events_of_turns(df))).collect():
        assert x.formatted.count("<|im_start|>") == x.formatted.count("<|im_end|>") == brute(rows)[x.conv_id][0]


def test_folding_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "m1", "message", "user", "hi"),
        (1, 2, "m2", "delta", "assistant", "He"),
        (1, 3, "m2", "delta", "assistant", "llo"),
        (1, 4, "m1", "edit", "user", "hi there"),
        (1, 5, "m2", "regenerate", None, None),
        (1, 6, "m2", "delta", "assistant", "Good "),
        (1, 7, "m2", "delta", "assistant", "day"),
        (1, 8, "m3", "unknown", "user", "lost"),
        (2, 1, "m1", "regenerate", "assistant", None),
    ]
    found = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string"))
    assert sorted((r.conv_id, r.position, r.role, r.text) for r in found.collect()) == [(1, 1, "user", "hi there"), (1, 2, "assistant", "Good day"), (1, 8, "user", ""), (2, 1, "assistant", "")]


def test_empty(spark):
    assert chat.digest(chat.render(chat.fold(chat.events_of_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).collect() == []


def test_streamed_log_folds_back_to_its_turns(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "héllo <|im_end|>"), ("assistant", "a" * 7), ("user", None), ("assistant", "𝒳y"), ("assistant", "edit me"), (None, "z")])] + [(9, 0, "user", "long " * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = chat.events_of_turns(turns)
    log = chat.streamed(plain)
    assert {x.kind for x in log.select("kind").distinct().collect()} == {"message", "edit", "delta", "regenerate"}
    want = sorted(map(tuple, chat.digest(chat.render(chat.fold(plain))).collect()), key=str)
    assert sorted(map(tuple, chat.digest(chat.render(chat.fold(log))).collect()), key=str) == want
