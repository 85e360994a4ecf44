import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import token_files as tf
from quillgraph.llm.queries import tokenizer_path


@pytest.mark.parametrize("most", [1, 2, 16, 300, 50_000, 2**31, 2**62])
def test_packing_round_trip(most):
    r = np.random.default_rng(most % 1000)
    lengths = r.integers(1, 3000, 30)
    ids = (r.integers(0, most, int(lengths.sum())) * (r.random(int(lengths.sum())) < 0.7)).astype(np.uint64)
    words, used, _ = tf.pack(ids, lengths)
    offsets = (np.cumsum(used) - used).astype("<u4").tobytes()
    assert (tf.segment_ids(lengths, offsets, words.tobytes()) == ids).all()


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tool, mine = Tokenizer.from_file(tokenizer_path()), tf.Encoder(tokenizer_path())
    r = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "a", "B", "it's", "'ll", "é", "ß", "×", "÷", "12", "#", ".", ",", "…", " ", "\x85", "\x1c", "　", "<|endoftext|>", "😀", "word", "\r\n", "_", "ñ.", "\x0b"]
    texts = [None, ""] + ["".join(r.choices(bits, k=r.randint(1, 30))) for _ in range(1500)]
    ids, lengths = mine(pa.array(texts, pa.string()))
    cut = np.split(ids, np.cumsum(lengths)[:-1])
    for text, got in zip(texts, cut, strict=True):
        assert got.tolist() == tool.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_files_read_back(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    rows = [(7, "The cat sat.\nIt slept"), (3, None), (5, ""), (11, "x" * 5000 + " é" * 700), (4, "again"), (None, "first")]
    got = tf.token_index(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, shard int"), tokenizer_path()).collect()
    want, start = {}, 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert tf.token_index(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
