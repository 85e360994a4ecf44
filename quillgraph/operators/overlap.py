"""Fingerprints by which a text is found inside longer ones.

The hashes of all runs of ``GRAM`` bytes are cut down to the least of every ``WINDOW`` in a row. A text of at least ``GRAM`` + ``WINDOW`` - 1
bytes is anchored by its least hash, which is the least of some window of any text around it, and so among that text's fingerprints.
Shorter texts are anchored by their first 1, 2, 4, 8 or 16 bytes, and the texts around them also list their runs of those sizes. Anchors only
propose; who uses them compares the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

GRAM, WINDOW = 8, 16


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes, a power of two up to 16; runs are joined from halves."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    x, have = data.astype(np.uint64), 1
    while have < min(size, 8):
        x = x[:-have] | x[have:] << np.uint64(8 * have)
        have *= 2
    if size == 16:
        x = _mixed(x[:-8]) ^ x[8:]
    return _mixed(x ^ np.uint64(size)) >> np.uint64(1)  # below 2**63


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _least_of_windows(h: np.ndarray) -> np.ndarray:
    width = 1
    while width < WINDOW and len(h) > width:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h


def _anchor(data: np.ndarray) -> tuple[int, int]:
    """(mark, size): the anchor of a text and, of a short one, the length of the run it comes from."""
    if len(data) >= GRAM + WINDOW - 1:
        return int(_hashes(data, GRAM).min()), 0
    size = 1 << (min(len(data), 16).bit_length() - 1)
    return int(_hashes(data[:size], size)[0]) ^ size, size


def _marks(data: np.ndarray, sizes: list[int]) -> np.ndarray:
    parts = [_least_of_windows(_hashes(data, GRAM))] if len(data) >= GRAM + WINDOW - 1 else []
    parts += [_hashes(data, s) ^ np.uint64(s) for s in sizes if len(data) >= s]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _bytes(value: pa.Scalar) -> np.ndarray:
    raw = value.as_buffer()
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def anchors(rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``rows`` but for ``text``, with mark and size; rows without text are left out."""
    kept, at = [c for c in rows.columns if c != text], rows.columns.index(text)

    def run(batches):
        for b in batches:
            found = [(i, *_anchor(d)) for i, d in ((i, _bytes(v)) for i, v in enumerate(b.column(at))) if len(d)]
            i, mark, size = zip(*found, strict=True) if found else ((), (), ())
            take = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).take(take) for c in kept], pa.array(mark, pa.int64()), pa.array(size, pa.int32())], names=[*kept, "mark", "size"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("mark", T.LongType()), T.StructField("size", T.IntegerType())]))


class _Wanted:
    """Marks that are looked for: a table over some of their bits lets nearly all others fall before they are compared."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.unique(marks.astype(np.uint64))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.marks)] = True

    @staticmethod
    def _slot(marks: np.ndarray) -> np.ndarray:
        return (marks & np.uint64((1 << 22) - 1)).astype(np.int64)

    def places(self, marks: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(self.bits[self._slot(marks)])
        at = np.minimum(np.searchsorted(self.marks, marks[some]), len(self.marks) - 1)
        return some[self.marks[at] == marks[some]]


def _found(data: np.ndarray, offsets: np.ndarray, sizes: list[int], wanted: _Wanted) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, mark) of the wanted marks of several texts that lie one behind the other, each once a text."""
    texts, marks = [], []
    for size in [0, *sizes]:
        if size:
            length, h = size, _hashes(data, size) ^ np.uint64(size)
        else:
            length, h = GRAM + WINDOW - 1, _hashes(data, GRAM)
            if len(h) < WINDOW:
                continue
            h = _least_of_windows(h)
        at = wanted.places(h)
        text = np.searchsorted(offsets, at, side="right") - 1
        whole = at + length <= offsets[text + 1]  # not over the end of its text
        texts.append(text[whole])
        marks.append(h[at[whole]])
    text, mark = np.concatenate(texts or [np.zeros(0, np.int64)]), np.concatenate(marks or [np.zeros(0, np.uint64)])
    order = np.lexsort((mark, text))
    text, mark = text[order], mark[order]
    first = np.r_[True, (text[1:] != text[:-1]) | (mark[1:] != mark[:-1])] if len(text) else np.zeros(0, bool)
    return text[first], mark[first]


#: Bytes of text that are hashed together.
TOGETHER = 1 << 19


def _matched(b: pa.RecordBatch, at: int, kept: list[str], sizes: list[int], wanted: _Wanted):
    column = b.column(at).cast(pa.large_binary())
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
    starts, lo = np.r_[0, ends], 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + TOGETHER)))
        hi = min(hi, b.num_rows)
        raw = b"".join(x for x in column.slice(lo, hi - lo).to_pylist() if x)
        text, mark = _found(np.frombuffer(raw, np.uint8), starts[lo : hi + 1] - starts[lo], sizes, wanted)
        if len(text):
            row = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).take(row) for c in kept], pa.array(mark.astype(np.int64))], names=[*kept, "mark"])
        lo = hi


def fingerprints(rows: DataFrame, text: str, sizes: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """The columns of ``rows`` but for ``text``, with each mark of the text; ``sizes``: the short runs that anchors come from.

    Of ``wanted`` marks, where they are given, all that a text has are returned, and no others.
    """
    kept, at = [c for c in rows.columns if c != text], rows.columns.index(text)
    look = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        if look is not None:
            if len(look.value):
                known = _Wanted(look.value)
                for b in batches:
                    yield from _matched(b, at, kept, sizes, known)
            return
        for b in batches:
            for i, value in enumerate(b.column(at)):
                marks = _marks(_bytes(value), sizes)
                if len(marks):
                    row = pa.array(np.full(len(marks), i, np.int64))
                    yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).take(row) for c in kept], pa.array(marks.astype(np.int64))], names=[*kept, "mark"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("mark", T.LongType())]))
