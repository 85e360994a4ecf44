"""Secret scan: fixed patterns plus a randomness test battery.

Three kinds are found by pattern (``assign``, ``access``, ``hex``). Other runs of key characters of ``LEAST`` or more (the
least length of an assigned key) get an inferred encoding and three tests against uniform random symbols: chi-squared uniformity over the alphabet, runs
about the middle symbol, and lag-one serial correlation. Fisher's method combines them. Truly random strings have
uniform combined p-values, ordinary identifiers pile up near zero; so, for each encoding and length band, the p-values
of all distinct strings give the number of random strings and the false discoveries above any cut. The smallest cut whose
share of false discoveries is at most ``RATE`` holds for that band, by the same rule for any number of strings (short bands,
where the tests are weak, need high cuts or find nothing). A band is trusted only if its p-values are flat in the upper half:
where they fall there by more than two standard errors, the tests don't part words from random strings, and nothing of it is
reported. No string of key characters is left out before the tests, be it letters or digits alone. Only the histogram, of fixed size, reaches the driver.

Defined cases: a null text is empty and has no spans; repeated rows are each returned; positions are code points; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import written

LEAST = 8
RATE = 0.02
#: Combined p-values below this are never random strings; it is the share of true secrets given up.
FLOOR = 0.005
CELLS = 100
BANDS = (12, 16, 20, 24, 32, 48, 96)
#: Tested strings that are held to test equal ones once.
HELD = 200_000
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
#: Encodings in the order in which they are tried: the first whose alphabet holds every symbol.
ALPHABETS = (
    ("digits", _DIGITS),
    ("lower", _LETTERS.lower()),
    ("upper", _LETTERS),
    ("letters", _LETTERS + _LETTERS.lower()),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _LETTERS + "234567"),
    ("base36", _DIGITS + _LETTERS.lower()),
    ("BASE36", _DIGITS + _LETTERS),
    ("base62", _LETTERS + _LETTERS.lower() + _DIGITS),
    ("base64", _LETTERS + _LETTERS.lower() + _DIGITS + "+/"),
    ("base64url", _LETTERS + _LETTERS.lower() + _DIGITS + "-_"),
)
_INDEX = [({c: i for i, c in enumerate(a)}, len(a)) for _, a in ALPHABETS]
_SETS = [frozenset(a) for _, a in ALPHABETS]


def encoding(token: str) -> int | None:
    """The number of the inferred encoding; none for strings that mix the signs of two encodings."""
    symbols = set(token)
    return next((k for k, a in enumerate(_SETS) if symbols <= a), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, kind: int) -> float:
    """Combined p-value of the three tests; uniform on (0, 1), nearly, for uniform random symbols."""
    index, size = _INDEX[kind]
    x = np.fromiter((index[c] for c in token), np.int64, len(token))
    n = len(x)
    expected = n / size
    chi = float(((np.bincount(x, minlength=size) - expected) ** 2 / expected).sum())
    df = size - 1
    spread = 2 * df * (n - 1) / n
    shape = 2 * df / spread  # matches mean and variance of the exact statistic by a scaled chi-squared
    p_chi = _upper(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df * shape))) / math.sqrt(2 / (9 * df * shape)))
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    p_serial = 2 * _upper(abs(float((d[1:] * d[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 2.0 ** (1 - n)
    s = -sum(math.log(min(1.0, max(p, 1e-300))) for p in (p_chi, p_runs, p_serial))
    return math.exp(-s) * (1 + s + s * s / 2)


def band(length: int) -> int:
    return sum(length >= b for b in BANDS)


def _id(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def tested(token: str) -> tuple[int, int, int] | None:
    """(encoding * 8 + band, histogram cell of p, id) of a string; none if it has no encoding or p is under FLOOR."""
    kind = encoding(token)
    p = 0.0 if kind is None else battery(token, kind)
    return (kind * 8 + band(len(token)), min(int(p * CELLS), CELLS - 1), _id(token)) if p >= FLOOR else None


def spans(text: str, run: bool, known: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Base spans (kind, start, end) and candidates (encoding * 8 + band, start, end, p cell, id) that touch none of them."""
    base = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        base += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        base += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    more = []
    if run:
        base += [(2, *m.span()) for m in HEX.finditer(text)]
        for m in RUN.finditer(text):
            if any(s < m.end() and m.start() < e for _, s, e in base):
                continue
            token = m[0]
            if token not in known:
                if len(known) >= HELD:
                    known.clear()
                known[token] = tested(token)
            if (t := known[token]) is not None:
                more.append((t[0], *m.span(), *t[1:]))
    return sorted(base, key=lambda x: (x[1], x[0], x[2])), more


_SPAN = "array<struct<start:long,kind:int,end:long>>"
_FOUND = f"doc_id long, base {_SPAN}, more array<struct<cell:int,start:long,end:long,k:int,id:long>>"


def _found(batches):
    known: dict = {}
    for b in batches:
        base, more = [], []
        texts = b.column(1)
        for first, last, data, offsets in tx.pieces(texts):
            start, end, before = tx.words_of(data, offsets, _KEY)
            long = np.concatenate([[0], np.cumsum(end - start >= LEAST)])[before]
            raw = data.tobytes()
            for k in range(last - first):
                s, m = spans(raw[offsets[k] : offsets[k + 1]].decode(), long[k + 1] > long[k], known)
                base.append([{"start": x[1], "kind": x[0], "end": x[2]} for x in s])
                more.append([{"cell": x[0], "start": x[1], "end": x[2], "k": x[3], "id": x[4]} for x in m])
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        cell = pa.list_(pa.struct([("cell", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("k", pa.int32()), ("id", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(more, cell)], names=["doc_id", "base", "more"])


def cuts(histogram: dict[int, dict[int, int]]) -> dict[int, int]:
    """For each encoding and length band, the least p cell that counts as random; bands that can't be trusted are left out.

    ``histogram``: the distinct strings of each band by p cell; cell 0 has those of FLOOR and more.
    """
    out = {}
    for cell, counts in histogram.items():
        n = [counts.get(k, 0) for k in range(CELLS)]
        upper, top = sum(n[CELLS // 2 :]), sum(n[3 * CELLS // 4 :])
        if upper - 2 * top > 2 * math.sqrt(upper):  # falling, so words reach into the upper half
            continue
        above = sum(n)
        for k in range(CELLS):
            if k:
                above -= n[k - 1]
            false = above - 2 * upper * (1 - max(FLOOR, k / CELLS))
            if above and false <= RATE * above:
                out[cell] = k
                break
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, random): spans by pattern and by the test battery, of every row."""
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_found, _FOUND))
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    strings = found.select(F.explode("more").alias("m")).select("m.cell", "m.k", "m.id").distinct()
    for r in strings.groupBy("cell", "k").agg(F.count("*").alias("n")).collect():
        histogram[r["cell"]][r["k"]] = r["n"]
    chosen = cuts(histogram)
    if chosen:
        table = F.create_map(*[F.lit(x) for cell, cut in sorted(chosen.items()) for x in (cell, cut)])
        kept = F.filter("more", lambda m: m["k"] >= F.coalesce(table[m["cell"]], F.lit(CELLS)))
    else:
        kept = F.filter("more", lambda m: F.lit(False))
    random = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return found.select("doc_id", "base", random.alias("random"))


def _joined(spans_):
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined(F.concat("base", "random")).alias("spans"))
