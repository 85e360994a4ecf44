"""Token ids in Simple-8b files.

Texts are tokenised, an end id is appended, and the ids are packed into 64-bit words: the top four bits select how many
ids of which width share the other 60 bits; selector 15 escapes to one whole id in the next word. Each document is a run
of blocks of ``BLOCK`` ids; a segment (one row of the file) holds whole documents with the word offset of every block,
so all blocks of a segment decode together. Shards are range partitions of doc_id; segments follow each other in
ascending doc_id order. The files are written and read by Spark, so any file system serves.

Byte-level pre-tokenisation always cuts at certain places (see ``_cuts``), so the ids of a text are those of the parts
between them; each distinct part is tokenised once for each worker process, up to ``CACHE`` parts at a time.

Defined cases: a null text is empty and yields the end id alone; rows without doc_id come first; rows with equal doc_id
are ordered by text and each kept; extra columns are ignored; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import shared_dir

BLOCK = 512
#: Fixed values of the format: ids in a word and bits of each, by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
SEGMENT_BYTES = 2 << 20
CACHE = 1_000_000


_WIDTH = np.zeros(1 << 16, np.uint8)
for _bit in range(16):
    _WIDTH[1 << _bit :] = _bit + 1


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    out = _WIDTH[(ids & np.uint64(0xFFFF)).astype(np.int64)]
    for shift in (16, 32, 48):
        high = (ids >> np.uint64(shift)) & np.uint64(0xFFFF)
        if not high.any():
            continue
        out = np.where(high > 0, _WIDTH[high.astype(np.int64)] + np.uint8(shift), out)
    return out


def _choices(width: np.ndarray) -> np.ndarray:
    """The selector that packs the most ids from each place of each block (a row, zero past its end) on."""
    rows, columns = width.shape
    most = {1: width}

    def reach(k: int) -> np.ndarray:
        """The largest width among k places from each on."""
        if k not in most:
            half = k - k // 2
            part = reach(half)
            out = part.copy()
            step = k - half
            np.maximum(out[:, : columns - step], part[:, step:], out=out[:, : columns - step])
            most[k] = out
        return most[k]

    out = np.full((rows, columns), ESCAPE, np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        many, bits = SELECTORS[s]
        np.putmask(out, reach(many) <= bits, np.uint8(s))
    return out


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all blocks, words of each block, blocks of each document. Blocks end at document ends.

    A word may reach past its block's end, as if zeros followed; readers know the ids of each block.
    """
    ids = ids.astype(np.uint64)
    blocks = -(-lengths // BLOCK)
    within = tx.positions(np.zeros(len(lengths), np.int64), blocks)
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - within * BLOCK)
    rows = len(size)
    wide = BLOCK + max(m for m, _ in SELECTORS[2:])
    table = np.zeros((rows, wide), np.uint64)
    table[np.arange(wide)[None, :] < size[:, None]] = ids
    choice = _choices(_widths(table))
    flat, flat_choice = table.reshape(-1), choice.reshape(-1)
    step = np.array([m for m, _ in SELECTORS] + [1], np.int64)[flat_choice]
    base = np.arange(rows) * wide
    at, stop, lane = base.copy(), base + size, np.arange(rows)
    starts = np.full((rows, BLOCK), -1, np.int64)
    used = np.zeros(rows, np.int64)
    turn = 0
    while len(at):
        starts[lane, turn] = at
        used[lane] += 1
        at = at + step[at]
        live = at < stop
        at, stop, lane, turn = at[live], stop[live], lane[live], turn + 1
    start = starts[:, :turn].reshape(-1)
    start = start[start >= 0]
    chosen = flat_choice[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (many, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == s) if bits else ()
        if len(mine):
            value, begin = words[mine], start[mine]
            for k in range(many):
                value |= flat[begin + k] << np.uint64(bits * k)
            words[mine] = value
    raw = np.flatnonzero(chosen == ESCAPE)
    if len(raw):
        words = np.insert(words, raw + 1, flat[start[raw]])
        used = used + np.bincount(start[raw] // wide, minlength=rows)
    return words, used, blocks


def unpack(words: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of blocks of ``size`` ids in ``used`` words each."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    place = np.arange(len(words))
    if (selector == ESCAPE).any():
        # a raw id may look like any selector: walk the blocks that hold an escape, all in step
        real = np.ones(len(words), bool)
        at, stop = np.cumsum(used) - used, np.cumsum(used)
        while len(at):
            wide = selector[at] == ESCAPE
            real[at[wide] + 1] = False
            at = at + 1 + wide
            live = at < stop
            at, stop = at[live], stop[live]
        place = np.flatnonzero(real)
    chosen = selector[place]
    many = np.array([m for m, _ in SELECTORS] + [1], np.int64)[chosen]
    lane = np.searchsorted(np.cumsum(used), place, side="right")
    # the last word of a block may hold fewer
    total = np.bincount(lane, weights=many, minlength=len(used)).astype(np.int64)
    last = np.flatnonzero(np.r_[lane[1:] != lane[:-1], True]) if len(lane) else np.zeros(0, np.int64)
    many[last] -= (total - size)[lane[last]]
    out = np.zeros(int(many.sum()), np.uint64)
    begin = np.cumsum(many) - many
    for s, (most, bits) in enumerate(SELECTORS):
        if not bits:
            continue
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        mask = np.uint64((1 << bits) - 1)
        w, b, m = words[place[mine]], begin[mine], many[mine]
        for k in range(most):
            on = m > k
            if not on.any():
                break
            out[b[on] + k] = (w[on] >> np.uint64(bits * k)) & mask
    wide = np.flatnonzero(chosen == ESCAPE)
    out[begin[wide]] = words[place[wide] + 1]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes beside which nothing is cut: other control characters (some tools call them white space) and non-ASCII.
_STRANGE = np.zeros(256, bool)
_STRANGE[:9] = _STRANGE[14:32] = _STRANGE[127:] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_SLOTS = 1 << 20
#: Byte-level models write bytes that print as themselves and the others as characters from U+0100 on, in order.
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: chr(b) for b in _PRINT} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINT)}
_encoders: dict[str, Encoder] = {}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the pre-tokeniser always starts a new part, whatever else the text holds.

    These are text starts; single spaces and single line breaks between other characters; a Latin letter after such a
    line break; and ASCII punctuation other than an apostrophe after a Latin letter.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space, letter = _SPACE[data], _LETTER[data]
        # white space beyond ASCII has lead bytes C2 E1 E2 E3: a cut needs sure neighbours on both sides
        unsure = space | _STRANGE[data]
        edge = np.zeros(n, bool)
        edge[offsets[:-1][offsets[:-1] < n]] = True
        alone = np.zeros(n, bool)
        alone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:] & ~edge[1:-1] & ~edge[2:]
        lead = (data >= 0xC3) & (data <= 0xDF)
        sure_left = ~unsure | (data >= 0xC0)
        tail = (data >= 0x80) & (data < 0xC0)
        # a two-byte character with lead C3..DF is no white space
        sure_left[1:] |= tail[1:] & lead[:-1]
        sure_left &= ~(data >= 0xC0)
        sure_right = ~unsure | lead
        alone[1:-1] &= sure_left[:-2] & sure_right[2:]
        single = alone & ((data == 32) | (data == 10))
        cut[:n] |= single
        wide = np.zeros(n, bool)  # second byte of a two-byte Latin letter; C3 97 and C3 B7 are signs
        wide[1:] = tail[1:] & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins = letter.copy()
        begins[:-1] |= wide[1:]
        cut[1:n] |= (alone & (data == 10))[:-1] & begins[1:]
        cut[1:n] |= (letter | wide)[:-1] & _STOP[data[1:]]
    cut[offsets] = True
    return cut[:n]


class Encoder:
    """Ids of texts by the tokenizers library; each part that the pre-tokeniser surely cuts is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.slot_hash, self.slot_code = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.flat, self.at, self.filled = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Encode new parts; a run of letters, with or without one space before it, is one pre-token of the model."""
        ids: dict[int, np.ndarray] = {}
        rest, model = [], self.tool.model
        for i, part in enumerate(parts):
            text = part.decode()
            if text.isalpha() or text[:1] == " " and text[1:].isalpha():
                ids[i] = np.array([t.id for t in model.tokenize(part.decode("latin-1").translate(_BYTE_LEVEL))], np.int32)
            else:
                rest.append((i, text))
        if rest:
            for (i, _), e in zip(rest, self.tool.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
                ids[i] = np.array(e.ids, np.int32)
        new = [ids[i] for i in range(len(parts))]
        size = np.cumsum([len(x) for x in new])
        code, end = self.filled, int(self.at[self.filled])
        while code + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
        while end + int(size[-1]) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[end : end + int(size[-1])] = np.concatenate(new)
        self.at[code + 1 : code + 1 + len(new)] = end + size
        self.filled += len(new)
        self.known.update(zip(hashes.tolist(), range(code, self.filled), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each text)"""
        out, lengths = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        with np.errstate(over="ignore"):
            for first, last, data, offsets in tx.pieces(texts):
                if len(data):
                    ids, lengths[first:last] = self._piece(data, offsets)
                    out.append(ids)
        return np.concatenate(out), lengths

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self.clear()
        cut = _cuts(data, offsets)
        raw = data.tobytes()
        for word in self.special:  # these stay whole
            at = raw.find(word)
            while at >= 0:
                cut[at + 1 : at + len(word)] = False
                at = raw.find(word, at + 1)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(data)]
        hashes = tx.span_hash(tx.prefix_hash(data), start, end)
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        code = self.slot_code[slot]
        miss = np.flatnonzero(self.slot_hash[slot] != hashes)
        if len(miss):
            some, index, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            fresh = [k for k, h in enumerate(some.tolist()) if h not in self.known]
            if fresh:
                where = miss[index[fresh]]
                self._learn(some[fresh], [raw[s:e] for s, e in zip(start[where], end[where], strict=True)])
            codes = np.fromiter((self.known[h] for h in some.tolist()), np.int32, len(some))
            code[miss] = codes[inverse]
            at = (some & np.uint64(_SLOTS - 1)).astype(np.int64)
            # two parts of one slot: the later write wins in both arrays, as both are written in one order
            self.slot_hash[at] = some
            self.slot_code[at] = codes
        size = self.at[code + 1] - self.at[code]
        before = np.r_[0, np.cumsum(size)]
        return self.flat[tx.positions(self.at[code], size)], np.diff(before[np.searchsorted(start, offsets)])


def _segments(path: str, end_id: int):
    """One row of the file for every few megabytes of text; the shard is the number of the range partition."""

    def run(batches):
        encoder, shard, segment = Encoder.of(path), TaskContext.get().partitionId(), 0
        for b in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)).astype(np.int64))
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SEGMENT_BYTES, side="right")))
                ids, lengths = encoder(b.column(1).slice(at, stop - at))
                flat = np.full(len(ids) + stop - at, end_id, np.int64)
                flat[tx.positions(np.cumsum(lengths + 1) - lengths - 1, lengths)] = ids
                words, used, _ = pack(flat, lengths + 1)
                row = {"shard": shard, "segment": segment, "doc_ids": b.column(0).slice(at, stop - at).to_pylist(), "n_tokens": (lengths + 1).tolist(), "offsets": (np.cumsum(used) - used).astype("<u4").tobytes(), "words": words.astype("<u8").tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_SEGMENT)
                at, segment = stop, segment + 1

    return run


_SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])
_FILE = "shard int, segment int, doc_ids array<long>, n_tokens array<long>, offsets binary, words binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Tokenise every text and write the files under ``path``; only a range shuffle by doc_id comes before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(_segments(tokenizer, end_id), _FILE).write.option("compression", "none").parquet(path)


def segment_ids(n_tokens: np.ndarray, offsets: bytes, words: bytes) -> np.ndarray:
    """All ids of one segment, its blocks decoded together."""
    words = np.frombuffer(words, "<u8").astype(np.uint64)
    start = np.frombuffer(offsets, "<u4").astype(np.int64)
    used = np.diff(np.r_[start, len(words)])
    blocks = -(-n_tokens // BLOCK)
    within = tx.positions(np.zeros(len(n_tokens), np.int64), blocks)
    return unpack(words, used, np.minimum(BLOCK, np.repeat(n_tokens, blocks) - within * BLOCK))


def _read(batches):
    for b in batches:
        shard, segment, docs, counts, offsets, words = (b.column(k).to_pylist() for k in range(6))
        for k in range(b.num_rows):
            n = np.array(counts[k], np.int64)
            ids = memoryview(segment_ids(n, offsets[k], words[k]).astype("<u4").tobytes())
            end = np.cumsum(n)
            crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(end - n, end, strict=True)]
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([shard[k]] * m, pa.int32()), pa.array([segment[k]] * m, pa.int32()), pa.array(docs[k], pa.int64()), pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())], names=["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema(_FILE).parquet(path)
    # one row for every few megabytes of text
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    segments = files.select("shard", "segment", total.alias("n"))
    shards = segments.groupBy("shard").agg(F.sum("n").alias("n"))
    before_shard = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    before = segments.select("shard", "segment", (F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")).alias("before")).join(before_shard, "shard").select("shard", "segment", (F.col("before") + F.col("before_shard")).alias("before"))
    docs = files.mapInArrow(_read, "shard int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(before, ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and return what is read back from them."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return read_index(docs.sparkSession, path)
