"""Quality rules and n-gram perplexity.

Base rules count words, symbols, repeated lines and repeated eight-word windows of each text. The language model is an
interpolated modified Kneser-Ney model over the bytes of a text in their order, across words (``ORDER`` bytes; runs of white
space are one space, digits are one digit). Spark counts the n-grams of all well-formed texts by language and fold; what
it gathers grows with the input. Well-formed texts have 20 words and at most one mark of ASCII punctuation for two words,
so text out of symbols or menus doesn't teach the model. The model is kept as sorted key arrays. A text is scored by the
model of the other fold; the fold follows the least word hash, so copies and most edited copies share it and can't vouch
for each other.

Each language has its own band about the median m of its well-formed texts. With S the robust deviation of
|x - m| / sqrt(1 + SPREAD / bytes), a text of n bytes may lie ``BELOW`` * S under and ``ABOVE`` * S over m, times
sqrt(1 + SPREAD / n), as short texts vary more. Texts outside go.

A clean text with passages in a second language lies over this band, among menus and lists of its own language. So texts
between ``ABOVE`` and ``MIXED`` are judged again: each stretch of ``STRETCH`` signs counts by the language that fits it best, and a
text that then lies in the band of its own language stays. It costs one more scoring by every language of the texts between
the two limits.

Models go to the executors in blocks of about ``MODEL_ROWS`` n-grams, cut by the two bytes before the predicted one, so a
position needs one block only; each block takes a pass over the texts and adds its part of the log probability.

Defined cases: a null or blank text has no words, so it fails the base rules and has no perplexity; a null language is
the language "" ; a text whose language has no well-formed text in the other fold has nothing to be judged by and keeps
the verdict of the base rules; ties and repeated rows are each returned; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import _text as tx
from quillgraph.llm._shared import content_key, released, small, trimmed, without, written

ORDER = 5
#: Width of the band in robust deviations, and the length in bytes at which chance within a text weighs as much as the
#: differences between texts.
BELOW, ABOVE, SPREAD = 15.0, 8.0, 2000.0
#: Up to how many robust deviations a text may be one of several languages, and the signs of a stretch that has one language.
MIXED, STRETCH = 30.0, 32
#: The least robust deviation, in nats a byte; it matters only for languages whose texts are nearly all alike.
LEAST_DEVIATION = 0.01
MODEL_ROWS = 2_000_000
#: The bands of at most this many languages are broadcast; more are joined by a shuffle.
LANGUAGES = 10_000
#: Perplexity histogram cells per nat.
CELLS = 1000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[tx.ALNUM] = False
#: What a byte counts as in the model.
_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[~tx.NOT_SPACE] = 0x20
_SIGN[0x30:0x3A] = 0x30
#: Counted n-grams that a worker holds before it hands them on, and cells of a model's cache.
_HELD, _CACHE = 1 << 19, 1 << 17


def _repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: has it an equal one in its group; has it an earlier equal one."""
    key = tx.mix(value + group.astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return any_, earlier


def base_counts(texts: pa.Array) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = np.zeros((len(texts), 5), np.int64)
    for first, last, data, offsets in tx.pieces(texts):
        if not len(data):
            continue
        start, end, before = tx.words_of(data, offsets, tx.NOT_SPACE)
        prefix = tx.prefix_hash(data)
        out[first:last, 0] = np.diff(before)
        for k, mask in ((1, tx.NOT_SPACE[data] & ((data & 0xC0) != 0x80)), (2, _SYMBOL[data])):
            out[first:last, k] = np.diff(np.r_[0, np.cumsum(mask)][offsets])
        breaks = np.flatnonzero(data == 10)
        l0 = np.sort(np.concatenate([breaks + 1, offsets[:-1]]), kind="stable")
        l1 = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        doc = np.searchsorted(offsets, l1, side="left") - 1
        worded = np.searchsorted(start, l1) > np.searchsorted(start, l0)
        l0, l1, doc = l0[worded], l1[worded], doc[worded]
        if len(l0):
            _, earlier = _repeated(doc, tx.span_hash(prefix, l0, l1))
            out[first:last, 3] = np.bincount(doc[earlier], minlength=last - first)
        grams = tx.windows(tx.span_hash(prefix, start, end), 8)
        doc = np.repeat(np.arange(last - first), np.diff(before))
        valid = np.flatnonzero(doc[: len(grams)] == doc[7 : 7 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
        if len(valid):
            twice = valid[_repeated(doc[valid], grams[valid])[0]]
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 8, -1)
            out[first:last, 4] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=last - first)
    return out


def _traits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fold (0 or 1) of each text, and whether it is well-formed."""
    fold, formed = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for first, last, data, offsets in tx.pieces(texts):
        if not len(data):
            continue
        start, end, before = tx.words_of(data, offsets, tx.NOT_SPACE)
        n = np.diff(before)
        marks = np.diff(np.r_[0, np.cumsum(_MARK[data])][offsets])
        formed[first:last] = (n >= 20) & (2 * marks <= n)
        some = np.flatnonzero(n)
        if len(some):
            least = np.minimum.reduceat(tx.mix(tx.span_hash(tx.prefix_hash(data), start, end)), before[:-1][some])
            fold[first + some] = (least >> tx.U64(7)).astype(np.int64) & 1
    return fold, formed


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each sign of each text, packed with the last sign lowest, and the number of signs before each text.

    Before the first sign of a text there are spaces, and after the last one there is one.
    """
    space = ~tx.NOT_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begin = offsets[:-1][offsets[:-1] < len(data)]
    keep[begin] = ~space[begin]
    # each text starts after ORDER - 1 spaces and ends in one, which is that of its own or the first of the next text's
    at = np.cumsum(keep) - 1
    texts = len(offsets) - 1
    size = np.diff(np.r_[0, np.cumsum(keep)][offsets])
    shift = np.repeat(np.arange(1, texts + 1) * (ORDER - 1), np.diff(offsets))
    signs = np.full(int(size.sum()) + (texts + 1) * (ORDER - 1), 0x20, np.uint8)
    signs[(at + shift)[keep]] = _SIGN[data[keep]]
    packed = signs.astype(tx.U64)
    have = 1
    while have < ORDER:
        step = min(have, ORDER - have)
        more = packed.copy()
        more[step:] = packed[step:] | (packed[:-step] & tx.U64((1 << 8 * have) - 1)) << tx.U64(8 * step)
        packed, have = more, have + step
    packed &= tx.U64((1 << 8 * ORDER) - 1)
    stop = np.cumsum(size) + np.arange(1, texts + 1) * (ORDER - 1)
    last = signs[stop - 1] != 0x20  # texts that don't end in white space get their last space
    length = np.where(size > 0, size + last, 0)
    where = tx.positions(stop - size, length)
    return packed[where], np.r_[0, np.cumsum(length)]


def _grouped(b: pa.RecordBatch, lang: int, text: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The languages of a batch, and for each row the number of its language * 2 + its fold, whether it is well-formed, and
    the rows in the order of these numbers."""
    fold, formed = _traits(b.column(text))
    coded = b.column(lang).fill_null("").dictionary_encode()
    group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + fold
    return coded.dictionary.to_pylist(), group, formed, np.argsort(group, kind="stable")


def _counted(batches):
    """(lang, fold, gram, n) of the well-formed texts; equal n-grams are summed before they are handed on."""
    held: dict[tuple[str, int], list] = {}
    size = 0

    def emit():
        for (lang, fold), parts in held.items():
            keys, n = _summed(parts)
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(k)), pa.repeat(pa.scalar(fold, pa.int32()), len(k)), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["lang", "fold", "gram", "n"])
        held.clear()

    with np.errstate(over="ignore"):
        for b in batches:
            names, group, formed, order = _grouped(b, 0, 1)
            order = order[formed[order]]
            for g in np.unique(group[order]):
                texts = b.column(1).take(pa.array(order[group[order] == g]))
                parts = held.setdefault((names[g // 2], int(g % 2)), [])
                for _, _, data, offsets in tx.pieces(texts):
                    keys, n = np.unique(_grams(data, offsets)[0], return_counts=True)
                    parts.append((keys, n.astype(np.int64)))
                    size += len(keys)
                    if size > _HELD:
                        for key, some in held.items():
                            held[key] = [_summed(some)] if some else []
                        parts = held[names[g // 2], int(g % 2)]
                        size = sum(len(k) for some in held.values() for k, _ in some)
                        if 2 * size > _HELD:
                            yield from emit()
                            parts, size = held.setdefault((names[g // 2], int(g % 2)), []), 0
        yield from emit()


def _summed(parts):
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, tx.U64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    n = np.concatenate([c for _, c in parts])[order] if parts else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, fold, gram, n): n-grams of ORDER signs over all well-formed texts."""
    part = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text")).mapInArrow(trimmed(_counted), "lang string, fold int, gram long, n long")
    return part.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def _middle(gram: Column) -> Column:
    return F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF))


def _block(middle, blocks: int):
    """The block of the n-grams with these two signs before the last one; the same for columns and arrays."""
    return middle * 40503 % 65536 % blocks


def low_counts(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, fold, k, n1, n2, n3, n4): how many n-grams of order k (3 and more) have count 1 to 4, and (lang, fold, gram, n) of order 2.

    Below ORDER, the count of an n-gram is that of its distinct left neighbours. All n-grams with the same two signs
    before the last are in one partition, which holds for every order, so there is one shuffle.
    """
    at = counts.withColumn("middle", _middle(F.col("gram"))).repartition("lang", "fold", "middle")
    times = lambda k: at.groupBy("lang", "fold").agg(F.lit(k).alias("k"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    found = []
    for k in range(ORDER, 2, -1):
        found.append(times(k))
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
        keys = ["lang", "fold", "middle"] if k > 3 else ["lang", "fold"]
        at = at.groupBy(*keys, shorter.alias("gram")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, found), at


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return np.array([0.0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] else 0.5 * i for i in (1, 2, 3))])


class Model:
    """Interpolated modified Kneser-Ney probabilities: for each order the sorted n-grams with their share and the sorted
    contexts with what they leave to the next lower order. ``gram`` may be one block; orders 1 and 2 are always whole."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, times: dict[int, list[int]], pairs: tuple[np.ndarray, np.ndarray]):
        self.levels = []
        sort = np.argsort(gram)
        keys, counts = gram[sort], count[sort]
        for k in range(ORDER, 2, -1):
            self._add(k, keys, counts, discounts(times.get(k, [0, 0, 0, 0])))
            keys, counts = np.unique(keys & tx.U64((1 << 8 * (k - 1)) - 1), return_counts=True)
        keys, counts = pairs
        for k in (2, 1):
            self._add(k, keys, counts, discounts([int((counts == i).sum()) for i in (1, 2, 3, 4)]))
            keys, counts = np.unique(keys & tx.U64(0xFF), return_counts=True)
        self.levels.reverse()
        self.cached, self.value = np.full(_CACHE, np.iinfo(np.uint64).max, tx.U64), np.zeros(_CACHE)

    def _add(self, k, keys, counts, off):
        less = off[np.minimum(counts, 3)]
        context, inverse = np.unique(keys >> tx.U64(8), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(context))
        share = (counts - less) / np.maximum(total[inverse], 1e-9)
        rest = np.bincount(inverse, weights=less, minlength=len(context)) / np.maximum(total, 1e-9)
        self.levels.append((k, keys, share.astype(np.float32), context, rest.astype(np.float32)))

    def probability(self, gram: np.ndarray) -> np.ndarray:
        p = np.full(len(gram), 1 / 256)
        for k, keys, share, context, rest in self.levels:
            if not len(keys):
                continue
            g = gram & tx.U64((1 << 8 * k) - 1)
            c = np.minimum(np.searchsorted(context, g >> tx.U64(8)), len(context) - 1)
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            own = np.where(keys[i] == g, share[i], 0.0)
            p = np.where(context[c] == g >> tx.U64(8), own + rest[c] * p, p)
        return p

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """Log probabilities; those of frequent n-grams are cached."""
        slot = (gram * tx.U64(0x9E3779B97F4A7C15) >> tx.U64(64 - _CACHE.bit_length() + 1)).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero(self.cached[slot] != gram)
        if len(miss):
            keys, inverse = np.unique(gram[miss], return_inverse=True)
            logs = np.log(self.probability(keys))
            out[miss] = logs[inverse]
            at = (keys * tx.U64(0x9E3779B97F4A7C15) >> tx.U64(64 - _CACHE.bit_length() + 1)).astype(np.int64)
            self.cached[at], self.value[at] = keys, logs  # of two in one slot the later stays, in both arrays
        return out


def _scored(models: dict[tuple[str, int], Model], block: int, blocks: int):
    """Base counts (with the first block), number of signs and this block's part of the log probability of each text."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                names, group, formed, order = _grouped(b, 1, 2)
                total, signs = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
                for g in np.unique(group):
                    model = models.get((names[g // 2], 1 - int(g % 2)))
                    rows = order[group[order] == g]
                    if model is None:
                        continue
                    for first, last, data, offsets in tx.pieces(b.column(2).take(pa.array(rows))):
                        gram, before = _grams(data, offsets)
                        if blocks > 1:
                            logs = np.zeros(len(gram))
                            here = np.flatnonzero(_block((gram >> tx.U64(8)).astype(np.int64) & 0xFFFF, blocks) == block)
                            logs[here] = model.logs(gram[here])
                        else:
                            logs = model.logs(gram)
                        size = np.diff(before)
                        some = np.flatnonzero(size)
                        if len(some):  # each text is summed on its own, so its batch doesn't matter
                            total[rows[first + some]] = np.add.reduceat(logs, before[:-1][some])
                        signs[rows[first:last]] = size
                part = [pa.array(-total), pa.array(signs)]
                if block:
                    yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), *part], names=["key1", "key2", "loss", "signs"])
                else:
                    counts = base_counts(b.column(2))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), *(pa.array(counts[:, k]) for k in range(5)), pa.array(formed), *part], names=_NAMES)

    return run


_PART = "key1 long, key2 long, loss double, signs long"
_NAMES = ["doc_id", "lang", "key1", "key2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "formed", "loss", "signs"]
_OUT = "doc_id long, lang string, key1 long, key2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, formed boolean, loss double, signs long"


def _models(counts: DataFrame, low, block: int, blocks: int) -> dict[tuple[str, int], Model]:
    times, pairs = low
    here = counts if blocks == 1 else counts.where(_block(_middle(F.col("gram")), blocks) == block)
    table = here.toArrow()
    models = {}
    with np.errstate(over="ignore"):
        coded = table["lang"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + table["fold"].to_numpy()
        gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
        known = {x: k for k, x in enumerate(coded.dictionary.to_pylist())}
        for lang, fold in pairs:
            mine = code == known[lang] * 2 + fold if lang in known else np.zeros(len(code), bool)
            models[lang, fold] = Model(gram[mine], n[mine], times[lang, fold], pairs[lang, fold])
    return models


def _stretched(models: dict[tuple[str, int], Model], names: list[str], block: int, blocks: int):
    """(key1, key2, parts): this block's part of the loss of each stretch of a text, by each of the languages in turn."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                fold, _ = _traits(b.column(2))
                parts: list = [None] * b.num_rows
                for f in (0, 1):
                    rows = np.flatnonzero(fold == f)
                    for first, last, data, offsets in tx.pieces(b.column(2).take(pa.array(rows))):
                        gram, before = _grams(data, offsets)
                        count = -(-np.diff(before) // STRETCH)
                        at = tx.positions(np.zeros(len(count), np.int64), count) * STRETCH + np.repeat(before[:-1], count)
                        loss = np.full((len(at), len(names)), np.inf)
                        here = np.arange(len(gram)) if blocks == 1 else np.flatnonzero(_block((gram >> tx.U64(8)).astype(np.int64) & 0xFFFF, blocks) == block)
                        for k, name in enumerate(names):
                            model = models.get((name, 1 - f))
                            if model is not None and len(at):
                                logs = np.zeros(len(gram))
                                logs[here] = model.logs(gram[here])
                                loss[:, k] = -np.add.reduceat(logs, at)
                        for row, some in zip(rows[first:last], np.split(loss, np.cumsum(count)[:-1]), strict=True):
                            parts[row] = some.ravel()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.float64()))], names=["key1", "key2", "parts"])

    return run


def _low(counts: DataFrame):
    """Counts of counts by (lang, fold) and order, and the pairs by (lang, fold): at most 65,536 for each, whatever the input."""
    times, pairs = low_counts(counts)
    found: dict[tuple[str, int], dict[int, list[int]]] = {}
    for r in times.collect():
        found.setdefault((r["lang"], r["fold"]), {})[r["k"]] = [r[f"n{i}"] for i in (1, 2, 3, 4)]
    held: dict[tuple[str, int], list] = {}
    for r in pairs.orderBy("lang", "fold", "gram").collect():
        held.setdefault((r["lang"], r["fold"]), []).append((r["gram"], r["n"]))
    return found, {k: tuple(np.array(x, t) for x, t in zip(zip(*v, strict=True), (np.uint64, np.int64), strict=True)) for k, v in held.items()}


def _taught(docs: DataFrame):
    """The rows to judge, their n-grams, how many blocks these make, and what all blocks share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), *content_key("lang", "text"))
    counts = written(gram_counts(rows))
    return rows, counts, max(1, -(-counts.count() // MODEL_ROWS)), _low(counts)


def _pass(rows: DataFrame, taught, block: int, judge, schema: str) -> DataFrame:
    """What ``judge`` makes of the rows with the models of one block, written."""
    _, counts, blocks, low = taught
    held = rows.sparkSession.sparkContext.broadcast(_models(counts, low, block, blocks))
    made = written(rows.mapInArrow(lambda batches: released(judge(held.value)(batches)), schema))
    held.destroy()
    return made


def scores(docs: DataFrame) -> DataFrame:
    """Base counts, log perplexity per byte (null without a model) and the number of signs it rests on, of every row."""
    return _scores(_taught(docs))


def _scores(taught) -> DataFrame:
    rows, _, blocks, _ = taught
    whole, parts = None, []
    for block in range(blocks):
        made = _pass(rows, taught, block, lambda models, block=block: _scored(models, block, blocks), _PART if block else _OUT)
        if block:
            parts.append(made)
        else:
            whole = made
    if parts:
        more = reduce(DataFrame.unionByName, [p.dropDuplicates(["key1", "key2"]) for p in parts]).groupBy("key1", "key2").agg(F.sum("loss").alias("more"))
        whole = whole.join(more, ["key1", "key2"], "left").withColumn("loss", F.col("loss") + F.coalesce("more", F.lit(0.0))).drop("more")
    return whole.withColumn("log_ppl", F.try_divide("loss", "signs")).drop("loss")


def _reach() -> Column:
    """How much more a text of its length varies than a very long one."""
    return F.sqrt(1 + SPREAD / F.greatest("signs", F.lit(1)))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, middle, deviation) of log perplexity by language, from exact histograms of its distinct well-formed texts that pass the base rules."""
    fine = scored.where("log_ppl is not null and formed and not base_failed").select(F.coalesce("lang", F.lit("")).alias("lang"), "key1", "key2", "log_ppl", "signs").distinct()

    def median(df: DataFrame, value: Column) -> DataFrame:
        cells = df.groupBy("lang", F.floor(value * CELLS).alias("cell")).agg(F.count("*").alias("n"))
        rows = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(F.col("cell").alias("x"), "n"))).alias("c"), F.sum("n").alias("all"))
        run = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("x")), lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), F.when(a["x"].isNull() & (2 * (a["n"] + e["n"]) >= F.col("all")), e["x"].cast("double")).otherwise(a["x"]).alias("x")))
        return rows.select("lang", ((run["x"] + 0.5) / CELLS).alias("m"))

    middle = small(median(fine, F.col("log_ppl")), LANGUAGES)
    apart = median(fine.join(middle, "lang"), F.abs(F.col("log_ppl") - F.col("m")) / _reach()).withColumnRenamed("m", "d")
    return middle.join(apart, "lang").select("lang", F.col("m").alias("middle"), F.greatest(1.4826 * F.col("d"), F.lit(LEAST_DEVIATION)).alias("deviation"))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ppl, kept) of every row."""
    return _verdicts(docs).drop("key1", "key2")


def _cleared(taught, suspect: DataFrame) -> DataFrame:
    """The keys of the suspect texts (key1, key2, signs, most) whose loss is at most ``most`` a sign where each stretch has the
    language that fits it best."""
    rows, _, blocks, low = taught
    names = sorted({lang for lang, _ in low[1]})
    texts = rows.select("key1", "key2", "text").join(small(suspect.select("key1", "key2")), ["key1", "key2"], "left_semi")
    parts = [_pass(texts, taught, block, lambda models, block=block: _stretched(models, names, block, blocks), "key1 long, key2 long, parts array<double>").dropDuplicates(["key1", "key2"]) for block in range(blocks)]
    summed = lambda held: F.aggregate(F.slice(held, 2, blocks), held[0], lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    whole = reduce(DataFrame.unionByName, parts).groupBy("key1", "key2").agg(F.collect_list("parts").alias("parts")).withColumn("parts", summed(F.col("parts")))
    stretches = F.transform(F.sequence(F.lit(1), F.size("parts"), F.lit(len(names))), lambda i: F.array_min(F.slice("parts", i, len(names))))
    loss = whole.select("key1", "key2", F.aggregate(stretches, F.lit(0.0).cast("double"), lambda a, x: a + x).alias("loss"))
    return loss.join(suspect, ["key1", "key2"]).where("loss <= most * signs").select("key1", "key2")


def _verdicts(docs: DataFrame) -> DataFrame:
    """The rows of ``judged`` with the key of their language and text, which alone decide."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    taught = _taught(docs)
    scored = _scores(taught).withColumn("base_failed", failed)
    limits = small(bands(scored).withColumnRenamed("lang", "_lang"), LANGUAGES)
    out = scored.join(limits, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    room = F.col("deviation") * _reach()
    most = F.col("middle") + ABOVE * room
    inside = F.coalesce(F.col("log_ppl").between(F.col("middle") - BELOW * room, most), F.lit(True))
    suspect = out.where(~F.col("base_failed") & (F.col("log_ppl") > most) & (F.col("log_ppl") <= F.col("middle") + MIXED * room))
    suspect = written(suspect.select("key1", "key2", "signs", most.alias("most")).dropDuplicates(["key1", "key2"]))
    if suspect.isEmpty():
        out = out.withColumn("kept", ~F.col("base_failed") & inside)
    else:
        cleared = small(_cleared(taught, suspect).withColumn("mixed", F.lit(True)))
        out = out.join(cleared, ["key1", "key2"], "left").withColumn("kept", ~F.col("base_failed") & (inside | F.coalesce("mixed", F.lit(False))))
    return out.select("doc_id", "key1", "key2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "kept")


def good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; ids, shared or missing, play no part."""
    return without(docs, _verdicts(docs).where("not kept"), "lang", "text")
