"""Keys under which strings meet that contain each other or lie few edits apart, so that fuzzy look-ups are equi-joins.

Containment goes by the asked string's rarest run of three characters. Closeness goes by deletion neighbourhoods: two strings within k edits
have a common string after at most k deletions in each. Strings longer than ``SHORT``, whose neighbourhoods would grow with the square of their
length, go by pieces: of k + 1 pieces of the asked string one stands unedited in the other, at most k characters off its place.
Keys only propose; every proposal is compared with the strings themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators.tables import small, written

SHORT = 20
GRAM = 3
#: Edits allowed by the length of the asked string: (edits, least length, most).
WORD_BANDS = ((1, 4, 6), (2, 7, None))
NAME_BANDS = ((1, 5, 9), (2, 10, None))
Bands = tuple[tuple[int, int, int | None], ...]


def deletions(word: Column, edits: int) -> Column:
    """The word and what is left of it after one (or up to two) deletions; it must have more letters than edits."""
    n = F.length(word)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    if edits == 1:
        return F.concat(F.array(word), one)
    two = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, j - i), F.substr(word, j + 2))))
    return F.concat(F.array(word), one, F.flatten(two))


def _piece(word: Column, size: Column, k: int, edits: int, off: int) -> Column:
    """The key of piece k of an asked string of ``size`` letters, read from ``word`` at ``off`` letters from its place."""
    step = F.floor(size / (edits + 1)).cast("int")
    length = size - edits * step if k == edits else step
    return F.concat_ws(":", F.lit(f"p{edits}{k}"), size.cast("string"), F.substr(word, F.greatest(F.lit(1), k * step + off + 1), length))


def tagged(tag: str, words: Column) -> Column:
    return F.transform(words, lambda x: F.concat(F.lit(f"{tag}:"), x))


def _if(condition: Column, keys: Column) -> Column:
    return F.when(condition, keys).otherwise(F.array().cast("array<string>"))


def asked_keys(word: Column, bands: Bands) -> Column:
    """Keys of an asked string; none if its length is in no band."""
    n, parts = F.length(word), []
    for edits, least, most in bands:
        inside = (n >= least) & (n <= most if most else F.lit(True))
        parts.append(_if(inside & (n <= SHORT), tagged(f"d{edits}", deletions(word, edits))))
        if not most or most > SHORT:
            parts.append(_if(inside & (n > SHORT), F.array(*[_piece(word, n, k, edits, 0) for k in range(edits + 1)])))
    return F.array_distinct(F.concat(*parts))


def held_keys(word: Column, bands: Bands) -> Column:
    """Keys of a string that may lie within the allowed edits of an asked one."""
    n, parts = F.length(word), []
    for edits, least, most in bands:
        inside = (n >= max(least - edits, edits + 1)) & (n <= most + edits if most else F.lit(True))
        parts.append(_if(inside & (n <= SHORT + edits), tagged(f"d{edits}", deletions(word, edits))))
        if not most or most > SHORT:
            pieces = [_piece(word, n + more, k, edits, off) for more in range(-edits, edits + 1) for k in range(edits + 1) for off in range(-edits, edits + 1)]
            parts.append(_if(inside & (n > SHORT - edits), F.array(*pieces)))
    return F.array_distinct(F.concat(*parts))


def grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - GRAM + 1)), lambda i: F.substr(word, i, F.lit(GRAM))))


def matching_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(tok, word, points) for the asked tokens (tok) and the distinct words (word) that score for them: 2 if the word contains the
    token, 1 if it lies within the token's edits."""
    asked = small(asked.select("tok").distinct())
    runs = asked.select("tok", F.explode(grams(F.col("tok"))).alias("gram"))
    held = words.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    counts = held.join(small(runs.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = runs.join(counts, "gram", "left").groupBy("tok").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    contain = held.join(small(rarest), "gram").where(F.contains("word", F.col("tok"))).select("tok", "word", F.lit(2).alias("points"))
    near = words.select("word", F.explode(held_keys(F.col("word"), WORD_BANDS)).alias("key")).join(small(asked.select("tok", F.explode(asked_keys(F.col("tok"), WORD_BANDS)).alias("key"))), "key")
    near = near.where(F.levenshtein("tok", "word") <= tx.edit_allowance(F.col("tok"))).select("tok", "word", F.lit(1).alias("points"))
    return contain.unionByName(near).groupBy("tok", "word").agg(F.max("points").alias("points"))


def words_of(candidates: DataFrame, text: Column) -> DataFrame:
    """The dictionary of a table of candidates: its distinct words (word), written."""
    return written(candidates.select(F.explode(tx.tokens(text)).alias("word")).distinct())
