"""Repair of almost-JSON replies: fences, prose, comments on commas, quotes and keys, truncation. Never raises."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH, CANDIDATES = 512, 32


class _End(Exception):
    pass


class _Reader:
    """A forgiving reader of one value; missing ends are closed, unreadable pieces are skipped."""

    def __init__(self, text: str, at: int):
        self.s, self.i = text, at

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def peek(self) -> str:
        self.space()
        return self.s[self.i] if self.i < len(self.s) else ""

    def value(self, depth: int):
        if depth > DEPTH:
            raise _End
        c = self.peek()
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c and c in "\"'":
            return self.string()
        return self.word()

    def object(self, depth: int) -> dict:
        out: dict = {}
        self.i += 1
        while c := self.peek():
            if c == "}":
                self.i += 1
                break
            if c == ",":
                self.i += 1
                continue
            if c == "]":
                break
            key = self.string() if c in "\"'" else self.bare()
            if self.peek() == ":":
                self.i += 1
                if self.peek() in (",", "}", ""):
                    out[key] = None
                else:
                    out[key] = self.value(depth + 1)
            elif not key:
                self.i += 1
        return out

    def array(self, depth: int) -> list:
        out: list = []
        self.i += 1
        while c := self.peek():
            if c == "]":
                self.i += 1
                break
            if c == ",":
                self.i += 1
                continue
            if c == "}":
                break
            begun = self.i
            out.append(self.value(depth + 1))
            if self.i == begun:
                self.i += 1
        return out

    def string(self) -> str:
        quote, out = self.s[self.i], []
        self.i += 1
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == quote:
                break
            if c == "\\" and self.i < len(self.s):
                e = self.s[self.i]
                self.i += 1
                if e == "u" and re.match(r"[0-9a-fA-F]{4}", self.s[self.i : self.i + 4]):
                    out.append(chr(int(self.s[self.i : self.i + 4], 16)))
                    self.i += 4
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
            else:
                out.append(c)
        return "".join(out)

    def bare(self) -> str:
        m = re.compile(r"[^\s:,{}\[\]\"']+").match(self.s, self.i)
        if not m:
            return ""
        self.i = m.end()
        return m[0]

    def word(self):
        word = self.bare()
        named = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
        if word in named:
            return named[word]
        try:
            return int(word)
        except ValueError:
            try:
                number = float(word)
                return number if math.isfinite(number) else None
            except ValueError:
                return word


def parse_object(text: str | None) -> dict | None:
    """The first object that can be read, strict JSON first; None if there is none."""
    text = re.sub(r"```[A-Za-z]*", "", text or "")
    for k, m in enumerate(re.finditer(r"\{", text)):
        if k == CANDIDATES:
            break
        try:
            found, _ = json.JSONDecoder().raw_decode(text, m.start())
            return found
        except (ValueError, RecursionError):
            pass
        try:
            found = _Reader(text, m.start()).value(1)
        except (_End, RecursionError):
            continue
        if isinstance(found, dict) and found:
            return found
    return None


def to_json(value) -> str:
    """Canonical text: lone surrogates escaped, numbers that aren't finite are null."""

    def plain(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (v := parse_object(t)) is None else to_json(v))


# -- typed reads of a parsed object ----------------------------------------------------------------------------------------


def text_of(value, key: str | None = None) -> str:
    """A value, or that under ``key``, as trimmed text; "" for what has no plain text."""
    value = value.get(key) if key is not None and isinstance(value, dict) else value
    if isinstance(value, bool):
        return str(value).lower()
    return value.strip() if isinstance(value, str) else f"{value}" if isinstance(value, int | float) else ""


def texts_of(value: dict, key: str) -> list[str]:
    """The texts of a list that aren't blank; a single text is a list of one."""
    found = value.get(key)
    return [t for t in map(text_of, found if isinstance(found, list) else [found]) if t]


def objects_of(value: dict, key: str) -> list[dict]:
    """The objects of a list; a single object is a list of one."""
    found = value.get(key)
    return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]


def number_of(value: dict, key: str) -> float | None:
    """A finite number, also out of a text that spells one."""
    found = value.get(key)
    if isinstance(found, bool) or not isinstance(found, int | float | str):
        return None
    try:
        number = float(found)
    except (ValueError, OverflowError):
        return None
    return number if math.isfinite(number) else None


@F.pandas_udf(T.StringType())
def field_text(text: pd.Series, key: pd.Series) -> pd.Series:
    """The text under a key of the first object in a reply."""
    return pd.Series([text_of(parse_object(t) or {}, k) for t, k in zip(text, key, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("number", T.DoubleType()), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("objects", T.ArrayType(T.StringType()))]))
def field_values(text: pd.Series, key: pd.Series) -> pd.DataFrame:
    """What stands under a key of the first object in a reply, read as a number, as texts and as objects (as JSON)."""
    rows = []
    for t, k in zip(text, key, strict=True):
        found = parse_object(t) or {}
        rows.append((number_of(found, k), texts_of(found, k), [to_json(x) for x in objects_of(found, k)]))
    return pd.DataFrame(rows, columns=["number", "texts", "objects"])
