"""Document sources: plain text, Markdown, PDF by a caller's parser, HTML pages, and a small demonstration corpus.

Files come through Spark's ``binaryFile`` source. Each reader returns (documents, errors): a file that can't be read is a
row of ``errors`` and stops nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators.tables import small, written

#: Suffixes of the readers, tried in this order.
SUFFIXES = {"text": (".txt",), "markdown": (".md", ".markdown"), "pdf": (".pdf",)}


def kind_of(path: Column) -> Column:
    out = F.lit("unsupported")
    for kind, suffixes in reversed(SUFFIXES.items()):
        test = F.lit(False)
        for s in suffixes:
            test = test | F.endswith(F.lower(path), F.lit(s))
        out = F.when(test, kind).otherwise(out)
    return out


_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def inline_text(line: str) -> str:
    line = re.sub(r"<!--.*?-->|</?[A-Za-z][^>]*>", "", line)
    line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
    line = re.sub(r"!?\[([^\]]*)\]\[[^\]]*\]", r"\1", line)
    line = re.sub(r"<(https?://[^>]+)>", r"\1", line)
    line = re.sub(r"(`+)(.+?)\1", r"\2", line)
    line = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", line)
    line = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", line)
    return re.sub(r"\\([\\`*_{}\[\]()#+.!>-])", r"\1", line)


def markdown_text(text: str) -> str:
    """Visible text: blocks end in a blank line, list items stand one to a line, links and images keep their text."""
    blocks: list[str] = []
    lines = text.removeprefix("﻿").splitlines()
    held: list[str] = []
    items: list[str] = []

    def close() -> None:
        if held:
            blocks.append(inline_text(" ".join(held)).strip())
            held.clear()
        if items:
            blocks.append("\n".join(items))
            items.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            close()
            code = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                code.append(lines[i])
                i += 1
            blocks.append("\n".join(code))
        elif not line.strip() or re.fullmatch(r"\s{0,3}([-*_])(\s*\1){2,}\s*", line):
            close()
        elif m := re.match(r"\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", line):
            close()
            blocks.append(inline_text(m[1]))
        elif re.fullmatch(r"\s{0,3}(=+|-+)\s*", line) and held:
            close()
        elif _ITEM.match(line):
            if held:
                close()
            items.append(inline_text(_ITEM.sub("", line, count=1)).strip())
        elif items and line[:1].isspace():
            items[-1] += " " + inline_text(line).strip()
        else:
            if items:
                close()
            held.append(re.sub(r"^\s{0,3}>\s?", "", line).strip())
        i += 1
    close()
    return "\n\n".join(b for b in blocks if b.strip())


def html_text(html: str | None) -> str:
    """Visible text of a page: scripts, styles and tags removed, entities resolved."""
    import html as entities

    body = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ", html or "")
    body = re.sub(r"(?i)</?(p|div|br|li|h[1-6]|tr|section|article|header|footer|ul|ol|table)\b[^>]*>", "\n", body)
    body = entities.unescape(re.sub(r"<[^>]+>", "", body))
    lines = (re.sub(r"[ \t ]+", " ", x).strip() for x in body.split("\n"))
    return "\n".join(x for x in lines if x)


def read_files(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None, parsers: dict[str, Callable[[bytes], str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(filename, content) and (filename, error) of the files under ``path``; text is strict UTF-8, blank PDFs are errors.

    ``parsers`` by file suffix (".docx") come before the built-in kinds; ``pdf`` is short for one by ".pdf".
    """
    known = {k.lower(): f for k, f in (parsers or {}).items()} | ({".pdf": pdf} if pdf is not None else {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), kind_of(F.col("path")).alias("kind"), "content")

    def parse(batches):
        for pdf_rows in batches:
            out = []
            for name, kind, raw in zip(pdf_rows["filename"], pdf_rows["kind"], pdf_rows["content"], strict=True):
                own = next((f for suffix, f in known.items() if name.lower().endswith(suffix)), None)
                try:
                    if own is not None:
                        said = own(bytes(raw))
                        if not said.strip():
                            raise ValueError("the file has no text")
                    elif kind == "unsupported":
                        raise ValueError("unsupported file type; text, Markdown and PDF are read")
                    elif kind == "pdf":
                        raise ValueError("no PDF parser is set")
                    else:
                        said = bytes(raw).decode("utf-8")
                        said = markdown_text(said) if kind == "markdown" else said
                    out.append((name, said, None))
                except (ValueError, UnicodeDecodeError) as e:
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["filename", "content", "error"])

    parsed = files.mapInPandas(parse, "filename string, content string, error string")
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").drop("content")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, text) of a table of raw pages."""

    @F.pandas_udf("string")
    def visible(html: pd.Series) -> pd.Series:
        return html.map(html_text)

    return spark.read.parquet(path).select("page_id", "url", visible("html").alias("text"))


def demo(spark: SparkSession) -> DataFrame:
    """Three short documents for a first try."""
    rows = [
        ("demo", 0, "lodgings.txt", "Sherlock Holmes met John Watson in London. Watson helped Holmes at Baker Street."),
        ("demo", 1, "visitor.txt", "Mary Morstan visited Sherlock Holmes. Holmes told Watson about the letter."),
        ("demo", 2, "river.txt", "Holmes chased Jonathan Small down the Thames. Watson met Mary Morstan again."),
    ]
    return spark.createDataFrame(rows, "corpus_id string, doc_idx int, filename string, content string")


def text_units(documents: DataFrame) -> DataFrame:
    """Overlapping units of each document; blank documents have none but keep their index."""
    parts = documents.select("corpus_id", "doc_idx", "filename", F.posexplode(tx.text_units("content")).alias("ordinal", "text"))
    uid = F.concat(F.col("corpus_id"), F.lit("::doc-"), F.col("doc_idx").cast("string"), F.lit("::tu-"), F.col("ordinal").cast("string"))
    return parts.select("corpus_id", uid.alias("id"), F.col("filename").alias("document_name"), "ordinal", "text", (F.col("doc_idx").cast("long") * (1 << 32) + F.col("ordinal")).alias("ord"))


#: Documents whose numbers of chunks are broadcast; of more, texts are shuffled to them.
DOCUMENTS = 4_000_000


def chunks(documents: DataFrame) -> DataFrame:
    """Chunks numbered across each corpus, in document order.

    Counts of chunks per document, not the chunks, are summed in order; so only those small rows meet in one place, and they come to
    the texts, which stay where they are. Documents are cut once and written, so that no task holds a Python worker for this and another
    for what the caller does with the chunks.
    """
    cut = documents.select("corpus_id", "doc_idx", "filename", tx.chunks("content").alias("parts"))
    cut = written(cut.withColumn("n", F.size("parts")))
    counts = cut.select("corpus_id", "doc_idx", "n")
    before = small(counts.select("corpus_id", "doc_idx", (F.sum("n").over(Window.partitionBy("corpus_id").orderBy("doc_idx")) - F.col("n")).alias("before")), DOCUMENTS)
    rows = cut.join(before, ["corpus_id", "doc_idx"]).select("corpus_id", "filename", "before", F.posexplode("parts").alias("pos", "text"))
    ordinal = (F.col("before") + F.col("pos")).cast("long")
    return rows.select("corpus_id", F.concat(F.col("corpus_id"), F.lit("::chunk-"), ordinal.cast("string")).alias("id"), ordinal.alias("ordinal"), "text", F.col("filename").alias("document_name"))
