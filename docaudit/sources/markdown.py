"""Markdown to blocks. A line scanner runs over partitions of documents; links, cells and JSON are columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import markdown_inline_to_plain

HEADING, FENCE = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"^ {0,3}(```+|~~~+)")
RULE, QUOTE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$"), re.compile(r"^ {0,3}>\s?(.*)$")
ITEM, ROW, SEPARATOR = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.+)$"), re.compile(r"^\s*\|(.+)\|\s*$"), re.compile(r"^[\s|:\-]+$")
SCHEMA = "doc_id long, block_index int, type string, level int, list_kind string, list_depth int, raw string"


def scan(text: str) -> Iterator[tuple[str, int | None, str | None, int | None, str]]:
    """(type, level, list_kind, list_depth, raw) in source order."""
    held: list[str] = []
    kind, fence = "paragraph", None

    def close() -> Iterator[tuple[str, int | None, str | None, int | None, str]]:
        if held:
            yield kind, None, None, None, "\n".join(held)
            held.clear()

    for line in text.split("\n"):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                yield from close()
                fence, kind = None, "paragraph"
            else:
                held.append(line)
            continue
        if mark:
            yield from close()
            fence, kind = mark[1], "fence"
            continue
        quote = QUOTE.match(line)
        if kind == "blockquote" and not quote or kind == "paragraph" and quote:
            yield from close()
            kind = "blockquote" if quote else "paragraph"
        if quote:
            held.append(quote[1])
        elif not line.strip():
            yield from close()
        elif m := HEADING.match(line):
            yield from close()
            yield "heading", len(m[1]), None, None, m[2]
        elif RULE.match(line):
            yield from close()
            yield "horizontal_rule", None, None, None, line.strip()
        elif m := ITEM.match(line):
            yield from close()
            yield "list_item", None, "ordered" if m[2][0].isdigit() else "bullet", len(m[1].replace("\t", "  ")) // 2, m[3]
        elif (m := ROW.match(line)) and not SEPARATOR.match(line):
            yield from close()
            yield "table_row", None, None, None, m[1]
        elif not SEPARATOR.match(line) or "|" not in line:
            held.append(line.strip())
    yield from close()


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items, table rows, fences, rules and quotes with ``raw`` and ``plain``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, *block) for k, t in zip(b["doc_id"], b["text"]) for i, block in enumerate(scan(t or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "block_index", "type", "level", "list_kind", "list_depth", "raw"]).astype({"level": "Int64", "list_depth": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
    keep = F.col("type").isin("fence", "horizontal_rule")
    cells = F.when(F.col("type") == "table_row", table_cells(F.col("raw")))
    plain = F.when(keep, F.col("raw")).when(F.col("type") == "table_row", F.array_join(cells, " | ")).otherwise(markdown_inline_to_plain(F.col("raw")))
    return rows.withColumns({"cells": cells, "plain": plain, "links": block_links(F.col("raw"))})


def table_cells(row: Column, limit: int = 40) -> Column:
    return F.slice(F.transform(F.split(row, r"\|", -1), lambda c: F.trim(c)), 1, limit)


def block_links(raw: Column, limit: int = 20) -> Column:
    """(text, target) pairs."""
    pattern = r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all(raw, F.lit(pattern), F.lit(2)).alias("target"))
    return F.slice(pairs, 1, limit)


def format_spans(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_index, kind, start, end): bold and italic spans, found again in the plain text from left to right."""
    marks = re.compile(r"\*\*(?P<bold>.+?)\*\*|__(?P<bold2>.+?)__|\*(?P<italic>[^*]+)\*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, i, raw, plain in zip(b["doc_id"], b["block_index"], b["raw"], b["plain"]):
                at = 0
                for m in marks.finditer(raw or ""):
                    inner = m["bold"] or m["bold2"] or m["italic"]
                    found = (plain or "").find(inner, at)
                    if found >= 0:
                        at = found + len(inner)
                        out.append((k, i, "italic" if m["italic"] else "bold", found, at))
            yield pd.DataFrame(out, columns=["doc_id", "block_index", "kind", "start", "end"])

    marked = blocks.where(F.col("raw").rlike(r"\*|__")).select("doc_id", "block_index", "raw", "plain")
    return marked.mapInPandas(run, "doc_id long, block_index int, kind string, start int, end int")


def block_json(blocks: DataFrame, chars: int = 1000, limit: int = 2000) -> Column:
    """Sorted JSON of a block with clipped strings; a mark where it stays too long."""
    names = sorted(c for c in blocks.columns if c not in ("doc_id", "block_index", "raw"))
    kinds = dict(blocks.dtypes)
    body = F.to_json(F.struct(*(F.substring(c, 1, chars).alias(c) if kinds[c] == "string" else F.col(c) for c in names)))
    return F.when(F.length(body) > limit, '{"truncated":true}').otherwise(body)
