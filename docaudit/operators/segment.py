"""Lines, sentences, blocks and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, min_visible: int = 0) -> DataFrame:
    """(doc_id, line, text) with lines from 1; lines with fewer visible characters than asked are left out."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    if min_visible:
        lines = lines.where(F.length(F.regexp_replace("text", r"\s", "")) >= min_visible)
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), "text")


def line_batches(lines: DataFrame, size: int = 500) -> DataFrame:
    return lines.withColumn("batch", F.floor((F.col("line") - 1) / size).cast("int"))


SENTENCE_END = r"(?<=[.!?…])\s+(?=\p{Lu})"


def sentences(lines: DataFrame) -> DataFrame:
    """(doc_id, line, sentence, text): sentences of each line, from 1."""
    return lines.select("doc_id", "line", F.posexplode(F.split("text", SENTENCE_END, -1)).alias("at", "text")).select("doc_id", "line", (F.col("at") + 1).alias("sentence"), "text")


LIST_LINE = r"^(\s*)([-*+]|\d+[.)])\s+(.+)$"


def text_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs and list items of plain text: (doc_id, block_index, type, list_kind, list_depth, plain). A blank line ends a paragraph; each list line is a block."""
    rows = explode_lines(docs).withColumn("item", F.col("text").rlike(LIST_LINE)).withColumn("blank", F.trim("text") == "")
    order = Window.partitionBy("doc_id").orderBy("line")
    before = F.lag(F.col("item") | F.col("blank"), 1, True).over(order)
    rows = rows.withColumn("start", F.col("item") | before).where(~F.col("blank"))
    rows = rows.withColumn("block_index", F.sum(F.col("start").cast("int")).over(order) - 1)
    indent = F.length(F.replace(F.regexp_extract("text", LIST_LINE, 1), F.lit("\t"), F.lit("  ")))
    kind = F.when(F.col("item"), F.when(F.regexp_extract("text", LIST_LINE, 2).rlike(r"^\d"), "ordered").otherwise("bullet"))
    words = F.when(F.col("item"), F.regexp_extract("text", LIST_LINE, 3)).otherwise(F.trim("text"))
    rows = rows.select("doc_id", "block_index", "line", "item", kind.alias("list_kind"), F.when(F.col("item"), F.floor(indent / 2).cast("int")).alias("list_depth"), words.alias("words"))
    return rows.groupBy("doc_id", "block_index").agg(
        F.when(F.max("item"), "list_item").otherwise("paragraph").alias("type"), F.min("list_kind").alias("list_kind"), F.min("list_depth").alias("list_depth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: x["words"]), " ").alias("plain"),
    ).withColumn("block_index", F.col("block_index").cast("int"))


def attach_list_intro(blocks: DataFrame) -> DataFrame:
    """Numbers each run of list items; the paragraph before a run introduces it."""
    order = Window.partitionBy("doc_id").orderBy("block_index")
    item = F.col("type") == "list_item"
    start = item & ~F.coalesce(F.lag(item).over(order), F.lit(False))
    rows = blocks.withColumn("list_group", F.when(item, F.sum(F.when(start, 1).otherwise(0)).over(order)))
    opens = F.lead("list_group").over(order)
    rows = rows.withColumn("introduces_list", F.when(F.col("type").isin("paragraph", "blockquote"), opens))
    intro = F.last(F.when(F.col("introduces_list").isNotNull(), F.col("block_index")), ignorenulls=True).over(order)
    group = F.last("introduces_list", ignorenulls=True).over(order)
    return rows.withColumn("list_intro_index", F.when(item & (group == F.col("list_group")), intro))


def nearest_heading(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.col("plain")), ignorenulls=True).over(order))


def heading_path(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """``path``: the headings that hold a block, outermost first. A heading ends those of its level and deeper."""
    order = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(1, levels + 1):
        last = F.max(F.when((F.col("type") == "heading") & (F.col("level") == k), F.struct("block_index", "plain"))).over(order)
        upper = F.max(F.when((F.col("type") == "heading") & (F.col("level") < k), F.col("block_index"))).over(order)
        parts.append(F.when(last["block_index"] > F.coalesce(upper, F.lit(-1)), last["plain"]))
    return blocks.withColumn("path", F.array_compact(F.array(*parts)))


def semantic_units(blocks: DataFrame) -> DataFrame:
    """``unit``: an introduction with its list items is one unit, a bare run of items too, else each block."""
    order = Window.partitionBy("doc_id").orderBy("block_index")
    item = F.col("type") == "list_item"
    lead_item = F.coalesce(F.lead(item).over(order), F.lit(False))
    intro = F.col("type").isin("paragraph", "blockquote") & F.col("plain").rlike("[:：]$") & lead_item
    rows = blocks.withColumn("intro", intro)
    before = F.coalesce(F.lag(item | F.col("intro")).over(order), F.lit(False))
    return rows.withColumn("unit", (F.sum(F.when(item & before, 0).otherwise(1)).over(order) - 1).cast("int")).drop("intro")


def chunk_plan(n: Column, target: int = 24) -> Column:
    """Blocks in a chunk: 8, and 4 more while over ``target`` chunks would come out, up to 28."""
    out = F.lit(28)
    for size in range(24, 7, -4):
        out = F.when(F.ceil(n / (size - 2)) <= target, size).otherwise(out)
    return out


def chunk_blocks(units: DataFrame, size: int = 8, overlap: int = 2) -> DataFrame:
    """(doc_id, chunk_index, block_ids): whole units packed into chunks of ``size`` blocks; the next chunk steps back over whole units until ``overlap`` blocks are covered. A fold over the units of a document, so grouped by document."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_index")
        groups = [g["block_index"].tolist() for _, g in part.groupby("unit", sort=True)]
        out, at = [], 0
        while at < len(groups):
            end, held = at, 0
            while end < len(groups) and (end == at or held + len(groups[end]) <= size):
                held += len(groups[end])
                end += 1
            out.append([b for g in groups[at:end] for b in g])
            if end >= len(groups):
                break
            back, covered = end, 0
            while back - 1 > at and covered < overlap:
                back -= 1
                covered += len(groups[back])
            at = back
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[0], "chunk_index": range(len(out)), "block_ids": out})

    kind = units.schema["doc_id"].dataType.simpleString()
    return units.select("doc_id", "block_index", "unit").groupBy("doc_id").applyInPandas(pack, f"doc_id {kind}, chunk_index int, block_ids array<int>")


def chunk_window_context(chunks: DataFrame, blocks: DataFrame, reach: int = 6) -> DataFrame:
    """Up to ``reach`` blocks on each side of a chunk, without its own, as lines ``[i] text``."""
    edges = chunks.select("doc_id", "chunk_index", "block_ids", F.array_min("block_ids").alias("lo"), F.array_max("block_ids").alias("hi"))
    near = edges.join(blocks.select("doc_id", "block_index", "plain"), "doc_id").where(
        F.col("block_index").between(F.col("lo") - reach, F.col("hi") + reach) & ~F.array_contains("block_ids", F.col("block_index"))
    )
    line = F.concat(F.lit("["), F.col("block_index").cast("string"), F.lit("] "), F.col("plain"))
    got = near.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("block_index", line.alias("line")))).alias("all"))
    return got.select("doc_id", "chunk_index", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("context"))


def neighbour_context(candidates: DataFrame, blocks: DataFrame, reach: int = 1) -> DataFrame:
    """Blocks within ``reach`` of a candidate's block, each once."""
    at = candidates.select("doc_id", F.explode(F.sequence(F.col("block_index") - reach, F.col("block_index") + reach)).alias("block_index")).distinct()
    return blocks.join(at, ["doc_id", "block_index"], "left_semi")


def compress_document(blocks: DataFrame, words: int = 12, limit: int = 12_000) -> DataFrame:
    """First words of each block behind its heading, cut where the document's text passes ``limit`` characters."""
    head = nearest_heading(blocks)
    short = F.array_join(F.slice(F.split(F.trim("plain"), r"\s+"), 1, words), " ")
    line = F.concat(F.coalesce(F.concat(F.col("heading"), F.lit(": ")), F.lit("")), short)
    rows = head.select("doc_id", "block_index", line.alias("line"))
    order = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(F.length("line") + 1).over(order)).where(F.col("upto") <= limit).select("doc_id", "block_index", "line", "upto")


def pack_by_chars(blocks: DataFrame, limit: int = 3500) -> DataFrame:
    """(doc_id, part, text): blocks split at ``limit`` characters (line end, else space, else there) and packed with one unit of overlap."""

    def split(text: str) -> Iterator[str]:
        while len(text) > limit:
            at = max(text.rfind("\n", 1, limit), 0) or max(text.rfind(" ", 1, limit), 0) or limit
            yield text[:at]
            text = text[at:].lstrip()
        if text:
            yield text

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        units = [u for t in part.sort_values("block_index")["plain"] for u in split(t or "")]
        out, held = [], []
        for u in units:
            if held and sum(map(len, held)) + len(held) + len(u) > limit:
                out.append("\n".join(held))
                held = held[-1:] if len(held[-1]) + len(u) < limit else []
            held.append(u)
        if held:
            out.append("\n".join(held))
        return pd.DataFrame({"doc_id": [part["doc_id"].iloc[0]] * len(out), "part": list(range(len(out))), "text": pd.Series(out, dtype=object)})

    kind = blocks.schema["doc_id"].dataType.simpleString()
    return blocks.select("doc_id", "block_index", "plain").groupBy("doc_id").applyInPandas(pack, f"doc_id {kind}, part int, text string")


def has_prose(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.max((F.length("plain") >= 40) & F.col("plain").rlike("[.!?;:]")).alias("has_prose"))


def has_structure(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.max(F.col("type") != "paragraph").alias("has_structure"))


def document_index(docs: DataFrame, top: int = 80, least: int = 2) -> DataFrame:
    """(doc_id, word, n): the most frequent words of each document that repeat."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}][\p{L}\p{N}_-]{3,})"), F.lit(1))).alias("word"))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("doc_id", "word", "n")


def document_text(blocks: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.when(F.col("plain") != "", F.struct("block_index", "plain"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["plain"]), "\n").alias("text"))


def document_json_bounded(blocks: DataFrame, limit: int = 16_000) -> DataFrame:
    """The first blocks whose JSON fits, and how many are left."""
    js = blocks.withColumn("json", F.to_json(F.struct("block_index", "plain", "type")))
    order = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(F.length("json") + 1).over(order) <= limit
    js = js.withColumn("fits", fits)
    return js.groupBy("doc_id").agg(F.count_if("fits").alias("blocks"), F.count_if(~F.col("fits")).alias("remaining_blocks"), F.sum(F.when(F.col("fits"), F.length("json") + 1)).alias("chars"))
