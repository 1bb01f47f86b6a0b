"""Web pages to text, blocks, links and nodes. The tokenizer runs over partitions of pages; everything after it is columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import normalize_spaces
from docaudit.sources.shared import checkpointed

#: Tags without visible text, page furniture, tags that begin a line, tags without an end, and kept attributes.
SKIP = frozenset("script style noscript template svg canvas iframe object embed head title meta link audio video".split())
CHROME = frozenset("nav footer header aside".split())
BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre br hr figure figcaption dl dd dt caption form".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre tr figcaption dd dt caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 pre blockquote section article footer".split())
ATTRIBUTES = ("id", "name", "type", "href", "src", "alt", "title", "placeholder", "role", "for", "action", "method", "required")


class Tree(HTMLParser):
    """Elements in document order with their path, own text and kept attributes; unclosed tags end with their parents, a new paragraph ends an open one."""

    def __init__(self, chrome: bool = False):
        super().__init__(convert_charrefs=True)
        self.chrome, self.open, self.nodes, self.lines, self.hidden = chrome, [], [], [""], 0
        self.counts: list[dict[str, int]] = [{}]

    def _hides(self, tag: str, attrs: dict[str, str | None]) -> bool:
        style = re.sub(r"\s", "", attrs.get("style") or "")
        return tag in SKIP or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or (not self.chrome and (tag in CHROME or attrs.get("role") in ("navigation", "banner")))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P and any(n["tag"] == "p" for n in self.open):
            self._close("p")
        if tag == "li" and self.open and self.open[-1]["tag"] == "li":
            self._close("li")
        got = dict(attrs)
        at = self.counts[-1]
        at[tag] = at.get(tag, -1) + 1
        parent = self.open[-1] if self.open else None
        node = {"tag": tag, "path": (parent["path"] + "/" if parent else "") + f"{tag}#{at[tag]}", "attrs": {k: got[k] or "" for k in ATTRIBUTES if k in got}, "text": "", "hides": self._hides(tag, got), "parents": [n["tag"] for n in self.open]}
        if tag in BLOCK:
            self._line()
        visible = not self.hidden and not node["hides"] and not (tag == "input" and got.get("type") == "hidden")
        if visible:
            self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts.append({})
            self.hidden += node["hides"]

    def handle_endtag(self, tag: str) -> None:
        if any(n["tag"] == tag for n in self.open):
            self._close(tag)

    def _close(self, tag: str) -> None:
        while self.open:
            node = self.open.pop()
            self.counts.pop()
            self.hidden -= node["hides"]
            if node["tag"] in BLOCK:
                self._line()
            if node["tag"] == tag:
                return

    def _line(self) -> None:
        if self.lines[-1]:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.lines[-1] += data
        if self.open:
            for n in self.open:
                if n["tag"] in BLOCKS:
                    n["text"] += data
            if self.open[-1]["tag"] not in BLOCKS:
                self.open[-1]["text"] += data


def parsed(html: str | None, chrome: bool = False) -> Tree:
    tree = Tree(chrome)
    tree.feed(html or "")
    tree.close()
    return tree


def visible_text(pages: DataFrame, chrome: bool = False) -> DataFrame:
    """(page_id, line, text): visible lines with normalised spaces; empty lines go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, t) for k, h in zip(b["page_id"], b["html"]) for i, t in enumerate(parsed(h, chrome).lines, 1)]
            yield pd.DataFrame(out, columns=["page_id", "line", "text"])

    rows = pages.select("page_id", "html").mapInPandas(run, "page_id long, line int, text string")
    return rows.withColumn("text", normalize_spaces(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_index, type, level, plain): headings, paragraphs, items, quotes, rows and the like; a paragraph inside an item or cell is the item's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b["page_id"], b["html"]):
                at = 0
                for n in parsed(h).nodes:
                    tag = n["tag"]
                    if tag not in BLOCKS or (tag == "p" and {"li", "td", "th"} & set(n["parents"])) or not n["text"].strip():
                        continue
                    kind = "heading" if tag[0] == "h" and tag[1:].isdigit() else {"p": "paragraph", "li": "list_item", "tr": "table_row"}.get(tag, tag)
                    out.append((k, at, kind, int(tag[1:]) if kind == "heading" else None, " ".join(n["text"].split())))
                    at += 1
            yield pd.DataFrame(out, columns=["page_id", "block_index", "type", "level", "plain"]).astype({"level": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, block_index int, type string, level int, plain string")


def dom_nodes(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), limit: int = 2000) -> DataFrame:
    """Visible nodes depth first: keys, pos, tag, path, attrs and own text of 120 characters at most, ``limit`` a page."""
    names = [*keys, "pos", "tag", "path", "attrs", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                for i, n in enumerate(parsed(row.html, chrome=True).nodes[:limit]):
                    out.append((*(getattr(row, k) for k in keys), i, n["tag"], n["path"], n["attrs"], " ".join(n["text"].split())[:120]))
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, "html").mapInPandas(run, schema + ", pos int, tag string, path string, attrs map<string,string>, text string")


HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def absolute(base: Column, href: Column) -> Column:
    """Absolute URL without query, fragment and trailing slash."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    full = F.when(href.rlike("(?i)^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))
    return F.regexp_replace(F.regexp_replace(full, r"[?#].*$", ""), r"/+$", "")


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, src, dst): targets of anchors, each once for a page; places within the page, mail and phone left out."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    found = found.where(~F.col("href").rlike("(?i)^(#|mailto:|tel:|javascript:)"))
    return found.select("page_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "").alias("src"), absolute(F.col("url"), F.col("href")).alias("dst")).distinct()


#: Extensions of files that are no pages.
FILES = (
    "pdf zip gz tar rar 7z jpg jpeg png gif svg webp ico bmp mp3 mp4 avi mov wmv flv doc docx xls xlsx ppt pptx "
    "exe msi dmg apk css js json xml rss atom woff woff2 ttf eot"
).split()


def same_domain(links: DataFrame) -> DataFrame:
    return links.where((url_host(F.col("src")) == url_host(F.col("dst"))) & ~F.lower("dst").rlike(r"\.(" + "|".join(FILES) + ")$"))


def robots_filter(links: DataFrame, robots: DataFrame) -> DataFrame:
    """Links whose path begins with no disallowed prefix of its host. ``robots``: host, prefix."""
    keyed = links.withColumns({"host": url_host(F.col("dst")), "path": F.regexp_replace("dst", r"^https?://[^/]+", "")})
    return keyed.join(robots, (keyed["host"] == robots["host"]) & F.startswith(keyed["path"], robots["prefix"]), "left_anti").drop("host", "path")


def reachable(links: DataFrame, start: DataFrame, max_level: int = 10, limit: int = 200) -> DataFrame:
    """(url, level): pages in breadth-first order from ``start`` (url), at most ``limit`` by (level, url). Each level is a join; lineage is cut by checkpoint."""
    edges = links.select("src", "dst").distinct()
    seen = start.select("url", F.lit(0).alias("level")).distinct()
    front = seen
    for level in range(1, max_level + 1):
        step = edges.join(front.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        front = checkpointed(step.join(seen, "url", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
        if seen.limit(limit).count() >= limit:
            break
    return seen.orderBy("level", "url").limit(limit)
