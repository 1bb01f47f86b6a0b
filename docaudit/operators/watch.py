"""Page monitoring: fingerprints, status, differences. Snapshots: page_id, checked_at, html or text, error."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import mask_pii, mask_volatile
from docaudit.operators.align import matching, opcodes

MIN_TEXT = 24
#: Share of words that two lines must have in common for their words to be compared.
SIMILAR = 0.3


def content_fingerprint(text: Column) -> Column:
    return F.sha2(mask_volatile(text), 256)


def struct_fingerprint(nodes: DataFrame, keys: list[str]) -> DataFrame:
    line = F.concat_ws("|", "path", "tag", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs")))), mask_volatile(mask_pii(F.col("text"))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return nodes.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), 256).alias("struct_hash"))


def snapshot_quality(text: Column, html: Column) -> Column:
    """Error text for pages that are too short or ask for a login, else null."""
    login = html.rlike(r"""(?i)<input[^>]+type\s*=\s*["']?password""") & text.rlike("(?i)log ?in|sign in|войти|вход")
    return F.when(F.length(F.coalesce(text, F.lit(""))) < MIN_TEXT, "too short").when(login, "login page")


def change_status(snapshots: DataFrame, skip_errors: bool = False) -> DataFrame:
    """``status``: error, changed (a hash differs from the row before, errors have empty hashes) or same; a page's first row is same."""
    per = Window.partitionBy("page_id").orderBy("checked_at")
    bad = F.col("error").isNotNull()
    rows = snapshots.withColumns({c: F.when(bad, "").otherwise(F.col(c)) for c in ("content_hash", "struct_hash")})
    key = F.struct("content_hash", "struct_hash")
    before = F.last(F.when(~bad, key), ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, -1)) if skip_errors else F.lag(key).over(per)
    rows = rows.withColumn("before", before)
    changed = (F.col("before.content_hash") != F.col("content_hash")) | (F.col("before.struct_hash") != F.col("struct_hash"))
    return rows.withColumn("status", F.when(bad, "error").when(F.coalesce(changed, F.lit(False)), "changed").otherwise("same")).drop("before")


def page_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id").agg(
        F.max_by("status", "checked_at").alias("last_status"), F.max("checked_at").alias("last_checked"), F.max(F.when(F.col("status") == "changed", F.col("checked_at"))).alias("last_changed"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("checked_at"))).alias("last_error"))


def unseen_changes(state: DataFrame, seen: DataFrame) -> DataFrame:
    return state.join(seen, "page_id", "left").where(F.col("last_changed").isNotNull() & (F.col("seen").isNull() | (F.col("seen") < F.col("last_changed"))))


def changed_pair(rows: DataFrame, last: int = 20) -> DataFrame:
    """The newest changed snapshot among the last ``last`` of each page and the one right before it."""
    per = Window.partitionBy("page_id").orderBy(F.desc("checked_at"))
    r = rows.withColumns({"r": F.row_number().over(per), "before": F.lead("checked_at").over(per)}).where(F.col("r") <= last)
    return r.where("status = 'changed'").groupBy("page_id").agg(F.max("checked_at").alias("new_at"), F.max_by("before", "checked_at").alias("old_at"))


def line_set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, text, change): lines with another number of occurrences, order-free."""
    a, b = (x.groupBy("page_id", "text").agg(F.count("*").alias(n)) for x, n in ((old, "o"), (new, "n")))
    both = a.join(b, ["page_id", "text"], "full").select("page_id", "text", (F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0))).alias("d"))
    return both.where("d <> 0").select("page_id", "text", F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), F.abs("d").alias("times"))


def text_hunks(pairs: DataFrame, context: int = 6) -> DataFrame:
    """(page_id, hunk, op, lines, words, same): line differences of ``pairs`` (page_id, old, new).

    Lines that stay are a longest common subsequence (see ``align``). A line replaced by a similar one carries its words and
    which of them stayed; runs of over ``context`` equal lines keep two lines at each end.
    """

    def diff(old: list[str], new: list[str]) -> Iterator[tuple[str, list[str], list[str], list[bool]]]:
        for equal, i, i_end, j, j_end in opcodes(old, new):
            if equal:
                yield from collapsed(old[i:i_end], context)
                continue
            words, same = similar_words(old[i], new[j]) if (i_end - i, j_end - j) == (1, 1) else ([], [])
            if i_end > i:
                yield "del", old[i:i_end], [], []
            if j_end > j:
                yield "add", new[j:j_end], words, same

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, o, n in zip(batch["page_id"], batch["old"], batch["new"]):
                out = [(k, i, *h) for i, h in enumerate(diff((o or "").split("\n"), (n or "").split("\n")))]
                yield pd.DataFrame(out, columns=["page_id", "hunk", "op", "lines", "words", "same"])

    return pairs.select("page_id", "old", "new").mapInPandas(run, "page_id long, hunk int, op string, lines array<string>, words array<string>, same array<boolean>")


def collapsed(run: list[str], context: int) -> Iterator[tuple[str, list[str], list[str], list[bool]]]:
    """A run of equal lines; of a long one the two lines at each end, and how many were skipped."""
    if len(run) > context:
        yield "eq", run[:2], [], []
        yield "skip", [str(len(run) - 4)], [], []
        run = run[-2:]
    yield "eq", run, [], []


def similar_words(old: str, new: str) -> tuple[list[str], list[bool]]:
    """The words of ``new`` and which of them stand in ``old``, too; nothing if too few do."""
    x, y = old.split(), new.split()
    stay = {j for _, j in matching(x, y)}
    return (y, [j in stay for j in range(len(y))]) if 2 * len(stay) > SIMILAR * (len(x) + len(y)) else ([], [])


EVENT_RANK = {"added": 0, "removed": 1, "moved": 2, "tag": 3, "attr": 4, "text": 5}


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both versions that say anything, with a digest of what they show; of pages that differ only."""

    def side(df: DataFrame, version: int) -> DataFrame:
        attrs = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs"))))
        shown = F.xxhash64("tag", attrs, mask_volatile(mask_pii(F.col("text"))))
        rows = df.select("page_id", F.lit(version).alias("version"), "pos", "tag", "path", attrs.alias("attrs"), "text", shown.alias("shown"))
        return rows.where("text <> '' or attrs <> '{}'")

    rows = side(old, 0).unionByName(side(new, 1))
    # the sums of what the two versions show, place by place, are equal on pages that stayed
    place = F.row_number().over(Window.partitionBy("page_id", "version").orderBy("pos"))
    digest = F.xxhash64("place", "shown").cast("decimal(20,0)")
    sign = F.when(F.col("version") == 0, -1).otherwise(1)
    differ = rows.withColumn("place", place).groupBy("page_id").agg(F.sum(digest * sign).alias("d")).where("d <> 0").select("page_id")
    return rows.join(differ, "page_id", "left_semi")


def _same_spot(a: dict, b: dict) -> bool:
    """Same path, or the same text, picture, target or id below the same parent."""
    if a["path"] == b["path"]:
        return True
    if a["path"].rpartition("/")[0] != b["path"].rpartition("/")[0]:
        return False
    x, y = json.loads(a["attrs"]), json.loads(b["attrs"])
    return (a["text"] != "" and a["text"] == b["text"]) or any(x.get(k) and x.get(k) == y.get(k) for k in ("alt", "href", "id"))


def node_events(old: list[dict], new: list[dict]) -> list[tuple]:
    """(kind, tag, path, old_path, old_text, new_text) of one page."""
    stay = matching([n["shown"] for n in old], [n["shown"] for n in new])
    out = []
    kept_old, kept_new = {i for i, _ in stay}, {j for _, j in stay}
    # what went here and came there has moved
    piles: dict[int, deque] = {}
    for j, n in enumerate(new):
        if j not in kept_new:
            piles.setdefault(n["shown"], deque()).append(j)
    for i, n in enumerate(old):
        if i not in kept_old and (pile := piles.get(n["shown"])):
            j = pile.popleft()
            kept_old.add(i)
            kept_new.add(j)
            out.append(("moved", new[j]["tag"], new[j]["path"], n["path"], n["text"], new[j]["text"]))
    # between two nodes that stay, those of one spot, then those of one tag, have changed
    last = (-1, -1)
    for x, y in [*stay, (len(old), len(new))]:
        gone = [i for i in range(last[0] + 1, x) if i not in kept_old]
        came = [j for j in range(last[1] + 1, y) if j not in kept_new]
        last = (x, y)
        for same in (_same_spot, lambda a, b: a["tag"] == b["tag"]):
            left = []
            for i in gone:
                j = next((j for j in came if same(old[i], new[j])), None)
                if j is None:
                    left.append(i)
                    continue
                came.remove(j)
                a, b = old[i], new[j]
                kind = "tag" if a["tag"] != b["tag"] else "attr" if a["attrs"] != b["attrs"] else "text"
                out.append((kind, b["tag"], b["path"], a["path"], a["text"], b["text"]))
            gone = left
        out += [("removed", old[i]["tag"], old[i]["path"], old[i]["path"], old[i]["text"], None) for i in gone]
        out += [("added", new[j]["tag"], new[j]["path"], None, None, new[j]["text"]) for j in came]
    return out


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, kind, tag, path, old_path, old_text, new_text): nodes that changed between two versions of pages.

    The nodes of both versions are aligned by what they show (tag, attributes, text without dates and the like), whatever their paths:
    an item put in front of a list is one addition. Of the others, equal ones have moved; between two that stay, nodes on one spot,
    then nodes with one tag, differ in tag, attributes or text; the rest is added or removed. Nodes without text and attributes tell
    nothing and are left out. Pages that show the same never reach Python; a page holds a bounded number of nodes (``dom_nodes``).
    """
    columns = ["version", "pos", "tag", "path", "attrs", "text", "shown"]

    def run(page: pd.DataFrame) -> pd.DataFrame:
        both = [part.sort_values("pos")[columns].to_dict("records") for part in (page[page["version"] == v] for v in (0, 1))]
        rows = [(page["page_id"].iloc[0], *e) for e in node_events(*both)]
        return pd.DataFrame(rows, columns=["page_id", "kind", "tag", "path", "old_path", "old_text", "new_text"])

    return _sides(old, new).groupBy("page_id").applyInPandas(run, "page_id long, kind string, tag string, path string, old_path string, old_text string, new_text string")


def merge_events(events: DataFrame) -> DataFrame:
    """Equal events of a page become one with its paths and count."""
    return events.groupBy("page_id", "kind", "tag", "old_text", "new_text").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.array_sort(F.collect_list("old_path")).alias("old_paths"), F.count("*").alias("count"))


def order_events(events: DataFrame) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for kv in EVENT_RANK.items() for x in kv))[F.col("kind")]
    return events.withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy(rank, F.col("paths")[0], "old_text", "new_text")))


def event_ui_list(hunks: DataFrame, events: DataFrame) -> DataFrame:
    """One list of changes: node events, and changed lines that no node event covers."""
    lines = hunks.where("op in ('add', 'del')").select("page_id", F.when(F.col("op") == "add", "added").otherwise("removed").alias("kind"), F.explode("lines").alias("text")).where("text <> ''")
    covered = events.select("page_id", F.explode(F.array("old_text", "new_text")).alias("text")).where("text is not null and text <> ''").distinct()
    free = lines.join(covered, ["page_id", "text"], "left_anti")
    return free.select("page_id", "kind", "text").unionByName(events.select("page_id", "kind", F.coalesce("new_text", "old_text").alias("text")))


def salvage_truncated(json_text: Column) -> Column:
    """struct<json, full>: a JSON array that was cut is closed behind its last whole element; a text that is no array gives an empty one.

    The text is scanned once: depth, whether within a string, whether the next character is escaped. What stands behind the array is left out.
    """

    @F.pandas_udf("json string, full boolean")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([closed(t) for t in texts], columns=["json", "full"])

    return scanned(json_text)


_SYNTAX = re.compile(r'["\\[\]{},]')


def closed(text: str | None) -> tuple[str, bool]:
    """A JSON array as it is, or closed behind its last whole element, and whether it was whole."""
    text = (text or "").strip()
    if not text.startswith("["):
        return "[]", False
    depth, inside, skip, end = 0, False, -1, 1
    for m in _SYNTAX.finditer(text):
        c, at = m[0], m.start()
        if at == skip:
            continue
        if inside:
            if c == "\\":
                skip = at + 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 0:
                return text[: at + 1], True
            if depth == 1:
                end = at + 1
        elif c == "," and depth == 1:
            end = max(end, at)
    # an element that is no object or list is whole only where a comma follows; a closing quote ends a string
    if depth == 1 and not inside and text.endswith('"') and len(text) > end:
        end = len(text)
    return text[:end].rstrip() + "]", False
