"""The same operators on unbounded input."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docaudit.operators.lint import DEFAULT_RULES, Rule, lint
from docaudit.operators.segment import explode_lines


#: Columns of a snapshot that waits for its turn, in the state of its page.
_WAITING = ("checked_at", "content_hash", "struct_hash", "error")


def watch_stream(snapshots: DataFrame, late: str = "0 seconds", quiet_days: int = 90) -> DataFrame:
    """Status of each snapshot (page_id, checked_at, content_hash, struct_hash, error) against the page's one before it in event time.

    A snapshot waits in its page's state until the watermark, ``late`` behind the newest snapshot of all, has passed it; then
    those that wait are judged in the order of their times. So batches that come in the wrong order give what one batch
    gives, unless a snapshot comes later than the watermark: Spark drops it. Besides what waits a page keeps its last two hashes, until
    it has been silent for ``quiet_days``; the first snapshot after that counts as a page's first. Ties go by hash.
    """
    out = "page_id long, checked_at timestamp, status string"
    keeps = "content_hash string, struct_hash string, seen long, waiting string"
    quiet = quiet_days * 86_400_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, struct, seen, waiting = state.get if state.exists else (None, None, None, "[]")
        rows = [tuple(r) for r in json.loads(waiting)]
        for part in parts:
            for at, *rest in part[list(_WAITING)].itertuples(index=False):
                rows.append((int(pd.Timestamp(at).value // 1000), *(None if x is None or pd.isna(x) else x for x in rest)))
        mark = state.getCurrentWatermarkMs()
        # the watermark has whole milliseconds
        due = sorted((r for r in rows if r[0] // 1000 <= mark), key=lambda r: (r[0], r[1] or ""))
        rows = [r for r in rows if r[0] // 1000 > mark]
        found = []
        for at, content_now, struct_now, error in due:
            now = ("", "") if error is not None else (content_now or "", struct_now or "")
            known = seen is not None and at - seen <= quiet
            found.append((key[0], pd.Timestamp(at, unit="us"), "error" if error is not None else "changed" if known and (content, struct) != now else "same"))
            (content, struct), seen = now, at
        if rows or (seen is not None and mark * 1000 - seen <= quiet):
            state.update((content, struct, seen, json.dumps(rows)))
            # wakes when the first that waits is due, else when the page has been silent for too long
            wake = min((r[0] // 1000 for r in rows), default=((seen or 0) + quiet) // 1000 + 1)
            state.setTimeoutTimestamp(max(wake, mark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["page_id", "checked_at", "status"])

    marked = snapshots.withWatermark("checked_at", late)
    return marked.groupBy("page_id").applyInPandasWithState(step, out, keeps, "append", GroupStateTimeout.EventTimeTimeout)


def rule_hits_stream(hits: DataFrame) -> DataFrame:
    """Running count and last time of each (user, rule), for update or complete mode."""
    return hits.where(F.trim("rule") != "").groupBy("user", "rule").agg(F.count("*").alias("count"), F.max("ts").alias("last_ts"))


def findings_stream(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Findings of arriving documents; stateless."""
    return lint(explode_lines(docs), rules)


def usage_windows(usage: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tokens by tumbling or sliding window; rows later than ``late`` are left out of closed windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return usage.withWatermark("ts", late).groupBy(w.alias("w"), "worker").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "worker", "tokens", "calls")


def dedupe_stream(requests: DataFrame, key: str = "request_key", within: str = "1 hour") -> DataFrame:
    """Repeated keys within the watermark pass once."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
