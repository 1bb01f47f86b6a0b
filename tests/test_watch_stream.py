"""Snapshots as a stream: batches in any order, pages that fall silent."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docaudit.operators import watch as W
from docaudit.streaming import streams as S

SCHEMA = "page_id long, checked_at timestamp, content_hash string, struct_hash string, error string"
DAY = 86_400


def rows_of(spark, rows):
    made = spark.createDataFrame([(p, t, c, s, e) for p, t, c, s, e in rows], "page_id long, t double, content_hash string, struct_hash string, error string")
    return made.select("page_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("checked_at"), "content_hash", "struct_hash", "error")


def streamed(spark, folder, batches, **more):
    """Each batch as a file, read in order; statuses by page and second, and the query's last progress."""
    source, out = f"{folder}/in", f"{folder}/out"
    held = []
    for i, rows in enumerate(batches):
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        query = S.watch_stream(stream, **more).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(out)
        query.awaitTermination()
        held += [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    got = spark.read.schema("page_id long, checked_at timestamp, status string").parquet(out).select("page_id", F.unix_micros("checked_at").alias("at"), "status").collect()
    return sorted((r["page_id"], r["at"] / 1_000_000, r["status"]) for r in got), held


def batch(spark, rows):
    got = W.change_status(rows_of(spark, rows)).select("page_id", F.unix_micros("checked_at").alias("at"), "status").collect()
    return sorted((r["page_id"], r["at"] / 1_000_000, r["status"]) for r in got)


END = (99, 1000.0 * DAY, "end", "", None)


def test_batches_in_the_wrong_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(p, float(t), rng.choice("ab"), "s", None if rng.random() < 0.8 else "failed") for p in range(4) for t in rng.sample(range(1000, 9000), 12)]
    rng.shuffle(rows)
    parts = [rows[:20], rows[20:30], rows[30:], [END]]
    got, _ = streamed(spark, tmp_path, parts, late="3 hours")
    assert [r for r in got if r[0] != 99] == batch(spark, rows)


def test_later_batch_first_and_nulls(spark, tmp_path):
    late = [(1, 5000.5, "b", None, None), (1, 6000.0, "b", None, None)]
    early = [(1, 4000.0, "a", None, None), (1, 4000.25, None, None, "failed"), (2, 4500.0, None, None, None)]
    got, _ = streamed(spark, tmp_path, [late, early, [END]], late="1 hour")
    assert [r for r in got if r[0] != 99] == batch(spark, [*late, *early]) == [(1, 4000.0, "same"), (1, 4000.25, "error"), (1, 5000.5, "changed"), (1, 6000.0, "same"), (2, 4500.0, "same")]


def test_silent_pages_leave_the_state(spark, tmp_path):
    first = [(p, 100.0 + p, "a", "s", None) for p in range(20)]
    got, held = streamed(spark, tmp_path, [first, [(50, 20.0 * DAY, "x", "s", None)], [(3, 40.0 * DAY, "b", "s", None), (51, 41.0 * DAY, "x", "s", None)]], quiet_days=10)
    # page 3 came back after its state had gone, so its hash is no change
    assert [r for r in got if r[0] == 3] == [(3, 103.0, "same"), (3, 40.0 * DAY, "same")]
    assert held[-1] <= 3 and max(held) >= 20


@pytest.mark.parametrize("days, want", [(10, "changed"), (1, "same")])
def test_limit_of_silence_within_a_batch(spark, tmp_path, days, want):
    got, _ = streamed(spark, tmp_path, [[(1, 100.0, "a", "s", None), (1, 100.0 + 5 * DAY, "b", "s", None)]], quiet_days=days)
    assert [r[2] for r in got] == ["same", want]
