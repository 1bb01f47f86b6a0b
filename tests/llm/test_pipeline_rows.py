"""Rows whose 64-bit digests meet in the near-duplicate stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as P

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [(1, LONG), (2, LONG + " more"), (3, "quite another text of seven or eight words"), (3, "quite another text of seven or eight words"), (4, "a third one that stands alone here today"), (None, LONG), (5, None), (5, ""), (4, "the same id with other words than before")]


def docs_of(spark):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def test_digests_that_meet_lose_no_row(spark, monkeypatch):
    docs = docs_of(spark)
    want = sorted(map(str, P.drop_near_duplicates(spark, docs, "").collect()))
    assert len(want) == 6
    own, turns = P.row_digest, []

    def meeting(turn):
        turns.append(turn)
        return F.lit(7).cast("long") if turn == 0 else own(turn) % 2 if turn == 1 else own(turn)

    monkeypatch.setattr(P, "row_digest", meeting)
    assert sorted(map(str, P.drop_near_duplicates(spark, docs, "").collect())) == want
    assert max(turns) >= 2


def test_numbers_tell_rows_apart(spark):
    rows = P.numbered(docs_of(spark)).collect()
    by_number = {}
    for r in rows:
        by_number.setdefault(r[P.ROW], set()).add((r["doc_id"], r["text"]))
    assert len(rows) == len(ROWS) and all(len(v) == 1 for v in by_number.values()) and len(by_number) == len(set(ROWS))
