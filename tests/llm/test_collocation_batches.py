"""Operator 13: what tasks hold at once stays small, whatever their size."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docaudit.llm import collocations as C

CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pages(spark, path):
    """Rows and pages of each column chunk of a file."""
    j, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = j.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(j.org.apache.hadoop.fs.Path(path), conf)
    reader = j.org.apache.parquet.hadoop.ParquetFileReader.open(place)
    out = [(b.getRowCount(), reader.readOffsetIndex(c).getPageCount()) for b in reader.getFooter().getBlocks() for c in b.getColumns()]
    reader.close()
    return out


def test_few_rows_a_batch_and_a_page(spark, monkeypatch):
    kept, rows_of, made = C.written, {}, {}

    def seen(df, name, **more):
        rows_of[name] = int(spark.conf.get(CONF))
        made[name] = kept(df, name, **more)
        return made[name]

    monkeypatch.setattr(C, "written", seen)
    usual = spark.conf.get(CONF)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.concat(F.lit("word"), F.pmod(F.hash(i, F.col("id")), F.lit(90)).cast("string"))))
    docs = spark.range(160).coalesce(1).select(F.lit("en").alias("lang"), text.alias("text"))
    found = C.phrases(docs).collect()
    assert len(found) == C.TOP and found[0]["n"] == 160 * 8000
    assert rows_of["words"] <= 256 and rows_of["occurrences-1"] <= 256 and max(rows_of[n] for n in ("counts-2", "occurrences-2", "counts-3")) <= 8
    assert spark.conf.get(CONF) == usual
    for name in ("occurrences-1", "occurrences-2"):
        chunks = [x for f in made[name].inputFiles() for x in pages(spark, f)]
        assert sum(rows for rows, _ in chunks) > 2 * 16 and all(rows <= 8 * n for rows, n in chunks)


def test_batches_as_the_session_says(spark):
    usual = spark.conf.get(CONF)
    try:
        for given, want in (("5", "5"), ("0", "8"), ("10000", "8")):
            spark.conf.set(CONF, given)
            with pytest.raises(ValueError), C.batches_of(spark, 8):
                assert spark.conf.get(CONF) == want
                raise ValueError
            assert spark.conf.get(CONF) == given
    finally:
        spark.conf.set(CONF, usual)


def test_blocks_across_batches(monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 60)
    rows = [(f"l{i % 40}" if i % 3 else "en", f"one{i} two {'x' * (i % 50)}. three") for i in range(400)]
    batches = [pa.record_batch([pa.array([r[0]]), pa.array([r[1]])], names=["lang", "text"]) for r in rows]
    read = 0

    def one_by_one():
        nonlocal read
        for b in batches:
            read += 1
            yield b

    got, first = Counter(), None
    longest = 0
    for lang, text in C.joined_blocks(one_by_one()):
        first = first or read
        longest = max(longest, len(text))
        got.update((lang, w) for w in C.Words(text, 1).at(np.arange(len(C.Words(text, 1).start))))
    want = Counter((lang, w.encode()) for lang, text in rows for w in text.replace(".", " ").split())
    # nothing lost, no block longer than one, and given on while rows still come
    assert got == want and longest <= 61 and first < 40
    assert sum(1 for _ in C.blocks(*batches)) < len(rows)


@pytest.mark.parametrize("n", [0, 1, 65535, 65536, 70000])
def test_rows_of_a_relation(n):
    hashes = [np.arange(n, dtype=np.uint64) * np.uint64(1 << 40), np.arange(n, dtype=np.uint64)]
    ids = np.append(np.arange(n), -1).astype(np.int32)
    ((flat, back),) = C._each(iter([C._rows(hashes, ids)]), 2)
    assert back.tolist() == ids.tolist() and flat.reshape(-1, 2).T.tolist() == [h.tolist() for h in hashes]
