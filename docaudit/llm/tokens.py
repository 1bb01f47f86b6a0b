"""Token counts of whole texts (operator 2) with a map-side lookup in two tiers.

Tier one is a hash table of frequent pre-tokens and their lengths in tokens: at most ``FREQUENT`` entries of at most
``WORD_CHARS`` characters, so its size has a fixed bound. It is broadcast and only read. Tier two is a cache in each
Python worker, bounded in bytes, for the pre-tokens that tier one lacks; a miss there is encoded. Pre-tokens are never
shuffled.

Which pre-tokens are in tier one changes the speed only, never a count, so they are taken from the ``SAMPLE_DOCS``
documents whose hashed doc_id is smallest.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows give repeated results; other
columns are ignored; an empty table gives no rows. Keys are integers or strings of digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.bpe import WordBpe, loaded, vocabulary
from docaudit.llm.common import table

FREQUENT = 32_768
WORD_CHARS = 48
SAMPLE_DOCS = 400
LIMIT = 2048


def frequent_lengths(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> dict[str, int]:
    """Tier one: frequent pre-tokens with their numbers of tokens, from a bounded sample of documents."""
    ids = [r[0] for r in docs.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCS).collect()]
    if not ids:
        return {}

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                for part in bpe.segments(t.as_py() or ""):
                    if isinstance(part, str):
                        seen.update(w for w in bpe.split(part) if len(w) <= WORD_CHARS)
                if len(seen) > 8 * FREQUENT:
                    seen = Counter(dict(seen.most_common(FREQUENT)))
        most = seen.most_common(FREQUENT)
        if most:
            yield pa.record_batch([pa.array([w for w, _ in most]), pa.array([n for _, n in most], pa.int64())], names=["word", "n"])

    counts = docs.where(F.col(key).isin(ids)).select(text).mapInArrow(top, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    bpe = loaded(path)
    return {r["word"]: len(bpe.merge(r["word"])) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}


def count(bpe: WordBpe, frequent: dict[str, int], text: str | None) -> int:
    total = 0
    for part in bpe.segments(text or ""):
        if isinstance(part, int):
            total += 1
            continue
        words = bpe.split(part)
        found = list(map(frequent.get, words))
        if None in found:
            total += sum(bpe.lengths.all([w for w, n in zip(words, found) if n is None])) + sum(filter(None, found))
        else:
            total += sum(found)
    return total


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, key, text))
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, frequent = loaded(path), shared.value
        for batch in batches:
            n = [count(bpe, frequent, t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], schema=schema)

    kind = docs.schema[key].dataType
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("k"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("t"))
    return slim.mapInArrow(run, "k long, n_bytes long, n_tokens long").select(F.col("k").cast(kind).alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
