"""Quality classifier (operator 3): logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

Words are runs of letters, of digits or of symbols; features are n-grams of three orders, hashed to ``2 ** BITS``
places: the words of a text, pairs of neighbouring words, and runs of ``WINDOW`` words with each word written as a
reference to the equal ones before it in the run, so that n-grams of words that were never learnt from still meet by
how they repeat. The value of a place is ``SCALE`` times the root of its share of all the
text's n-grams, so long and short texts have feature vectors of one length. L1 regularisation keeps the
weights of rare features at zero.

Fitting takes a bounded sample: the ``sample_rows`` labelled rows whose hashed doc_id is smallest. It is
dealt over ``SHARDS`` groups by that hash; each group trains by itself in a Spark task and the weights are
averaged (one-shot parameter mixing), so the model does not depend on how the table is partitioned. The
weights (at most ``2 ** BITS`` floats) are broadcast and every whole text is scored in one pass without
a shuffle. Language, source, doc_id and labels are never inputs of a score.

Defined results: null text scores as an empty one; an empty text has no features and scores the sigmoid
of the bias. Rows with a null label or doc_id are not learnt from; several labels of one doc_id are all
learnt from. A doc_id that ``documents`` repeats is learnt from once, with its least text. With no labels of one
of the two kinds nothing is learnt and every score is 0.5. Repeated rows get equal scores; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import BoundedCache, table, written

BITS = 18
WINDOW = 4
SHARDS = 4
EPOCHS = 5
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
SCALE = 10.0
ALPHA, BETA, L1, L2 = 0.1, 1.0, 1.0, 1.0
WORD = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
MIX = np.uint64(0x9E3779B97F4A7C15)

_hashes = BoundedCache(lambda word: xxhash.xxh64_digest(word.encode("utf-8", "replace")))


def references(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``WINDOW`` words by which of their words are equal: one bit for each two places of the run."""
    runs = max(0, len(words) - WINDOW + 1)
    code = np.ones(runs, dtype=np.uint64)
    for later in range(1, WINDOW):
        for earlier in range(later):
            code = (code << np.uint64(1)) | (words[later : later + runs] == words[earlier : earlier + runs])
    return code * MIX * MIX


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the n-grams of a text, in rising order, and their values."""
    words = np.frombuffer(b"".join(_hashes.all(WORD.findall(text or ""))), dtype="<u8")
    pairs = (words[:-1] * MIX) ^ (words[1:] >> np.uint64(7))
    places = (np.concatenate([words, pairs * MIX, references(words)]) >> np.uint64(64 - BITS)).astype(np.int32)
    at, times = np.unique(places, return_counts=True)
    return at, SCALE * np.sqrt(times / max(1, len(places)))


def linear(weights: np.ndarray, text: str | None) -> float:
    """Sparse dot product of a text's features with the weights, with the bias, which stands last."""
    at, value = features(text)
    return float(weights[at] @ value + weights[-1])


class Ftrl:
    """FTRL-proximal with per-coordinate rates; place ``2 ** BITS`` is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights (the bias last) learnt from at most ``sample_rows`` labelled rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("label"))
    ids = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    # a repeated doc_id counts once, so a group holds no more rows than were sampled
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(ids), "doc_id").withColumn("shard", F.pmod("h", F.lit(SHARDS)))

    def train(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "doc_id", "label", "text"], kind="stable")
        found = [features(t) for t in part["text"]]
        found = [(np.append(at, np.int32(1 << BITS)), np.append(value, 1.0)) for at, value in found]
        model = Ftrl()
        for _ in range(EPOCHS):
            for (at, value), y in zip(found, part["label"]):
                model.learn(at, value, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at.astype("int32"), "w": w[at], "shard": key[0]})

    parts = rows.groupBy("shard").applyInPandas(train, "at int, w double, shard long")
    parts = written(parts, "quality-weights")
    kinds = ids.agg(F.count_distinct("label")).first()[0]
    out = np.zeros((1 << BITS) + 1)
    if kinds < 2:
        return out
    shards = max(1, parts.select("shard").distinct().count())
    mean = parts.groupBy("at").agg((F.sum("w") / shards).alias("w")).toPandas()
    out[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` rows as key, score and predicted; the whole text of every row is read."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    schema = pa.schema([("k", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            total = np.array([linear(w, t.as_py()) for t in batch.column(1)], dtype=np.float64)
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col("text").alias("t"))
    return slim.mapInArrow(run, "k long, score double, predicted int").select(F.col("k").cast(kind).alias(key), "score", "predicted")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; each text goes through one scoring pass and no join."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        least = np.log(threshold / (1 - threshold))
        for batch in batches:
            total = np.array([linear(w, t.as_py()) for t in batch.column(at)], dtype=np.float64)
            yield batch.filter(pa.array(total >= least))

    # names may hold dots, which mapInArrow doesn't take
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fold(key: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; remainder 0 is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def learnt(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the labelled rows that are not held out."""
    return fit(docs, labels.where(fold() != 0))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = learnt(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
