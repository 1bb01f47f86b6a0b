"""Exact top-k search by inner product with block-at-a-time pruning (operator 8).

Components are terms, floor(64 * x) is the weight of a term in a document. The rows are sorted by vec_id and cut into
blocks of ``BLOCK_DOCS``; a block holds the largest and the smallest weight of each term. For a query, the sum over
the terms of weight times largest (smallest, where the query's weight is negative) bounds every score in the block.
Each query takes the blocks in falling order of its bounds, scores them through the block's forward index (its rows of
weights) and stops once the bound falls below its k-th score so far; at equality it goes on, as ties go to smaller ids.

Queries come in blocks with a fixed bound, each of which is searched, ranked and written before the next. Weights are
multiplied as doubles where all sums stay below 2 ** 53, so they are exact, as 64-bit integers where they stay below 2 ** 63,
and as Python's integers otherwise.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
vectors of different lengths are not compared; rows with the query's vec_id are its own; a repeated vec_id asks once, with
its least vector, and each of its rows is a candidate; fewer candidates than k all come back; a score beyond 64 bits comes
back as the largest (smallest) 64-bit integer; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import table, written
from docaudit.llm.vectors import chunks, in_query_blocks, lengths, ranked, rows_of, usable

SCALE = 64
TOP = 20
EVERY = 20
BLOCK_DOCS = 256
CHUNK = 64 * BLOCK_DOCS
FOUND = "query_id long, rank int, vec_id long, score long"
LARGEST = 2**63 - 1


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k = k
        self.score = np.zeros((queries, k), dtype=kind)
        self.ids = np.zeros((queries, k), dtype=np.int64)
        self.n = np.zeros(queries, dtype=np.int64)

    def full_kth(self) -> tuple[np.ndarray, np.ndarray]:
        return self.n == self.k, self.score[:, self.k - 1]

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Flat arrays of query place, score and id."""
        old = np.unique(q)
        x, y = np.nonzero(np.arange(self.k) < self.n[old][:, None])
        q, score, ids = np.concatenate([q, old[x]]), np.concatenate([score, self.score[old[x], y]]), np.concatenate([ids, self.ids[old[x], y]])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        begin = np.searchsorted(q, q)
        rank = np.arange(len(q)) - begin
        keep = rank < self.k
        self.score[q[keep], rank[keep]], self.ids[q[keep], rank[keep]] = score[keep], ids[keep]
        self.n[old] = np.minimum(self.k, np.bincount(q, minlength=len(self.n))[old])


def integers(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole-numbered doubles as ``kind``; as Python's integers for ``object``."""
    return np.vectorize(int, otypes=[object])(x) if kind is object else x.astype(kind)


def search(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = None
        for chunk in chunks(batches, CHUNK):
            docs, w = chunk.column(0).to_numpy(), rows_of(chunk.column(1).combine_chunks())
            largest = np.abs(w).max() * np.abs(queries).max() * w.shape[1]
            kind = np.float64 if largest < 2.0**53 else np.int64 if largest < 2.0**62 else object
            w, q = integers(w, kind), integers(queries, kind)
            if best is None:
                best = Best(len(ids), k, np.int64)
            blocks = [slice(s, s + BLOCK_DOCS) for s in range(0, len(docs), BLOCK_DOCS)]
            high, low = np.stack([w[b].max(axis=0) for b in blocks]), np.stack([w[b].min(axis=0) for b in blocks])
            bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            order = np.argsort(-bound, axis=1, kind="stable")
            live = np.ones(len(ids), dtype=bool)
            for turn in range(len(blocks)):
                full, kth = best.full_kth()
                at = order[:, turn]
                live &= ~full | (bound[np.arange(len(ids)), at] >= kth)
                if not live.any():
                    break
                for b in np.unique(at[live]):
                    who = np.flatnonzero(live & (at == b))
                    score = q[who] @ w[blocks[b]].T
                    names = docs[blocks[b]]
                    ok = ~full[who][:, None] | (score >= kth[who][:, None])
                    ok &= names[None, :] != ids[who][:, None]
                    x, y = np.nonzero(ok)
                    if len(x):
                        best.add(who[x], np.clip(score[x, y], -LARGEST - 1, LARGEST).astype(np.int64), names[y])
        if best is not None:
            x, y = np.nonzero(np.arange(k) < best.n[:, None])
            yield pa.record_batch([pa.array(ids[x]), pa.array(best.ids[x, y]), pa.array(best.score[x, y])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products for each row whose vec_id is divisible by ``every``."""
    rows = usable(vectors, nonzero=False).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    parts = []
    for d in lengths(rows):
        own = rows.where(F.size("v") == d)
        index = written(own.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "forward")
        parts.append(in_query_blocks(index, F.col("vec_id") % every == 0, lambda ids, queries, index=index: ranked(search(index, ids, queries, k), k), FOUND))
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], FOUND)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {TOP}
"""
