"""Nearest neighbours by additive quantisation with an exact check (operator 4).

A vector is approximated by the sum of one word from each of ``BOOKS`` codebooks of full-dimensional words.
The codebooks are fitted on a bounded sample (the ``SAMPLE`` vectors whose hash is smallest): residual k-means, then
turns of encoding and least squares over all books together. Every vector is encoded by beam search over the
residuals and stored with its codes, the norm of its approximation and the cosine and sine of the angle between the two.
A query builds a table of its inner products with all words; the sum of a row's entries over its stored norm
approximates the cosine. The ``SHORTLIST`` best of a chunk of rows by that are a query's short list there, which is scored
exactly, in double precision on the original vectors.

How well a sum of words fits differs between tables, so the exact check goes on: a query's angle to a row is at least that to
the row's approximation less the angle between the two. Rows that may, by that bound, be nearer than the k-th best found
so far are scored as well. What is returned is therefore exact on any rows; a bad fit costs time only.

Equal vectors are one entry of the index, with their k + 1 smallest ids, so large groups of copies cost nothing further,
cannot push nearer vectors out of a short list, and ties go to the smaller id. Queries come in blocks with a fixed
bound, each of which is searched, ranked and written before the next.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different lengths are not compared; rows with the query's vec_id are its own and left out; a row
repeated with id and vector counts once; a query with fewer candidates than k returns them all; tables without usable
vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import table, written
from docaudit.llm.topk import Best
from docaudit.llm.vectors import chunks, in_query_blocks, lengths, ranked, rows_of, usable

BOOKS, WORDS, BEAM = 32, 64, 4
SAMPLE = 4096
SHORTLIST = 256
CHUNK = 8192
QUERIES_AT_ONCE = 128
PRODUCTS = 1 << 22
NEAREST = 5
EVERY = 50
FOUND = "query_id long, rank int, vec_id long, score double"


def levelled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its squares neither overflow nor vanish. Its cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = levelled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        near = np.argmin((words * words).sum(1) - 2 * x @ words.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return words


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks (books, words, d) from sample rows of unit length."""
    rng = np.random.RandomState(5)
    k = min(WORDS, max(1, len(x) // 2))
    left, books = x.copy(), []
    for _ in range(BOOKS):
        words = _kmeans(left, k, rng)
        left = left - words[np.argmin((words * words).sum(1) - 2 * left @ words.T, axis=1)]
        books.append(words)
    books = np.stack(books)
    for _ in range(2):
        chosen = np.zeros((len(x), BOOKS * k), dtype=np.float32)
        chosen[np.arange(len(x))[:, None], encode(x, books).astype(np.int64) + np.arange(BOOKS) * k] = 1
        gram = (chosen.T @ chosen).astype(np.float64)
        gram[np.diag_indices(BOOKS * k)] += 1.0
        books = np.linalg.solve(gram, chosen.T @ x + books.reshape(BOOKS * k, -1)).reshape(books.shape).astype(np.float32)
    return books


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes by beam search over the residuals."""
    k = books.shape[1]
    own = (books * books).sum(axis=2)
    codes = []
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        n = len(part)
        left, cost, chosen = part[:, None, :], np.zeros((n, 1), dtype=np.float32), np.zeros((n, 1, 0), dtype=np.uint8)
        for words, square in zip(books, own):
            grown = (cost[:, :, None] + square - 2 * (left @ words.T)).reshape(n, -1)
            at = np.argpartition(grown, min(BEAM, grown.shape[1]) - 1, axis=1)[:, :BEAM]
            path, word = (at // k)[:, :, None], at % k
            cost = np.take_along_axis(grown, at, 1)
            left = np.take_along_axis(left, path, 1) - words[word]
            chosen = np.concatenate([np.take_along_axis(chosen, path, 1), word[:, :, None].astype(np.uint8)], axis=2)
        codes.append(chosen[np.arange(n), cost.argmin(axis=1)])
    return np.concatenate(codes)


def fits(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximations' norms, and cosine and sine of the angles between them and the rows, which have unit length."""
    near = np.zeros(x.shape)
    for i, book in enumerate(books):
        near += book[codes[:, i]]
    norm = np.sqrt((near * near).sum(axis=1))
    near /= np.maximum(norm, 1e-300)[:, None]
    cosine = (x * near).sum(axis=1)
    off = x - cosine[:, None] * near
    return norm, cosine, np.sqrt((off * off).sum(axis=1))


def bounds(near: np.ndarray, room: np.ndarray, cosine: np.ndarray, sine: np.ndarray) -> np.ndarray:
    """Above every cosine that can go with the looked-up ``near``, which rounding moved by at most ``room``: that of the angle to
    the approximation less the angle between it and the row."""
    near = np.clip(near + room, -1, 1)
    return np.where(near >= cosine, 1, near * cosine + np.sqrt(1 - near * near) * sine) + np.float32(4e-6)


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(h, v, names): every different vector with a hash and its ``ids`` smallest ids. No task sorts more than that many ids of a vector before the shuffle."""
    hashed = rows.select(F.xxhash64("v").alias("h"), "v", "vec_id")
    least = hashed.withColumn("place", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("place") <= ids)
    return least.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("names"))


def build_index(entries: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Every entry with its codes and how well they fit, as a written table, and the codebooks."""
    sample = entries.select("v", "h").orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    books = fit(unit(rows_of(sample.column(0).combine_chunks())).astype(np.float32))
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(rows_of(batch.column(0)))
                codes = encode(x.astype(np.float32), shared.value)
                kept = [pa.array(c.astype(np.float32)) for c in fits(x, codes, shared.value)]
                yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), *kept], names=["v", "names", "codes", "norm", "cosine", "sine"])

    coded = entries.select("v", "names").mapInArrow(run, "v array<double>, names array<long>, codes binary, norm float, cosine float, sine float")
    return written(coded, "index"), books


class Chunk:
    """Some entries of the index and what scores them for queries."""

    def __init__(self, table: pa.Table, ids: np.ndarray, queries: np.ndarray, best: Best):
        self.ids, self.queries, self.best = ids, queries, best
        self.v = levelled(rows_of(table.column("v").combine_chunks()))
        self.size, self.asked = np.sqrt((self.v * self.v).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
        names = table.column("names").combine_chunks()
        self.names, self.count = names.flatten().to_numpy(), names.value_lengths().to_numpy()
        self.first = np.cumsum(self.count) - self.count

    def rescore(self, q: np.ndarray, at: np.ndarray) -> None:
        """Exact cosines of queries ``q`` and entries ``at``, for every id of an entry but the query's own."""
        step = max(1, PRODUCTS // self.v.shape[1])
        for start in range(0, len(q), step):
            x, y = q[start : start + step], at[start : start + step]
            score = (self.queries[x] * self.v[y]).sum(axis=1) / (self.asked[x] * self.size[y])
            full, kth = self.best.full_kth()
            good = ~full[x] | (score >= kth[x])
            x, y, score = x[good], y[good], score[good]
            each = np.repeat(np.arange(len(y)), self.count[y])
            names = self.names[np.arange(len(each)) + (self.first[y] - np.cumsum(self.count[y]) + self.count[y])[each]]
            other = names != self.ids[x][each]
            if other.any():
                self.best.add(x[each][other], score[each][other], names[other])

    def check(self, q: slice, open_: np.ndarray) -> None:
        """Scores what is marked in ``open_`` (queries, entries), where products of unit vectors come up to the k-th score."""
        full, kth = self.best.full_kth()
        some, rounding = np.flatnonzero(open_.any(axis=0)), (self.v.shape[1] + 8) * 2.0**-52
        near = (self.queries[q] / self.asked[q, None]) @ (self.v[some] / self.size[some, None]).T
        x, y = np.nonzero(open_[:, some] & (~full[q, None] | (near >= kth[q, None] - rounding)))
        self.rescore(x + q.start, some[y])


def search(index: DataFrame, books: np.ndarray, ids: np.ndarray, queries: np.ndarray, size: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k nearest of each query. In each chunk first the short list is scored, then what its k-th score leaves open."""
    shared = index.sparkSession.sparkContext.broadcast((books, ids, levelled(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, ids, queries = shared.value
        best, asked = Best(len(ids), k, np.float64), unit(queries).astype(np.float32)
        rounding = (len(books) + books.shape[2]) * 2.0**-23 * np.sqrt((books * books).sum(axis=2)).max(axis=1).sum()
        for table in chunks(batches, CHUNK):
            chunk = Chunk(table, ids, queries, best)
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, len(books)).astype(np.int64)
            norm, cosine, sine = (np.maximum(table.column(c).to_numpy(), least) for c, least in (("norm", np.float32(1e-12)), ("cosine", np.float32(-1)), ("sine", np.float32(0))))
            room = np.minimum(rounding / norm, 2).astype(np.float32)
            keep = min(size, len(norm))
            for start in range(0, len(ids), QUERIES_AT_ONCE):
                q = slice(start, min(start + QUERIES_AT_ONCE, len(ids)))
                near = sum(np.take(asked[q] @ book.T, codes[:, i], axis=1) for i, book in enumerate(books)) / norm
                most = bounds(near, room, cosine, sine)
                full, kth = best.full_kth()
                open_ = ~full[q, None] | (most >= kth[q, None])
                at = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                x, y = np.nonzero(np.take_along_axis(open_, at, 1))
                chunk.rescore(x + start, at[x, y])
                np.put_along_axis(open_, at, False, 1)
                full, kth = best.full_kth()
                open_ &= ~full[q, None] | (most >= kth[q, None])
                chunk.check(q, open_)
        x, y = np.nonzero(np.arange(k) < best.n[:, None])
        yield pa.record_batch([pa.array(ids[x]), pa.array(best.ids[x, y]), pa.array(best.score[x, y])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest for each row whose vec_id is divisible by ``every``."""
    rows = usable(vectors, nonzero=True)
    parts = [_nearest(rows.where(F.size("v") == d), every, k, shortlist) for d in lengths(rows)]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], FOUND)


def _nearest(rows: DataFrame, every: int, k: int, shortlist: int) -> DataFrame:
    index, books = build_index(written(distinct_vectors(rows, k + 1), "entries"))

    def found(ids: np.ndarray, queries: np.ndarray) -> DataFrame:
        return ranked(search(index, books, ids, queries, shortlist, k), k)

    return in_query_blocks(rows, F.col("vec_id") % every == 0, found, FOUND)


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
