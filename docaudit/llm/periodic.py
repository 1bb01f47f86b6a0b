"""Periodic runs of words (operator 12): suffix-tree LCE over a document and its reversal, Lyndon-root candidates extended both ways.

A run is a stretch of consecutive words with smallest period q and at least max(``MIN_WORDS``, 2 q) words that no neighbouring
word extends. Every run holds a Lyndon word of its period, least by one of the two orders of the alphabet, that is the longest
one at its place; such words end where the next smaller (or, by the other order, next greater) suffix starts. So the places
and their next smaller and greater suffixes are all candidates, two a word. Each is extended to the right by the longest common
extension of its two places in the document and to the left by that in the reversal. Both come from a suffix tree built by
Ukkonen's algorithm: the string depth of the lowest common ancestor of two leaves is the least one on the Euler tour between
them, looked up in constant time in a table of minima. Of the tour only the shallowest visit between two leaves is kept.

In a run of ``MIN_WORDS`` words or more every word stands in some piece of ``MIN_WORDS // 2`` words that the run holds twice.
So words outside repeated pieces are left out before the trees are built, again and again until each stretch that is left
repeats itself; what is left holds every run whole. Most texts have none.

Documents are rows, spread by Spark; nothing is shuffled. A worker holds one document at a time; the trees take some hundred
bytes for each word of its repeated stretches.

Defined results: null and empty texts have no words and no runs; a document without doc_id has no planted period; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored. Keys are integers or strings of
digits; a key that is no whole number is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import table

MIN_WORDS = 12
#: Documents that a worker hands on at once.
ROWS = 512

Run = tuple[int, int, int]


class SuffixTree:
    """Suffix tree of a list of symbols from 1 on, to which an end mark 0 is added; ``rank`` of each suffix, and the longest common extension of any two places."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.size, width = len(s), max(s) + 1
        start, stop, edge = self._built(s, width)
        order, common = self._leaves(start, stop, edge, width)
        self.rank = np.empty(self.size, dtype=np.int64)
        self.rank[order] = np.arange(self.size)
        # minima over stretches of 2^k neighbouring leaves
        self.least = [np.asarray(common, dtype=np.int32)]
        step = 1
        while 2 * step <= self.size:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    @staticmethod
    def _built(s: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
        """Ukkonen's algorithm: begin and end of the edge above each node, and node * width + symbol -> child. Leaves end with the text."""
        n = len(s)
        start, stop, link, edge = [0], [0], [0], {}
        node = at = length = pending = 0
        for i, c in enumerate(s):
            pending += 1
            last = 0
            while pending:
                if not length:
                    at = i
                key = node * width + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    span = stop[child] - begin
                    if length >= span:
                        at += span
                        length -= span
                        node = child
                        continue
                    follows = s[begin + length]
                    if follows == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = len(start)
                    start += (begin, i)
                    stop += (begin + length, n)
                    link += (0, 0)
                    edge[key] = inner
                    edge[inner * width + c] = inner + 1
                    edge[inner * width + follows] = child
                    start[child] = begin + length
                    if last:
                        link[last] = inner
                    last = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - pending + 1
        return start, stop, edge

    @staticmethod
    def _leaves(start: list[int], stop: list[int], edge: dict[int, int], width: int) -> tuple[list[int], list[int]]:
        """Suffixes in order, and the string depth of the lowest common ancestor of each with the one before it."""
        n = max(stop)
        keys = np.fromiter(edge.keys(), dtype=np.int64, count=len(edge))
        by_key = np.argsort(keys)
        children = np.fromiter(edge.values(), dtype=np.int64, count=len(edge))[by_key].tolist()
        first = np.searchsorted(keys[by_key], np.arange(len(start) + 1, dtype=np.int64) * width).tolist()
        order, common = [], []
        # node, string depth of its parent, depth of the shallowest visit since the last leaf
        todo = [(0, 0, 0)]
        while todo:
            node, above, shallow = todo.pop()
            a, b = first[node], first[node + 1]
            if a == b:
                order.append(start[node] - above)
                common.append(shallow)
                continue
            depth = above + stop[node] - start[node]
            for k in range(b - 1, a, -1):
                todo.append((children[k], depth, depth))
            todo.append((children[a], depth, shallow))
        assert len(order) == n
        return order, common

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of symbols from places ``i`` and ``j`` on (two different ones) that are equal."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            t = self.least[k]
            out[own] = np.minimum(t[low[own]], t[high[own] - (1 << int(k)) + 1])
        return out


def next_beyond(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one of smaller and of greater rank; the last place (the end mark) where there is none."""
    n = len(rank)
    smaller, greater = [n - 1] * n, [n - 1] * n
    low: list[int] = []
    high: list[int] = []
    for j, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = j
        low.append(j)
        while high and rank[high[-1]] < r:
            greater[high.pop()] = j
        high.append(j)
    return smaller, greater


def all_runs(symbols: list[int], min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period), sorted, of all runs of ``symbols`` (from 1 on)."""
    n = len(symbols)
    if n < 2:
        return np.empty((0, 3), dtype=np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    at = np.arange(n, dtype=np.int64)
    roots = [np.stack([at, np.array(to[:n], dtype=np.int64)], axis=1) for to in next_beyond(ahead.rank.tolist())]
    pairs = np.concatenate(roots)
    i, j = pairs[pairs[:, 1] < n].T
    right, left = ahead.extension(i, j), back.extension(n - i, n - j)
    start, period, length = i - left, j - i, j - i + left + right
    long = length >= np.maximum(min_words, 2 * period)
    return np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)


def _covered(ids: np.ndarray, piece: int) -> np.ndarray | None:
    """Which words stand in a piece of ``piece`` words that comes again; none if there is no such word. Pieces that only share a digest may count, too."""
    digest = np.zeros(len(ids) - piece + 1, dtype=np.uint64)
    for k in range(piece):
        digest = digest * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(digest)]
    digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ordered = np.sort(digest)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return None
    again = np.isin(digest, ordered[1:][twice])
    depth = np.zeros(len(ids) + 1, dtype=np.int64)
    depth[: len(again)] += again
    depth[piece : piece + len(again)] -= again
    return np.cumsum(depth[:-1]) > 0


def repeated_stretches(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Stretches (from, to) that hold every run of ``min_words`` words or more whole."""
    piece = max(1, min_words // 2)
    found, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < max(2, min_words) or (covered := _covered(ids[a:b], piece)) is None:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).reshape(-1, 2) + a
        if len(edges) == 1 and tuple(edges[0]) == (a, b):
            found.append((a, b))
        else:
            todo += [(int(x), int(y)) for x, y in edges]
    return sorted(found)


def runs(words: list, min_words: int = MIN_WORDS) -> list[Run]:
    """(start, length, period) of all runs of a document's words, by start, then period."""
    if len(words) < max(2, min_words):
        return []
    codes: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    stretches = repeated_stretches(ids, min_words)
    if not stretches:
        return []
    # stretches go into one text, with a mark of its own behind each
    parts, places, shift = [], [], 0
    for k, (a, b) in enumerate(stretches):
        parts += [ids[a:b].astype(np.int64), np.array([len(codes) + k])]
        places.append((shift, a))
        shift += b - a + 1
    _, symbols = np.unique(np.concatenate(parts), return_inverse=True)
    found = all_runs((symbols + 1).tolist(), min_words)
    begins = np.array([p for p, _ in places])
    offset = np.array([a - p for p, a in places])
    found[:, 0] += offset[np.searchsorted(begins, found[:, 0], side="right") - 1]
    return [tuple(r) for r in found[np.lexsort((found[:, 2], found[:, 0]))].tolist()]


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words joined by one space, without those that some run holds after its first period."""
    if not found:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the period that the digest of ``doc_id`` asks for, if any."""
    digest = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if digest % 10 or not n:
        return words
    g = digest // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + period]
    return words[:a] + (piece * ((n - a) // period + 1))[: n - a]


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces, tabs and line ends, in UTF-8."""
    return (text or "").encode("utf-8").split()


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def summary(words: list[bytes], found: list[Run]) -> tuple:
    """The columns of ``RESULT`` of one document."""
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return (len(found), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest())


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """``key`` and the columns of ``RESULT`` of every row; ``plant``: documents get the period that their doc_id asks for first."""
    schema = pa.schema([("k", pa.int64()), *zip([c.split()[0] for c in RESULT.split(", ")], _TYPES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1)):
                    words = words_of(t.as_py())
                    words = planted(words, k) if plant else words
                    rows.append(summary(words, runs(words, min_words)))
                yield pa.record_batch([part.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*rows), _TYPES))], schema=schema)

    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"k long, {RESULT}").withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)


def without_repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each run cut down to its first period. Texts without runs, null ones included, stay as they are; others get single spaces."""
    at = docs.columns.index(text)

    def cut(value: str | None) -> str | None:
        words = words_of(value)
        found = runs(words, min_words)
        return collapsed(words, found).decode("utf-8") if found else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([cut(t.as_py()) for t in columns[at]], batch.schema.field(at).type)
            yield pa.record_batch(columns, schema=batch.schema)

    # names may hold dots, which mapInArrow doesn't take
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
