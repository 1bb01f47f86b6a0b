"""Phrase collocation mining (operator 13): SETM over occurrence relations.

Texts are split at marks and line ends into pieces, pieces into words. The relation of length k holds an occurrence of each
phrase of k words, sorted by document, piece and position. It is persisted in blocks (rows) of about ``BLOCK_BYTES`` of text:
the block's phrases, and for each position the number of the phrase there, or -1 where a piece ends or a phrase that is not
frequent stood. As the blocks are sorted, the merge-join by piece and adjacent position needs no shuffle: it compares neighbours
within a block. Its result is counted by phrase (combined in the task, then by a shuffle of counts alone), phrases of fewer than
``min_count`` occurrences go, and the relation is cut down to the frequent ones before the next length.

That semi-join reads a bitmap of ``BITS`` bits (8 MB, whatever the corpus) of the frequent phrases. A phrase whose bit is set by
another one stays in the relation and leaves when its own count is read, so counts are exact.

Words are known by 64-bit hashes of language and word. All words of the corpus are counted with their hashes first; if two of
them share one, all is hashed anew with another seed. (Within a block, equal hashes are told apart by a second one.)

Defined results: null texts are empty; rows without language belong to ``und``; doc_id is not read; repeated rows count each
time; ties are ranked by phrase in byte order; an empty table gives no rows; other columns are ignored. A text longer than a
block is cut between pieces; a single piece stays whole, so a task's memory grows with the longest piece.

Rows of texts and blocks are long, so that Spark's usual batches of them for Python (10,000 rows) and Parquet's usual pages (100
rows before the first look at their size) hold tens of megabytes, several times in each task and outside the heap. Here both
are a few rows (``TEXTS``, ``BLOCKS``), whatever the size of a task; blocks are joined across batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import table, written

MIN_COUNT = 10
MAX_WORDS = 3
#: A phrase goes if a longer one with it has so many hundredths of its occurrences.
SHARE = 50
TOP = 2000
BLOCK_BYTES = 1 << 19
BITS = 26
#: Rows of counts that a task holds before it hands them on, and rows of these in a batch.
HELD = 1 << 18
HANDED = 1 << 15
#: Rows in a batch for Python: of texts, of blocks.
TEXTS, BLOCKS = 256, 8
#: Bytes of texts of all languages that a task holds until they make blocks, in blocks.
OPEN_BLOCKS = 8
LONG_WORD = 64
SALTS = 64
NO_LANGUAGE = "und"

#: Bytes that end a piece, and those between words.
MARKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(MARKS)] = 2
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to ``size``."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit value of several."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


class Words:
    """The words of a block of UTF-8 text: hash, second hash, piece, and where each stands."""

    def __init__(self, text: bytes, seed: int, check: bool = False):
        self.text = text = text.lower()
        raw = np.frombuffer(text, dtype=np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2)[self.start] if len(raw) else np.empty(0, dtype=np.int64)
        self.hash = self._hashed(raw, _BASES[0], seed)
        self.second = self._hashed(raw, _BASES[1], seed + 1) if check else None

    def _hashed(self, raw: np.ndarray, base: int, seed: int) -> np.ndarray:
        size = 1 << max(12, int(len(raw)).bit_length())
        up, down = _powers(base, size)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * down[self.start]
        # long words one by one, as sums of powers are weak there
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            value[i] = xxhash.xxh64_intdigest(self.text[self.start[i] : self.end[i]], base & 0xFFFF)
        return mixed(value, np.full(len(value), seed & (2**64 - 1), dtype=np.uint64))

    def at(self, places: np.ndarray) -> list[bytes]:
        return [self.text[a:b] for a, b in zip(self.start[places].tolist(), self.end[places].tolist())]


def seed_of(lang: str, turn: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), turn)


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of at most a block, cut behind a mark; a single piece stays whole."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        ends = [text.rfind(bytes([m]), at, at + BLOCK_BYTES) for m in MARKS]
        end = max(ends)
        if end < 0:
            end = min((e for m in MARKS if (e := text.find(bytes([m]), at + BLOCK_BYTES)) >= 0), default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    if at < len(text):
        yield text[at:]


def blocks(*batches: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, text) of the rows (lang, text) of batches, joined to blocks by language."""
    return joined_blocks(iter(batches))


def joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """``blocks`` of batches that come one by one. Where many languages meet, the largest open block goes before it is full."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not text.is_valid:
                continue
            for part in _cut(text.as_buffer().to_pybytes()):
                if held.get(lang) and sizes[lang] + len(part) > BLOCK_BYTES:
                    total -= sizes.pop(lang)
                    yield lang, b"\n".join(held.pop(lang))
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                total += len(part) + 1
                if total > OPEN_BLOCKS * BLOCK_BYTES:
                    largest = max(sizes, key=sizes.__getitem__)
                    total -= sizes.pop(largest)
                    yield largest, b"\n".join(held.pop(largest))
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs hands Python at most ``rows`` rows at once, or as many as the session says if these are fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang, word, n) of all words, and the turn of hashing in which all their hashes differ."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
    turn = 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for lang, text in joined_blocks(batches):
                words = Words(text, seed_of(lang, turn), check=True)
                by_hash = np.lexsort((words.second, words.hash))
                h, second = words.hash[by_hash], words.second[by_hash]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])])) if len(h) else by_hash
                n = np.diff(np.append(new, len(h)))
                found = pa.array(words.at(by_hash[new]), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(new), pa.string()), found, _signed(h[new]), pa.array(n, pa.int64())], schema=schema)

        counted = _texts(docs).mapInArrow(run, "lang string, word string, h long, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
        with batches_of(docs.sparkSession, TEXTS):
            counted = written(counted, "words")
        if counted.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return counted, turn
        turn += 1


def bitmap(frequent: DataFrame, names: list[str]) -> np.ndarray:
    """Bits of the phrases whose words' hashes ``frequent`` holds, by the leading ``BITS`` bits of their mix; at most 8 MB come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.unique(mixed(*(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)) >> np.uint64(64 - BITS))
            slot = (key >> np.uint64(6)).astype(np.int32)
            bits = np.uint64(1) << (key & np.uint64(63))
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else slot
            yield pa.record_batch([pa.array(slot[first], pa.int32()), _signed(np.bitwise_or.reduceat(bits, first) if len(slot) else bits)], names=["slot", "bits"])

    parts = frequent.select(*names).mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[parts.column("slot").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return out


def among(bits: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    key = mixed(*hashes) >> np.uint64(64 - BITS)
    return (bits[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) > 0


def relation(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Occurrences ``ids`` as a row of the relation: -1 stands where one is not ``joined`` with the next; those that are joined on no side go."""
    joined = joined[: max(0, len(ids) - 1)]
    if not len(joined):
        return np.empty(0, dtype=np.int32)
    alone = ~(np.append(joined, False) | np.insert(joined, 0, False))
    breaks = np.append(~joined, True)
    kept, breaks = ids[~alone], breaks[~alone]
    out = np.full(len(kept) + int(breaks.sum()), -1, dtype=np.int32)
    out[np.arange(len(kept)) + np.cumsum(breaks) - breaks] = kept
    return out


_BLOCK = "phrases binary, ids binary"


def _number_type(phrases: int) -> str:
    """Of the numbers of so many phrases, and of 0 for none."""
    return "<u2" if phrases < 1 << 16 else "<u4"


def _rows(phrases: list[np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
    """One block: the hashes of each phrase, one after the other, and the occurrences, each as bytes."""
    flat = np.stack(phrases, axis=1).astype("<u8", copy=False)
    return pa.record_batch([pa.array([flat.tobytes()], pa.binary()), pa.array([(ids + 1).astype(_number_type(len(flat))).tobytes()], pa.binary())], names=["phrases", "ids"])


def relation_written(blocks_of: DataFrame, name: str, rows: int) -> DataFrame:
    """Write a relation that is made from batches of ``rows`` rows, in pages of few blocks."""
    with batches_of(blocks_of.sparkSession, rows):
        return written(blocks_of, name, **{"parquet.page.size.row.check.min": BLOCKS, "parquet.page.row.count.limit": BLOCKS, "parquet.block.size": 16 * BLOCK_BYTES})


def _used(phrases: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases that occur, and their new numbers."""
    seen = np.unique(ids[ids >= 0])
    number = np.full(int(seen[-1]) + 2 if len(seen) else 1, -1, dtype=np.int32)
    number[seen] = np.arange(len(seen), dtype=np.int32)
    return [p[seen] for p in phrases], number[ids]


def occurrences(docs: DataFrame, frequent: np.ndarray, turn: int) -> DataFrame:
    """The relation of single words, cut down to those that are frequent and have such a neighbour."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for lang, text in joined_blocks(batches):
            words = Words(text, seed_of(lang, turn))
            at = np.flatnonzero(among(bits, words.hash))
            known, ids = np.unique(words.hash[at], return_inverse=True)
            piece = words.piece[at]
            ids = relation(ids.astype(np.int32), (at[1:] == at[:-1] + 1) & (piece[1:] == piece[:-1]))
            if len(ids):
                yield _rows(*_used([known], ids))

    return _texts(docs).mapInArrow(run, _BLOCK)


def _joined(phrases: np.ndarray, ids: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Merge-join of a block with itself by adjacent position: the hashes of each longer phrase, how often it occurs, and its number at each position (-1: none)."""
    words = phrases.reshape(-1, width)
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    both = (a >= 0) & (b >= 0)
    found, numbers, n = np.unique(a[both] * len(words) + b[both], return_inverse=True, return_counts=True)
    first, last = np.divmod(found, max(1, len(words)))
    at = np.full(len(a), -1, dtype=np.int32)
    at[both] = numbers
    return [*words[first].T, words[last, width - 1]], n, at


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for phrases, ids in zip(batch.column(0), batch.column(1)):
            flat = np.frombuffer(phrases.as_py(), dtype="<u8")
            yield flat, np.frombuffer(ids.as_py(), dtype=_number_type(len(flat) // width)).astype(np.int32) - 1


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of equal phrases as one row; rows with another phrase of the same mix between them stay apart."""
    order = np.argsort(mixed(*columns))
    columns = [c[order] for c in columns]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


def phrase_counts(blocks_of: DataFrame, width: int, min_count: int) -> DataFrame:
    """(h0, h1, ..., a): phrases of ``width`` + 1 words that occur ``min_count`` times or more, from the relation of ``width``."""
    names = [f"h{i}" for i in range(width + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*(c for c, _ in held))]
            columns, n = _summed(columns, np.concatenate([n for _, n in held]))
            held.clear()
            for i in range(0, len(n), HANDED):
                yield pa.record_batch([*(_signed(c[i : i + HANDED]) for c in columns), pa.array(n[i : i + HANDED], pa.int64())], names=[*names, "a"])

        for phrases, ids in _each(batches, width):
            columns, n, _ = _joined(phrases, ids, width)
            if len(n):
                held.append((columns, n))
                size += len(n)
            if size > HELD:
                yield from out()
                size = 0
        if held:
            yield from out()

    counted = blocks_of.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", a long")
    return counted.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def extended(blocks_of: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """The relation of ``width`` + 1, cut down to phrases that are frequent and have such a neighbour."""
    shared = blocks_of.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for phrases, ids in _each(batches, width):
            columns, n, at = _joined(phrases, ids, width)
            if not len(n):
                continue
            at = np.where(at >= 0, np.where(among(shared.value, *columns)[at], at, -1), -1)
            here = np.flatnonzero(at >= 0)
            at = relation(at[here], here[1:] == here[:-1] + 1)
            if len(at):
                yield _rows(*_used(columns, at))

    return blocks_of.mapInArrow(run, _BLOCK)


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def _score(left: str, right: str) -> Column:
    """floor(1000000 a^2 / (l r)), in decimals of 38 digits."""
    return F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def candidates(counts: list[DataFrame], share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases of two words or more that no longer one covers. ``counts``: by length; of words h0, lang, phrase, a."""
    named = [counts[0]]
    out = None
    for k in range(2, len(counts) + 1):
        names = [f"h{i}" for i in range(k)]
        # the phrase from that of its first k - 1 words and its last word
        head = named[-1].select(*names[:-1], "lang", F.col("phrase").alias("head"))
        tail = counts[0].select(F.col("h0").alias(names[-1]), F.col("phrase").alias("tail"))
        rows = counts[k - 1].join(head, names[:-1]).join(tail, names[-1]).select(*names, "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a")
        named.append(rows := written(rows, f"phrases-{k}") if k < len(counts) else rows)
        for cut in range(1, k):
            left = counts[cut - 1].select(*names[:cut], F.col("a").alias(f"l{cut}"))
            right = counts[k - cut - 1].select(*(F.col(f"h{i}").alias(names[cut + i]) for i in range(k - cut)), F.col("a").alias(f"r{cut}"))
            rows = rows.join(left, names[:cut]).join(right, names[cut:])
        if k < len(counts):
            longer = [counts[k].select(*(F.col(f"h{i + at}").alias(names[i]) for i in range(k)), F.col("a").alias("longer")) for at in (0, 1)]
            most = longer[0].unionByName(longer[1]).groupBy(*names).agg(F.max("longer").alias("longer"))
            rows = rows.join(most, names, "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
        least = F.array_min(F.array(*(F.struct(_score(f"l{c}", f"r{c}").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k))))
        rows = rows.select("lang", "phrase", "a", least.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to ``max_words`` words of each language."""
    words, turn = word_counts(docs)
    frequent = words.where(F.col("n") >= min_count)
    counts = [frequent.select(F.col("h").alias("h0"), "lang", F.col("word").alias("phrase"), F.col("n").alias("a"))]
    found = relation_written(occurrences(docs, bitmap(frequent, ["h"]), turn), "occurrences-1", TEXTS)
    for width in range(1, max_words):
        with batches_of(docs.sparkSession, BLOCKS):
            counts.append(written(phrase_counts(found, width, min_count), f"counts-{width + 1}"))
        if width + 1 < max_words:
            found = relation_written(extended(found, width, bitmap(counts[-1], [f"h{i}" for i in range(width + 1)])), f"occurrences-{width + 1}", BLOCKS)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = candidates(counts, share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # a language may hold most phrases, so the first of each share of them are found before the first of all
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH pieces AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
occ AS (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM pieces),
totals AS (SELECT lang, count(*) AS n FROM occ GROUP BY lang),
f1 AS (SELECT lang, w, count(*) AS f FROM occ GROUP BY ALL),
f2 AS (SELECT x.lang, x.w AS w1, y.w AS w2, count(*) AS f FROM occ x JOIN occ y ON y.piece = x.piece AND y.i = x.i + 1 GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT x.lang, x.w AS w1, y.w AS w2, z.w AS w3, count(*) AS f FROM occ x JOIN occ y ON y.piece = x.piece AND y.i = x.i + 1 JOIN occ z ON z.piece = x.piece AND z.i = x.i + 2 GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, l.f AS l, r.f AS r, 1 AS k FROM f2 p JOIN f1 l ON l.lang = p.lang AND l.w = p.w1 JOIN f1 r ON r.lang = p.lang AND r.w = p.w2
  LEFT JOIN inside q ON q.lang = p.lang AND q.w1 = p.w1 AND q.w2 = p.w2 WHERE coalesce(100 * q.f < 50 * p.f, true)
  UNION ALL SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, l.f, r.f, 1 FROM f3 p JOIN f1 l ON l.lang = p.lang AND l.w = p.w1 JOIN f2 r ON r.lang = p.lang AND r.w1 = p.w2 AND r.w2 = p.w3
  UNION ALL SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, l.f, r.f, 2 FROM f3 p JOIN f2 l ON l.lang = p.lang AND l.w1 = p.w1 AND l.w2 = p.w2 JOIN f1 r ON r.lang = p.lang AND r.w = p.w3),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) QUALIFY rank <= 2000"""
