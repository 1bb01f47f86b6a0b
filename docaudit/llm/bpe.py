"""Byte-pair encoding and decoding of whole texts (operator 5) and the word encoder that token counting (operator 2) shares.

A word is encoded with a contiguous rank array: the symbol ids of the word and, beside them, the rank of
each adjacent pair. The smallest rank is looked for again and again, the boundary behind it is deleted
and the two neighbouring ranks are looked up anew. That is quadratic, so words of over ``SHORT`` symbols
take a heap over a linked list instead, with the same order of merges.

Texts are rows of a DataFrame; Spark deals them out and each Python worker keeps a cache of words, bounded in
bytes. There is no shuffle. Defined results: a null text counts as an empty one (no ids, empty decoded text);
repeated rows give repeated results; an empty table gives no rows; other columns of the input are ignored. Keys
are integers or strings of digits; a key that is no whole number is an error.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import BoundedCache, table

SHORT = 48
ID_BITS = 20
NO_RANK = 1 << 60
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORDS_ASCII = "'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+"

# Where the character tables that the vocabulary's pattern, normal form and lower case go by differ from those of this interpreter.
#: Letters and numbers of Unicode versions that the pattern does not know; to it they are symbols.
NOT_WORDS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Combining marks that the normal form does not know: it neither moves nor joins them.
NOT_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff"
    "\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99"
    "\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
#: Capitals of later Unicode versions and their small letters: single ones, then (first, last, distance).
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL_RANGES = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))

_not_words, _not_marks = regex.compile(f"[{NOT_WORDS}]"), regex.compile(f"([{NOT_MARKS}])")
#: Sigma has one small letter wherever it stands.
_small = {0x3A3: 0x3C3} | SMALL | {c: c + away for first, last, away in SMALL_RANGES for c in range(first, last + 1)}


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 stands for itself, the others are numbered from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in out]
    out |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of lower-cased words with end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: rank and new id of each pair in one number, so that the least number is the pair of least rank
        self.merges = {(vocab[a], vocab[b]): rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        pieces = vocab | self.special
        self.tokens = np.empty(max(pieces.values()) + 1, dtype=object)
        self.tokens[:] = b""
        for piece, i in pieces.items():
            self.tokens[i] = piece.encode("utf-8")
        self.words, self.words_ascii = regex.compile(WORDS), re.compile(WORDS_ASCII)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache = BoundedCache(lambda word: array.array("I", self.merge(word)).tobytes())
        self.lengths = BoundedCache(lambda word: len(self.merge(word)))

    def segments(self, text: str) -> Iterator[str | int]:
        """The id of a special string, or the text between two of them."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text
            return
        for part in self.split_special.split(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield part

    def split(self, text: str) -> list[str]:
        """Normal form C, lower case letter by letter, then words."""
        if text.isascii():
            return self.words_ascii.findall(text.lower())
        if _not_marks.search(text):
            text = "".join(unicodedata.normalize("NFC", part) for part in _not_marks.split(text))
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.translate(_small).lower()
        if not _not_words.search(text):
            return self.words.findall(text)
        # seen as U+FFFD, which is a symbol
        marked = _not_words.sub("\ufffd", text)
        return [text[m.start() : m.end()] for m in self.words.finditer(marked)]

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank_of = self.merges.get
        ranks = [rank_of(pair, NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = new = least & ((1 << ID_BITS) - 1)
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], new), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of((new, ids[at + 1]), NO_RANK)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := self.merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = least & ((1 << ID_BITS) - 1), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (found, i, new, ids[k]))
            if (h := before[i]) >= 0 and (found := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (found, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.segments(text or ""):
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
            else:
                out += self.cache.all(self.split(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the pieces with a space between each two, as the vocabulary names no decoder of its own."""
        return b" ".join(self.tokens[np.frombuffer(ids, dtype="<u4")])


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ids (array<int>) and the decoded text of every row."""
    kind = docs.schema[key].dataType
    schema = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                coded = [bpe.encode(t.as_py()) for t in part.column(1)]
                yield pa.record_batch(
                    [part.column(0), pa.array([np.frombuffer(c, dtype="<i4") for c in coded], pa.list_(pa.int32())), pa.array([bpe.decode(c).decode("utf-8") for c in coded], pa.string())],
                    schema=schema,
                )

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t") if isinstance(text, str) else text.alias("t"))
    return slim.mapInArrow(run, "k long, ids array<int>, decoded string").select(F.col("k").cast(kind).alias(key), "ids", "decoded")


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256 of every row; ids and decoded texts never leave the worker."""
    schema = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=schema)

    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "k long, n_tokens long, ids_sha256 string, decoded_sha256 string").select(F.col("k").cast(kind).alias(key), "n_tokens", "ids_sha256", "decoded_sha256")


def encoded(docs: DataFrame, path: str, places: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, ids (array<int>) and decoded_sha256 of every row, in the order of the rows; ``places``: long columns carried along."""
    kinds = docs.schema["doc_id"].dataType, docs.schema["source"].dataType
    schema = pa.schema([("k", pa.int64()), ("s", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string()), *((c, pa.int64()) for c in places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                coded = [bpe.encode(t.as_py()) for t in part.column(2)]
                ids = pa.array([np.frombuffer(c, dtype="<i4") for c in coded], pa.list_(pa.int32()))
                of_text = pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string())
                yield pa.record_batch([part.column(0), part.column(1), pa.array([len(c) // 4 for c in coded], pa.int64()), ids, of_text, *part.columns[3:]], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("source").cast("string").alias("s"), F.col("text").alias("t"), *places)
    out = slim.mapInArrow(run, "k long, s string, n_tokens long, ids array<int>, decoded_sha256 string" + "".join(f", {c} long" for c in places))
    return out.select(F.col("k").cast(kinds[0]).alias("doc_id"), F.col("s").cast(kinds[1]).alias("source"), "n_tokens", "ids", "decoded_sha256", *places)


def vocabulary() -> str:
    """Place of the public vocabulary file that the queries use; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary())
