"""Toxicity (operator 11): a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding: compatibility forms, lower case, marks that don't show go, letters of other scripts that look like Latin ones become those
(``HOMOGLYPHS``), and digits and signs within words become the letters they stand for (``SUBSTITUTES``); l, 1, | and ! are one letter
with i. What is no letter or digit becomes one space, so every word stands between spaces.

The lexicon holds whole words and beginnings of words. A word of a text counts by its longest entry, unless an exception phrase
covers it. A document's density is the sum of its weights by the number of its words (``SMOOTH`` added), and its score
the sigmoid of a line over the logarithm of density.

Entries, their weights, exceptions and the line are learnt from labelled rows: the ``sample_rows`` of them whose hashed doc_id is
smallest, counted in Spark by word, as documents with equal texts may repeat, each different text once. An entry's weight is
its log odds: how much commoner it is in toxic texts than in others. ``BASE_LEXICON`` holds where the labels say nothing about
a word; ``BASE_EXCEPTIONS`` always hold, and phrases of an entry with a neighbour that stand in clean texts again and again
and never in a toxic one join them. The lexicon has at most ``MAX_ENTRIES`` entries, so what is broadcast is bounded. Every whole
text is scored in one pass without a shuffle. Language, source, doc_id and labels are never inputs of a score.

Defined results: null text scores as an empty one, which has density 0. Rows with a null label or doc_id are not learnt from; of
several labels of one doc_id all are. Without labels of both kinds the base lexicon, its weights and ``DEFAULT_LINE`` are
used. Repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import table, written
from docaudit.llm.quality import fold

SAMPLE_ROWS = 24_000
MAX_ENTRIES = 4096
MAX_EXCEPTIONS = 1024
#: Least number of different toxic texts with an entry, how much commoner (times) it is there, and least significance.
LEAST_TEXTS, LEAST_TIMES, LEAST_Z = 3, 8.0, 6.0
#: Letters of the shortest beginning of words that can be an entry, and of the longest.
SHORTEST, LONGEST = 4, 8
#: Least number of clean texts with an exception phrase.
EXCEPTION_TEXTS = 4
SMOOTH = 8.0
THRESHOLD = 0.5
DEFAULT_LINE = (-3.0, 3.0)
BASE_WEIGHT = 4.0

#: Letters that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "авекмнорстухіјѕԁһӏԛԝгп" "αβγεζηικνορτυχω" "ɑɡɩıʟɴʀʏᴀʙᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ" "øłđŧħ",
    "abekmhopctyxijsdhlqwrn" "abyeznikvoptuxw" "agiilnryabcdejkmoptuvwz" "oldth",
)
#: Digits and signs that stand for letters within words.
SUBSTITUTES = str.maketrans("013456789@$!|+€", "oieasgtbgasiitE".lower())
#: Insults, whole words, and phrases that hold one and are none.
BASE_LEXICON = "idiot stupid moron clown loser scum trash worthless pathetic disgusting".split()
BASE_EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "empty the trash", "clown fish", "clown car", "circus clown",
    "pathetic fallacy", "pond scum", "soap scum", "the loser of the match", "idiot proof", "idiot light",
)

_HIDDEN = re.compile("[­​-‏⁠-⁤︀-️﻿̀-ͯ҈҉]")
_STANDS_FOR = re.compile(r"(?<![\d.,])[013456789@$!|+€]+(?=[^\W\d_])|(?<=[^\W\d_])[013456789@$!|+€]+(?=[^\W_])")
_ODD_DIGIT = re.compile(r"[^\W\d_][013456789@$!|+€]|[013456789@$!|+€][^\W\d_]")
_BETWEEN = re.compile(r"[\W_]+")
_ONE_LETTER = str.maketrans("l", "i")


def folded(text: str | None) -> str:
    """The words of a text between single spaces, with a space at both ends."""
    text = text or ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", unicodedata.normalize("NFKC", text).lower())).translate(HOMOGLYPHS)
    if _ODD_DIGIT.search(text):
        text = _STANDS_FOR.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    text = _BETWEEN.sub(" ", text).translate(_ONE_LETTER).strip()
    return f" {text} " if text else " "


def n_words(text: str) -> int:
    return text.count(" ") - 1


@dataclass
class Lexicon:
    """``entries``: folded words with a space before and, if whole, behind, and their weights; ``exceptions``: folded phrases between spaces; ``line``: intercept and slope."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    line: tuple[float, float] = DEFAULT_LINE
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self) -> ahocorasick.Automaton:
        """Entries and exceptions in one automaton, built once in each worker."""
        if self._machine is None:
            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), None))
            for entry, weight in self.entries.items():
                if entry not in made:
                    made.add_word(entry, (len(entry), weight))
            if len(made):
                made.make_automaton()
            self._machine = made
        return self._machine

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of each word of a folded text that counts: its longest entry, if no exception covers its begin."""
        if not len(self.machine):
            return []
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for last, (size, weight) in self.machine.iter(text):
            begin = last + 1 - size
            if weight is None:
                free.append((begin, last))
            elif best.get(begin, (0, 0.0))[0] < size:
                best[begin] = (size, weight)
        return [(a, a + n, w) for a, (n, w) in best.items() if not any(x <= a < y for x, y in free)]

    def density(self, text: str) -> float:
        return max(0.0, sum(w for _, _, w in self.hits(text))) / (n_words(text) + SMOOTH)

    def score(self, text: str | None) -> float:
        low = self.line[0] + self.line[1] * feature(self.density(folded(text)))
        return float(1.0 / (1.0 + np.exp(-np.clip(low, -35, 35))))


def feature(density: float) -> float:
    return float(np.log1p(100.0 * density))


def base() -> Lexicon:
    """The lexicon without anything learnt."""
    return Lexicon({f" {folded(w).strip()} ": BASE_WEIGHT for w in BASE_LEXICON}, tuple(sorted(folded(p) for p in BASE_EXCEPTIONS)))


def _words_of(rows: DataFrame) -> DataFrame:
    """(label, word): the different folded words of each text, with a space at both ends, and the different beginnings of words with one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = {w for w in folded(text.as_py()).split() if len(w) <= 64}
                begins = {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}
                found = [f" {w} " for w in words] + [f" {w}" for w in begins]
                yield pa.record_batch([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], names=["label", "word"])

    return rows.select("label", "text").mapInArrow(run, "label int, word string")


def sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(label, text): at most ``sample_rows`` labelled rows, each different text with a label once."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return written(rows.groupBy("digest", "label").agg(F.min("text").alias("text")).select("label", "text"), "labelled")


def weighted(words: DataFrame, texts: tuple[int, int]) -> dict[str, float]:
    """Entries and weights from the number of toxic (``t``) and clean (``c``) texts of each word; ``texts``: how many clean and toxic ones there are."""
    clean, toxic = texts
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    expected = F.col("c") * toxic / clean
    z = (F.col("t") - expected) / F.sqrt(expected + 1)
    kept = words.select("word", "t", odds.alias("odds"), z.alias("z")).where((F.col("t") >= LEAST_TEXTS) & (F.col("odds") >= float(np.log(LEAST_TIMES))) & (F.col("z") >= min(LEAST_Z, LEAST_TEXTS * 0.9)))
    # the beginning of a single word says no more than that word
    begins = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word") - 3)), lambda n: F.substring("word", F.lit(1), n + 1))
    whole = words.where(F.col("word").endswith(" ") & (F.length("word") > SHORTEST + 2) & (F.col("t") > 0))
    of_words = whole.select(F.explode(begins).alias("word"), F.col("t").alias("most")).groupBy("word").agg(F.max("most").alias("most"))
    kept = kept.join(of_words, "word", "left").where(F.col("word").endswith(" ") | (2 * F.col("most") <= F.col("t")))
    found = kept.orderBy(F.desc("z"), "word").limit(MAX_ENTRIES).toPandas()
    return dict(zip(found["word"], found["odds"].astype(float)))


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression by Newton's steps, with a little ridge so that separable labels end, too."""
    data = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(data @ w, -35, 35)))
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + ridge, data.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learnt(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Lexicon, exceptions and line from at most ``sample_rows`` labelled rows."""
    rows = sample(docs, labels, label, sample_rows)
    counts = dict(rows.groupBy("label").count().collect())
    start = base()
    if len(counts) < 2:
        return start
    texts = counts[0], counts[1]
    words = written(_words_of(rows).groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "lexicon")
    entries = weighted(words, texts)
    known = words.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in start.entries], "word string")), "word").where("t + c >= 3").select("word").toPandas()["word"]
    lexicon = Lexicon({w: v for w, v in start.entries.items() if w not in set(known)} | entries, start.exceptions)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each entry that counts with the word before and with the word behind it."""
        for batch in batches:
            out = set()
            for i, (y, text) in enumerate(zip(batch["label"], batch["text"])):
                text = folded(text)
                for a, b, _ in lexicon.hits(text):
                    before, after = text.rfind(" ", 0, a), text.find(" ", max(b, a + 1) if text[b - 1] != " " else b - 1)
                    if before >= 0:
                        out.add((i, y, text[before : after + 1]))
                    if (behind := text.find(" ", after + 1)) >= 0:
                        out.add((i, y, text[a : behind + 1]))
            yield pd.DataFrame([(y, p) for _, y, p in out], columns=["label", "phrase"])

    phrases = rows.mapInPandas(near, "label int, phrase string").where(F.length("phrase") <= 130).groupBy("phrase").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    harmless = phrases.where(f"t = 0 and n >= {EXCEPTION_TEXTS}").orderBy(F.desc("n"), "phrase").limit(MAX_EXCEPTIONS).toPandas()["phrase"]
    lexicon = Lexicon(lexicon.entries, tuple(sorted({*start.exceptions, *harmless})))

    def densities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [feature(lexicon.density(folded(t))) for t in batch["text"]]})

    seen = rows.mapInPandas(densities, "label int, x double").toPandas().sort_values(["x", "label"])
    return Lexicon(lexicon.entries, lexicon.exceptions, _line(seen["x"].to_numpy(), seen["label"].to_numpy(dtype=float)))


def toxicity(docs: DataFrame, lexicon: Lexicon | None = None, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` rows as key, score, predicted, n_hits and n_words."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon or base())
    names = ["k", "score", "predicted", "n_hits", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            weight, hits, words = [], [], []
            for t in batch.column(1):
                text = folded(t.as_py())
                found = own.hits(text)
                hits.append(len(found))
                words.append(n_words(text))
                weight.append(max(0.0, sum(w for _, _, w in found)))
            x = np.log1p(100.0 * np.array(weight) / (np.array(words) + SMOOTH))
            p = 1.0 / (1.0 + np.exp(-np.clip(own.line[0] + own.line[1] * x, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], names=names)

    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col("text").cast("string").alias("t"))
    out = slim.mapInArrow(run, "k long, score double, predicted int, n_hits long, n_words long")
    return out.select(F.col("k").cast(kind).alias(key), "score", "predicted", "n_hits", "n_words")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learnt(docs, table(spark, sf_dir, "labels").where(fold() != 0))
    return toxicity(docs, lexicon).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "n_words")
