"""Operator 13 against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docaudit.llm import collocations as C


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, min_count, max_words=3, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in frequent.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(lx == lang and len(q) > len(p) and inside(q) and 100 * b >= share * a for (lx, q), b in frequent.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def made(seed, n=60):
    rng = random.Random(seed)
    words = "a B c dé É 日本 e\x1cf x-y".split(" ")
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ", ", "\r\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), ("en", " .\n."), ("", "q r q r q r"), ("en", "new york city " * 30)]


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"h": F.lit(1), "phrase": F.lit("x"), "a": F.lit(0), "n": F.lit(0)})
    got = C.phrases(docs, **more).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got)


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_equals_brute_force(spark, max_words):
    rows = made(max_words)
    assert found(spark, rows, min_count=3, max_words=max_words, top=25) == brute(rows, 3, max_words, top=25)


def test_empty_table_and_nothing_frequent(spark):
    assert found(spark, []) == [] and found(spark, [("en", "once only")]) == []


def test_blocks_of_one_text(spark, monkeypatch):
    rows = made(9)
    docs = [pa.record_batch([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])]
    whole = Counter()
    monkeypatch.setattr(C, "BLOCK_BYTES", 50)
    for lang, text in C.blocks(docs[0]):
        w = C.Words(text, 1)
        whole.update((lang, x) for x in w.at(np.arange(len(w.start))))
    want = Counter((r[0] or "und", x.encode()) for r in rows for x in re.findall("[^\x20\x09-\x0d.,;:!?]+", lowered(r[1] or "")))
    assert whole == want
    parts = list(C._cut(("long piece without end " * 9 + ". next. " + "tail " * 30).encode()))
    assert b"".join(parts).count(b"tail") == 30 and len(parts) > 1 and all(p.endswith(b".") for p in parts[:-1])


def test_hashes():
    text = ("one two one é " + "x" * 100 + " " + "x" * 100 + " " + "y" * 100).encode()
    w = C.Words(text, 7, check=True)
    words = w.at(np.arange(len(w.start)))
    for values in (w.hash, w.second):
        assert [a == b for a in values for b in values] == [a == b for a in words for b in words]
    other = C.Words(b"Padding here; " + text, 7)
    assert other.hash[2:].tolist() == w.hash.tolist() and C.Words(text, 8).hash[0] != w.hash[0]


def test_words_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    kept = C.written

    def clash(df, name):
        out = kept(df, name)
        return out.withColumn("h", F.lit(1).cast("long")) if len(calls := calls_of.setdefault(name, [])) < 1 and not calls.append(1) else out

    calls_of: dict = {}
    monkeypatch.setattr(C, "written", clash)
    docs = spark.createDataFrame([("en", "a b"), ("de", "a b"), ("en", "a b")], "lang string, text string")
    words, turn = C.word_counts(docs)
    assert turn == 1 and words.select("h").distinct().count() == 4
    assert {(r["lang"], r["word"]): r["n"] for r in words.collect()} == {("en", "a"): 2, ("en", "b"): 2, ("de", "a"): 1, ("de", "b"): 1}


def test_relation():
    ids = np.array([4, 5, 6, 7, 8], dtype=np.int32)
    assert C.relation(ids, np.array([True, False, False, True])).tolist() == [4, 5, -1, 7, 8, -1]
    assert C.relation(ids[:1], np.empty(0, bool)).tolist() == []


def test_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long")
    assert rows.select(C._score("l", "r").alias("s")).first()["s"] == 450_000
