"""Operator 11: folding, matching against brute force, learning, held-out accuracy."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from docaudit.llm import toxicity as T
from docaudit.llm.quality import fold


@pytest.mark.parametrize(
    "text",
    ["idiot", "IDIOT", "іdіоt", "1d10t", "ｉｄｉｏｔ", "id­i​ot", "i̇diot", "!diot", "|d|ot", "ιdιοt", "idiot!!!", "(idiot)", "idiot###", "ld1ot"],
)
def test_disguises(text):
    assert T.folded(text) == " idiot " and T.base().score(f"you {text}") > 0.5


def test_folding_leaves_words_alone():
    assert T.folded("Route 66, 3.5 % of 1,000 $5 it's ÉTÉ") == " route 66 3 5 of 1 000 5 it s été "
    assert [T.folded(x) for x in (None, "", " ", "...", "a")] == [" ", " ", " ", " ", " a "]
    assert [T.n_words(T.folded(x)) for x in (None, "...", "a", "a b. c")] == [0, 0, 1, 3]


def brute_hits(lexicon, text):
    """Every entry and exception is looked for at every place."""
    out = []
    for a in range(len(text)):
        own = [e for e in lexicon.entries if text.startswith(e, a)]
        free = any(text.startswith(p, x) and x <= a < x + len(p) - 1 for p in lexicon.exceptions for x in range(a + 1))
        if own and not free:
            best = max(own, key=len)
            out.append((a, a + len(best), lexicon.entries[best]))
    return out


def test_hits_against_brute_force():
    rng = random.Random(1)
    words = "idiot idiots idea trash can trashy the clown fish clownish a".split()
    entries = {" idiot ": 2.0, " idio": 1.0, " trash ": 3.0, " clow": 1.5, " clown ": 4.0, " the ": -0.5}
    lexicon = T.Lexicon(entries, (" trash can ", " clown fish ", " the clown "))
    for _ in range(200):
        text = f" {' '.join(rng.choice(words) for _ in range(rng.randint(0, 12)))} ".replace("  ", " ")
        hits = lexicon.hits(text)
        assert sorted(hits) == brute_hits(lexicon, text)
        weight = max(0.0, math.fsum(w for _, _, w in hits))
        assert lexicon.density(text) == pytest.approx(weight / (max(0, T.n_words(text)) + T.SMOOTH))


def test_exceptions_and_length():
    base = T.base()
    assert base.score("please empty the trash can") < 0.5 < base.score("you are trash")
    assert base.score("idiot") > base.score("idiot " + "word " * 50) > base.score("word " * 50)
    assert T.Lexicon({}).score("idiot") == pytest.approx(1 / (1 + math.exp(3)))


ODD = [(1, None), (2, ""), (3, " \n"), (4, "idiot"), (5, "x" * 200_000), (6, "word " * 50_000 + "idiot"), (7, "You M0R0N, you l0s3r"), (7, "You M0R0N, you l0s3r"), (None, "idiot")]


def test_odd_rows_and_equal_scores(spark):
    docs = spark.createDataFrame([(*r, 9, "a") for r in ODD], "doc_id long, text string, score int, k string")
    got = T.toxicity(docs).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for k, t in ODD if k == r["doc_id"])
        assert r["score"] == pytest.approx(T.base().score(text)) and r["predicted"] == (r["score"] >= 0.5)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0, 7: 1, None: 1}
    assert T.toxicity(docs.limit(0)).collect() == []


def test_learning(spark):
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=60)
        toxic = i % 4 == 0
        if toxic:
            words += [f"zorgl{rng.choice('abcdefghjkmnpqrstuvw')}" for _ in range(4)] + ["bl1bber"]
        elif i % 20 == 1:
            words += ["blibber", "oil"]
        rng.shuffle(words)
        text = " ".join(words).replace("blibber", "blibber oil")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    labels += [(1000 + i, 1) for i in range(50)] + [(None, 1), (3, None), (999_999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = T.learnt(docs, known)
    assert " zorgi" in lexicon.entries and not any(w.startswith(" w1") for w in lexicon.entries)
    assert " biibber oii " in lexicon.exceptions
    wrong = T.toxicity(docs, lexicon).join(known.dropna(), "doc_id").where("predicted <> toxic").count()
    assert wrong == 0
    # equal texts count once, so a word of one text, copied fifty times, is no entry
    once = {r["word"]: r["t"] for r in T._words_of(T.sample(docs, known, "toxic", 1000)).groupBy("word").agg(F.sum("label").alias("t")).where("t > 90").collect()}
    assert once[" biibber "] <= 101
    assert T.learnt(docs, known.where("toxic = 0")) == T.base()
    assert T.learnt(docs, known.limit(0)) == T.base()


def test_held_out_accuracy(spark):
    from docaudit.llm.common import table

    d = "/root/testdata/sf0.1"
    got = T.op11_toxicity(spark, d)
    assert got.count() == table(spark, d, "documents").count()
    pairs = got.where("held_out").join(table(spark, d, "labels"), "doc_id").select("toxic", "predicted").collect()
    toxic = [p for t, p in pairs if t]
    assert sum(t == p for t, p in pairs) / len(pairs) > 0.97 and sum(toxic) / len(toxic) > 0.9
    assert got.where(fold() != 0).where("held_out").isEmpty()
