"""Vectors by a user's model; masks and spelling matches by written cases."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import lint as L
from docaudit.operators import retrieve as R


def digest(t):
    return hashlib.sha256(t.encode()).hexdigest()


def calls(folder):
    return [line for name in os.listdir(folder) for line in (folder / name).read_text().splitlines()]


@pytest.mark.parametrize("partitions", [1, 7])
def test_each_text_goes_to_the_model_once(spark, tmp_path, partitions):
    import uuid

    def model(texts):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        assert 0 < len(texts) <= 10
        return [[float(len(t)), 1.0] for t in texts]

    texts = [f"text {i % 37}" for i in range(300)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(partitions)
    cache = spark.createDataFrame([(digest("text 3"), [9.0, 9.0]), (digest("text 3"), [9.0, 9.0]), (digest("other"), [1.0, 1.0])], "digest string, v array<double>")
    out = R.embedded(df, model, batch=10, cache=cache)
    got = {r["digest"]: r["v"] for r in out.collect()}
    out.count()
    assert got == {digest(f"text {i}"): [9.0, 9.0] if i == 3 else [float(len(f"text {i}")), 1.0] for i in range(37)}
    assert sorted(calls(tmp_path)) == sorted(f"text {i}" for i in range(37) if i != 3)


def test_wrong_number_of_vectors(spark):
    with pytest.raises(Exception, match="returned 0 vectors"):
        R.embedded(spark.createDataFrame([("a",)], "text string"), lambda texts: [])


def test_retrieval_with_a_model(spark):
    from docaudit.plans import retrieval as Q

    rules = [dict(rule=f"r{i}", title=t, text=t * 2, bad_examples=[], good_examples=[], mandatory=False, priority=50, scope="section", machine_verifiable=False, tasks=[], categories=[]) for i, t in enumerate(["aaab", "bbbb", "zz zz"])]
    rs = spark.createDataFrame(rules, "rule string, title string, text string, bad_examples array<string>, good_examples array<string>, mandatory boolean, priority int, scope string, machine_verifiable boolean, tasks array<string>, categories array<string>")
    ps = spark.createDataFrame([(1, "a a a a", None, None), (2, "bb", None, None), (3, "", None, None)], "chunk long, text string, task string, category string")
    got = {(r["chunk"], r["rank"]): (r["rule"], r["mode"]) for r in R.retrieve_embedded(ps, rs, 2, Q.letter_model).collect()}
    assert got[1, 1] == ("r0", "hybrid") and got[2, 1] == ("r1", "hybrid") and got[3, 1][1] == "fallback"
    # the cosine of (3, 1) and (1, 0) is that of the rule's identity and text, its examples have no vector
    first = R.retrieve_embedded(ps, rs, 2, Q.letter_model).where("chunk = 1 and rank = 1").first()
    assert first["score"] == pytest.approx(0.45 * 0.70 * 3 / 10**0.5 + 0.05)


@pytest.mark.parametrize(
    "text, want",
    [
        ("1 234 просмотра", ""), ("было 5 Просмотров тут", "было тут"), ("12 345 views today", "today"), ("3 view", ""), ("Обновлено вчера в 5\nтекст", "\nтекст"), ("ОБНОВЛЕНО 01.02.2024", ""), ("Last Updated: now", "Last"),
        ("на 01.09.2026 12:30", "на"), ("2024-05-06 в 7:08:09", "в"), ("id 360bf20f-3c4d-45f7-9a53-51ccbd4e0123 end", "id end"), ("hash 0123456789abcdef0 x", "hash x"), ("review 2 parts", "review 2 parts"), ("2 previews", "2 previews"), ("", ""),
    ],
)
def test_volatile_parts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.mask_volatile(F.col("t")).alias("x")).first()["x"]
    assert got.strip() == want.strip()


def test_spelling_matches(spark):
    rows = [
        (1, 5, ".", "PUNCT", "punctuation", "Так ."), (2, 4, ".", "PUNCT", "punctuation", "Так."), (3, 1, ",", "PUNCT", "punctuation", ", да"), (4, 5, "!", "PUNCT", "punctuation", "Раз. Два !"[5:]),
        (5, 1, "выше нового", "Unify_Adj_NN_case", "typos", "Уровень выше нового стандартом"), (6, 1, "выше нового", "Other", "typos", "Уровень выше нового стандартом"), (7, 1, "кое-что", "X", "typos", "кое-что"), (8, 1, "раз - два", "X", "typos", "раз - два"),
        (9, 1, "ашибка", "X", "typos", "ашибка"), (10, 1, "ашибка", "X", "style", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, column int, text string, rule string, category string, whole string")
    got = {r["doc_id"]: (r["text"], r["severity"]) for r in L.spelling_filter(df).collect()}
    assert got == {1: ("Так .", "warning"), 4: ("Два !", "warning"), 6: ("выше нового", "error"), 8: ("раз - два", "error"), 9: ("ашибка", "error"), 10: ("ашибка", "suggestion")}
