"""Operator 12 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docaudit.llm import periodic as P

DATA = "/root/testdata/sf0.001"


def brute_runs(w: list, least: int) -> list:
    """Every stretch is looked at for every period: O(n^2)."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            start, length = a, i + q - a
            part = w[start : start + length]
            smallest = all(any(part[x] != part[x + p] for x in range(length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and smallest:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.integers(2, 13))
def test_runs_of_random_words(w, least):
    assert P.runs(w, least) == brute_runs(w, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.integers(1, 7)), max_size=6))
def test_runs_of_repeated_pieces(parts):
    w = [x for piece, times in parts for x in piece * times]
    assert P.runs(w) == brute_runs(w, 12)
    assert [tuple(r) for r in P.all_runs(w, 2)[:, :3].tolist()] == sorted(brute_runs(w, 2))


def test_suffix_tree_extension():
    rng = random.Random(5)
    s = [rng.randint(1, 2) for _ in range(200)] + [1, 2] * 40
    tree = P.SuffixTree(s)
    assert sorted(range(len(s) + 1), key=lambda i: [*s[i:], 0]) == np.argsort(tree.rank).tolist()
    i, j = zip(*[(a, b) for a in range(0, len(s), 7) for b in range(0, len(s), 5) if a != b])
    got = tree.extension(np.array(i), np.array(j))
    for a, b, n in zip(i, j, got):
        assert s[a : a + n] == s[b : b + n] and [*s, 0][a + n] != [*s, 0][b + n]


def brute_row(doc_id, text) -> dict:
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[1] * 1000 // best[2] if best[2] else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    }


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    ids = [x for x in range(4000) if zlib.crc32(str(x).encode()) % 10 == 0][:40]
    rows = [(x, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 90))), "x") for x in [*ids, *range(60)]]
    rows += [(5001, None, "x"), (5002, "", "x"), (5003, " \t\n ", "x"), (None, "w " * 30, "x"), (5004, "a b é\x1c " * 20, "x"), (5004, "a b é\x1c " * 20, "x")]
    rows.append((5005, "one two three\r\n" * 500 + " ".join(map(str, range(3000))) + " x" * 700, "x"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_runs string")


def test_query_rows(spark, odd):
    rows, docs = odd
    got = P.periodic_runs(docs, plant=True).collect()
    want = [brute_row(k, t) for k, t, _ in rows if k != 5005]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["collapsed_sha256"])
    assert sorted((r.asDict() for r in got if r["doc_id"] != 5005), key=key) == sorted(want, key=key)
    long = next(r for r in got if r["doc_id"] == 5005)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (2, 0, 1500, 3)
    assert P.periodic_runs(docs.limit(0)).collect() == []


def test_query_on_documents(spark):
    from docaudit.llm.common import table

    want = {r["doc_id"]: brute_row(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").select("doc_id", "text").collect() if len(r["text"]) < 1500}
    got = {r["doc_id"]: r.asDict() for r in P.op12_periodic_runs(spark, DATA).collect()}
    assert len(want) > 50 and {k: got[k] for k in want} == want and any(r["n_runs"] for r in want.values())


def test_long_text_in_linear_time():
    w = [x for k in range(300) for x in [f"w{k}"] * 1 + ["a", "b", "c"] * 100]
    found = P.runs(w)
    assert sum(1 for r in found if r[2] == 3) == 300 and len(w) == 90_300


def test_without_repeats(spark):
    text = "go  on " * 20 + "end"
    docs = spark.createDataFrame([(1, text, 7), (2, "a  b", 8), (3, None, 9)], "`doc.id` long, text string, extra int")
    assert [tuple(r) for r in P.without_repeats(docs).sort("extra").collect()] == [(1, "go on end", 7), (2, "a  b", 8), (3, None, 9)]
