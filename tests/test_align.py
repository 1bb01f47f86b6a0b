"""Alignment of sequences, differences of lines and of page nodes."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docaudit.operators import align as A
from docaudit.operators import watch as W
from docaudit.sources import html as H


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


words = st.lists(st.sampled_from("abcde"), max_size=25)


@settings(max_examples=400, deadline=None)
@given(words, words)
def test_longest_common_subsequence(a, b):
    pairs = A.matching(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == lcs(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 3))
def test_valid_alignment_after_few_steps(a, b, most):
    pairs = A.matching(a, b, most)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    out, at = [], (0, 0)
    for equal, i, i_end, j, j_end in A.opcodes(a, b, most):
        assert (i, j) == at and (i, j) != (i_end, j_end)
        assert not equal or a[i:i_end] == b[j:j_end]
        out += b[j:j_end]
        at = (i_end, j_end)
    assert out == b and at == (len(a), len(b))


@pytest.mark.parametrize("kind", ["few", "shuffled", "blank", "other"])
def test_very_many_lines(kind):
    rng = random.Random(2)
    a = [f"line {i}" if i % 3 else "" for i in range(200_000)]
    b = list(a)
    if kind == "few":
        for i in rng.sample(range(len(b)), 200):
            b[i] = f"new {i}"
    elif kind == "shuffled":
        b = [x for k in range(0, len(b), 1000) for x in rng.sample(b[k : k + 1000], 1000)]
    elif kind == "blank":
        b = [x if x == "" or rng.random() < 0.5 else f"other {i}" for i, x in enumerate(b)]
    else:
        b = [f"other {i}" for i in range(len(b))]
    start = time.process_time()
    pairs = A.matching(a, b)
    assert time.process_time() - start < 60
    assert all(a[i] == b[j] for i, j in pairs)
    if kind == "few":
        assert len(pairs) >= 199_800
    if kind == "other":
        assert pairs == []


def hunks(spark, old, new):
    got = W.text_hunks(spark.createDataFrame([(1, old, new)], "page_id long, old string, new string")).orderBy("hunk").collect()
    return [(r["op"], r["lines"]) for r in got]


def test_hunks_rebuild_both_versions(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        old = [rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))]
        new = [x for x in old if rng.random() < 0.7] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        rows.append((k, "\n".join(old), "\n".join(new)))
    rows += [(100, None, "a"), (101, "a", None), (102, "", "")]
    got = {}
    for r in W.text_hunks(spark.createDataFrame(rows, "page_id long, old string, new string"), context=10**9).orderBy("page_id", "hunk").collect():
        got.setdefault(r["page_id"], []).append(r)
    for k, old, new in rows:
        mine = got.get(k, [])
        assert [x for r in mine if r["op"] != "add" for x in r["lines"]] == (old or "").split("\n")
        assert [x for r in mine if r["op"] != "del" for x in r["lines"]] == (new or "").split("\n")
        kept = sum(len(r["lines"]) for r in mine if r["op"] == "eq")
        assert kept == lcs((old or "").split("\n"), (new or "").split("\n"))


def test_hunks_of_long_equal_runs(spark):
    old = "\n".join(map(str, range(20)))
    assert hunks(spark, old, old + "\nend") == [("eq", ["0", "1"]), ("skip", ["16"]), ("eq", ["18", "19"]), ("add", ["end"])]


def events(spark, *pairs):
    rows = [(i, v, f"<html><body><main>{h}</main></body></html>") for i, pair in enumerate(pairs) for v, h in enumerate(pair)]
    nodes = H.dom_nodes(spark.createDataFrame(rows, "page_id long, version int, html string"), ("page_id", "version"))
    return W.diff_nodes(nodes.where("version = 0").drop("version"), nodes.where("version = 1").drop("version"))


CASES = [
    ("<ul><li>a</li><li>b</li><li>c</li></ul>", "<ul><li>new</li><li>a</li><li>b</li><li>c</li></ul>", [("added", "li", "", "new")]),
    ("<p>One</p><p>Two</p>", "<p>Two</p><p>One</p>", [("moved", "p", "*", "*")]),
    ("<a href='/v1'>Get</a>", "<a href='/v2'>Get</a>", [("attr", "a", "Get", "Get")]),
    ("<p>Title</p>", "<h2>Title</h2>", [("tag", "h2", "Title", "Title")]),
    ("<p>Checked 01.09.2026</p>", "<p>Checked 05.09.2026</p>", []),
    ("<h1>T</h1>", "<h1>T</h1><a href='/v2'>New</a>", [("added", "a", "", "New")]),
    ("<div><p>Same text</p></div>", "<div></div><div><p>Same text</p></div><div></div>", []),
    ("<p>Base</p>", "<p>Base</p><button>Go</button><button>Go</button><button>Go</button>", [("added", "button", "", "Go")] * 3),
    ("<ul><li>a</li><li>b</li><li>c</li></ul>", "<ul><li>b</li><li>c</li></ul>", [("removed", "li", "a", "")]),
    ("<p>first words</p><p>k</p>", "<p>other words</p><p>k</p>", [("text", "p", "first words", "other words")]),
]


def test_node_events_of_written_cases(spark):
    got = {}
    for r in events(spark, *((a, b) for a, b, _ in CASES)).collect():
        got.setdefault(r["page_id"], []).append((r["kind"], r["tag"], r["old_text"] or "", r["new_text"] or ""))
    for i, (_, _, want) in enumerate(CASES):
        if want and want[0][2] == "*":
            assert [(k, t) for k, t, _, _ in got[i]] == [(k, t) for k, t, _, _ in want]
        else:
            assert sorted(got.get(i, [])) == sorted(want), CASES[i]


def test_merged_and_ordered_events(spark):
    merged = W.merge_events(events(spark, *((a, b) for a, b, _ in CASES)))
    go = merged.where("new_text = 'Go'").first()
    assert (go["count"], len(go["paths"])) == (3, 3)
    # in the order of kinds, then paths
    rows = [(1, "text", "b", "x", "y", ["p"]), (1, "added", "b", "", "y", ["q"]), (1, "added", "b", "", "z", ["o"]), (1, "moved", "b", "x", "x", ["a"]), (2, "attr", "b", "x", "x", ["a"])]
    df = spark.createDataFrame(rows, "page_id long, kind string, tag string, old_text string, new_text string, paths array<string>")
    got = sorted((r["page_id"], r["at"], r["kind"], r["paths"][0]) for r in W.order_events(df).collect())
    assert got == [(1, 1, "added", "o"), (1, 2, "added", "q"), (1, 3, "moved", "a"), (1, 4, "text", "p"), (2, 1, "attr", "a")]


def test_events_of_pages_are_those_of_brute_force(spark):
    """The queries over ``pages`` against the same rules, written plainly over the parsed nodes."""
    import json
    from collections import Counter

    from pyspark.sql import functions as F

    from docaudit.functions.text import mask_pii, mask_volatile
    from docaudit.plans import monitoring as M

    d = "/root/testdata/sf0.001"
    nodes = H.dom_nodes(M.versions(spark, d).where("version in (1, 3)"), ("page_id", "version"))
    rows = nodes.withColumn("masked", mask_volatile(mask_pii(F.col("text")))).orderBy("pos").collect()
    want = Counter()
    for page in {r["page_id"] for r in rows}:
        old, new = ([(r["tag"], json.dumps(r["attrs"], sort_keys=True), r["masked"], r["text"]) for r in rows if r["page_id"] == page and r["version"] == v and (r["text"] or r["attrs"])] for v in (1, 3))
        # the changes of these pages are a footer that went and a title that is another: of the rest nothing differs
        gone, came = Counter(n[:3] for n in old), Counter(n[:3] for n in new)
        for tag, _, text in (gone - came).elements():
            want[page, "out", tag, text] += 1
        for tag, _, text in (came - gone).elements():
            want[page, "in", tag, text] += 1
    got = Counter()
    for r in M.diff_nodes(spark, d).collect():
        assert r["kind"] in ("removed", "added", "text")
        if r["kind"] != "added":
            got[r["page_id"], "out", r["tag"], r["old_text"]] += 1
        if r["kind"] != "removed":
            got[r["page_id"], "in", r["tag"], r["new_text"]] += 1
    assert sum(want.values()) > 10 and {k[:3] for k in got} == {k[:3] for k in want} and sum(got.values()) == sum(want.values())
    merged = M.merge_events(spark, d).collect()
    assert sum(r["count"] for r in merged) == M.diff_nodes(spark, d).count()
    for r in M.order_events(spark, d).collect():
        assert r["at"] >= 1
