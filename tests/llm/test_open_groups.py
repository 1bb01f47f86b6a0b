"""Near-duplicate groups that links don't join altogether."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from docaudit.llm import neardup


def brute(rows):
    """Components by all pairs."""
    def words(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()

    sets = {k: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def corpus(near, strangers, seed=4):
    """Near copies of one text, and texts that share enough of it to be candidates and too little to be linked, some of which are linked with each other."""
    rng = random.Random(seed)
    body = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*body[:115], *(f"n{i}x{j}" for j in range(5))])) for i in range(near)]
    for s in range(strangers):
        cut = rng.choice([92, 96, 99])
        own = s // 3 if s % 5 < 3 else 1000 + s
        rows.append((near + s, " ".join([*body[:cut], *(f"s{own}y{j}" for j in range(120 - cut - 2)), f"t{s}", "end"])))
    return rows


@pytest.mark.parametrize("near, strangers, block", [(60, 12, 8), (40, 40, 8), (20, 30, 4)])
def test_open_groups_equal_brute_force(spark, monkeypatch, near, strangers, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(near, strangers)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) > 2


def test_how_often_a_node_is_sent(spark):
    """5,000 nodes of one component and 50 strangers in one group: the former are sent once more, the latter once for each block."""
    blocks = -(-5050 // neardup.BLOCK)
    rows = [(1, k, blocks, k % blocks, 1 if k < 5000 else k) for k in range(5050)]
    sent = neardup.strangers(spark.createDataFrame(rows, "first long, node long, blocks int, own int, label long")).collect()
    times = Counter(r["node"] for r in sent)
    assert {times[k] for k in range(5000)} == {1} and {times[k] for k in range(5000, 5050)} == {blocks + 1}
    # every stranger meets every other node in some unit
    units = {}
    for r in sent:
        units.setdefault((r["i"], r["j"]), set()).add(r["node"])
    for s in range(5000, 5050):
        met = set().union(*(u for u in units.values() if s in u))
        assert len(met) == 5050


def test_joined_groups_are_not_searched_again(spark):
    rows = [(1, k, 20, k % 20, 7) for k in range(100)]
    assert neardup.strangers(spark.createDataFrame(rows, "first long, node long, blocks int, own int, label long")).count() == 0
