"""Cut JSON lists."""

from __future__ import annotations

import json
import random

import pytest

from docaudit.operators import watch as W


def made(rng, depth=0):
    kind = rng.randint(0, 2 if depth < 3 else 0)
    if kind == 0:
        return rng.choice(["a},b", '"]', "\\", "x", "[{", "", "é ", ",", 12, True, None])
    if kind == 1:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b}", "c,"]): made(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_every_cut_of_nested_objects():
    """Brute force: of a list of objects the longest beginning of whole ones."""
    rng = random.Random(8)
    for _ in range(60):
        whole = [{"k": made(rng)} for _ in range(rng.randint(0, 4))]
        parts = [json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in whole]
        text = "[" + ", ".join(parts) + "]"
        ends = [len("[" + ", ".join(parts[: i + 1])) for i in range(len(parts))]
        for cut in range(len(text) + 1):
            got, full = W.closed(text[:cut])
            n = sum(e <= cut for e in ends)
            assert json.loads(got) == whole[:n] and full == (cut == len(text)), text[:cut]


@pytest.mark.parametrize(
    "text, want",
    [('[{"text":"a},b', []), ('[{"a":1},{"b":2}', [{"a": 1}, {"b": 2}]), ('["x", "y"', ["x", "y"]), ('["x", "y', ["x"]), ("[1, 2", [1]), ("[[1, 2], [3", [[1, 2]]), ("", []), (None, []), ("{}", []), ('[{"a":1}] junk', [{"a": 1}])],
)
def test_written_cases(text, want):
    assert json.loads(W.closed(text)[0]) == want


def test_column(spark):
    df = spark.createDataFrame([(1, '[{"a":"}"},{"b'), (2, "[]"), (3, None)], "k int, t string")
    got = df.select("k", W.salvage_truncated(df["t"]).alias("s")).orderBy("k").collect()
    assert [(r["s"]["json"], r["s"]["full"]) for r in got] == [('[{"a":"}"}]', False), ("[]", True), ("[]", False)]
