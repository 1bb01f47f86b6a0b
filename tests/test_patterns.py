"""Patterns of users against ``re``, and in linear time."""

from __future__ import annotations

import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docaudit.operators import lint as L
from docaudit.operators import patterns as P

atoms = st.sampled_from(["a", "b", "C", ".", r"\w", r"\d", r"\s", r"\W", "[ab]", "[^a]", "[a-c1]", r"[\w-]", "é", r"\b", "^", "$", r"(?<!a)", r"(?=b)", r"\B"])
repeats = st.sampled_from(["", "", "", "*", "+", "?", "{2}", "{1,3}", "*?", "+?", "{0,2}?"])


@st.composite
def pattern(draw, depth=2):
    def piece():
        if depth and draw(st.integers(0, 3)) == 0:
            inner, times = draw(pattern(depth - 1)), draw(repeats)
            # what repeats of an empty part mean differs from engine to engine
            return f"({inner})" + ("" if re.search(r"[*?^$]|\{0|\\[bB]", inner) else times)
        atom = draw(atoms)
        return atom if atom in (r"\b", r"\B", "^", "$") or atom.startswith("(?") else atom + draw(repeats)

    return "|".join("".join(piece() for _ in range(draw(st.integers(1, 4)))) for _ in range(draw(st.integers(1, 2))))


@settings(max_examples=1500, deadline=None)
@given(pattern(), st.text("abcCé1 -_", max_size=14))
def test_equals_re(p, text):
    want = [m.span() for m in re.finditer(p, text, re.I)]
    try:
        ready = P.prepare(p)
    except P.Refused:
        assert re.fullmatch(p, "", re.I) is not None or r"\B" in p
        return
    if any(a == b for a, b in want):
        return  # matches of no characters are none, so the next one may begin elsewhere
    assert ready.spans(text) == want
    assert [s for _, s in P.matches(pa.array([text]), ready)] == ([want] if want else [])


@pytest.mark.parametrize("p", [r"(a|aa)+$", r"(\w+\s?)+!", r"(a*)*b", r"\b(\w|\w\w)+\b!", r"(?<!x)(a+)+b", r"a+b", ".*.*.*="])
def test_linear_time(p):
    ready = P.prepare(p)
    start = time.process_time()
    for n in (50_000,):
        assert list(P.matches(pa.array(["a" * n + "c", None, "a " * (n // 2) + "c"]), ready)) == []
    assert time.process_time() - start < 20


@pytest.mark.parametrize(
    "p, reason",
    [("", "no pattern"), (None, "no pattern"), ("(", "not a pattern"), ("a" * 501, "longer"), ("a*", "empty line"), (r"(a)\1", "trying out"), ("(?>a+)b", "trying out"), ("(?=ab)a", "look-around"), ("x{2}" + "(?:a{90}){90}", "states"), ("(?i:a)b|(?-i:c)", "flags"), (r"\P{L}", "negated")],
)
def test_refused(p, reason):
    with pytest.raises(P.Refused, match=reason):
        P.prepare(p)


@pytest.mark.parametrize(
    "p, text, want",
    [(r"\bтест\w*\b", "Тестом протестуем ТЕСТ", ["Тестом", "ТЕСТ"]), (r"(?P<n>a)b", "AB ab", ["AB", "ab"]), (r"\p{Lu}+\d", "aB1 é2 ٣", ["aB1", "é2"]), (r"[\p{L}_]+", "a1_б", ["a", "_б"]), (r"\b\p{Nd}{2}\b", "12 123 ٣٤", ["12", "٣٤"]), (r"\\p", r"a\p", [r"\p"]), ("a\ufdd0?b", "ab a\ufdd0b", ["ab", "a\ufdd0b"])],
)
def test_written_cases(p, text, want):
    ready = P.prepare(p)
    assert [text[a:b] for a, b in ready.spans(text)] == want
    assert [text[a:b] for _, s in P.matches(pa.array(["", text]), ready) for a, b in s] == want


def test_literals():
    lit = lambda p: P.longest_literal(P._parsed(p)[0])
    assert [lit(p) for p in (r"\bTest\w+ing", "a|bc", "(?:xyz)+q", "(?:xyz)*q", r"\d+", "ſtraße")] == ["test", "", "xyz", "q", "", "tra"]


def test_user_rules_of_a_table(spark):
    rules = [{"id": "r1", "pattern": r"\bcat\b", "message": "m", "severity": "error"}, {"id": "r2", "pattern": "(?P<n>c)a"}, {"id": "bad", "pattern": r"(a)\1"}, {"id": "r3", "pattern": "(a|aa)+$"}]
    lines = spark.createDataFrame([(1, 1, "Cat and cats"), (1, 2, None), (2, 1, ""), (2, 2, "baa")], "doc_id long, line int, text string")
    got = sorted((r["rule"], r["doc_id"], r["line"], r["column"], r["end_column"], r["text"], r["severity"], r["source"]) for r in L.user_rules(lines, rules).collect())
    assert got == [("r1", 1, 1, 1, 4, "Cat", "error", "custom"), ("r2", 1, 1, 1, 3, "Ca", "warning", "custom"), ("r2", 1, 1, 9, 11, "ca", "warning", "custom"), ("r3", 2, 2, 2, 4, "aa", "warning", "custom")]
    assert [n for n, _ in L.checked_user_rules(rules)[1]] == ["bad"] and L.user_rules(lines, []).collect() == []
