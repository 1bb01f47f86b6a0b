"""Many rules by one automaton, many terms by their words."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

from docaudit.operators import catalogue
from docaudit.operators import lint as L
from docaudit.operators import patterns as P
from docaudit.operators.rules import Rule

TEXTS = [
    "Файл отчет.PDF", "Вам следует подождать, файл/папка", 'в кавычках "раз"  два', "ip-адрес и Чекбокс — тут", "клик КЛИК кликните", "", None, "откройте вкладку, активизируйте вкладки",
    "10 MB и 10 мин. ждать", "ОЗУ АБВГ", "Ёж и ёж", "без изменяя", "x" * 5000, "«Abc» (" + "y" * 40 + ")", "От5 web-сайт WEB-Сайт",
]


def test_same_findings(spark):
    lines = spark.createDataFrame([(i, 1, t) for i, t in enumerate(TEXTS)], "doc_id long, line int, text string")
    rules = (*catalogue.RULES, *catalogue.DEFAULT_RULES[4:], Rule("Kelvin", "(?iu)kelvin", "x"))
    key = lambda rows: Counter(map(tuple, rows))
    want = key(L.lint(lines, rules).collect())
    assert key(L.lint_many(lines, rules).collect()) == want and len(want) > 20
    assert L.lint_many(lines.limit(0), rules).collect() == []
    assert key(L.lint_many(lines, rules[:1]).collect()) == key(L.lint(lines, rules[:1]).collect())


def test_literals_of_patterns():
    assert P.literals(r"(?iU)\bab[cd]+e{3}(?:xyz|uvw)\d") == {"xyz", "uvw"} or min(map(len, P.literals(r"(?iU)\bab[cd]+e{3}(?:xyz|uvw)\d"))) == 3
    assert P.literals(r"a*b?") == frozenset() and P.literals(r"(x") == frozenset() and P.literals("[^a]b{2,}") == {"bb"}
    rng = random.Random(6)
    for _ in range(300):
        parts = [rng.choice(["a", "bc", "[ab]", "(?:ab|c)", "d+", "e*", "(?:f|)", "x{2}", r"\w"]) for _ in range(rng.randint(1, 5))]
        p = "".join(parts)
        needed = P.literals(p)
        for _ in range(20):
            text = "".join(rng.choice("abcdefx") for _ in range(12))
            if re.search(p, text) and needed:
                assert any(x in text for x in needed), (p, text, needed)


def test_rules_that_match_nowhere_cost_nothing(spark):
    lines = spark.createDataFrame([(i, 1, f"plain line {i} of words") for i in range(20)], "doc_id long, line int, text string")
    rules = tuple(Rule(f"r{i}", f"(?iu)term{i}x", "m") for i in range(2000))
    P.literals.cache_clear()
    start = time.time()
    owners = [L.rule_literals(r) for r in rules]
    assert all(len(o) == 1 for o in owners) and time.time() - start < 20
    assert L.lint_many(lines, rules[:150]).collect() == []


def test_lexicon_of_a_long_block(spark):
    words = ["the"] * 60_000 + ["the", "end"] * 20_000
    blocks = spark.createDataFrame([(1, 0, " ".join(words)), (1, 1, "The END. of"), (2, 0, None), (2, 1, "")], "doc_id long, block_index int, plain string")
    terms = [("the end", "stop", "c"), ("the the the", None, None), ("the", "a", ""), ("End", "z", None), ("...", "x", None), ("not here at all in it", "x", None)]
    lexicon = spark.createDataFrame(terms, "term string, replacement string, comment string")
    got = {(r["doc_id"], r["block_index"], r["term"]): r["n"] for r in L.lexicon_match(blocks, lexicon).collect()}
    assert got == {(1, 0, "the"): 80_000, (1, 0, "the end"): 20_000, (1, 0, "the the the"): 59_999, (1, 0, "End"): 20_000, (1, 1, "the"): 1, (1, 1, "the end"): 1, (1, 1, "End"): 1}
    assert L.lexicon_match(blocks, lexicon.limit(0)).collect() == []
