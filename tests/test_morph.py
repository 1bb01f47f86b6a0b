"""Readings by endings: brute force, held-out forms, agreement of words that the table lacks."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from docaudit.operators import lint as L
from docaudit.operators import morph as M

SCHEMA = "form string, rank int, lemma string, pos string, number string, grammatical_case string, gender string"
#: Endings of regular Russian words: (ending, number, case).
NOUN = {"masc": "|sing|nomn а|sing|gent у|sing|datv ом|sing|ablt е|sing|loct ы|plur|nomn ов|plur|gent ам|plur|datv ами|plur|ablt ах|plur|loct", "femn": "а|sing|nomn ы|sing|gent е|sing|datv у|sing|accs ой|sing|ablt ам|plur|datv ами|plur|ablt ах|plur|loct"}
ADJ = "ый|sing|nomn|masc ого|sing|gent|masc ому|sing|datv|masc ая|sing|nomn|femn ую|sing|accs|femn ое|sing|nomn|neut ые|plur|nomn| ых|plur|gent| ыми|plur|ablt|"
VERB = "ать|| ает|sing| ают|plur| ал|sing| али|plur|"


def words(n=60, seed=1):
    """A morphology table of over a thousand forms of made-up stems."""
    rng = random.Random(seed)
    stems = {"".join(rng.choice("бвгдзклмнпрст") + rng.choice("аеиоу") for _ in range(rng.randint(1, 3))) + rng.choice("бвгдзлмнпрст") for _ in range(n * 4)}
    rows = []
    for i, s in enumerate(sorted(stems)):
        if i % 4 < 2:
            gender = ("masc", "femn")[i % 2]
            cells = [c.split("|") for c in NOUN[gender].split(" ")]
            rows += [(s + e, 0, s + cells[0][0], "NOUN", number, case, gender) for e, number, case in cells]
        elif i % 4 == 2:
            rows += [(s + e, 0, s + "ый", "ADJ", number, case, gender or None) for e, number, case, gender in (c.split("|") for c in ADJ.split(" "))]
        else:
            rows += [(s + e, 0, s + "ать", "VERB", number or None, None, None) for e, number, _ in (c.split("|") for c in VERB.split(" "))]
    merged = defaultdict(list)
    for r in rows:
        merged[r[0]].append(r)
    return [(f, k, *r[2:]) for f, own in merged.items() for k, r in enumerate(own)]


def brute(morph, unknown, longest=6, least=2):
    forms = defaultdict(list)
    for f, rank, lemma, *rest in set(morph):
        kept = next((i for i, (x, y) in enumerate(zip(f, lemma)) if x != y), min(len(f), len(lemma)))
        forms[f].append((rank, *rest, len(f) - kept, lemma[kept:]))
    key = lambda p: tuple(tuple((x is not None, x if x is not None else "") for x in r) for r in p)
    counts = defaultdict(Counter)
    for f, readings in forms.items():
        paradigm = tuple(sorted(readings, key=lambda r: key([r])))
        for n in range(max(1, *(r[5] for r in paradigm)) if len(paradigm) > 1 else max(1, paradigm[0][5]), min(longest, len(f)) + 1):
            counts[f[-n:]][paradigm] += 1
    out = set()
    for w in unknown:
        for n in range(min(longest, len(w)), 0, -1):
            good = {p: c for p, c in counts[w[-n:]].items() if c >= least} if w[-n:] in counts else {}
            if good:
                best = max(good, key=lambda p: (good[p], key(p)))
                out |= {(w, r[0], w[: len(w) - r[5]] + r[6], *r[1:5]) for r in best}
                break
    return out


def test_against_brute_force(spark):
    rows = words(12)
    rng = random.Random(3)
    held = {r[0] for r in rows if rng.random() < 0.3} | {"ё", "столами", "xyz", ""}
    known = [r for r in rows if r[0] not in held]
    df = spark.createDataFrame([*known, *known[:5], (None, 0, "x", "NOUN", None, None, None)], SCHEMA)
    got = M.predicted(spark.createDataFrame([(w,) for w in [*held, *held, None]], "word string"), M.endings(df)).collect()
    assert {tuple(r) for r in got} == brute(known, held) and len(got) == len({tuple(r) for r in got})


def test_held_out_accuracy(spark):
    rows = words()
    assert len({r[0] for r in rows}) > 1000
    rng = random.Random(5)
    held = {f for f in {r[0] for r in rows} if rng.random() < 0.25}
    df = spark.createDataFrame([r for r in rows if r[0] not in held], SCHEMA)
    got = defaultdict(set)
    for r in M.predicted(spark.createDataFrame([(w,) for w in held], "word string"), M.endings(df)).collect():
        got[r["form"]].add((r["lemma"], r["pos"], r["number"], r["grammatical_case"], r["gender"]))
    want = defaultdict(set)
    for f, _, *reading in rows:
        if f in held:
            want[f].add(tuple(reading))
    right = sum(bool(got[f] & want[f]) for f in held) / len(held)
    parts = sum(bool({x[1] for x in got[f]} & {x[1] for x in want[f]}) for f in held) / len(held)
    assert parts > 0.85 and right > 0.7


def test_agreement_of_words_that_the_table_lacks(spark):
    rows = words()
    adj, noun = "новых", "задачами"  # plural genitive, plural ablative: they disagree
    agreeing = "новыми"
    assert not {adj, noun, agreeing} & {r[0] for r in rows}
    lines = spark.createDataFrame([(1, 1, f"Мы {adj} {noun} рады."), (2, 1, f"Мы {agreeing} {noun} рады.")], "doc_id long, line int, text string")
    tokens = L.word_tokens(lines)
    readings = L.morph_lookup(tokens, M.completed(tokens, spark.createDataFrame(rows, SCHEMA)))
    assert [(r["doc_id"], r["a_word"], r["b_word"]) for r in L.disagreement(readings, "ADJ", "NOUN").collect()] == [(1, adj, noun)]


def test_queries_over_documents(spark):
    from docaudit.plans import findings as Q

    d = "/root/testdata/sf0.001"
    table = [tuple(r) for r in Q.word_table(spark, d).collect()]
    words_of = {r["w"] for r in L.word_tokens(Q.lines(spark, d)).selectExpr("lower(word) as w").distinct().collect()}
    lacking = words_of - {r[0] for r in table}
    want = {(x[0], x[2], x[3], x[4]) for x in brute(table, lacking)}
    assert {tuple(r) for r in Q.morph_predicted(spark, d).collect()} == want and len(want) > 1000
    total = sum(r["n"] for r in Q.morph_coverage(spark, d).collect())
    assert 0 < total <= L.word_tokens(Q.lines(spark, d)).count()
