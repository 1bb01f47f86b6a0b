"""Evaluation against brute force over lists of expectations and findings."""

import random
import re

import pytest

from docaudit.operators import evaluate as E

ITEM = "case string, polarity string, kind string, rule string, block_index int, severity string, text string, start int, end int, value string, match string, note string"
FINDING = "case string, rule string, block_index int, severity string, text string, start int, end int, suggestion string, polarity string"
CASE = "case string, clean boolean, candidate_observed boolean, latency_ms double, tokens long, hit string"


def agrees(item, finding):
    keys = ("rule", "block_index", "severity", "start", "end")
    if any(item[k] is not None and item[k] != finding[k] for k in keys) or item["text"] is not None and item["text"] not in (finding["text"] or ""):
        return False
    if item["kind"] != "suggestions":
        return True
    want, got = item["value"] or "", finding["suggestion"] or ""
    if item["match"] == "exact":
        return want == got
    return re.search(want, got, re.IGNORECASE) is not None if item["match"] == "regex" else want.lower() in got.lower()


def brute(case, items, findings, selected, candidates):
    mine = [f for f in findings if f["case"] == case["case"]]
    out = {f"{w}_{k}": 0 for w in ("expected", "hit") for k in E.KINDS} | {"missing": 0, "violations": 0}
    ids = set()
    for i in (i for i in items if i["case"] == case["case"]):
        hit = any(agrees(i, f) for f in mine)
        if i["polarity"] == "forbid":
            out["violations"] += hit
            continue
        out[f"expected_{i['kind']}"] += 1
        out[f"hit_{i['kind']}"] += hit
        out["missing"] += not hit
        if i["kind"] == "rules" and i["rule"] is not None:
            ids.add(i["rule"])
    stage = lambda rows: len(ids & {r for c, r in rows if c == case["case"]})
    out |= {"rule_ids": len(ids), "final_rule_hits": stage((f["case"], f["rule"]) for f in mine), "retrieval_rule_hits": stage(selected), "candidate_rule_hits": stage(candidates)}
    out |= {"issues_found": len(mine), "clean_failure": bool(case["clean"]) and bool(mine)}
    return out | {"passed": not out["missing"] and not out["violations"] and not out["clean_failure"]}


def made(seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    name = lambda: pick("hot", "hot", "hot", *(f"c{i}" for i in range(12)))
    rule = lambda: pick("A", "B", "C", None)
    cases = [{"case": c, "clean": pick(True, False, None), "candidate_observed": pick(True, False), "latency_ms": pick(1.5, None), "tokens": pick(7, None), "hit": "x"} for c in ["hot", "idle", *(f"c{i}" for i in range(10))]]
    items = [{"case": pick(name(), None) if n % 9 == 0 else name(), "polarity": pick("expect", "expect", "forbid"), "kind": pick(*E.KINDS), "rule": rule(), "block_index": pick(None, None, 0, 1), "severity": pick(None, None, None, "error"), "text": pick(None, None, "A.b", "", "я"),
              "start": pick(None, None, None, 3), "end": pick(None, None, None, 5), "value": pick("Ab", "^a", "", None, "Я"), "match": pick("exact", "regex", "contains", None), "note": "n"} for n in range(160)]
    items += items[:20]
    findings = [{"case": pick(name(), None) if n % 9 == 0 else name(), "rule": rule(), "block_index": pick(0, 1, 2, None), "severity": pick("error", "minor", None), "text": pick("xA.by", "я", None, ""), "start": pick(3, 4, None), "end": pick(5, None), "suggestion": pick("ab", "Ab", "xAb", "я", None), "polarity": "p"} for n in range(120)]
    findings += findings[:10]
    pairs = lambda: [(name(), rule()) for _ in range(30)]
    return cases, items, findings, pairs(), pairs()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cases_and_metrics(spark, seed):
    cases, items, findings, selected, candidates = made(seed)
    frame = lambda rows, schema: spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rows], schema)
    pair = lambda rows: spark.createDataFrame(rows, "case string, rule string")
    got = E.evaluate_cases(frame(cases, CASE), frame(items, ITEM), frame(findings, FINDING), pair(selected), pair(candidates))
    rows = {r["case"]: r.asDict() for r in got.collect()}
    want = {c["case"]: brute(c, items, findings, selected, candidates) for c in cases}
    assert {c: {k: r[k] for k in want[c]} for c, r in rows.items()} == want
    m = E.eval_metrics(got).first().asDict()
    total = lambda k, rows=tuple(want): sum(want[c][k] for c in rows)
    seen = [c["case"] for c in cases if c["candidate_observed"]]
    share = lambda a, b: a / b if b else None
    assert m["cases"] == len(cases) and m["pass_rate"] == total("passed") / len(cases) and m["violations"] == total("violations") and m["clean_failures"] == total("clean_failure")
    for k in E.KINDS:
        assert m[f"{k[:-1]}_recall"] == share(total(f"hit_{k}"), total(f"expected_{k}"))
    assert m["rule_recall_at_k"] == share(total("retrieval_rule_hits"), total("rule_ids"))
    assert m["finder_rule_recall"] == share(total("candidate_rule_hits", seen), total("rule_ids", seen))
    assert m["verifier_rule_recall"] == share(total("final_rule_hits", seen), total("rule_ids", seen))
    assert m["latency_ms_total"] == sum(c["latency_ms"] or 0 for c in cases) and m["tokens_total"] == sum(c["tokens"] or 0 for c in cases)


def test_nothing_to_measure(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    got = E.evaluate_cases(empty("case string"), empty(ITEM), empty(FINDING))
    assert got.count() == 0
    m = E.eval_metrics(got)
    row = m.first()
    assert (row["pass_rate"], row["rule_recall"], row["rule_recall_at_k"], row["violations"]) == (1.0, None, None, 0)
    assert all(r["ok"] for r in E.eval_thresholds(m).collect())


def test_limits(spark):
    m = spark.createDataFrame([(0.5, 3, None)], "pass_rate double, violations int, span_recall double")
    got = {r["metric"]: r["ok"] for r in E.eval_thresholds(m, {"pass_rate": ("min", 0.5), "violations": ("max", 2), "span_recall": ("min", 1)}).collect()}
    assert got == {"pass_rate": True, "violations": False, "span_recall": True}


def test_regression_texts(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], ["c"], ["t", "u"]), (2, None, None, None)], "case int, expect_rules array<string>, forbid_rules array<string>, forbid_texts array<string>")
    found = spark.createDataFrame([(1, ["b", "c"], ["u", "x"])], "case int, rules array<string>, texts array<string>")
    got = {r["case"]: (r["missing"], r["forbidden"], r["forbidden_texts"]) for r in E.regression_rules(cases, found).collect()}
    assert got == {1: (["a"], ["c"], ["u"]), 2: ([], [], [])}
