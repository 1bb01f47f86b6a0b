"""Evaluation: what reports were expected to hold, case by case, and the measures and limits over all cases.

An expectation asks for (``expect``) or rules out (``forbid``) a finding of its case. It is of one of four kinds:
``rules``, ``blocks``, ``spans`` and ``suggestions``; each may give rule, block_index, severity, text, start and end, and
one of the kind ``suggestions`` also value and match. What it leaves null holds for any finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("rules", "blocks", "spans", "suggestions")
GIVEN = {"rule": "string", "block_index": "int", "severity": "string", "text": "string", "start": "int", "end": "int"}
EXPECTED = {"case": None, "polarity": "string", "kind": "string", **GIVEN, "value": "string", "match": "string"}

#: What an evaluation has to reach.
THRESHOLDS = {
    "pass_rate": ("min", 0.70), "rule_recall": ("min", 0.80), "block_recall": ("min", 0.70), "span_recall": ("min", 0.70), "suggestion_recall": ("min", 0.60), "violations": ("max", 0),
    "clean_failures": ("max", 0), "rule_recall_at_k": ("min", 0.90), "finder_rule_recall": ("min", 0.80), "verifier_rule_recall": ("min", 0.80),
}


def suggestion_match(kind: Column, expected: Column, got: Column) -> Column:
    """``exact``: the same text; ``regex``: found somewhere, in any case; else contained, in any case. A null suggestion is an empty one."""
    expected, got = F.coalesce(expected, F.lit("")), F.coalesce(got, F.lit(""))
    return F.when(kind == "exact", expected == got).when(kind == "regex", F.regexp(got, F.concat(F.lit("(?iu)"), expected))).otherwise(F.contains(F.lower(got), F.lower(expected)))


def with_columns(df: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    """The named columns of ``df`` alone; those that it lacks are null."""
    return df.select(*(F.col(c) if kind is None else (F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()))


def meets(given: tuple[str, ...] = tuple(GIVEN)) -> Column:
    """Whether a finding has all that an expectation (columns ``e_…``) gives; a text has to be part of the finding's, letter by letter."""
    ok = F.lit(True)
    for c in given:
        e = F.col(f"e_{c}")
        ok &= e.isNull() | F.coalesce(F.contains(F.coalesce(c, F.lit("")), e) if c == "text" else F.col(c) == e, F.lit(False))
    return ok


def met(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(item): the expectations for which a finding is there.

    Findings that look alike count once. Expectations that name a rule are joined by case and rule, the others by case alone; both are
    inner joins, so a case that holds a great part of all findings may be split, and the items are made distinct before they are shuffled.
    """
    found = with_columns(findings, {"case": None, **GIVEN, "suggestion": "string"}).distinct()
    asked = items.select("item", "kind", F.col("case").alias("e_case"), *(F.col(c).alias(f"e_{c}") for c in (*GIVEN, "value", "match")))
    ok = meets() & ((F.col("kind") != "suggestions") | suggestion_match(F.col("e_match"), F.col("e_value"), F.col("suggestion")))
    same = F.col("e_case") == F.col("case")
    named = asked.where("e_rule is not null").join(found, same & (F.col("e_rule") == F.col("rule")) & ok)
    loose = asked.where("e_rule is null").join(found, same & ok)
    return named.select("item").unionByName(loose.select("item")).distinct()


def evaluate_cases(cases: DataFrame, expectations: DataFrame, findings: DataFrame, selected: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """One row a case: what was expected and hit of each kind, what is forbidden and there, and the rules that each stage knew.

    ``cases``: case and, where known, clean, retrieval_observed, candidate_observed, latency_ms, tokens, token_calls; rows of one case are
    summed up. ``selected`` and ``candidates`` (case, rule) are the rules that retrieval and the finder gave; without a column of
    their own, cases count as observed if the table is given. Expectations count as often as they stand there. A clean case fails with any
    finding. Rows without a case, and expectations and findings of cases that ``cases`` lacks, have no part; a case without
    expectations is passed unless it is a clean one with findings. Other columns are ignored.
    """
    runs = with_columns(cases, {"case": None, "clean": "boolean", "retrieval_observed": "boolean", "candidate_observed": "boolean", "latency_ms": "double", "tokens": "long", "token_calls": "long"})
    seen = lambda c, rows: F.coalesce(F.bool_or(c), F.lit(c not in cases.columns and rows is not None)).alias(c)
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero)).alias(c)
    runs = runs.where("case is not null").groupBy("case").agg(
        F.coalesce(F.bool_or("clean"), F.lit(False)).alias("clean"), seen("retrieval_observed", selected), seen("candidate_observed", candidates), total("latency_ms", 0.0), total("tokens", 0), total("token_calls", 0))

    names = list(EXPECTED)
    items = with_columns(expectations, EXPECTED).where("case is not null").groupBy(*names).agg(F.count("*").alias("n"))
    items = items.withColumn("item", F.sha2(F.to_json(F.struct(*names)), 256))
    rows = items.join(met(items, findings).withColumn("hit", F.lit(1)), "item", "left")
    expect, hit = F.col("polarity") == "expect", F.col("hit").isNotNull()
    count = lambda ok, name: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias(name)
    counts = rows.groupBy("case").agg(
        *(count(expect & (F.col("kind") == k), f"expected_{k}") for k in KINDS), *(count(expect & hit & (F.col("kind") == k), f"hit_{k}") for k in KINDS),
        count(expect & ~hit, "missing"), count((F.col("polarity") == "forbid") & hit, "violations"))

    # the rules that were asked for, found, selected and proposed: one pass over marked rows
    mark = lambda df, bit: df.where("case is not null and rule is not null").select("case", "rule", F.lit(bit).alias("bit"))
    marks = mark(items.where(expect & (F.col("kind") == "rules")), 1).unionByName(mark(findings, 2))
    for df, bit in ((selected, 4), (candidates, 8)):
        if df is not None:
            marks = marks.unionByName(mark(df, bit))
    known = marks.groupBy("case", "rule").agg(F.bit_or("bit").alias("bits")).where("bits & 1 = 1")
    stages = known.groupBy("case").agg(F.count("*").alias("rule_ids"), *(F.count_if(F.col("bits").bitwiseAND(bit) != 0).alias(c) for c, bit in (("final_rule_hits", 2), ("retrieval_rule_hits", 4), ("candidate_rule_hits", 8))))
    issues = findings.groupBy("case").agg(F.count("*").alias("issues_found"))

    out = runs.join(counts, "case", "left").join(stages, "case", "left").join(issues, "case", "left").fillna(0)
    out = out.withColumn("clean_failure", F.col("clean") & (F.col("issues_found") > 0))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("violations") == 0) & ~F.col("clean_failure"))


def eval_metrics(results: DataFrame) -> DataFrame:
    """One row: shares and sums over all cases; a share of nothing is null, the pass rate of no case is 1."""
    ratio = lambda hits, of: (F.sum(hits) / F.nullif(F.sum(of), F.lit(0)))
    where = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total")
    return results.agg(
        F.count("*").alias("cases"), F.coalesce(F.count_if("passed") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("pass_rate"),
        *(ratio(f"hit_{k}", f"expected_{k}").alias(f"{k[:-1]}_recall") for k in KINDS),
        F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.count_if("clean_failure").alias("clean_failures"),
        ratio(where("retrieval_observed", "retrieval_rule_hits"), where("retrieval_observed", "rule_ids")).alias("rule_recall_at_k"),
        ratio(where("candidate_observed", "candidate_rule_hits"), where("candidate_observed", "rule_ids")).alias("finder_rule_recall"),
        ratio(where("candidate_observed", "final_rule_hits"), where("candidate_observed", "rule_ids")).alias("verifier_rule_recall"),
        total("latency_ms"), total("tokens"), total("token_calls"))


def eval_thresholds(metrics: DataFrame, limits: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(metric, value, ok): minimum or maximum checks; a metric that is null passes."""
    limits = THRESHOLDS if limits is None else limits
    tall = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(kind).alias("kind"), F.lit(float(bound)).alias("bound")) for n, (kind, bound) in limits.items()))).alias("m")).select("m.*")
    ok = F.col("value").isNull() | F.when(F.col("kind") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return tall.select("metric", "value", ok.alias("ok"))


def regression_rules(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case): expected rules not found, forbidden rules and forbidden texts found. ``cases``: case, expect_rules, forbid_rules, forbid_texts; ``found``: case, rules, texts."""
    none = F.array().cast("array<string>")
    lists = lambda df, *names: df.select("case", *(F.coalesce(F.col(c) if c in df.columns else none, none).alias(c) for c in names))
    both = lists(cases, "expect_rules", "forbid_rules", "forbid_texts").join(lists(found, "rules", "texts"), "case", "left").withColumns({c: F.coalesce(c, none) for c in ("rules", "texts")})
    met = lambda a, b: F.array_sort(F.array_intersect(a, b))
    return both.select("case", F.array_sort(F.array_except("expect_rules", "rules")).alias("missing"), met("forbid_rules", "rules").alias("forbidden"), met("forbid_texts", "texts").alias("forbidden_texts"))
