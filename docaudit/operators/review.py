"""Candidates: evidence, model responses, validation, conflicts, reports; guides."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_OF_ENGINE = {"error": "blocker", "suggestion": "minor"}
SEVERITY_OF_REPORT = {"blocker": "error", "suggestion": "warning", "minor": "suggestion"}
ISSUE = "array<struct<block_index: int, rule: string, severity: string, type: string, span_text: string, description: string, suggestion: string, reasoning: string>>"


def mapped(c: Column, names: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def engine_evidence(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with a block as candidates of worker 0; verification is asked where the rule is not machine-verifiable."""
    joined = findings.join(rules.select("rule", "machine_verifiable"), "rule", "left")
    return joined.select(
        "doc_id", "block_index", "rule", mapped(F.col("severity"), SEVERITY_OF_ENGINE, F.lit("suggestion")).alias("severity"), F.col("text").alias("span_text"), F.coalesce("replacement", F.lit("")).alias("suggestion"),
        F.col("message").alias("description"), F.array(F.lit(0)).alias("source_workers"), F.lit("engine").alias("evidence_source"), (~F.coalesce("machine_verifiable", F.lit(False))).alias("verification_required"),
    )


def first_object(text: str) -> str | None:
    """The first balanced object of a text, strings respected."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i, c in enumerate(text[start:], start):
            if escaped:
                escaped = False
            elif quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def parse_model_response(responses: DataFrame) -> DataFrame:
    """(request_key, issue): thinking and fences stripped, JSON parsed; where that fails, the first balanced object is tried."""

    def rescue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(body=[first_object(t or "") for t in b["body"]])

    body = F.regexp_replace(F.regexp_replace("response", r"(?s)<think>.*?</think>", ""), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    rows = responses.select("request_key", body.alias("body"))
    parsed = F.from_json("body", f"struct<issues: {ISSUE}>", {"mode": "PERMISSIVE"})
    good = rows.where(F.trim("body").startswith("{") & F.trim("body").endswith("}"))
    rest = rows.where(~(F.trim("body").startswith("{") & F.trim("body").endswith("}"))).mapInPandas(rescue, rows.schema)
    return good.unionByName(rest).select("request_key", F.explode(parsed["issues"]).alias("issue")).select("request_key", "issue.*")


def validated(issues: DataFrame, blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues with ``reject_reason`` (null: accepted). ``blocks``: doc_id, block_index, plain. Rules may have forbidden_chars, forbidden_introduced_chars and required_chars."""
    joined = issues.join(blocks.select("doc_id", "block_index", "plain"), ["doc_id", "block_index"], "left").join(rules.select("rule", F.lit(1).alias("known"), "forbidden_chars", "forbidden_introduced_chars", "required_chars"), "rule", "left")
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = F.array().cast("array<string>")
    source = F.coalesce(F.nullif("span_text", F.lit("")), F.col("plain"))
    s = F.col("suggestion")
    reason = (
        F.when(F.col("known").isNull(), "unknown rule").when(F.col("plain").isNull(), "unknown block").when(empty(F.col("description")), "no description")
        .when(~empty(F.col("span_text")) & ~F.contains("plain", "span_text"), "span not in block").when(~empty(s) & (F.trim(s) == F.trim(source)), "suggestion changes nothing")
        .when(~empty(s) & F.exists(F.coalesce("forbidden_chars", none), lambda c: F.contains(s, c)), "forbidden character")
        .when(~empty(s) & F.exists(F.coalesce("forbidden_introduced_chars", none), lambda c: F.contains(s, c) & ~F.contains(source, c)), "introduced character")
        .when(~empty(s) & (F.size(F.coalesce("required_chars", none)) > 0) & ~F.exists(F.coalesce("required_chars", none), lambda c: F.contains(s, c)), "required character missing")
    )
    severity = F.when(F.col("severity").isin("blocker", "suggestion", "minor"), F.col("severity")).otherwise("suggestion")
    return joined.withColumns({"reject_reason": reason, "severity": severity, "type": F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("style"))}).drop("plain", "known", "forbidden_chars", "forbidden_introduced_chars", "required_chars")


def split_objective(candidates: DataFrame, verifier: bool) -> DataFrame:
    status = F.when(~F.col("verification_required"), "objective").otherwise("to_verify" if verifier else "ablation_unverified")
    return candidates.withColumn("verification_status", status)


def resolve_conflicts(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """(kept rows) pairs of a block in order: a rule that supersedes or specialises another drops it; of rules that conflict and have different suggestions the one of lower precedence goes; of equal precedence both stay, marked unresolved.

    Rules conflict that share a conflict family or of which one names the other in ``conflicts``. Precedence is that of
    ``combine.rule_precedence``; of the columns mandatory, scope, machine_verifiable and conflicts each may be missing, and candidates of
    unknown rules count as a rule without properties. A dropped row takes no further part, so the rows of a block are folded in
    order, each compared with those of related rules alone; blocks without related rows pass by.
    """
    have = rules
    for c, kind in (("mandatory", "boolean"), ("scope", "string"), ("machine_verifiable", "boolean"), ("conflicts", "array<string>")):
        if c not in rules.columns:
            have = have.withColumn(c, F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    have = have.select("rule", "mandatory", "priority", "scope", "machine_verifiable", "conflict_family", F.coalesce("over", none).alias("over"), F.coalesce("conflicts", none).alias("conflicts"))
    rows = candidates.join(have, "rule", "left").withColumns({"over": F.coalesce("over", none), "conflicts": F.coalesce("conflicts", none)})
    scope = F.coalesce(F.create_map(*(F.lit(x) for kv in SCOPE_RANK.items() for x in kv))[F.lower(F.trim("scope"))], F.lit(0))
    priority = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("priority", F.lit(50))))
    key = F.struct((~F.coalesce("mandatory", F.lit(False))).cast("int").alias("m"), (-priority).alias("p"), (-scope).alias("s"), (~F.coalesce("machine_verifiable", F.lit(False))).cast("int").alias("v"))
    per = Window.partitionBy("doc_id", "block_index")
    rows = rows.withColumn("key", key).withColumn("alone", F.count("*").over(per) == 1)
    out = "doc_id long, block_index int, pos int, rule string, suggestion string, unresolved boolean"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        items = part.sort_values("pos", kind="stable").to_dict("records")
        kept, open_ = settled(items)
        return pd.DataFrame({c: [items[i][c] for i in kept] for c in ("doc_id", "block_index", "pos", "rule", "suggestion")} | {"unresolved": [i in open_ for i in kept]})

    cols = ["doc_id", "block_index", "pos", "rule", "suggestion"]
    single = rows.where("alone").select(*cols, F.lit(False).alias("unresolved"))
    folded = rows.where("not alone").select(*cols, "key", "conflict_family", "over", "conflicts").groupBy("doc_id", "block_index").applyInPandas(fold, out)
    return single.select(*(F.col(c).cast(t) for c, t in (x.split(" ") for x in out.split(", ")))).unionByName(folded)


#: Wider scopes come later in the order of precedence.
SCOPE_RANK = {"all": 0, "document": 1, "section": 2, "sentence": 3, "token": 4}


def settled(items: list[dict]) -> tuple[list[int], set[int]]:
    """Places of the items of a block that stay, and of those that a conflict leaves open."""
    by_rule: dict[str, list[int]] = {}
    by_family: dict[str, list[int]] = {}
    for i, x in enumerate(items):
        by_rule.setdefault(x["rule"], []).append(i)
        if x["conflict_family"]:
            by_family.setdefault(x["conflict_family"], []).append(i)
    related: dict[str, set[str]] = {}
    for x in items:
        for other in (*x["over"], *x["conflicts"]):
            if other in by_rule:
                related.setdefault(x["rule"], set()).add(other)
                related.setdefault(other, set()).add(x["rule"])
    gone: set[int] = set()
    open_: set[int] = set()
    for i, a in enumerate(items):
        if i in gone:
            continue
        others = {j for r in related.get(a["rule"], ()) for j in by_rule[r]} | set(by_family.get(a["conflict_family"] or "", ()))
        for j in sorted(x for x in others if x > i):
            if j in gone:
                continue
            b = items[j]
            if b["rule"] in a["over"]:
                gone.add(j)
                continue
            if a["rule"] in b["over"]:
                gone.add(i)
                break
            named = b["rule"] in a["conflicts"] or a["rule"] in b["conflicts"]
            if not named and not (a["conflict_family"] and a["conflict_family"] == b["conflict_family"]) or a["suggestion"] == b["suggestion"]:
                continue
            x, y = ((*(k[c] for c in "mpsv"), r) for k, r in ((a["key"], a["rule"]), (b["key"], b["rule"])))
            if x < y:
                gone.add(j)
            elif y < x:
                gone.add(i)
                break
            else:
                open_ |= {i, j}
    return [i for i in range(len(items)) if i not in gone], open_ - gone


def report_rows(candidates: DataFrame) -> DataFrame:
    message = F.concat_ws(" ", "description", F.nullif(F.trim("reasoning"), F.lit("")))
    return candidates.withColumns({"message": message, "severity": mapped(F.col("severity"), SEVERITY_OF_REPORT, F.lit("warning"))})


def order_report(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows by block and place of the span in it; spans that are not there come last."""
    joined = rows.join(blocks.select("doc_id", "block_index", "plain"), ["doc_id", "block_index"], "left")
    at = F.position("span_text", "plain")
    joined = joined.withColumn("at", F.when(at > 0, at).otherwise(10**9))
    return joined.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index", "at", "span_text", "message"))).drop("plain")


def category_label(rule: Column, source: Column) -> Column:
    return F.when(source == "custom", "custom").when(rule.rlike("(?i)spell|morf"), "spelling").when(rule.rlike("(?i)punct|quote|spac|dash|comma"), "punctuation").when(rule.rlike("(?i)gramm|agree"), "grammar").otherwise("style guide")


PASSES = (("language", "has_prose", 1), ("guide", None, 1), ("structure", "has_structure", 1), ("document", None, 2), ("consistency", None, 8))


def build_requests(chunks: DataFrame, rules_text: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """One request for each chunk and enabled pass that applies. ``chunks``: doc_id, chunk_index, text, has_prose, has_structure, n_blocks; ``rules_text``: pass, rules."""
    passes = F.filter(
        F.array(*(F.when((F.col(flag) if flag else F.lit(True)) & (F.col("n_blocks") >= least), name) for name, flag, least in PASSES if name in enabled)), lambda p: p.isNotNull()
    )
    rows = chunks.select("*", F.explode(passes).alias("pass")).join(rules_text, "pass", "left")
    return rows.withColumn("request_key", request_key("pass", "rules", "text"))


def request_key(*parts: str) -> Column:
    """sha256 of the parts with a NUL between each two."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def run_model_pass(requests: DataFrame, call: Callable[[str], str], retries: int = 2) -> DataFrame:
    """(request_key, response, error): applies the user's function to each request in Python workers; an error is a row, not a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["request_key"], b["text"]):
                error = response = None
                for _ in range(retries + 1):
                    try:
                        response, error = call(text), None
                        break
                    except Exception as e:  # the user's function may raise anything
                        error = repr(e)[:500]
                out.append((key, response, error))
            yield pd.DataFrame(out, columns=["request_key", "response", "error"])

    return requests.select("request_key", "text").mapInPandas(run, "request_key string, response string, error string")


def keyword_stub(text: str) -> str:
    """Deterministic stand-in for a model: one issue for the first long word."""
    words = [w for w in (text or "").split() if len(w) > 9]
    issues = [{"block_index": 0, "rule": "Long_Word", "severity": "minor", "type": "style", "span_text": words[0], "description": "long word", "suggestion": "", "reasoning": ""}] if words else []
    return "<think>words</think>```json\n" + json.dumps({"issues": issues}) + "\n```"


# guides
def validate_rules(rules: DataFrame) -> DataFrame:
    """Empty rules go; titles from the text's first 60 characters; priority clamped to 0..100 (50); inferred fields recorded."""
    text, title = F.trim("text"), F.nullif(F.trim("title"), F.lit(""))
    rows = rules.where(F.coalesce(text, F.lit("")) != "")
    inferred = F.array_compact(F.array(F.when(title.isNull(), "title"), F.when(F.col("priority").isNull(), "priority"), F.when(F.col("scope").isNull(), "scope")))
    return rows.withColumns({
        "inferred": inferred, "title": F.coalesce(title, F.substring(text, 1, 60)), "text": text, "priority": F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("priority", F.lit(50)))), "scope": F.coalesce("scope", F.lit("all"))})


def validate_lexicon(entries: DataFrame) -> DataFrame:
    rows = entries.where(F.trim("term") != "")
    return rows.select("kind", F.trim("term").alias("term"), F.concat(F.lit("Lexicon."), F.regexp_replace(F.lower(F.trim("term")), r"[^\p{L}\p{N}]+", "_")).alias("rule"), F.nullif(F.trim("replacement"), F.lit("")).alias("replacement"))


def guide_hash(rules: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rule", "title", "text")))
    return rules.groupBy("guide").agg(F.sha2(F.to_json(ordered), 256).alias("content_hash"))


def guide_readiness(rules: DataFrame) -> DataFrame:
    got = rules.groupBy("guide").agg(F.count("*").alias("n_rules"), F.count_if(F.trim("text") != "").alias("with_text"), F.count_if(F.size("bad_examples") > 0).alias("with_examples"), F.count_if(F.col("priority").isNotNull()).alias("with_metadata"))
    return got.withColumn("ready", (F.col("n_rules") > 0) & (F.col("with_text") == F.col("n_rules")))


def authority_metadata(rules: DataFrame) -> DataFrame:
    priority = mapped(F.col("severity"), {"error": "90", "warning": "60", "suggestion": "40"}, F.lit("50")).cast("int")
    return rules.withColumns({
        "categories": F.array_distinct(F.array("rule_group", F.element_at(F.split("section", r"\."), 1))), "priority": priority, "scope": F.lit("all"),
        "machine_verifiable": (F.col("automation") == "automatic") & (F.col("engine") != "manual")})
