"""Review queries: findings on lines as candidates, ``benchmark`` as guide rules, ``labels`` as expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.operators import combine as C
from docaudit.operators import evaluate as E
from docaudit.operators import review as V
from docaudit.plans.findings import FOUND, findings, rule_table
from docaudit.plans.registry import query, table
from docaudit.plans.text import lines


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their line as the block."""
    return findings(spark, d).withColumn("block_index", F.col("line"))


def rules(spark: SparkSession) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return rule_table(spark).withColumns({"machine_verifiable": F.col("automation") == "automatic", "forbidden_chars": F.when(F.col("rule") == "HomogeneousMembers", F.array(F.lit(","))).otherwise(none), "forbidden_introduced_chars": none, "required_chars": none,
                                          "priority": F.when(F.col("rule") == "Digits_Long", 10).otherwise(60), "conflict_family": F.when(F.col("rule").isin("Quotes_Straight", "Digits_Long"), "q"), "over": F.when(F.col("rule") == "Exclamation_Double", F.array(F.lit("HomogeneousMembers"))).otherwise(none)})


@query(FOUND + "SELECT rule, CASE severity WHEN 'error' THEN 'blocker' WHEN 'suggestion' THEN 'minor' ELSE 'suggestion' END AS severity, rule = 'Digits_Long' AS verification_required, count(*) AS n FROM found GROUP BY ALL")
def engine_evidence(spark: SparkSession, d: str) -> DataFrame:
    return V.engine_evidence(placed(spark, d), rules(spark)).groupBy("rule", "severity", "verification_required").agg(F.count("*").alias("n"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with faults: some name an unknown rule, some have no description, some change nothing."""
    c = V.engine_evidence(placed(spark, d), rules(spark)).withColumns({"type": F.lit(""), "suggestion": F.when(F.col("block_index") % 5 == 0, F.col("span_text")).otherwise(F.concat(F.col("span_text"), F.lit("!")))})
    return c.withColumns({"rule": F.when(F.col("block_index") % 7 == 0, "Nobody").otherwise(F.col("rule")), "description": F.when(F.col("block_index") % 4 == 0, "").otherwise(F.col("description"))})


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", F.col("line").alias("block_index"), F.col("text").alias("plain"))


REASON = "CASE WHEN line % 7 = 0 THEN 'unknown rule' WHEN line % 4 = 0 THEN 'no description' WHEN line % 5 = 0 THEN 'suggestion changes nothing' WHEN rule = 'HomogeneousMembers' THEN 'forbidden character' END"


@query(FOUND + f"SELECT doc_id, line AS block_index, CASE WHEN line % 7 = 0 THEN 'Nobody' ELSE rule END AS rule, text AS span_text, {REASON} AS reject_reason FROM found")
def validate_issues(spark: SparkSession, d: str) -> DataFrame:
    return V.validated(issues(spark, d), blocks(spark, d), rules(spark)).select("doc_id", "block_index", "rule", "span_text", "reject_reason")


@query(FOUND + f"SELECT {REASON} AS reason, count(*) AS n FROM found WHERE {REASON} IS NOT NULL GROUP BY 1")
def validation_rejects(spark: SparkSession, d: str) -> DataFrame:
    return V.validated(issues(spark, d), blocks(spark, d), rules(spark)).where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(FOUND + "SELECT CASE WHEN rule = 'Digits_Long' THEN 'ablation_unverified' ELSE 'objective' END AS verification_status, count(*) AS n FROM found GROUP BY 1")
def split_objective(spark: SparkSession, d: str) -> DataFrame:
    return V.split_objective(V.engine_evidence(placed(spark, d), rules(spark)), False).groupBy("verification_status").agg(F.count("*").alias("n"))


@query()
def resolve_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = placed(spark, d).select("doc_id", "block_index", F.col("column").alias("pos"), "rule", F.coalesce("replacement", "text").alias("suggestion"))
    return V.resolve_conflicts(c, rules(spark).select("rule", "priority", "conflict_family", "over"))


@query(FOUND + "SELECT severity, rule, count(*) AS n FROM found GROUP BY ALL")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    c = V.engine_evidence(placed(spark, d), rules(spark)).withColumn("reasoning", F.lit(""))
    return V.report_rows(c).groupBy("severity", "rule").agg(F.count("*").alias("n"))


@query(FOUND + """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, position(found.text IN lines.text), found.text, CASE rule WHEN 'Digits_Long' THEN 'Long run of digits' WHEN 'Email_Address' THEN 'Personal address' WHEN 'Exclamation_Double' THEN 'One exclamation mark is enough' ELSE replace(rule, '_', ' ') END) AS INT) AS number,
line AS block_index, CAST(position(found.text IN lines.text) AS INT) AS at, rule FROM found JOIN lines USING (doc_id, line)""")
def order_report(spark: SparkSession, d: str) -> DataFrame:
    c = V.report_rows(V.engine_evidence(placed(spark, d), rules(spark)).withColumn("reasoning", F.lit("")))
    return V.order_report(c, blocks(spark, d)).select("doc_id", "number", "block_index", "at", "rule")


@query(FOUND + "SELECT rule, CASE WHEN regexp_matches(rule, '(?i)spell|morf') THEN 'spelling' WHEN regexp_matches(rule, '(?i)punct|quote|spac|dash|comma') THEN 'punctuation' WHEN regexp_matches(rule, '(?i)gramm|agree') THEN 'grammar' ELSE 'style guide' END AS category, count(*) AS n FROM found GROUP BY ALL")
def category_label(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("rule", V.category_label(F.col("rule"), F.col("source")).alias("category")).agg(F.count("*").alias("n"))


@query(FOUND + "SELECT doc_id, rule, count(*) AS n, 'engine' AS sources FROM found GROUP BY ALL")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return V.engine_evidence(placed(spark, d), rules(spark)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("evidence_source")), "+").alias("sources"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").cast("int").alias("n_blocks"))
    rows = c.join(n, "conv_id")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text", (F.length("text") >= 40).alias("has_prose"), (F.col("role") != "user").alias("has_structure"), "n_blocks")


def requests(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([("language", "rules of language"), ("guide", "rules of the guide"), ("structure", "rules of structure"), ("document", "d"), ("consistency", "c")], "pass string, rules string")
    return V.build_requests(chunks(spark, d), texts, ("language", "guide", "structure", "document"))


REQUESTS = """n AS (SELECT conv_id, count(*) AS n_blocks FROM conversations GROUP BY 1), q AS (
SELECT conv_id AS doc_id, turn AS chunk_index, text, p.pass, p.rules FROM conversations JOIN n USING (conv_id), (VALUES ('language', 'rules of language'), ('guide', 'rules of the guide'), ('structure', 'rules of structure'), ('document', 'd')) p(pass, rules)
WHERE (pass = 'language' AND length(text) >= 40) OR pass = 'guide' OR (pass = 'structure' AND role <> 'user') OR (pass = 'document' AND n_blocks >= 2))"""


@query(f"WITH {REQUESTS} SELECT doc_id, chunk_index, pass FROM q")
def build_requests(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("doc_id", "chunk_index", "pass")


@query(f"WITH {REQUESTS} SELECT doc_id, chunk_index, pass, sha256(pass || chr(0) || rules || chr(0) || text) AS request_key FROM q")
def request_key(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("doc_id", "chunk_index", "pass", "request_key")


@query(f"WITH {REQUESTS} SELECT pass, count(*) FILTER (chunk_index % 2 = 0) AS hits, count(*) FILTER (chunk_index % 2 <> 0) AS misses FROM q GROUP BY pass")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).withColumn("request_key", F.concat_ws("/", "doc_id", "chunk_index", "pass"))
    hit, miss = C.cache_lookup(r, r.where("chunk_index % 2 = 0").select("request_key", F.lit("stored").alias("response")))
    both = hit.select("pass", F.lit(1).alias("h")).unionByName(miss.select("pass", F.lit(0).alias("h")))
    return both.groupBy("pass").agg(F.count_if(F.col("h") == 1).alias("hits"), F.count_if(F.col("h") == 0).alias("misses"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    return V.run_model_pass(requests(spark, d).where("pass = 'guide'"), V.keyword_stub)


@query("SELECT count(*) AS n, count(*) AS answered FROM conversations")
def run_model_pass(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("answered"))


@query()
def parse_model_response(spark: SparkSession, d: str) -> DataFrame:
    return V.parse_model_response(responses(spark, d)).select("request_key", "rule", "span_text", "description")


@query(f"WITH {REQUESTS} SELECT doc_id, count(*) AS passes, count(*) FILTER (pass = 'structure') AS failed, count(*) FILTER (pass = 'structure') > 0 AS partial FROM q GROUP BY doc_id")
def pass_metrics(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("pass") == "structure"
    return requests(spark, d).groupBy("doc_id").agg(F.count("*").alias("passes"), F.count_if(failed).alias("failed"), (F.count_if(failed) > 0).alias("partial"))


@query(f"WITH {REQUESTS} SELECT count(*) AS chunks, count(*) FILTER (length(text) > 200) AS succeeded, count(*) FILTER (length(text) <= 200) AS empty FROM q WHERE pass = 'guide'")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).where("pass = 'guide'").agg(F.count("*").alias("chunks"), F.count_if(F.length("text") > 200).alias("succeeded"), F.count_if(F.length("text") <= 200).alias("empty"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), F.lit("minor").alias("severity"), F.col("l_returnflag").alias("description"), F.col("l_linestatus").alias("suggestion"),
                    F.array("l_linenumber").alias("source_workers"), F.when(F.col("l_tax") > 0.04, "a").otherwise("b").alias("evidence_source"), F.when(F.col("l_linenumber") > 1, "why").otherwise(" ").alias("reasoning"), F.col("l_returnflag").alias("span_text"), "l_orderkey")


@query("SELECT l_orderkey * 10 + l_linenumber AS source_id, CASE WHEN max(l_quantity) > 40 THEN 'blocker' ELSE 'minor' END AS severity, min(l_returnflag) AS description FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 10")
def apply_verdicts(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    q = F.col("l_quantity")
    verdict = F.when(q > 40, "revise").when(q > 10, "accept").when(q > 5, "reject").otherwise("insufficient_context")
    v = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), verdict.alias("verdict"), F.lit("blocker").alias("severity"), F.lit(" ").alias("description"), F.lit("").alias("suggestion"))
    c = candidates(spark, d).groupBy("source_id").agg(F.first("severity").alias("severity"), F.min("description").alias("description"), F.min("suggestion").alias("suggestion"))
    return C.apply_verdicts(c, v).select("source_id", "severity", "description")


@query("SELECT l_orderkey AS final_id, list_sort(list_distinct(list(l_linenumber))) AS source_workers, CASE WHEN max(l_linenumber) > 1 THEN 'why' END AS reasoning, string_agg(DISTINCT CASE WHEN l_tax > 0.04 THEN 'a' ELSE 'b' END, '+' ORDER BY CASE WHEN l_tax > 0.04 THEN 'a' ELSE 'b' END) AS evidence_source FROM lineitem GROUP BY 1")
def critic_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    finals = c.groupBy(F.col("l_orderkey").alias("final_id")).agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    return C.critic_reconstruct(finals, c.drop("l_orderkey")).select("final_id", "source_workers", "reasoning", "evidence_source")


@query("SELECT l_orderkey AS batch, l_linenumber AS id, CASE WHEN max(l_quantity) > 40 THEN 'suggestion' ELSE 'blocker' END AS severity FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2")
def review_join(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    answers = i.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"), F.when(F.col("l_quantity") > 40, "odd").otherwise("blocker").alias("s"))
    items = i.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"))
    return answers.join(items, ["batch", "id"]).select("batch", "id", F.when(F.col("s").isin("blocker", "minor", "suggestion"), F.col("s")).otherwise("suggestion").alias("severity"))


def guide(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    return b.select((k % 4).cast("string").alias("guide"), k.cast("string").alias("rule"), F.when(k % 3 == 0, "").otherwise(F.substring("text", 1, 20)).alias("title"), F.when(k % 9 == 0, " ").otherwise(F.trim("text")).alias("text"),
                    F.when(k % 2 == 0, (k * 10).cast("int")).alias("priority"), F.when(k % 5 == 0, "token").alias("scope"), F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("bad_examples"))


@query("SELECT CAST(item_id AS VARCHAR) AS rule, CASE WHEN item_id % 3 = 0 THEN substring(trim(text, ' '), 1, 60) ELSE trim(substring(text, 1, 20), ' ') END AS title, CAST(CASE WHEN item_id % 2 = 0 THEN least(100, item_id * 10) ELSE 50 END AS INT) AS priority, CASE WHEN item_id % 5 = 0 THEN 'token' ELSE 'all' END AS scope FROM benchmark WHERE item_id % 9 <> 0")
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_rules(guide(spark, d)).select("rule", "title", "priority", "scope")


@query("SELECT 'Lexicon.' || regexp_replace(lower(c_mktsegment || ' ' || c_nationkey), '[^\\p{L}\\p{N}]+', '_', 'g') AS rule, count(*) AS n FROM customer GROUP BY 1")
def validate_lexicon(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("forbidden").alias("kind"), F.concat_ws(" ", F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("term"), F.lit("").alias("replacement"))
    return V.validate_lexicon(c).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT CAST(item_id % 4 AS VARCHAR) AS guide, sha256('[' || string_agg('{"rule":"' || item_id || '","title":' || to_json(CASE WHEN item_id % 3 = 0 THEN '' ELSE substring(text, 1, 20) END) || ',"text":' || to_json(CASE WHEN item_id % 9 = 0 THEN ' ' ELSE trim(text, ' ') END) || '}', ',' ORDER BY CAST(item_id AS VARCHAR)) || ']') AS content_hash FROM benchmark GROUP BY 1""")
def guide_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.guide_hash(guide(spark, d))


@query("SELECT CAST(item_id % 4 AS VARCHAR) AS guide, count(*) AS n_rules, count(*) FILTER (item_id % 9 <> 0) AS with_text, count(*) FILTER (item_id % 2 = 0) AS with_examples, count(*) FILTER (item_id % 2 = 0) AS with_metadata, count(*) = count(*) FILTER (item_id % 9 <> 0) AS ready FROM benchmark GROUP BY 1")
def guide_readiness(spark: SparkSession, d: str) -> DataFrame:
    return V.guide_readiness(guide(spark, d))


@query(FOUND + "SELECT rule, CAST(CASE severity WHEN 'error' THEN 90 WHEN 'warning' THEN 60 ELSE 40 END AS INT) AS priority, rule <> 'Digits_Long' AS machine_verifiable, count(*) AS n FROM found GROUP BY ALL")
def authority_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = V.authority_metadata(rule_table(spark)).select("rule", "priority", "machine_verifiable")
    return findings(spark, d).select("rule").join(meta, "rule").groupBy("rule", "priority", "machine_verifiable").agg(F.count("*").alias("n"))


def suggested(spark: SparkSession, d: str) -> DataFrame:
    """Findings as the reports of an evaluation: a document is a case, a line a block, the words found the suggestion."""
    return findings(spark, d).select(F.col("doc_id").alias("case"), "rule", "severity", F.col("line").alias("block_index"), "text", F.col("text").alias("suggestion"))


def expectations(spark: SparkSession, d: str) -> DataFrame:
    """Documents of low quality should have doubled marks, good ones must not; what else is asked for differs by document."""
    x = table(spark, d, "labels")
    low, k = F.col("quality") == 0, F.col("doc_id") % 3
    wanted = F.when(low, "expect").otherwise("forbid")

    def item(kind: str, polarity: Column, **given: Column) -> Column:
        names = {"rule": "string", "block_index": "int", "text": "string", "value": "string", "match": "string"}
        return F.struct(F.lit(kind).alias("kind"), polarity.alias("polarity"), *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in names.items()))

    items = F.array(
        item("rules", wanted, rule=F.lit("Exclamation_Double")), item("rules", F.lit("expect"), rule=F.when(k == 0, "Digits_Long").otherwise("HomogeneousMembers")),
        item("blocks", F.lit("expect"), block_index=(1 + k).cast("int")), item("spans", wanted, text=F.when(k == 0, "!!").when(k == 1, ", ").otherwise('"')),
        item("suggestions", F.lit("expect"), rule=F.when(k == 2, "Exclamation_Double"), value=F.when(k == 0, "E").when(k == 1, "^[A-M].*,").otherwise("!!"), match=F.when(k == 0, "contains").when(k == 1, "regex").otherwise("exact")))
    return x.select(F.col("doc_id").alias("case"), F.explode(items).alias("i")).select("case", "i.*")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval is the two commonest rules of a document, the finder whatever isn't a suggestion; each second run has told of its candidates."""
    found = suggested(spark, d)
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)))
    cases = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", words.alias("tokens"), F.length("text").alias("latency_ms")), "doc_id")
    cases = cases.select(F.col("doc_id").alias("case"), (F.col("toxic") == 1).alias("clean"), (F.col("doc_id") % 2 == 0).alias("candidate_observed"), "latency_ms", "tokens", F.lit(1).alias("token_calls"))
    place = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("n"), "rule"))
    selected = found.groupBy("case", "rule").agg(F.count("*").alias("n")).withColumn("place", place).where("place <= 2")
    return E.evaluate_cases(cases, expectations(spark, d), found, selected, found.where("severity <> 'suggestion'"))


RESULTS = FOUND + """, items AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'expect' ELSE 'forbid' END AS p, 'rules' AS kind, 'Exclamation_Double' AS rule, NULL::INT AS blk, NULL AS txt, NULL AS val FROM labels
UNION ALL SELECT doc_id, 'expect', 'rules', CASE WHEN doc_id % 3 = 0 THEN 'Digits_Long' ELSE 'HomogeneousMembers' END, NULL, NULL, NULL FROM labels
UNION ALL SELECT doc_id, 'expect', 'blocks', NULL, 1 + doc_id % 3, NULL, NULL FROM labels
UNION ALL SELECT doc_id, CASE WHEN quality = 0 THEN 'expect' ELSE 'forbid' END, 'spans', NULL, NULL, CASE doc_id % 3 WHEN 0 THEN '!!' WHEN 1 THEN ', ' ELSE '"' END, NULL FROM labels
UNION ALL SELECT doc_id, 'expect', 'suggestions', CASE WHEN doc_id % 3 = 2 THEN 'Exclamation_Double' END, NULL, NULL, 'x' FROM labels),
met AS (SELECT i.*, EXISTS (SELECT 1 FROM found f WHERE f.doc_id = i.doc_id AND (i.rule IS NULL OR f.rule = i.rule) AND (i.blk IS NULL OR f.line = i.blk) AND (i.txt IS NULL OR contains(f.text, i.txt))
AND (i.val IS NULL OR CASE i.doc_id % 3 WHEN 0 THEN contains(lower(f.text), 'e') WHEN 1 THEN regexp_matches(f.text, '(?i)^[A-M].*,') ELSE f.text = '!!' END)) AS hit FROM items i),
ranked AS (SELECT doc_id, rule, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rule) AS place FROM (SELECT doc_id, rule, count(*) AS n FROM found GROUP BY ALL)),
ids AS (SELECT DISTINCT doc_id, rule FROM items WHERE kind = 'rules' AND p = 'expect'),
st AS (SELECT doc_id, count(*) AS rule_ids, count(f) AS final_rule_hits, count(place) AS retrieval_rule_hits, count(c) AS candidate_rule_hits FROM ids LEFT JOIN (SELECT doc_id, rule, 1 AS f, max(CASE WHEN severity <> 'suggestion' THEN 1 END) AS c FROM found GROUP BY 1, 2) USING (doc_id, rule)
LEFT JOIN (FROM ranked WHERE place <= 2) USING (doc_id, rule) GROUP BY 1),
co AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (p = 'expect' AND kind = '{k}') AS expected_{k}, count(*) FILTER (p = 'expect' AND hit AND kind = '{k}') AS hit_{k}" for k in E.KINDS) + """, count(*) FILTER (p = 'expect' AND NOT hit) AS missing, count(*) FILTER (p = 'forbid' AND hit) AS violations FROM met GROUP BY 1),
res AS (SELECT doc_id AS "case", toxic = 1 AS clean, true AS retrieval_observed, doc_id % 2 = 0 AS candidate_observed, CAST(length(text) AS DOUBLE) AS latency_ms, len(regexp_extract_all(text, '[^ \n]+')) AS tokens, CAST(1 AS BIGINT) AS token_calls, co.* EXCLUDE (doc_id), st.* EXCLUDE (doc_id),
coalesce(n, 0) AS issues_found, toxic = 1 AND coalesce(n, 0) > 0 AS clean_failure, missing = 0 AND violations = 0 AND NOT (toxic = 1 AND coalesce(n, 0) > 0) AS passed
FROM labels JOIN documents USING (doc_id) JOIN co USING (doc_id) JOIN st USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY 1) USING (doc_id)),
m AS (SELECT count(*) AS cases, count(*) FILTER (passed) / count(*) AS pass_rate, """ + ", ".join(f"sum(hit_{k}) / nullif(sum(expected_{k}), 0) AS {k[:-1]}_recall" for k in E.KINDS) + """, CAST(sum(violations) AS BIGINT) AS violations, count(*) FILTER (clean_failure) AS clean_failures,
sum(retrieval_rule_hits) / sum(rule_ids) AS rule_recall_at_k, sum(candidate_rule_hits) FILTER (candidate_observed) / sum(rule_ids) FILTER (candidate_observed) AS finder_rule_recall, sum(final_rule_hits) FILTER (candidate_observed) / sum(rule_ids) FILTER (candidate_observed) AS verifier_rule_recall,
sum(latency_ms) AS latency_ms_total, CAST(sum(tokens) AS BIGINT) AS tokens_total, CAST(sum(token_calls) AS BIGINT) AS token_calls_total FROM res) """


@query(RESULTS + "SELECT * FROM res")
def evaluate_cases(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d)


@query(RESULTS + "SELECT * FROM m")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.eval_metrics(results(spark, d))


@query(RESULTS + " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS value, {n} {'>=' if kind == 'min' else '<='} {bound} AS ok FROM m" for n, (kind, bound) in E.THRESHOLDS.items()))
def eval_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return E.eval_thresholds(E.eval_metrics(results(spark, d)))


@query(FOUND + "SELECT l.doc_id AS \"case\", f.line, f.rule FROM labels l JOIN found f ON l.doc_id = f.doc_id WHERE (l.quality = 1 OR f.rule = 'Exclamation_Double') AND (l.toxic = 0 OR contains(f.text, 'e'))")
def expectation_match(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    e = table(spark, d, "labels").select(F.col("doc_id").alias("case"), F.when(F.col("quality") == 0, "Exclamation_Double").alias("rule"), none.cast("int").alias("line"), none.cast("string").alias("severity"), F.when(F.col("toxic") == 1, "e").alias("text"))
    return C.expectation_match(e, findings(spark, d).withColumnRenamed("doc_id", "case")).select("case", "line", "rule")


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_name = p_type WHEN 1 THEN regexp_matches(p_name, '(?i)^[A-M]') ELSE contains(lower(p_name), 'a') END AS ok FROM part")
def suggestion_match(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "exact").when(F.col("p_size") % 3 == 1, "regex").otherwise("contains")
    expected = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, "^[A-M]").otherwise("A")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), E.suggestion_match(kind, expected, F.col("p_name")).alias("ok"))


@query(FOUND + "SELECT doc_id AS \"case\", CASE WHEN doc_id IN (SELECT doc_id FROM found WHERE rule = 'Exclamation_Double') THEN 0 ELSE 1 END AS n_missing, CASE WHEN doc_id IN (SELECT doc_id FROM found WHERE rule = 'Email_Address') THEN 1 ELSE 0 END AS n_forbidden, "
       "(SELECT count(DISTINCT text) FROM found f WHERE f.doc_id = labels.doc_id AND text IN ('!!', '!!!')) AS n_texts FROM labels")
def regression_rules(spark: SparkSession, d: str) -> DataFrame:
    words = lambda *w: F.array(*map(F.lit, w))
    cases = table(spark, d, "labels").select(F.col("doc_id").alias("case"), words("Exclamation_Double").alias("expect_rules"), words("Email_Address").alias("forbid_rules"), words("!!", "!!!").alias("forbid_texts"))
    found = findings(spark, d).groupBy(F.col("doc_id").alias("case")).agg(F.collect_set("rule").alias("rules"), F.collect_set("text").alias("texts"))
    return E.regression_rules(cases, found).select("case", F.size("missing").alias("n_missing"), F.size("forbidden").alias("n_forbidden"), F.size("forbidden_texts").alias("n_texts"))
