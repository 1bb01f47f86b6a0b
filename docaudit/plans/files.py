"""Queries that write to the shared folder and read back, and field functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators import catalogue
from docaudit.operators import lint as L
from docaudit.plans.findings import FOUND, findings
from docaudit.plans.registry import query, table
from docaudit.plans.text import LINES, lines
from docaudit.sources import io
from docaudit.sources.shared import shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def scan_audit(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "audit")
    e = table(spark, d, "events")
    io.append_audit(e.select(F.lit(1704067200.5).alias("ts"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("action"), F.col("value").cast("string").alias("amount")), path)
    e.limit(3).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return io.read_audit(spark, path).where("extra.amount is not null").groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"))


@query("SELECT event_type AS worker, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE floor(value) > 0 GROUP BY 1")
def append_usage(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "usage")
    usage = table(spark, d, "events").select(F.col("event_type").alias("worker"), F.floor("value").cast("long").alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))
    for part in (usage.where("worker < 'f'"), usage.where("worker >= 'f'")):
        io.append_usage(part, path)
    return spark.read.parquet(path).groupBy("worker").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("tokens"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def append_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "snapshots")
    io.append_snapshot(table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("checked_at"), F.col("props").alias("text")), path)
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(FOUND + "SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id")
def append_history(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "history")
    io.append_history(findings(spark, d).groupBy("doc_id").agg(F.count("*").alias("total")), path)
    return spark.read.parquet(path).select("doc_id", F.get_json_object("report", "$.total").cast("long").alias("n"))


@query(FOUND + "SELECT severity, count(*) AS n FROM found GROUP BY severity")
def sink_findings_report(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "report")
    io.sink_report(findings(spark, d), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality, toxic FROM labels")
def sink_eval_json(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "eval")
    labels = table(spark, d, "labels")
    io.sink_eval_json(labels, path)
    return spark.read.schema(labels.schema).json(path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS spec_id, 'info/description' AS path_str, 2 AS line, 'description' AS key, p_name AS text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'paths/[0]/summary', 4, 'summary', p_type FROM part")
def scan_spec_fields(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("info:\n  description: '"), F.col("p_name"), F.lit("'\npaths:\n- summary: '"), F.col("p_type"), F.lit("'\n"))
    return io.spec_fields(table(spark, d, "part").select(F.col("p_partkey").alias("spec_id"), body.alias("body")))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'response' ELSE 'schema' END AS kind, CASE WHEN p_size % 3 = 2 THEN p_brand END AS name FROM part")
def field_kind(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_size") % 3 == 0, "paths/a/summary").when(F.col("p_size") % 3 == 1, "paths/a/responses/200/description").otherwise(F.concat(F.lit("components/schemas/X/properties/"), F.col("p_brand"), F.lit("/description")))
    return table(spark, d, "part").select("p_partkey", io.field_kind(path).alias("kind"), io.field_name(path).alias("name"))


#: Rules that texts in Latin letters can break, as patterns without the classes on which the two engines differ; of the rest none has a match there.
LATIN_RULES = {
    "Dash_EmDash": "—", "FileFormats_ExtensionCase": r"\.(?:TXT|PDF|JSON|CSV|YAML|PNG|JPG|JPEG|SVG|ZIP|SQL|MD|SH|PY|HTML|XML)\b", "Formatting_LineSeparator": " ", "Formatting_SoftHyphen": "­",
    "HomogeneousMembers": r"[\p{L}\p{N}\p{M}_]+,\s+[\p{L}\p{N}\p{M}_]+,\s+[\p{L}\p{N}\p{M}_]+,\s+[\p{L}\p{N}\p{M}_]+,", "Parentheses": r"\([^)]{25,}\)", "Quotes_LatinInQuotes": r'[«„"][A-Za-z][^»"„]*[»"]', "Quotes_Straight": r'"[^"]*"',
    "Slash_Words": r"\b[A-Z]{2,}/[A-Z]{2,}\b", "Spacing_Double": r"[^\n ] {2,}[^\n ]", "Units_International": r"\b(?:MB|GB|TB|KB|Mbit|Gbit|kbit|MHz|GHz|kHz|THz)\b",
}
_COUNTS = " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n FROM lines, unnest(regexp_extract_all(text, '{p}')) HAVING count(*) > 0" for rule, p in LATIN_RULES.items())


@query(f"WITH {LINES} {_COUNTS}")
def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return L.lint_many(lines(spark, d), catalogue.RULES).groupBy("rule").agg(F.count("*").alias("n"))
