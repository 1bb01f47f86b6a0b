"""Queries over Markdown blocks, reports and passes that join several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.operators import combine as C
from docaudit.operators import lint as L
from docaudit.operators import review as V
from docaudit.plans.findings import FOUND, findings, rule_table
from docaudit.plans.registry import query, table
from docaudit.plans.stats import HITS, hits
from docaudit.plans.text import TURNS, turns
from docaudit.sources import markdown as M


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations with Markdown round them."""
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("# "), F.col("role"), F.lit("\n\nSee **"), F.substring("text", 1, 12), F.lit("** and [link](http://x.org/"), F.col("turn").cast("string"), F.lit(").\n- "), F.col("text"), F.lit("\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\ncode\n```\n"))
    return M.markdown_blocks(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text")))


@query()
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", "block_index", "type", "level", "list_kind", F.length("plain").alias("n"))


@query("SELECT conv_id * 1000 + turn AS doc_id, 'link' AS text, 'http://x.org/' || turn AS target FROM conversations")
def block_links(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", F.explode("links").alias("l")).select("doc_id", "l.text", "l.target").where("target like 'http://x.org/%'")


@query("SELECT conv_id * 1000 + turn AS doc_id, unnest(['a | b', '1 | 2']) AS cells FROM conversations")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).where("size(cells) = 2 and plain in ('a | b', '1 | 2')").select("doc_id", F.array_join("cells", " | ").alias("cells"))


@query()
def format_spans(spark: SparkSession, d: str) -> DataFrame:
    return M.format_spans(marked(spark, d))


@query()
def block_json(spark: SparkSession, d: str) -> DataFrame:
    b = marked(spark, d)
    return b.select("doc_id", "block_index", F.md5(M.block_json(b)).alias("digest"))


@query(FOUND + "SELECT doc_id, CASE severity WHEN 'error' THEN 'error' WHEN 'suggestion' THEN 'suggestion' ELSE 'warning' END AS severity, count(*) AS n FROM found GROUP BY ALL")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).withColumn("block_index", F.col("line"))
    meta = rule_table(spark).withColumn("machine_verifiable", F.lit(True))
    return V.report_rows(V.engine_evidence(rows, meta).withColumn("reasoning", F.lit(""))).groupBy("doc_id", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {HITS} SELECT "user", rule, upper(rule) AS title, count FROM hits""")
def insights(spark: SparkSession, d: str) -> DataFrame:
    rows = C.rule_hits(hits(spark, d))
    titles = C.rule_titles(rows.select("rule", F.upper("rule").alias("title")).distinct())
    return rows.join(titles, "rule", "left").select("user", "rule", "title", "count")


@query("SELECT CAST(item_id AS VARCHAR) AS rule, substring(text, 1, 12) AS term, CAST(row_number() OVER (ORDER BY item_id) AS INT) AS at FROM benchmark QUALIFY row_number() OVER (ORDER BY item_id) <= 60")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array(F.substring("text", 1, 12))).alias("pos", "term"))
    first = b.orderBy("item_id", "pos").limit(60)
    return first.select(F.col("item_id").cast("string").alias("rule"), "term", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("item_id")).alias("at"))


@query(f"""WITH {TURNS}, w AS (SELECT doc_id, block_index, unnest(regexp_extract_all(lower(plain), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM turns)
SELECT doc_id, block_index, term, count(*) AS n FROM w WHERE term IN ('the', 'la', 'der') AND NOT (term = 'la' AND doc_id % 2 = 0) GROUP BY ALL""")
def lexicon_pass(spark: SparkSession, d: str) -> DataFrame:
    """Forbidden terms without those that a document's allowed list takes out."""
    lexicon = spark.createDataFrame([("the", "", ""), ("la", "", ""), ("der", "", "")], "term string, replacement string, comment string")
    blocks = turns(spark, d)
    allowed = blocks.where("doc_id % 2 = 0").select("doc_id", F.lit("la").alias("term")).distinct()
    return L.lexicon_match(blocks, lexicon).join(allowed, ["doc_id", "term"], "left_anti").select("doc_id", "block_index", "term", "n")
