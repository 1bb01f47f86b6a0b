"""Queries over documents and pages: clean-up, lines, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import segment as S
from docaudit.plans.registry import query, table


@query("SELECT doc_id, source, CASE WHEN starts_with(text, '<') THEN 'html' WHEN regexp_matches(text, '(^|\\n)#') THEN 'md' ELSE 'txt' END AS format, length(text) AS n FROM documents WHERE length(trim(text)) > 0")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length(F.trim("text")) > 0)
    kind = F.when(F.startswith("text", F.lit("<")), "html").when(F.col("text").rlike("(^|\n)#"), "md").otherwise("txt")
    return docs.select("doc_id", "source", kind.alias("format"), F.length("text").cast("long").alias("n"))


@query("SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, length(html) AS n FROM pages WHERE length(trim(html)) > 0")
def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.length(F.trim("html")) > 0).select("page_id", "url", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.length("html").cast("long").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, chr(160) || chr(8201) || chr(8239) || chr(173), '   '), '[ \t]+', ' ', 'g'), '\s+([.,:;!?])', '\1', 'g'), ' ')) AS digest FROM documents")
def normalize_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_spaces(F.col("text"))).alias("digest"))


def replaced(column: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The rewriting rules as nested SQL."""
    for pattern, to in rules:
        pattern, to = pattern.replace("'", "''"), to.replace("$", "\\")
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


@query(f"SELECT doc_id, md5(trim({replaced('text', T.MARKDOWN)}, ' ')) AS digest FROM documents")
def markdown_to_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.markdown_to_plain(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(trim({replaced('text', T.MARKDOWN_INLINE)}, ' ')) AS digest FROM documents")
def markdown_inline_to_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.markdown_inline_to_plain(F.col("text"))).alias("digest"))


@query()
def mask_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.mask_pii(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, md5(trim({replaced('text', T.VOLATILE)}, ' -–—•·')) AS digest FROM documents")
def mask_volatile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.mask_volatile(F.col("text"))).alias("digest"))


@query("SELECT count(*) AS n FROM documents WHERE length(trim(text)) > 0")
def empty_text_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length(F.trim("text")) > 0).agg(F.count("*").alias("n"))


@query("SELECT part AS cell, CASE WHEN regexp_matches(part, '^[=+\\-@\\t\\r]') THEN '''' || part ELSE part END AS escaped FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[+=@-][A-Za-z0-9]{1,12}')) AS part FROM documents)")
def escape_formula_cells(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select(F.explode(F.expr("regexp_extract_all(text, '[+=@-][A-Za-z0-9]{1,12}', 0)")).alias("cell")).distinct()
    return parts.select("cell", T.escape_formula(F.col("cell")).alias("escaped"))


LINES = "lines AS (SELECT doc_id, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INT) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return S.explode_lines(table(spark, d, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line, md5(text) AS digest FROM lines")
def explode_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line", F.md5("text").alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, CAST(floor((line - 1) / 5) AS INT) AS batch, count(*) AS n FROM lines GROUP BY ALL")
def line_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.line_batches(lines(spark, d), 5).groupBy("doc_id", "batch").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, position('the' IN text) - 1 AS at, CAST(len(string_split(substring(text, 1, position('the' IN text) - 1), chr(10))) AS INT) AS line,
CAST(length(list_last(string_split(substring(text, 1, position('the' IN text) - 1), chr(10)))) + 1 AS INT) AS col FROM documents WHERE position('the' IN text) > 0""")
def offset_to_line_col(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "documents").withColumn("at", F.locate("the", "text") - 1).where("at >= 0")
    return at.withColumn("lc", T.line_col(F.col("text"), F.col("at"))).select("doc_id", F.col("at").cast("long").alias("at"), F.col("lc.line").alias("line"), F.col("lc.column").alias("col"))


@query()
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return S.sentences(lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("text")).alias("longest"))


@query(r"SELECT doc_id, regexp_extract(substring(text, 1, 39), '([^.!?]*)$', 1) AS l, trim(regexp_extract(substring(text, 1, 39), '([^.!?]*)$', 1) || regexp_extract(substring(text, 40), '^([^.!?]*[.!?]?)', 1), ' ') AS sentence FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents) WHERE length(text) >= 40")
def sentence_around(spark: SparkSession, d: str) -> DataFrame:
    first = lines(spark, d).where("line = 1").where(F.length("text") >= 40)
    return first.select("doc_id", F.regexp_extract(F.substring("text", 1, 39), r"([^.!?]*)$", 1).alias("l"), T.sentence_around(F.col("text"), F.lit(40)).alias("sentence"))


@query(r"SELECT doc_id, regexp_extract(substring(text, 1, 39), '(\S*)$', 1) || regexp_extract(substring(text, 40), '^(\S*)', 1) AS word FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents) WHERE length(text) >= 40")
def word_around(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where("line = 1").where(F.length("text") >= 40).select("doc_id", T.word_around(F.col("text"), F.lit(40)).alias("word"))


@query("""SELECT doc_id, CASE WHEN position(' the ' IN text) > 0 THEN substring(text, greatest(position(' the ' IN text) - 140, 1), 5 + least(position(' the ' IN text) - 1, 140) + 140) ELSE substring(text, 1, 280) END AS snippet FROM documents""")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit(" the ")).alias("snippet"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.text_blocks(table(spark, d, "documents"))


#: Blocks of ``documents``: no line there is a list item with a marker, so runs of non-blank lines are paragraphs.
BLOCKS = rf"""{LINES}, marked AS (
  SELECT *, regexp_matches(text, '^(\s*)([-*+]|\d+[.)])\s+(.+)$') AS item, trim(text, ' ') = '' AS blank FROM lines
), started AS (
  SELECT *, item OR coalesce(lag(item OR blank) OVER (PARTITION BY doc_id ORDER BY line), true) AS start FROM marked
), numbered AS (
  SELECT *, CAST(sum(CAST(start AS INT)) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INT) AS block_index FROM started WHERE NOT blank
), blocks AS (
  SELECT doc_id, block_index, CASE WHEN bool_or(item) THEN 'list_item' ELSE 'paragraph' END AS type,
         string_agg(CASE WHEN item THEN regexp_extract(text, '^(\s*)([-*+]|\d+[.)])\s+(.+)$', 3) ELSE trim(text, ' ') END, ' ' ORDER BY line) AS plain
  FROM numbered GROUP BY doc_id, block_index)"""


@query(f"WITH {BLOCKS} SELECT doc_id, block_index, type, md5(plain) AS digest FROM blocks")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("doc_id", "block_index", "type", F.md5("plain").alias("digest"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as blocks: assistants' turns are list items, others paragraphs; each conversation is a document."""
    kind = F.when(F.col("role") == "assistant", "list_item").when(F.col("role") == "system", "heading").otherwise("paragraph")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_index"), kind.alias("type"), F.lit(1).alias("level"), F.col("text").alias("plain"))


TURNS = "turns AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS block_index, CASE role WHEN 'assistant' THEN 'list_item' WHEN 'system' THEN 'heading' ELSE 'paragraph' END AS type, text AS plain FROM conversations)"


@query(f"""WITH {TURNS}, a AS (SELECT *, type = 'list_item' AS item, coalesce(lag(type = 'list_item') OVER w, false) AS before FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)),
b AS (SELECT *, CASE WHEN item THEN sum(CASE WHEN item AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index) END AS list_group FROM a),
c AS (SELECT *, CASE WHEN type = 'paragraph' THEN lead(list_group) OVER (PARTITION BY doc_id ORDER BY block_index) END AS introduces_list FROM b),
e AS (SELECT *, last_value(CASE WHEN introduces_list IS NOT NULL THEN block_index END IGNORE NULLS) OVER w AS intro, last_value(introduces_list IGNORE NULLS) OVER w AS grp FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY block_index))
SELECT doc_id, block_index, CAST(list_group AS BIGINT) AS list_group, CAST(introduces_list AS BIGINT) AS introduces_list, CASE WHEN item AND grp = list_group THEN intro END AS list_intro_index FROM e""")
def attach_list_intro(spark: SparkSession, d: str) -> DataFrame:
    return S.attach_list_intro(turns(spark, d)).select("doc_id", "block_index", F.col("list_group").cast("long").alias("list_group"), F.col("introduces_list").cast("long").alias("introduces_list"), "list_intro_index")


@query(f"WITH {TURNS} SELECT doc_id, block_index, md5(last_value(CASE WHEN type = 'heading' THEN plain END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_index)) AS heading FROM turns")
def nearest_heading(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_heading(turns(spark, d)).select("doc_id", "block_index", F.md5("heading").alias("heading"))


@query(f"""WITH {TURNS}, h AS (SELECT doc_id, block_index, plain, CASE WHEN type <> 'list_item' THEN block_index % 3 END AS level FROM turns),
l AS (SELECT doc_id, block_index, {', '.join(f"last_value(CASE WHEN level = {k} THEN block_index END IGNORE NULLS) OVER w AS i{k}, last_value(CASE WHEN level = {k} THEN plain END IGNORE NULLS) OVER w AS t{k}" for k in range(3))}
FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block_index))
SELECT doc_id, block_index, md5(concat_ws(' / ', t0, CASE WHEN i1 > coalesce(i0, -1) THEN t1 END, CASE WHEN i2 > greatest(coalesce(i0, -1), coalesce(i1, -1)) THEN t2 END)) AS path FROM l""")
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    """Turns that are no answers as headings of three levels."""
    levels = turns(spark, d).withColumn("type", F.when(F.col("type") == "list_item", "paragraph").otherwise("heading")).withColumn("level", F.col("block_index") % 3 + 1)
    return S.heading_path(levels).select("doc_id", "block_index", F.md5(F.array_join("path", " / ")).alias("path"))


@query(f"""WITH {TURNS}, a AS (SELECT *, type = 'list_item' AS item, coalesce(lead(type = 'list_item') OVER w, false) AS nxt FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)),
b AS (SELECT *, type = 'paragraph' AND regexp_matches(plain, '[:：]$') AND nxt AS intro FROM a),
c AS (SELECT *, coalesce(lag(item OR intro) OVER (PARTITION BY doc_id ORDER BY block_index), false) AS before FROM b)
SELECT doc_id, block_index, CAST(sum(CASE WHEN item AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS INT) AS unit FROM c""")
def semantic_units(spark: SparkSession, d: str) -> DataFrame:
    return S.semantic_units(turns(spark, d)).select("doc_id", "block_index", "unit")


@query()
def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_blocks(S.semantic_units(turns(spark, d)), 4, 1)


@query("SELECT doc_id, n, CASE WHEN ceil(n / 6.0) <= 24 THEN 8 WHEN ceil(n / 10.0) <= 24 THEN 12 WHEN ceil(n / 14.0) <= 24 THEN 16 WHEN ceil(n / 18.0) <= 24 THEN 20 WHEN ceil(n / 22.0) <= 24 THEN 24 ELSE 28 END AS size FROM (SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n FROM documents)")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.split("text", " ", -1))
    return table(spark, d, "documents").select("doc_id", n.alias("n"), S.chunk_plan(n).alias("size"))


@query()
def chunk_window_context(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d)
    return S.chunk_window_context(S.chunk_blocks(S.semantic_units(rows), 4, 1), rows, 2)


@query(f"WITH {TURNS} SELECT DISTINCT t.doc_id, t.block_index, md5(t.plain) AS digest FROM turns t JOIN turns c ON t.doc_id = c.doc_id AND c.type = 'list_item' AND abs(t.block_index - c.block_index) <= 1")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d)
    return S.neighbour_context(rows.where("type = 'list_item'"), rows).select("doc_id", "block_index", F.md5("plain").alias("digest"))


@query(rf"""WITH {TURNS}, h AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN plain END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_index) AS heading FROM turns),
l AS (SELECT doc_id, block_index, coalesce(heading || ': ', '') || array_to_string(string_split_regex(trim(plain, ' '), '\s+')[1:12], ' ') AS line FROM h),
c AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY block_index) AS BIGINT) AS upto FROM l) SELECT doc_id, block_index, line, upto FROM c WHERE upto <= 400""")
def compress_document(spark: SparkSession, d: str) -> DataFrame:
    return S.compress_document(turns(spark, d), limit=400)


@query()
def pack_by_chars(spark: SparkSession, d: str) -> DataFrame:
    return S.pack_by_chars(blocks(spark, d)).select("doc_id", "part", F.length("text").alias("n"))


@query(f"WITH {BLOCKS} SELECT doc_id, bool_or(length(plain) >= 40 AND regexp_matches(plain, '[.!?;:]')) AS has_prose FROM blocks GROUP BY doc_id")
def has_prose(spark: SparkSession, d: str) -> DataFrame:
    return S.has_prose(blocks(spark, d))


@query(f"WITH {TURNS} SELECT doc_id, bool_or(type <> 'paragraph') AS has_structure FROM turns GROUP BY doc_id")
def has_structure(spark: SparkSession, d: str) -> DataFrame:
    return S.has_structure(turns(spark, d))


@query("SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}][\\p{L}\\p{N}_-]{3,})', 1)) AS word FROM documents) GROUP BY ALL HAVING count(*) >= 2)) WHERE r <= 80")
def document_index(spark: SparkSession, d: str) -> DataFrame:
    return S.document_index(table(spark, d, "documents"))


@query(f"WITH {BLOCKS} SELECT doc_id, md5(string_agg(plain, chr(10) ORDER BY block_index)) AS digest FROM blocks WHERE plain <> '' GROUP BY doc_id")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    return S.document_text(blocks(spark, d)).select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH {BLOCKS}, j AS (SELECT doc_id, block_index, length('{{"block_index":' || block_index || ',"plain":' || to_json(plain) || ',"type":"' || type || '"}}') + 1 AS n FROM blocks),
u AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id ORDER BY block_index) <= 16000 AS fits FROM j)
SELECT doc_id, count(*) FILTER (fits) AS blocks, count(*) FILTER (NOT fits) AS remaining_blocks, CAST(sum(n) FILTER (fits) AS BIGINT) AS chars FROM u GROUP BY doc_id""")
def document_json_bounded(spark: SparkSession, d: str) -> DataFrame:
    return S.document_json_bounded(blocks(spark, d))
