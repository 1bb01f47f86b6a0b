"""Queries over findings: rules on the lines of ``documents``, joins, de-duplication, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.functions.text import escape_formula
from docaudit.operators import combine as C
from docaudit.operators import lint as L
from docaudit.operators import morph as M
from docaudit.plans.registry import query, table
from docaudit.plans.text import LINES, TURNS, lines, turns
from docaudit.sources.shared import written


def findings(spark: SparkSession, d: str) -> DataFrame:
    return L.lint(lines(spark, d))


def _found(rule: str, pattern: str, severity: str, where: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, line, CAST(coalesce(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i - 1], lambda x: length(x))), 0) + 1 AS INT) AS col,
regexp_extract_all(text, '{p}')[i] AS text, '{rule}' AS rule, '{severity}' AS severity FROM (SELECT *, unnest(generate_series(1, len(regexp_extract_all(text, '{p}')))) AS i FROM lines WHERE {where})"""


FOUND = (
    f"WITH {LINES}, found AS ("
    + " UNION ALL ".join((
        _found("Quotes_Straight", '"[^"]*"', "error"),
        _found("HomogeneousMembers", r"[\p{L}\p{N}\p{M}_]+,\s+[\p{L}\p{N}\p{M}_]+,\s+[\p{L}\p{N}\p{M}_]+,\s+[\p{L}\p{N}\p{M}_]+,", "warning"),
        _found("Spacing_Double", r"[^\n ] {2,}[^\n ]", "error"),
        _found("Digits_Long", r"[0-9]{16}", "suggestion"),
        _found("Email_Address", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", "suggestion"),
        _found("Parentheses", r"\([^)]{25,}\)", "suggestion"),
        _found("Exclamation_Double", r"!{2,}", "warning"),
    ))
    + ") "
)


@query(FOUND + "SELECT doc_id, line, col, text, rule, severity FROM found")
def existence_rules(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("doc_id", "line", F.col("column").alias("col"), "text", "rule", "severity")


@query(FOUND + "SELECT rule, severity, count(*) AS n FROM found GROUP BY ALL")
def findings_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return C.findings_by(findings(spark, d), "rule", "severity")


@query(FOUND + "SELECT doc_id, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'suggestion') AS suggestions FROM found GROUP BY doc_id")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.severity_summary(findings(spark, d))


@query(FOUND + "SELECT source, count(*) AS n FROM found JOIN documents USING (doc_id) GROUP BY source")
def findings_by_page(spark: SparkSession, d: str) -> DataFrame:
    return C.findings_by(findings(spark, d).drop("source").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source")


SWAP = {"of": "from", "onto": "on to", "que": "qui"}


@query(f"""WITH {LINES} SELECT doc_id, line, low AS text, CASE low WHEN 'of' THEN 'from' WHEN 'onto' THEN 'on to' WHEN 'que' THEN 'qui' END AS replacement, count(*) AS n
FROM (SELECT doc_id, line, lower(unnest(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) IN ('of', 'onto', 'que')))) AS low FROM lines) GROUP BY ALL""")
def substitution_rule(spark: SparkSession, d: str) -> DataFrame:
    found = L.existence(lines(spark, d), L.swap_rule("Glossary", SWAP, "Say"))
    return found.groupBy("doc_id", "line", F.lower("text").alias("text"), "replacement").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, hit AS (SELECT doc_id, line, len(regexp_extract_all(text, '\\bthe\\b')) AS a, len(regexp_extract_all(text, '\\bThe\\b')) AS b FROM lines)
SELECT doc_id, CAST(sum(a + b) AS BIGINT) AS n FROM hit WHERE doc_id IN (SELECT doc_id FROM hit GROUP BY doc_id HAVING sum(a) > 0 AND sum(b) > 0) GROUP BY doc_id""")
def consistency_rule(spark: SparkSession, d: str) -> DataFrame:
    return L.consistency(lines(spark, d), "Consistency", r"\bthe\b", r"\bThe\b", "One spelling").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(FOUND + "SELECT doc_id, line, col, rule FROM found WHERE NOT (rule = 'Exclamation_Double' AND text = '!!')")
def rule_exceptions(spark: SparkSession, d: str) -> DataFrame:
    out = spark.createDataFrame([("Exclamation_Double", "!!")], "rule string, text string")
    return L.without_exceptions(findings(spark, d), out).select("doc_id", "line", F.col("column").alias("col"), "rule")


def rule_table(spark: SparkSession) -> DataFrame:
    """Registry of the default rules."""
    rows = [(r.rule, "pattern", "manual" if r.rule == "Digits_Long" else "automatic", r.rule.split("_")[0], r.rule.replace("_", " "), r.severity, r.rule.split("_")[0].lower()) for r in L.DEFAULT_RULES]
    return spark.createDataFrame(rows, "rule string, engine string, automation string, section string, name string, severity string, rule_group string")


@query(FOUND + "SELECT rule, count(*) AS n FROM found WHERE rule <> 'Digits_Long' GROUP BY rule")
def enabled_rules(spark: SparkSession, d: str) -> DataFrame:
    return L.enabled(findings(spark, d), rule_table(spark)).groupBy("rule").agg(F.count("*").alias("n"))


@query(FOUND + "SELECT doc_id, line, col, rule, split_part(rule, '_', 1) AS section, replace(rule, '_', ' ') AS name, CASE WHEN rule = 'Digits_Long' THEN 'manual' ELSE 'automatic' END AS automation, lower(split_part(rule, '_', 1)) AS rule_group FROM found")
def enrich_findings(spark: SparkSession, d: str) -> DataFrame:
    return C.enrich_findings(findings(spark, d), rule_table(spark)).select("doc_id", "line", F.col("column").alias("col"), "rule", "section", "name", "automation", "rule_group")


USER_RULES = [{"id": "u1", "pattern": "th(?:is|at)", "message": "demonstrative"}, {"id": "bad", "pattern": "(a+)+\\1"}, {"id": "none", "pattern": ""}, {"id": "broken", "pattern": "("}]


@query(f"WITH {LINES} SELECT doc_id, line, CAST(len(regexp_extract_all(text, '(?i)th(?:is|at)')) AS BIGINT) AS n FROM lines WHERE regexp_matches(text, '(?i)th(?:is|at)')")
def user_regex_rules(spark: SparkSession, d: str) -> DataFrame:
    return L.user_rules(lines(spark, d), USER_RULES).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS}, terms AS (SELECT lower(text) AS term FROM (SELECT DISTINCT string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS text FROM benchmark) WHERE regexp_full_match(text, '[\\p{{L}}\\p{{N}}_]+ [\\p{{L}}\\p{{N}}_]+')),
w AS (SELECT doc_id, block_index, regexp_extract_all(lower(plain), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM turns),
p AS (SELECT doc_id, block_index, unnest(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w)
SELECT doc_id, block_index, term, count(*) AS n FROM p JOIN terms USING (term) GROUP BY ALL""")
def lexicon_match(spark: SparkSession, d: str) -> DataFrame:
    two = F.concat_ws(" ", F.split("text", " ")[0], F.split("text", " ")[1])
    terms = table(spark, d, "benchmark").select(F.lower(two).alias("term")).distinct().where(F.col("term").rlike(r"^[\p{L}\p{N}_]+ [\p{L}\p{N}_]+$"))
    lexicon = terms.select("term", F.lit("other").alias("replacement"), F.lit("").alias("comment"))
    return L.lexicon_match(turns(spark, d), lexicon).select("doc_id", "block_index", "term", "n")


@query()
def sentence_length(spark: SparkSession, d: str) -> DataFrame:
    return L.sentence_length(lines(spark, d)).select("doc_id", "line", "sentence", "n_words")


@query()
def formal_you(spark: SparkSession, d: str) -> DataFrame:
    forms = spark.createDataFrame([("The", "the"), ("Of", "of"), ("Die", "die"), ("La", "la")], "form string, replacement string")
    return L.formal_you(L.word_tokens(lines(spark, d)), forms)


@query()
def anthropomorphism(spark: SparkSession, d: str) -> DataFrame:
    first, second = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (("the", "la", "der"), ("is", "was", "est", "den")))
    return L.near_pair(L.word_tokens(lines(spark, d)), first, second)


def _morph(spark: SparkSession) -> DataFrame:
    rows = [("the", 0, "the", "ADJ", "sing", "nomn", "masc"), ("these", 0, "this", "ADJ", "plur", "nomn", None), ("is", 0, "be", "VERB", "sing", None, None), ("was", 0, "be", "VERB", "sing", None, None), ("are", 0, "be", "VERB", "plur", None, None),
            ("a", 0, "a", "NOUN", "plur", "nomn", None), ("of", 0, "of", "NOUN", "sing", "gent", "femn"), ("it", 0, "it", "NOUN", "sing", "nomn", "masc"), ("to", 0, "to", "PRTS", None, None, None), ("in", 0, "in", "NOUN", "sing", "nomn", "masc")]
    return spark.createDataFrame(rows, "form string, rank int, lemma string, pos string, number string, grammatical_case string, gender string")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return L.morph_lookup(L.word_tokens(lines(spark, d)), _morph(spark))


def _all_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of every word: those of ``word_table``, others by their endings."""
    tokens = L.word_tokens(lines(spark, d))
    return L.morph_lookup(tokens, written(M.completed(tokens.select("word"), word_table(spark, d)), "readings"))


@query()
def morph_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents by part of speech and number, and how many of these are guessed."""
    return _all_readings(spark, d).groupBy("part", "number").agg(F.count("*").alias("n"), F.count_if("guessed").alias("guessed"))


@query()
def morph_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _readings(spark, d).groupBy("lemma", "part").agg(F.count("*").alias("n"))


def word_table(spark: SparkSession, d: str) -> DataFrame:
    """Three in four of the different words of the documents with a reading that their letters tell, as a morphology table."""
    w = L.word_tokens(lines(spark, d)).select(F.lower("word").alias("form")).distinct().where(F.crc32("form") % 4 != 0)
    part = F.when(F.col("form").rlike("[nt]$"), "NOUN").when(F.col("form").rlike("e$"), "ADJ").when(F.col("form").rlike("(d|ing)$"), "VERB").otherwise("ADV")
    number = F.when(F.col("form").endswith("s"), "plur").otherwise("sing")
    lemma = F.when(F.col("form").endswith("s"), F.expr("left(form, length(form) - 1)")).otherwise(F.col("form"))
    none = F.lit(None).cast("string")
    return w.select("form", F.lit(0).alias("rank"), lemma.alias("lemma"), part.alias("pos"), number.alias("number"), none.alias("grammatical_case"), none.alias("gender"))


@query()
def morph_predicted(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the words that the table of ``word_table`` lacks, by the endings of the others."""
    m = word_table(spark, d)
    made = M.completed(L.word_tokens(lines(spark, d)).select("word"), m)
    return made.where("guessed").select("form", "lemma", F.col("pos").alias("part"), "number")


@query()
def adj_noun_agreement(spark: SparkSession, d: str) -> DataFrame:
    return L.disagreement(_readings(spark, d), "ADJ", "NOUN")


@query()
def subject_verb_agreement(spark: SparkSession, d: str) -> DataFrame:
    return L.subject_verb_disagreement(_readings(spark, d))


@query()
def passive_voice(spark: SparkSession, d: str) -> DataFrame:
    return L.passive_voice(_readings(spark, d))


_WORDS = ", ".join(f"'{w}'" for w in T.TECHNICAL_WORDS)
_PREFIXED = " OR ".join(f"(starts_with(low, '{p}') AND length(low) > {len(p) + 3})" for p in T.TECHNICAL_PREFIXES)
_MARKS = T.OUTER_MARKS.replace("'", "''")
#: Of a word ``low`` in lower case without marks round it.
TECHNICAL = rf"""low <> '' AND (low IN ({_WORDS}) OR regexp_matches(low, '[\p{{Nd}}_/\\]') OR regexp_matches(low, '^[\x00-\x7F]*[a-z][\x00-\x7F]*$') OR {_PREFIXED}
OR regexp_matches(low, '{T.TECHNICAL_COMPOUND}') OR regexp_matches(low, '{T.TECHNICAL_DOMAIN}'))"""


@query(f"""WITH w AS (SELECT word, lower(trim(word, '{_MARKS}')) AS low, n FROM (SELECT unnest(string_split(text, ' ')) AS word, count(*) AS n FROM documents GROUP BY 1) WHERE n >= 5) SELECT word, {TECHNICAL} AS technical, n FROM w""")
def technical_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    return words.select("word", T.technical_term(F.col("word")).alias("technical"), "n")


@query(f"""WITH w AS (SELECT doc_id, text, lower(trim(text, '{_MARKS}')) AS low FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS text FROM documents))
SELECT doc_id, text, count(*) AS n FROM w WHERE NOT contains(text, '-') AND NOT ({TECHNICAL}) GROUP BY ALL""")
def spelling_filter(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("text"), F.lit("S").alias("rule"), F.lit("typos").alias("category"))
    return L.spelling_filter(words, ("SKIP",)).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query(FOUND + "SELECT doc_id, line, col, rule FROM found WHERE severity = 'error' AND doc_id % 3 <> 0")
def severity_filter(spark: SparkSession, d: str) -> DataFrame:
    all_found = findings(spark, d)
    dismissed = all_found.where("doc_id % 3 = 0").select("doc_id", "line", "column", "rule")
    return L.severity_filter(all_found, "error", dismissed).select("doc_id", "line", F.col("column").alias("col"), "rule")


@query(FOUND + r"""SELECT doc_id, line, col AS "column", CASE WHEN rule = 'HomogeneousMembers' THEN trim(regexp_extract(substring(lines.text, 1, col - 1), '([^.!?]*)$', 1) || regexp_extract(substring(lines.text, col), '^([^.!?]*[.!?]?)', 1), ' ') ELSE found.text END AS text,
CASE rule WHEN 'HomogeneousMembers' THEN 'a list' WHEN 'Exclamation_Double' THEN '!' END AS replacement FROM found JOIN lines USING (doc_id, line)""")
def rewrite_matches(spark: SparkSession, d: str) -> DataFrame:
    return L.rewrite_to_sentence(findings(spark, d), lines(spark, d), "HomogeneousMembers", "a list").select("doc_id", "line", "column", "text", "replacement")


@query(f"WITH {TURNS}, n AS (SELECT *, lead(type) OVER (PARTITION BY doc_id ORDER BY block_index) AS nxt FROM turns) SELECT doc_id, block_index FROM n WHERE regexp_matches(plain, '\\.$') AND coalesce(nxt <> 'list_item', true)")
def unfinished_list_intro(spark: SparkSession, d: str) -> DataFrame:
    return L.unfinished_list_intro(turns(spark, d).withColumn("plain", F.regexp_replace("plain", r"\.$", ":")))


@query(f"WITH {LINES} SELECT doc_id, line AS block_index FROM lines WHERE regexp_matches(replace(replace(text, ' of ', ' in section '), ' de ', ' см. раздел '), '(?i)\\b(?:in section|see section)\\s+\\S+|(?:^|[^\\p{{L}}\\p{{N}}_])см\\. раздел\\s+\\S+')")
def unlinked_cross_reference(spark: SparkSession, d: str) -> DataFrame:
    """Lines in which two common words stand for references."""
    plain = F.replace(F.replace("text", F.lit(" of "), F.lit(" in section ")), F.lit(" de "), F.lit(" см. раздел "))
    return L.unlinked_cross_reference(lines(spark, d).select("doc_id", F.col("line").alias("block_index"), plain.alias("plain")))


@query(r"SELECT page_id AS doc_id, 0 AS block_index, unnest(regexp_extract_all(replace(html, 'The ', 'button The '), '(?i:button|кнопк[уаеи])\s+(\p{Lu}\p{L}*)', 1)) AS label FROM pages")
def unquoted_ui_label(spark: SparkSession, d: str) -> DataFrame:
    return L.unquoted_ui_label(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("block_index"), F.regexp_replace("html", "The ", "button The ").alias("plain")))


@query(FOUND + f", b AS (SELECT doc_id, line, sum(CASE WHEN trim(text, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block_index FROM lines) SELECT doc_id, CAST(block_index AS BIGINT) AS block_index, count(*) AS n FROM found JOIN b USING (doc_id, line) GROUP BY ALL")
def line_to_block(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("line")
    at = lines(spark, d).withColumn("block_index", F.sum(F.when(F.trim("text") == "", 1).otherwise(0)).over(order))
    return C.line_to_block(findings(spark, d), at).groupBy("doc_id", F.col("block_index").cast("long").alias("block_index")).agg(F.count("*").alias("n"))


@query(FOUND + "SELECT rule, count(*) AS n FROM found WHERE rule IN ('Quotes_Straight', 'Email_Address') GROUP BY rule")
def guide_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    guide, base = (spark.createDataFrame([(r,)], "rule string") for r in ("Quotes_Straight", "Email_Address"))
    return C.guide_semi_filter(findings(spark, d), guide, base).groupBy("rule").agg(F.count("*").alias("n"))


MATCHED = """matched AS (SELECT doc_id, CAST(nr AS INT) AS line, unnest(['Slash_Words', 'UITerms_Click', 'LetterYo', 'Quotes_LatinInQuotes', 'Quotes_Straight']) AS rule,
  unnest([CASE WHEN doc_id % 2 = 0 THEN 'Мбит/с' ELSE word || '/с' END, CASE WHEN doc_id % 3 = 0 THEN 'Откликнуться' ELSE 'клик ' || word END, CASE WHEN doc_id % 4 = 0 THEN 'Всё' ELSE word || 'ё' END, '«' || upper(word) || '»', '«' || word || '»']) AS text
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS nr FROM documents))"""


@query("WITH " + MATCHED + """SELECT rule, text, count(*) AS n FROM matched WHERE NOT (rule = 'Slash_Words' AND text = 'Мбит/с' OR rule = 'UITerms_Click' AND starts_with(text, 'Отклик')
  OR rule = 'LetterYo' AND text = 'Всё' OR rule = 'Quotes_LatinInQuotes' AND length(text) BETWEEN 4 AND 10) GROUP BY ALL""")
def post_filter_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of five rules made from every word of the documents, some of which are no mistakes."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("line", "word"))
    word, doc = F.col("word"), F.col("doc_id")
    texts = {
        "Slash_Words": F.when(doc % 2 == 0, "Мбит/с").otherwise(F.concat(word, F.lit("/с"))), "UITerms_Click": F.when(doc % 3 == 0, "Откликнуться").otherwise(F.concat(F.lit("клик "), word)),
        "LetterYo": F.when(doc % 4 == 0, "Всё").otherwise(F.concat(word, F.lit("ё"))), "Quotes_LatinInQuotes": F.concat(F.lit("«"), F.upper(word), F.lit("»")), "Quotes_Straight": F.concat(F.lit("«"), word, F.lit("»")),
    }
    rows = words.select("doc_id", "line", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), t.alias("text")) for r, t in texts.items()))).alias("m")).select("doc_id", "line", "m.*")
    return L.post_filter(rows).groupBy("rule", "text").agg(F.count("*").alias("n"))


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Style findings, a copy of some as spelling findings, and a copy of others as user findings."""
    # all that follows reads the findings several times, so the rules run once and their findings are written
    style = written(findings(spark, d), "findings")
    spelling = style.where("line % 2 = 0").withColumn("source", F.lit("spelling")).withColumn("column", F.col("column") + F.when(F.col("rule") == "Digits_Long", 1).otherwise(0))
    return C.union_engines(style, spelling, None, style.where("line % 3 = 0").withColumn("source", F.lit("user")))


MIXED = FOUND + ", mixed AS (SELECT *, 'style' AS source FROM found UNION ALL SELECT doc_id, line, col + CASE WHEN rule = 'Digits_Long' THEN 1 ELSE 0 END, text, rule, severity, 'spelling' FROM found WHERE line % 2 = 0 UNION ALL SELECT *, 'user' FROM found WHERE line % 3 = 0) "
SHADOWED = MIXED + ", clear AS (SELECT * FROM mixed m WHERE source <> 'spelling' OR NOT EXISTS (SELECT 1 FROM mixed s WHERE s.source = 'style' AND s.doc_id = m.doc_id AND s.line = m.line AND s.col = m.col AND lower(s.text) = lower(m.text))) "


@query(MIXED + "SELECT source, rule, count(*) AS n FROM mixed GROUP BY ALL")
def union_engines(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).groupBy("source", "rule").agg(F.count("*").alias("n"))


@query(SHADOWED + "SELECT source, rule, count(*) AS n FROM clear GROUP BY ALL")
def spelling_shadowed(spark: SparkSession, d: str) -> DataFrame:
    return C.spelling_shadowed(mixed(spark, d)).groupBy("source", "rule").agg(F.count("*").alias("n"))


@query(SHADOWED + "SELECT DISTINCT doc_id, line, col, lower(text) AS text, rule, first_value(source) OVER (PARTITION BY doc_id, line, col, lower(text), rule ORDER BY CASE source WHEN 'style' THEN 0 WHEN 'spelling' THEN 2 ELSE 3 END) AS source FROM clear")
def dedupe_findings(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_findings(mixed(spark, d)).select("doc_id", "line", F.col("column").alias("col"), F.lower("text").alias("text"), "rule", "source")


@query(FOUND + "SELECT doc_id, line, '!' AS replacement, CAST(min(col) AS INT) AS col, count(*) AS dup_count FROM found WHERE rule = 'Exclamation_Double' GROUP BY doc_id, line UNION ALL SELECT doc_id, line, NULL, col, 1 FROM found WHERE rule <> 'Exclamation_Double'")
def group_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return C.group_duplicates(findings(spark, d)).select("doc_id", "line", "replacement", F.col("column").alias("col"), "dup_count")


@query(FOUND + "SELECT rule, doc_id, line, col FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY doc_id, line, col) AS r FROM found) WHERE r <= 8")
def examples_per_rule(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_last(findings(spark, d), ["rule"], [F.asc("doc_id"), F.asc("line"), F.asc("column")], 8).select("rule", "doc_id", "line", F.col("column").alias("col"))


@query(FOUND + "SELECT doc_id, line, col, rule, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, col, rule) AS INT) AS at FROM found")
def order_findings(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "column", "rule"))
    return findings(spark, d).select("doc_id", "line", F.col("column").alias("col"), "rule", at.alias("at"))


@query(FOUND + "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY rule, line, col) - 1) / 12) AS INT) AS batch, line, col, rule FROM found")
def verify_batches(spark: SparkSession, d: str) -> DataFrame:
    return C.batches(findings(spark, d), "doc_id", ["rule", "line", "column"]).select("doc_id", "batch", "line", F.col("column").alias("col"), "rule")


@query(FOUND + "SELECT CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, col, rule) AS INT) AS number, doc_id, line, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS fragment, CASE WHEN rule LIKE 'Quotes%' OR rule LIKE 'Spacing%' OR rule LIKE 'Excl%' THEN 'punctuation' WHEN rule LIKE 'Email%' OR rule LIKE 'Digits%' THEN 'private' ELSE 'style' END AS category FROM found")
def findings_report(spark: SparkSession, d: str) -> DataFrame:
    rule = F.col("rule")
    category = F.when(rule.rlike("^(Quotes|Spacing|Excl)"), "punctuation").when(rule.rlike("^(Email|Digits)"), "private").otherwise("style")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "column", "rule"))
    return findings(spark, d).select(number.alias("number"), "doc_id", "line", escape_formula(F.col("text")).alias("fragment"), category.alias("category"))


@query(FOUND + "SELECT source, rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM found JOIN documents USING (doc_id) GROUP BY ALL HAVING count(*) > 1")
def site_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).drop("source").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source", "rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")
