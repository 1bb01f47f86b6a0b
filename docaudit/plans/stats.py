"""Queries over usage and version tables: ``events`` stands for usage and rule hits, ``orders`` of a customer for versions of a document, ``part`` for description fields, ``nation`` and ``region`` for folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.operators import combine as C
from docaudit.plans.registry import query, table


def usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("worker"), "ts", F.floor(F.col("value") * 10).cast("long").alias("prompt_tokens"), F.floor("value").cast("long").alias("completion_tokens"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("rule"), F.col("props").alias("description"), "ts", "event_id")


USAGE = "usage AS (SELECT user_id AS job_id, event_type AS worker, ts, CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens FROM events)"
MIDNIGHT = "2024-01-15 00:00:00"


@query(f"""WITH {USAGE} SELECT count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) FILTER (ts >= TIMESTAMP '{MIDNIGHT}') AS calls_today,
CAST(coalesce(sum(prompt_tokens) FILTER (ts >= TIMESTAMP '{MIDNIGHT}'), 0) AS BIGINT) AS prompt_today, CAST(coalesce(sum(completion_tokens) FILTER (ts >= TIMESTAMP '{MIDNIGHT}'), 0) AS BIGINT) AS completion_today FROM usage""")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return C.token_totals(usage(spark, d), F.lit(MIDNIGHT).cast(dict(table(spark, d, "events").dtypes)["ts"]))


@query(f"WITH {USAGE} SELECT job_id, worker, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS calls FROM usage GROUP BY GROUPING SETS ((job_id, worker), (job_id))")
def usage_by_worker(spark: SparkSession, d: str) -> DataFrame:
    return C.usage_by_worker(usage(spark, d))


HITS = "hits AS (SELECT user_id AS user, event_type AS rule, count(*) AS count, max(ts) AS last_ts FROM events GROUP BY ALL)"


@query('SELECT user_id AS "user", event_type AS rule, count(*) AS count, substring(split_part(max_by(props, ts), chr(10), 1), 1, 160) AS description, max(ts) AS last_ts FROM events GROUP BY ALL')
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return C.rule_hits(hits(spark, d))


@query(f"""WITH {HITS}, r AS (SELECT *, sum(count) OVER (PARTITION BY "user") AS total_hits, count(*) OVER (PARTITION BY "user") AS distinct_rules, row_number() OVER (PARTITION BY "user" ORDER BY count DESC, last_ts DESC, rule) AS rank FROM hits)
SELECT "user", rule, count, CAST(total_hits AS BIGINT) AS total_hits, distinct_rules, CAST(rank AS INT) AS rank, count / max(count) OVER (PARTITION BY "user") AS bar FROM r WHERE rank <= 3""")
def top_rules_per_user(spark: SparkSession, d: str) -> DataFrame:
    return C.top_rules_per_user(C.rule_hits(hits(spark, d)), 3).drop("description", "last_ts")


@query('SELECT user_id AS "user", count(*) AS n FROM events GROUP BY 1')
def history_count(spark: SparkSession, d: str) -> DataFrame:
    return C.findings_by(hits(spark, d), "user")


@query('SELECT user_id AS "user", event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 14')
def keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_last(hits(spark, d), ["user"], [F.desc("ts"), F.desc("event_id")], 14).select("user", "event_id", "ts")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(50)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view' AND value > 5) AS unseen FROM events GROUP BY user_id")
def group_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 5)).alias("unseen"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events")
def watch_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, event_type, max(ts) AS last_view FROM events GROUP BY ALL")
def last_views(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_view"))


@query("""WITH a AS (SELECT user_id AS "user", event_type AS doc_id, max(ts) AS last_activity FROM events WHERE event_type <> 'view' GROUP BY ALL), v AS (SELECT user_id AS "user", 'click' AS doc_id, max(ts) AS last_view FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT a."user", a.doc_id, last_activity FROM a LEFT JOIN v ON a."user" = v."user" AND a.doc_id = v.doc_id WHERE last_view IS NULL OR last_activity > last_view""")
def unseen_documents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("user_id", "user")
    activity = e.where("event_type <> 'view'").groupBy("user", F.col("event_type").alias("doc_id")).agg(F.max("ts").alias("last_activity"))
    views = e.where("event_type = 'view'").groupBy("user", F.lit("click").alias("doc_id")).agg(F.max("ts").alias("last_view"))
    return C.unseen_documents(activity, views).select("user", "doc_id", "last_activity")


def versions_table(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_custkey").alias("doc_id"), number.alias("number"), F.when(F.col("o_orderstatus") == "O", "review").otherwise("upload").alias("kind"), F.col("o_orderdate").alias("created_at"), "o_totalprice")


VERSIONS = "v AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS number, CASE o_orderstatus WHEN 'O' THEN 'review' ELSE 'upload' END AS kind, o_orderdate AS created_at, o_totalprice FROM orders)"


@query(f"WITH {VERSIONS} SELECT doc_id, count(*) AS n_versions, max(number) AS latest, CASE WHEN max(number) > 1 THEN max(number) - 1 END AS previous FROM v GROUP BY doc_id")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return C.versions(versions_table(spark, d))


@query(f"WITH {VERSIONS}, c AS (SELECT doc_id, coalesce(max(number) FILTER (kind <> 'review'), max(number)) AS current FROM v GROUP BY doc_id) SELECT doc_id, current, CASE WHEN current > 1 THEN current - 1 END AS baseline FROM c")
def review_aware_baseline(spark: SparkSession, d: str) -> DataFrame:
    return C.review_aware_baseline(versions_table(spark, d))


@query(f"WITH {VERSIONS} SELECT doc_id, count(*) AS n_versions, max(created_at) AS last_at, max(number) > 1 AS has_baseline FROM v GROUP BY doc_id")
def document_meta(spark: SparkSession, d: str) -> DataFrame:
    return versions_table(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_versions"), F.max("created_at").alias("last_at"), (F.max("number") > 1).alias("has_baseline"))


@query(f"WITH {VERSIONS} SELECT doc_id, max(created_at) AS last_at FROM v GROUP BY doc_id HAVING max(created_at) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    v = versions_table(spark, d)
    last = v.groupBy("doc_id").agg(F.max("created_at").alias("last_at"))
    now = v.agg(F.max("created_at").alias("now"))
    return last.join(F.broadcast(now), F.col("last_at") < F.col("now") - F.expr("INTERVAL 90 DAYS")).drop("now")


@query(f"WITH {VERSIONS} SELECT doc_id, max(number) + 1 AS next_number, sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(max(number) + 1 AS VARCHAR)) AS sha FROM v GROUP BY doc_id")
def register_version(spark: SparkSession, d: str) -> DataFrame:
    nxt = versions_table(spark, d).groupBy("doc_id").agg((F.max("number") + 1).alias("next_number"))
    return nxt.withColumn("sha", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("next_number").cast("string")), 256))


@query("SELECT o_custkey AS doc_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '1') OR contains(lower(o_orderpriority), 'urgent') GROUP BY 1")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).where(F.contains(F.lower("c_name"), F.lit("1")) | F.contains(F.lower("o_orderpriority"), F.lit("urgent")))
    return rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n"))


@query(f"WITH {VERSIONS}, l AS (SELECT doc_id, max(created_at) AS last_at FROM v GROUP BY doc_id) SELECT c_nationkey AS folder, doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY last_at DESC, doc_id) AS INT) AS at FROM l JOIN customer ON doc_id = c_custkey WHERE c_acctbal > 0")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    last = versions_table(spark, d).groupBy("doc_id").agg(F.max("created_at").alias("last_at"))
    live = last.join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("doc_id") == F.col("c_custkey"))
    return live.select(F.col("c_nationkey").alias("folder"), "doc_id", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("last_at"), "doc_id")).alias("at"))


@query("SELECT count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_acctbal <= 0) AS archived FROM customer")
def repo_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_if(F.col("c_acctbal") <= 0).alias("archived"))


def folders(spark: SparkSession, d: str) -> DataFrame:
    """Regions and, below them, nations; one root over all."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    root = r.agg(F.lit(0).alias("id"), F.lit("world").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    return root.unionByName(r.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit(0).alias("parent_id"))).unionByName(n.select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).alias("parent_id")))


FOLDERS = "f AS (SELECT 0 AS id, 'world' AS name, CAST(NULL AS INT) AS parent_id UNION ALL SELECT r_regionkey + 100, r_name, 0 FROM region UNION ALL SELECT n_nationkey + 1000, n_name, n_regionkey + 100 FROM nation)"


@query(f"WITH {FOLDERS} SELECT a.id, CAST(CASE WHEN c.id IS NOT NULL THEN 2 WHEN b.id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS depth, concat_ws(' / ', c.name, b.name, a.name) AS path FROM f a LEFT JOIN f b ON a.parent_id = b.id LEFT JOIN f c ON b.parent_id = c.id")
def folder_path(spark: SparkSession, d: str) -> DataFrame:
    return C.folder_paths(folders(spark, d))


@query(f"WITH RECURSIVE {FOLDERS}, down AS (SELECT id, 0 AS depth FROM f WHERE id = 101 UNION ALL SELECT f.id, depth + 1 FROM down JOIN f ON f.parent_id = down.id) SELECT id, CAST(depth AS INT) AS depth FROM down")
def folder_descendants(spark: SparkSession, d: str) -> DataFrame:
    return C.folder_descendants(folders(spark, d), 101)


@query(f"WITH {FOLDERS} SELECT f.id, (SELECT count(*) FROM f g WHERE g.parent_id = f.id) + (SELECT count(*) FROM customer WHERE c_nationkey + 1000 = f.id) AS items FROM f")
def folder_item_count(spark: SparkSession, d: str) -> DataFrame:
    f = folders(spark, d)
    items = f.select(F.col("parent_id").alias("id")).unionByName(table(spark, d, "customer").select((F.col("c_nationkey") + 1000).alias("id")))
    return f.select("id").join(items.groupBy("id").agg(F.count("*").alias("items")), "id", "left").select("id", F.coalesce("items", F.lit(0)).alias("items"))


@query(f"WITH {FOLDERS} SELECT c_custkey AS doc_id, concat_ws(' / ', 'world', r_name, n_name) AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def document_picker(spark: SparkSession, d: str) -> DataFrame:
    paths = C.folder_paths(folders(spark, d))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") + 1000).alias("id")).join(paths, "id").select("doc_id", F.col("path").alias("folder"))


@query("""WITH e AS (SELECT DISTINCT s_suppkey AS src, CAST(s_suppkey // 5 * 5 + (s_suppkey + s_nationkey + 1) % 5 AS BIGINT) AS dst FROM supplier),
w AS (SELECT a.src AS start, list_distinct([a.src, a.dst]) AS p FROM e a) SELECT src AS start, CAST(min(len) AS INT) AS length FROM (
SELECT a.src, 1 AS len FROM e a WHERE a.src = a.dst UNION ALL SELECT a.src, 2 FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src <> a.dst
UNION ALL SELECT a.src, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src <> b.src AND b.src <> c.src AND a.src <> c.src
UNION ALL SELECT a.src, 4 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e g ON c.dst = g.src AND g.dst = a.src WHERE len(list_distinct([a.src, b.src, c.src, g.src])) = 4
UNION ALL SELECT a.src, 5 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e g ON c.dst = g.src JOIN e h ON g.dst = h.src AND h.dst = a.src WHERE len(list_distinct([a.src, b.src, c.src, g.src, h.src])) = 5) GROUP BY src""")
def supersedes_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in fives, each pointing at one of its five."""
    s = table(spark, d, "supplier")
    five = F.floor(F.col("s_suppkey") / 5) * 5
    return C.reference_cycles(s.select(F.col("s_suppkey").alias("src"), (five + (F.col("s_suppkey") + F.col("s_nationkey") + 1) % 5).alias("dst")).distinct())


def spec(spark: SparkSession, d: str, lang: str) -> DataFrame:
    """Description fields: parts of one side's keys; the other side has other keys and some other texts."""
    p = table(spark, d, "part").withColumn("path_str", F.concat(F.lit("paths/"), F.col("p_partkey").cast("string"), F.lit("/description")))
    rows = p.where("p_partkey % 7 <> 0") if lang == "a" else p.where("p_partkey % 5 <> 0")
    text = F.col("p_name") if lang == "a" else F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    return rows.select("path_str", F.col("p_partkey").alias("line"), F.col("p_type").alias("kind"), text.alias("text"))


SPEC = """a AS (SELECT 'paths/' || p_partkey || '/description' AS path_str, p_partkey AS line, p_type AS kind, p_name AS text FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT 'paths/' || p_partkey || '/description' AS path_str, p_partkey AS line, p_type AS kind, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS text FROM part WHERE p_partkey % 5 <> 0)"""


@query(f"WITH {SPEC} SELECT path_str, coalesce(a.kind, b.kind) AS kind, a.text AS l_text, b.text AS r_text, CAST(CASE WHEN a.line IS NULL THEN 1 ELSE 0 END AS INT) AS only_right, coalesce(a.line, b.line) AS line FROM a FULL JOIN b USING (path_str)")
def pair_fields(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_fields(spec(spark, d, "a"), spec(spark, d, "b"))


@query(f"WITH {SPEC} SELECT path_str, b.text, a.text AS old_text, CASE WHEN a.line IS NULL THEN 'added' ELSE 'changed' END AS change FROM b LEFT JOIN a USING (path_str) WHERE a.line IS NULL OR a.text IS DISTINCT FROM b.text")
def diff_fields(spark: SparkSession, d: str) -> DataFrame:
    return C.diff_fields(spec(spark, d, "b"), spec(spark, d, "a")).select("path_str", "text", "old_text", "change")


@query(f"WITH {SPEC} SELECT b.path_str, b.text, p_brand AS translation FROM b LEFT JOIN a USING (path_str) JOIN part ON p_partkey = b.line WHERE a.line IS NULL OR a.text IS DISTINCT FROM b.text")
def diff_with_translation(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("translation"))
    return C.diff_fields(spec(spark, d, "b"), spec(spark, d, "a")).join(brands, "line", "left").select("path_str", "text", "translation")


@query("""WITH v AS (SELECT p_brand AS name, trim(p_type) AS text, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY ALL)
SELECT name, count(*) AS variants, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY name HAVING count(*) > 1 ORDER BY variants DESC, total DESC, name LIMIT 60""")
def consistency_by_name(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("text"))
    return C.consistency_by_name(fields).select("name", "variants", "total")


@query("WITH t AS (SELECT CASE WHEN p_size > 25 THEN upper(substring(p_name, 1, 6)) ELSE substring(p_name, 1, 6) END AS text FROM part) SELECT lower(trim(text)) AS norm, count(DISTINCT text) AS spellings, count(*) AS n, 'case' AS reason FROM t GROUP BY 1 HAVING count(DISTINCT text) > 1")
def consistency_by_text(spark: SparkSession, d: str) -> DataFrame:
    name = F.substring("p_name", 1, 6)
    return C.consistency_by_text(table(spark, d, "part").select(F.when(F.col("p_size") > 25, F.upper(name)).otherwise(name).alias("text")))


@query(f"WITH {SPEC} SELECT path_str, text FROM b WHERE contains(lower(text), 'a') OR contains(lower(path_str), '1') ORDER BY line LIMIT 50 OFFSET 50")
def segments_page(spark: SparkSession, d: str) -> DataFrame:
    rows = spec(spark, d, "b").where(F.contains(F.lower("text"), F.lit("a")) | F.contains(F.lower("path_str"), F.lit("1")))
    return rows.orderBy("line").offset(50).limit(50).select("path_str", "text")


@query(f"WITH {SPEC} SELECT path_str, CAST(floor((row_number() OVER (PARTITION BY kind ORDER BY line) - 1) / 20) AS INT) AS batch FROM (SELECT b.* FROM b LEFT JOIN a USING (path_str) WHERE a.line IS NULL OR a.text IS DISTINCT FROM b.text)")
def spec_review_batch(spark: SparkSession, d: str) -> DataFrame:
    return C.batches(C.diff_fields(spec(spark, d, "b"), spec(spark, d, "a")), "kind", ["line"], 20).select("path_str", "batch")


@query("WITH x AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), y AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT count(*) FILTER (y.k IS NULL) AS primary_only, count(*) FILTER (x.k IS NULL) AS secondary_only, count(*) FILTER (x.k IS NOT NULL AND y.k IS NOT NULL) AS shared FROM x FULL JOIN y USING (k)")
def shadow_comparison(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return C.shadow_comparison(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_custkey"])


@query("SELECT part_type AS rule, title FROM (SELECT p_type AS part_type, p_name AS title, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, p_name) AS r FROM part WHERE trim(p_name) <> '') WHERE r = 1")
def rule_titles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_type").alias("rule"), F.col("p_name").alias("title"), "p_size")
    return C.rule_titles(p.where("p_size > 40"), p.where("p_size <= 40"))


@query("SELECT o_custkey, CASE WHEN n > 10 THEN 'more' ELSE 'shown' END AS kind, CASE WHEN n > 10 THEN n - 10 ELSE n END AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT o_custkey, 'shown', 10 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 10")
def cap_with_marker(spark: SparkSession, d: str) -> DataFrame:
    return C.cap_with_marker(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 10)


@query("SELECT c_mktsegment AS kind, lower(trim(c_mktsegment || CAST(c_nationkey AS VARCHAR))) AS key, max_by(c_name, c_custkey) AS term FROM customer GROUP BY ALL")
def merge_lexicon(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_mktsegment").alias("kind"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("term"), F.col("c_name").alias("replacement"), F.lit("").alias("comment"), F.col("c_custkey").alias("seq"))
    return C.merge_lexicon(rows).select("kind", "key", F.col("replacement").alias("term"))


@query("SELECT title, text FROM (SELECT p_brand AS title, p_type AS text, row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def merge_rules(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_rules(table(spark, d, "part").select(F.col("p_brand").alias("title"), F.col("p_type").alias("text"), F.col("p_partkey").alias("seq"))).select("title", "text")


@query("""WITH cur AS (SELECT CAST(p_partkey AS VARCHAR) AS rule, 't' || p_partkey AS title, p_type AS text FROM part WHERE p_partkey % 3 <> 0), inc AS (SELECT 'n' || p_partkey AS rule, 'T' || p_partkey AS title, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS text FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(cur.rule, inc.rule) AS rule, coalesce(inc.title, cur.title) AS title, coalesce(nullif(inc.text, ''), cur.text) AS text, CASE WHEN cur.rule IS NULL THEN 'added' WHEN nullif(inc.text, '') IS NOT NULL AND inc.text <> cur.text THEN 'updated' ELSE 'same' END AS change FROM cur FULL JOIN inc ON lower(cur.title) = lower(inc.title)""")
def merge_guide_update(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    cur = p.where("p_partkey % 3 <> 0").select(k.alias("rule"), F.concat(F.lit("t"), k).alias("title"), F.col("p_type").alias("text"))
    inc = p.where("p_partkey % 4 <> 0").select(F.concat(F.lit("n"), k).alias("rule"), F.concat(F.lit("T"), k).alias("title"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("text"))
    return C.merge_guide_update(cur, inc)


@query("SELECT CASE WHEN r = 1 THEN p_brand ELSE p_brand || '_' || r END AS rule, p_partkey AS seq FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def unique_rule_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.unique_rule_ids(p.select(F.col("p_brand").alias("rule"), F.col("p_type").alias("title"), F.col("p_partkey").alias("seq"))).select("rule", "seq")


@query("""SELECT l_orderkey AS block_index, l_returnflag AS rule, lower(l_linestatus) AS span_text, list_sort(list_distinct(list(l_linenumber))) AS source_workers, string_agg(DISTINCT CASE WHEN l_tax > 0.04 THEN 'a' ELSE 'b' END, '+' ORDER BY CASE WHEN l_tax > 0.04 THEN 'a' ELSE 'b' END) AS evidence_source, bool_and(l_discount > 0.05) AS verification_required FROM lineitem GROUP BY 1, 2, 3""")
def dedupe_candidates(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    c = i.select(
        F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("block_index"), F.col("l_returnflag").alias("rule"), F.lower("l_linestatus").alias("span_text"), F.lit("").alias("suggestion"), F.array("l_linenumber").alias("source_workers"),
        F.when(F.col("l_tax") > 0.04, "a").otherwise("b").alias("evidence_source"), (F.col("l_discount") > 0.05).alias("verification_required"), F.lit("minor").alias("severity"), F.lit("").alias("description"), F.col("l_linenumber").alias("seq"),
    )
    return C.dedupe_candidates(c).select("block_index", "rule", "span_text", "source_workers", "evidence_source", "verification_required")


@query("SELECT l_orderkey AS block_index, l_returnflag AS rule, CAST(min(l_linenumber) AS INT) AS first, list_sort(list_distinct(list(l_suppkey))) AS workers FROM lineitem GROUP BY 1, 2")
def dedupe_block_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("block_index"), F.col("l_returnflag").alias("rule")).agg(F.min("l_linenumber").alias("first"), F.array_sort(F.collect_set("l_suppkey")).alias("workers"))


@query("SELECT a.l_orderkey AS block_index, a.l_linenumber AS l_pos, b.l_linenumber AS r_pos FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag <> b.l_returnflag")
def candidate_pair_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("block_index"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("rule"), F.lit("").alias("suggestion"))
    return C.candidate_pairs(c).where("l_rule <> r_rule").select("block_index", "l_pos", "r_pos")


@query("SELECT DISTINCT p_name AS rule FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45) ORDER BY 1 LIMIT 50")
def never_offered_rules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumnRenamed("p_name", "rule")
    return C.never_offered_rules(p, p.where("p_size > 45"))


@query("SELECT p_type AS rule FROM part WHERE p_size > 30 UNION SELECT p_brand FROM part UNION SELECT p_type FROM part WHERE p_size < 10")
def effective_rule_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.effective_rule_ids(p.where("p_size > 30").select(F.col("p_type").alias("rule")), p.select(F.col("p_brand").alias("rule")), p.where("p_size < 10").select(F.col("p_type").alias("rule")))
