"""Queries over pages: text, blocks, links, nodes, two versions of each page and their differences; streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import combine as C
from docaudit.operators import watch as W
from docaudit.plans.registry import query, table
from docaudit.plans.text import replaced
from docaudit.sources import html as H
from docaudit.sources.shared import shared_dir, written
from docaudit.streaming import streams as S


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query()
def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return H.visible_text(pages(spark, d))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return H.html_blocks(pages(spark, d))


@query()
def dom_nodes(spark: SparkSession, d: str) -> DataFrame:
    return H.dom_nodes(pages(spark, d)).select("page_id", "pos", "tag", "path", F.to_json("attrs").alias("attrs"), "text")


LINKS = r"""hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM pages),
links AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS src, regexp_replace(regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1) || href, '[?#].*$', ''), '/+$', '') AS dst FROM hrefs WHERE starts_with(href, '/'))"""


@query(f"WITH {LINKS} SELECT page_id, src, dst FROM links")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_links(pages(spark, d))


@query(f"WITH {LINKS} SELECT page_id, dst FROM links WHERE NOT regexp_matches(lower(dst), '\\.(jpg|png|css|js|xml|pdf|zip|json)$')")
def same_domain_links(spark: SparkSession, d: str) -> DataFrame:
    return H.same_domain(H.extract_links(pages(spark, d))).select("page_id", "dst")


@query(f"WITH {LINKS} SELECT DISTINCT dst FROM links")
def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_links(pages(spark, d)).select("dst").dropDuplicates(["dst"])


@query(f"WITH {LINKS} SELECT page_id, dst FROM links WHERE NOT (starts_with(regexp_replace(dst, '^https?://[^/]+', ''), '/t') AND regexp_extract(lower(dst), '^https?://([^/:?#]+)', 1) LIKE '%.com')")
def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    links = H.extract_links(pages(spark, d))
    robots = links.select(H.url_host(F.col("dst")).alias("host")).distinct().where(F.endswith("host", F.lit(".com"))).withColumn("prefix", F.lit("/t"))
    return H.robots_filter(links, robots).select("page_id", "dst")


@query()
def reachable_pages(spark: SparkSession, d: str) -> DataFrame:
    links = H.extract_links(pages(spark, d))
    start = links.select(F.col("src").alias("url")).orderBy("url").limit(3)
    return H.reachable(links, start, 4)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots of each page: as it is, then without footer (every third page), then with a short title (every fifth); every seventh has failed once."""
    p = pages(spark, d)
    k = F.col("page_id")
    second = F.when(k % 3 == 0, F.regexp_replace("html", "(?s)<footer>.*?</footer>", "")).otherwise(F.col("html"))
    third = F.when(k % 5 == 0, F.regexp_replace(second, "(?s)<h1>.*?</h1>", "<h1>New title</h1>")).otherwise(second)
    out = p.select(k, F.lit(1).alias("version"), "html", F.lit(None).cast("string").alias("error"))
    out = out.unionByName(p.select(k, F.lit(2).alias("version"), second.alias("html"), F.when(k % 7 == 0, "timeout").alias("error")))
    out = out.unionByName(p.select(k, F.lit(3).alias("version"), third.alias("html"), F.lit(None).cast("string").alias("error")))
    return out.withColumn("checked_at", F.timestamp_seconds(F.lit(1704067200) + F.col("version") * 3600))


VERSIONS = """s2 AS (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?s)<footer>.*?</footer>', '', 'g') ELSE html END AS h2 FROM pages),
v AS (SELECT page_id, 1 AS version, html, CAST(NULL AS VARCHAR) AS error FROM s2 UNION ALL SELECT page_id, 2, h2, CASE WHEN page_id % 7 = 0 THEN 'timeout' END FROM s2
UNION ALL SELECT page_id, 3, CASE WHEN page_id % 5 = 0 THEN regexp_replace(h2, '(?s)<h1>.*?</h1>', '<h1>New title</h1>', 'g') ELSE h2 END, NULL FROM s2),
h AS (SELECT *, CASE WHEN error IS NULL THEN sha256(html) ELSE '' END AS hash, 1704067200 + version * 3600 AS at FROM v),
st AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(hash <> lag(hash) OVER (PARTITION BY page_id ORDER BY version), false) THEN 'changed' ELSE 'same' END AS status FROM h)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Versions with hashes of the raw page, so that SQL can follow."""
    return versions(spark, d).withColumns({"content_hash": F.sha2("html", 256), "struct_hash": F.lit("x")})


def statuses(spark: SparkSession, d: str) -> DataFrame:
    return W.change_status(snapshots(spark, d))


@query(f"WITH {VERSIONS} SELECT page_id, version, status FROM st")
def change_status(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d).select("page_id", "version", "status")


@query(f"WITH {VERSIONS} SELECT page_id, max_by(status, version) AS last_status, CAST(max(version) FILTER (status = 'changed') AS INT) AS changed_version, max(error) AS last_error FROM st GROUP BY page_id")
def page_state(spark: SparkSession, d: str) -> DataFrame:
    state = W.page_state(statuses(spark, d))
    version = ((F.unix_timestamp("last_changed") - 1704067200) / 3600).cast("int")
    return state.select("page_id", "last_status", version.alias("changed_version"), "last_error")


@query(f"WITH {VERSIONS}, c AS (SELECT page_id, max(version) FILTER (status = 'changed') AS cv FROM st GROUP BY page_id) SELECT page_id FROM c WHERE cv IS NOT NULL AND (page_id % 2 = 1 OR cv > 2)")
def unseen_changes(spark: SparkSession, d: str) -> DataFrame:
    seen = pages(spark, d).where("page_id % 2 = 0").select("page_id", F.timestamp_seconds(F.lit(1704067200 + 2 * 3600)).alias("seen"))
    return W.unseen_changes(W.page_state(statuses(spark, d)), seen).select("page_id")


@query(f"WITH {VERSIONS} SELECT page_id, CAST(max(version) AS INT) AS new_version, CAST(max(version) - 1 AS INT) AS old_version FROM st WHERE status = 'changed' GROUP BY page_id")
def changed_pair(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: ((F.unix_timestamp(c) - 1704067200) / 3600).cast("int")
    return W.changed_pair(statuses(spark, d)).select("page_id", at("new_at").alias("new_version"), at("old_at").alias("old_version"))


@query(f"WITH {VERSIONS} SELECT page_id, version, length(html) AS n FROM st")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    kept = C.keep_last(snapshots(spark, d), ["page_id"], [F.desc("checked_at")], 20)
    return kept.select("page_id", "version", F.length("html").cast("long").alias("n"))


@query(f"WITH {VERSIONS}, s AS (SELECT page_id, max_by(status, version) AS last_status FROM st GROUP BY 1) SELECT regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (last_status = 'changed') AS changed FROM s JOIN pages USING (page_id) GROUP BY 1")
def list_watch_pages(spark: SparkSession, d: str) -> DataFrame:
    state = W.page_state(statuses(spark, d)).join(pages(spark, d).select("page_id", "url"), "page_id")
    return state.groupBy(H.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.col("last_status") == "changed").alias("changed"))


@query()
def snapshot_quality(spark: SparkSession, d: str) -> DataFrame:
    """Pages as they are, and each as a login page, by the text that a reader sees."""
    both = F.array(F.struct(F.lit(0).alias("login"), F.col("html")), F.struct(F.lit(1).alias("login"), F.concat(F.lit("<p>Sign in</p><input type=password>"), F.col("html")).alias("html")))
    p = pages(spark, d).select("page_id", F.explode(both).alias("b")).select((F.col("page_id") * 2 + F.col("b.login")).alias("page_id"), "b.html")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    shown = H.visible_text(p).groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return p.join(shown, "page_id", "left").select(F.floor(F.col("page_id") / 2).alias("page_id"), (F.col("page_id") % 2 == 1).alias("login"), W.snapshot_quality(F.col("text"), F.col("html")).alias("problem"))


@query(f"SELECT doc_id, sha256(trim({replaced('text', T.VOLATILE)}, ' -–—•·')) AS content_hash FROM documents")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", W.content_fingerprint(F.col("text")).alias("content_hash"))


@query()
def struct_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return W.struct_fingerprint(H.dom_nodes(versions(spark, d), ("page_id", "version")), ["page_id", "version"])


def _lines(html: str) -> str:
    return f"unnest(string_split(regexp_replace({html}, '>', '>' || chr(10), 'g'), chr(10)))"


@query(f"""WITH {VERSIONS}, o AS (SELECT page_id, text, count(*) AS n FROM (SELECT page_id, {_lines('html')} AS text FROM v WHERE version = 1) GROUP BY ALL), n AS (SELECT page_id, text, count(*) AS n FROM (SELECT page_id, {_lines('html')} AS text FROM v WHERE version = 3) GROUP BY ALL)
SELECT page_id, md5(text) AS digest, CASE WHEN coalesce(n.n, 0) > coalesce(o.n, 0) THEN 'added' ELSE 'removed' END AS change, abs(coalesce(n.n, 0) - coalesce(o.n, 0)) AS times FROM o FULL JOIN n USING (page_id, text) WHERE coalesce(n.n, 0) <> coalesce(o.n, 0)""")
def line_set_diff(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d).select("page_id", "version", F.explode(F.split(F.regexp_replace("html", ">", ">\n"), "\n", -1)).alias("text"))
    return W.line_set_diff(v.where("version = 1"), v.where("version = 3")).select("page_id", F.md5("text").alias("digest"), "change", "times")


def hunks(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d)
    text = F.regexp_replace("html", ">", ">\n")
    pairs = rows.groupBy("page_id").agg(F.max(F.when(F.col("version") == 1, text)).alias("old"), F.max(F.when(F.col("version") == 3, text)).alias("new"))
    return W.text_hunks(pairs.where("old <> new"))


@query()
def text_hunks(spark: SparkSession, d: str) -> DataFrame:
    return hunks(spark, d).select("page_id", "hunk", "op", F.size("lines").alias("n_lines"), F.size("words").alias("n_words"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    # both versions are read several times below, so they are parsed once and written
    nodes = written(H.dom_nodes(versions(spark, d).where("version in (1, 3)"), ("page_id", "version")), "nodes")
    return W.diff_nodes(nodes.where("version = 1").drop("version"), nodes.where("version = 3").drop("version"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return W.merge_events(changes(spark, d))


@query()
def diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d)


@query()
def merge_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


@query()
def order_events(spark: SparkSession, d: str) -> DataFrame:
    return W.order_events(events(spark, d)).select("page_id", "at", "kind", "tag", "count", "old_text", "new_text")


@query()
def event_ui_list(spark: SparkSession, d: str) -> DataFrame:
    return W.event_ui_list(hunks(spark, d), events(spark, d))


@query("""SELECT page_id, page_id % 3 > 0 AS full, '[' || array_to_string(list_transform(parts[1:CASE WHEN page_id % 3 > 0 THEN len(parts) ELSE len(parts) - 1 END], lambda x: to_json({'text': x})), ',') || ']' AS nodes
FROM (SELECT page_id, regexp_extract_all(html, '[A-Za-z0-9]+') AS parts FROM pages) WHERE len(parts) > 0""")
def salvage_truncated_dom(spark: SparkSession, d: str) -> DataFrame:
    """Each page's words as a JSON list, cut within its last element where page_id divides by 3."""
    words = pages(spark, d).select("page_id", F.regexp_extract_all("html", F.lit("([A-Za-z0-9]+)"), F.lit(1)).alias("parts")).where(F.size("parts") > 0)
    body = F.to_json(F.transform("parts", lambda x: F.struct(x.alias("text"))))
    cut = F.when(F.col("page_id") % 3 > 0, body).otherwise(F.substring(body, F.lit(1), F.length(body) - 3))
    return words.select("page_id", W.salvage_truncated(cut).alias("s")).select("page_id", F.col("s.full").alias("full"), F.col("s.json").alias("nodes"))


@query()
def mask_pii_html(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", T.mask_pii(F.col("html")).alias("masked"))


# streams: each reads its table as a stream of files, runs until all is read, and returns what the sink holds
def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{d}/{name}.parque[t]")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _collected(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and read what it wrote."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", at + "/state").trigger(availableNow=True).start(at + "/rows").awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(at + "/rows")).outputMode("complete").option("checkpointLocation", at + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(at + "/rows")


@query('SELECT user_id AS "user", event_type AS rule, count(*) AS count, max(ts) AS last_ts FROM events GROUP BY ALL')
def rule_hits_stream(spark: SparkSession, d: str) -> DataFrame:
    hits = _stream(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("rule"), "ts")
    return _collected(S.rule_hits_stream(hits), "hits", "complete")


@query("SELECT date_trunc('day', ts) AS start, event_type AS worker, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY ALL")
def usage_windows(spark: SparkSession, d: str) -> DataFrame:
    usage = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("worker"), F.floor(F.col("value") * 10).cast("long").alias("tokens"))
    return _collected(S.usage_windows(usage), "usage", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    requests = _stream(spark, d, "events").select("user_id", "event_type", F.concat_ws("/", "user_id", "event_type").alias("request_key"), F.col("ts").cast("timestamp").alias("ts"))
    return _collected(S.dedupe_stream(requests, within="400 days"), "dedupe", "append").select("user_id", "event_type")


@query()
def findings_stream(spark: SparkSession, d: str) -> DataFrame:
    return _collected(S.findings_stream(_stream(spark, d, "documents")), "findings", "append").groupBy("rule").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) SELECT user_id AS page_id, CASE WHEN event_type = 'error' THEN 'error' WHEN before IS NOT NULL AND CASE before WHEN 'error' THEN '' ELSE before END <> event_type THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM e GROUP BY ALL")
def watch_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "events")
    snaps = e.select(F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_type").alias("content_hash"), F.when(F.col("event_type") == "error", "").otherwise("x").alias("struct_hash"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return _collected(S.watch_stream(snaps), "watch", "append").groupBy("page_id", "status").agg(F.count("*").alias("n"))
