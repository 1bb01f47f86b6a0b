"""Joins, de-duplication, aggregates, windows, orders and set operations over findings, candidates and usage rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators.evaluate import meets
from docaudit.sources.shared import written


# joins
def enrich_findings(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Section, name, automation and group of each finding's rule; custom rules get fixed ones."""
    joined = findings.join(rules.select("rule", "section", "name", "automation", "rule_group"), "rule", "left")
    custom = F.col("source") == "custom"
    return joined.select(
        *findings.columns, F.when(custom, "Custom rules").otherwise(F.col("section")).alias("section"), F.coalesce("name", "rule").alias("name"),
        F.when(custom, "automatic").otherwise(F.col("automation")).alias("automation"), F.coalesce("rule_group", F.lit("other")).alias("rule_group"),
    )


def line_to_block(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """``blocks``: (doc_id, line, block_index); findings on lines without block go."""
    return findings.join(blocks.select("doc_id", "line", "block_index"), ["doc_id", "line"])


def guide_semi_filter(findings: DataFrame, *ids: DataFrame) -> DataFrame:
    """Findings whose rule is in the guide, the base rules or the lexicon."""
    return findings.join(effective_rule_ids(*ids), "rule", "left_semi")


def spelling_shadowed(findings: DataFrame) -> DataFrame:
    """Without spelling findings at the place and text of a style finding."""
    keyed = findings.withColumn("low", F.lower("text"))
    style = keyed.where("source = 'style'").select("doc_id", "line", "column", "low").distinct()
    spelling = keyed.where("source = 'spelling'").join(style, ["doc_id", "line", "column", "low"], "left_anti")
    return keyed.where("source <> 'spelling' or source is null").unionByName(spelling).drop("low")


def pair_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two languages' fields (path_str, line, kind, text); rows of the first keep their order, rows only in the second come last."""
    a = left.select("path_str", F.col("line").alias("l_line"), F.col("kind").alias("l_kind"), F.col("text").alias("l_text"))
    b = right.select("path_str", F.col("line").alias("r_line"), F.col("kind").alias("r_kind"), F.col("text").alias("r_text"))
    both = a.join(b, "path_str", "full")
    return both.select("path_str", F.coalesce("l_kind", "r_kind").alias("kind"), "l_text", "r_text", F.col("l_line").isNull().cast("int").alias("only_right"), F.coalesce("l_line", "r_line").alias("line"))


def diff_fields(new: DataFrame, old: DataFrame) -> DataFrame:
    """``added`` and ``changed`` fields of the new version; deletions are not reported."""
    joined = new.join(old.select("path_str", F.col("text").alias("old_text"), F.lit(1).alias("there")), "path_str", "left")
    change = F.when(F.col("there").isNull(), "added").when(~F.col("text").eqNullSafe(F.col("old_text")), "changed")
    return joined.withColumn("change", change).where("change is not null").drop("there")


def rule_titles(*sources: DataFrame) -> DataFrame:
    """First non-empty title of each rule over the sources in order."""
    rows = reduce(DataFrame.unionByName, (s.select("rule", "title", F.lit(i).alias("rank")) for i, s in enumerate(sources)))
    return rows.where(F.trim("title") != "").groupBy("rule").agg(F.min_by("title", F.struct("rank", "title")).alias("title"))


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted and revised candidates; a revision's non-empty severity, description and suggestion replace the candidate's."""
    v = verdicts.where("verdict in ('accept', 'revise')").select("source_id", "verdict", *(F.col(c).alias(f"new_{c}") for c in ("severity", "description", "suggestion")))
    joined = candidates.join(v, "source_id")

    def revised(c: str) -> Column:
        return F.when(F.col("verdict") == "revise", F.coalesce(F.nullif(F.trim(f"new_{c}"), F.lit("")), F.col(c))).otherwise(F.col(c))

    return joined.withColumns({c: revised(c) for c in ("severity", "description", "suggestion")}).drop("new_severity", "new_description", "new_suggestion")


def critic_reconstruct(finals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Final issues (final_id, source_ids) with the workers, the first reasoning and span and the sources of the candidates they name."""
    rows = finals.select("final_id", F.posexplode("source_ids").alias("at", "source_id")).join(candidates, "source_id")
    return rows.groupBy("final_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_workers")))).alias("source_workers"),
        F.min_by("reasoning", F.when(F.trim("reasoning") != "", F.col("at"))).alias("reasoning"), F.min_by("span_text", F.when(F.trim("span_text") != "", F.col("at"))).alias("span_text"),
        F.array_join(F.array_sort(F.collect_set("evidence_source")), "+").alias("evidence_source"),
    )


def never_offered_rules(rules: DataFrame, offered: DataFrame, show: int = 50) -> DataFrame:
    return rules.select("rule").distinct().join(offered.select("rule"), "rule", "left_anti").orderBy("rule").limit(show)


def unseen_documents(activity: DataFrame, views: DataFrame) -> DataFrame:
    """(user, doc_id, last_activity) with activity after the user's last view."""
    return activity.join(views, ["user", "doc_id"], "left").where(F.col("last_view").isNull() | (F.col("last_activity") > F.col("last_view")))


def expectation_match(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs in which a finding meets every key that the expectation gives (null: any)."""
    keys = tuple(c for c in ("rule", "line", "severity", "text", "start", "end") if c in expectations.columns)
    e = expectations.select("case", *(F.col(c).alias(f"e_{c}") for c in keys))
    return findings.join(e, "case").where(meets(keys))


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """Ordered pairs of candidates of one block."""
    a = candidates.select("doc_id", "block_index", F.col("pos").alias("l_pos"), F.col("rule").alias("l_rule"), F.col("suggestion").alias("l_suggestion"))
    b = candidates.select("doc_id", "block_index", F.col("pos").alias("r_pos"), F.col("rule").alias("r_rule"), F.col("suggestion").alias("r_suggestion"))
    return a.join(b, ["doc_id", "block_index"]).where("l_pos < r_pos")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a stored answer, and those without."""
    return requests.join(cache, "request_key"), requests.join(cache, "request_key", "left_anti")


# de-duplication
def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


ENGINE_RANK = {"style": 0, "custom": 1, "spelling": 2, "user": 3}


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """First finding of each (line, column, lower text, rule) by engine, after spelling findings under style findings went."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ENGINE_RANK.items() for x in kv))[F.col("source")], F.lit(9))
    rows = spelling_shadowed(findings).withColumn("low", F.lower("text")).withColumn("rank", rank)
    return first_of(rows, ["doc_id", "line", "column", "low", "rule"], ["rank", "message"]).drop("low", "rank")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each (block, rule, lower span, lower suggestion): workers united, sources joined, verification only if all ask for it, the rest from the first by ``seq``."""
    keys = [F.col("doc_id"), F.col("block_index"), F.col("rule"), F.lower(F.trim("span_text")).alias("span_key"), F.lower(F.trim("suggestion")).alias("suggestion_key")]
    return candidates.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_workers")))).alias("source_workers"), F.array_join(F.array_sort(F.collect_set("evidence_source")), "+").alias("evidence_source"),
        F.bool_and("verification_required").alias("verification_required"), F.min_by(F.struct("span_text", "suggestion", "severity", "description"), "seq").alias("first"),
    ).select("doc_id", "block_index", "rule", "first.*", "source_workers", "evidence_source", "verification_required")


def group_duplicates(findings: DataFrame) -> DataFrame:
    """Findings of one line with the same lower-case replacement become one with its count and rules; without replacement they stay alone."""
    has = F.length(F.trim(F.coalesce("replacement", F.lit("")))) > 0
    grouped = findings.where(has).groupBy("doc_id", "line", F.lower("replacement").alias("replacement")).agg(
        F.min("column").alias("column"), F.count("*").alias("dup_count"), F.array_sort(F.collect_set("rule")).alias("grouped_rules"))
    alone = findings.where(~has).select("doc_id", "line", F.lit(None).cast("string").alias("replacement"), "column", F.lit(1).cast("long").alias("dup_count"), F.array("rule").alias("grouped_rules"))
    return grouped.unionByName(alone)


def merge_lexicon(entries: DataFrame) -> DataFrame:
    """One entry for each normalised term: the last spelling, the last non-empty value of each field. Forbidden and allowed terms stay apart."""
    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.trim(c) != "", F.col("seq"))).alias(c)
    return entries.groupBy("kind", F.lower(F.trim("term")).alias("key")).agg(F.max_by("term", "seq").alias("term"), last("replacement"), last("comment"))


def merge_rules(rules: DataFrame) -> DataFrame:
    """Distinct by normalised title and text, the first kept."""
    keyed = rules.withColumn("t", F.lower(F.trim("title"))).withColumn("x", F.lower(F.trim("text")))
    return first_of(keyed, ["t", "x"], ["seq"]).drop("t", "x")


def merge_guide_update(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by normalised title: old ids stay, non-empty incoming fields win; ``change`` says added, updated or same."""
    a = current.select(F.lower(F.trim("title")).alias("key"), F.col("rule").alias("o_rule"), F.col("title").alias("o_title"), F.col("text").alias("o_text"))
    b = incoming.select(F.lower(F.trim("title")).alias("key"), F.col("rule").alias("n_rule"), F.col("title").alias("n_title"), F.nullif(F.trim("text"), F.lit("")).alias("n_text"))
    both = a.join(b, "key", "full")
    change = F.when(F.col("o_rule").isNull(), "added").when(F.col("n_text").isNotNull() & ~F.col("n_text").eqNullSafe(F.col("o_text")), "updated").otherwise("same")
    return both.select(F.coalesce("o_rule", "n_rule").alias("rule"), F.coalesce("n_title", "o_title").alias("title"), F.coalesce("n_text", "o_text").alias("text"), change.alias("change"))


def unique_rule_ids(rules: DataFrame) -> DataFrame:
    """Missing and repeated ids become the title's slug, repeated ones with _2, _3 and so on; suffixes that are taken are passed over."""
    from docaudit.functions.text import slug

    base = F.coalesce(F.nullif(F.trim("rule"), F.lit("")), slug(F.col("title")))
    rows = rules.withColumn("base", base)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("seq")))
    taken = rows.where("n = 1").select(F.col("base").alias("made"))
    # a base with m repeated rows and t names that already look like one of its own has m free ones among the first m + t
    looks = taken.select(F.regexp_extract("made", r"^(.*)_[0-9]+$", 1).alias("base")).groupBy("base").agg(F.count("*").alias("t"))
    wanted = rows.where("n > 1").groupBy("base").agg(F.count("*").alias("m")).join(looks, "base", "left")
    names = wanted.select("base", F.explode(F.sequence(F.lit(2), 1 + F.col("m") + F.coalesce("t", F.lit(0)))).alias("k")).withColumn("made", F.concat_ws("_", "base", "k"))
    free = names.join(taken, "made", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("k")) + 1)
    rows = rows.join(free.select("base", "n", "made"), ["base", "n"], "left")
    return rows.withColumn("rule", F.coalesce("made", "base")).drop("base", "n", "made")


# aggregates
def severity_summary(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("suggestion", "suggestions"))))


def findings_by(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count("*").alias("n"))


def token_totals(usage: DataFrame, midnight: Column) -> DataFrame:
    today = F.col("ts") >= midnight
    return usage.agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.count_if(today).alias("calls_today"), F.coalesce(F.sum(F.when(today, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_today"), F.coalesce(F.sum(F.when(today, F.col("completion_tokens"))), F.lit(0)).alias("completion_today"),
    )


def usage_by_worker(usage: DataFrame) -> DataFrame:
    """Sums for each job and worker, and a total row for each job (worker null)."""
    named = usage.withColumn("worker", F.coalesce("worker", F.lit("unknown")))
    rows = named.rollup("job_id", "worker").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"), F.grouping_id().alias("g"))
    return rows.where("g < 3").drop("g")


def rule_hits(hits: DataFrame) -> DataFrame:
    """(user, rule): count, description of the latest hit (first line, 160 characters) and its time."""
    first_line = F.substring(F.substring_index(F.col("description"), "\n", 1), 1, 160)
    return hits.where(F.trim("rule") != "").groupBy("user", "rule").agg(F.count("*").alias("count"), F.max_by(first_line, F.struct("ts", "description")).alias("description"), F.max("ts").alias("last_ts"))


def consistency_by_name(fields: DataFrame, top: int = 8, limit: int = 60) -> DataFrame:
    """Names with over one distinct trimmed text: variants with counts, the most frequent first; ``near`` if two variants are equal once normalised."""
    rows = fields.where("trim(text) <> ''").groupBy("name", F.trim("text").alias("text")).agg(F.count("*").alias("n"))
    norm = F.lower(F.btrim(F.regexp_replace("text", r"\s+", " "), F.lit(" .;:")))
    rows = rows.withColumn("norm", norm)
    got = rows.groupBy("name").agg(
        F.count("*").alias("variants"), F.sum("n").alias("total"), (F.count_distinct("norm") < F.count("*")).alias("near"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "text"))), lambda x: x["text"]), 1, top).alias("texts"),
    )
    return got.where("variants > 1").orderBy(~F.col("near"), F.desc("variants"), F.desc("total"), "name").limit(limit)


def consistency_by_text(fields: DataFrame) -> DataFrame:
    """Normalised texts with over one spelling, and what the spellings differ in."""
    spaced = F.regexp_replace(F.trim("text"), r"\s+", " ")
    marked = F.btrim(spaced, F.lit(" .;:"))
    rows = fields.select(F.lower(marked).alias("norm"), F.col("text"), spaced.alias("spaced"), marked.alias("marked"), F.lower("text").alias("low"))
    got = rows.groupBy("norm").agg(F.count_distinct("text").alias("spellings"), F.count("*").alias("n"), F.count_distinct("spaced").alias("s"), F.count_distinct("low").alias("l"), F.count_distinct("marked").alias("m"))
    reason = F.when(F.col("l") == 1, "case").when(F.col("s") == 1, "spaces").when(F.col("m") == 1, "trailing mark").otherwise("spelling")
    return got.where("spellings > 1").select("norm", "spellings", "n", reason.alias("reason"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


# windows
def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top_rules_per_user(hits: DataFrame, n: int = 15) -> DataFrame:
    per = Window.partitionBy("user")
    rows = hits.withColumns({"total_hits": F.sum("count").over(per), "distinct_rules": F.count("*").over(per)})
    rank = F.row_number().over(per.orderBy(F.desc("count"), F.desc("last_ts"), "rule"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return rows.withColumn("bar", F.col("count") / F.max("count").over(per))


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, number): latest and previous version of each document."""
    order = Window.partitionBy("doc_id").orderBy("number")
    rows = docs.withColumn("previous", F.lag("number").over(order))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_versions"), F.max("number").alias("latest"), F.max_by("previous", "number").alias("previous"))


def review_aware_baseline(docs: DataFrame) -> DataFrame:
    """The last version that is no review (else the last), and the version right before it as its baseline."""
    per = Window.partitionBy("doc_id")
    rows = docs.withColumn("previous", F.lag("number").over(per.orderBy("number")))
    rows = rows.withColumn("current", F.coalesce(F.max(F.when(F.col("kind") != "review", F.col("number"))).over(per), F.max("number").over(per)))
    return rows.where("number = current").select("doc_id", F.col("number").alias("current"), F.col("previous").alias("baseline"))


def cap_with_marker(events: DataFrame, key: str, order: list[Column | str], n: int = 200) -> DataFrame:
    """The first n events of each key, and a row that says how many more there are."""
    rows = events.withColumns({"r": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "all": F.count("*").over(Window.partitionBy(key))})
    more = rows.where(F.col("r") == n + 1).select(key, F.lit("more").alias("kind"), (F.col("all") - n).alias("n"))
    return rows.where(F.col("r") <= n).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("shown").alias("kind"), "n").unionByName(more)


def batches(df: DataFrame, key: str, order: list[Column | str], size: int = 12) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


# sets and trees
def union_engines(*outputs: DataFrame | None) -> DataFrame:
    """All detector outputs; one that failed (None) adds nothing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (o for o in outputs if o is not None))


def effective_rule_ids(*ids: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (i.select("rule") for i in ids)).distinct()


def shadow_comparison(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = (x.select(*keys).distinct().withColumn(n, F.lit(1)) for x, n in ((a, "l"), (b, "r")))
    both = left.join(right, keys, "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("primary_only"), F.count_if(F.col("l").isNull()).alias("secondary_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))


def rule_precedence() -> list[Column]:
    """Mandatory first, then priority, scope, machine-verifiable, id."""
    scope = F.create_map(*(F.lit(x) for kv in {"all": 0, "document": 1, "section": 2, "sentence": 3, "token": 4}.items() for x in kv))
    priority = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("priority", F.lit(50))))
    return [F.desc("mandatory"), F.desc(priority), F.desc(F.coalesce(scope[F.col("scope")], F.lit(0))), F.desc("machine_verifiable"), F.asc("rule")]


def authoritative_rules(guide: DataFrame, base: DataFrame) -> DataFrame:
    """Guide rules and base rules whose id the guide doesn't take, without those that another names in ``supersedes``."""
    both = guide.unionByName(base.join(guide.select("rule"), "rule", "left_anti"))
    gone = both.select(F.explode("supersedes").alias("rule"))
    return both.join(gone, "rule", "left_anti").orderBy(*rule_precedence())


def example_contradictions(rules: DataFrame) -> DataFrame:
    """Examples that are good and bad within a conflict family."""
    good = rules.select("conflict_family", F.explode("good_examples").alias("example"))
    return good.intersect(rules.select("conflict_family", F.explode("bad_examples").alias("example")))


def unknown_rule_refs(rules: DataFrame) -> DataFrame:
    refs = rules.select("rule", F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("supersedes", "specializes", "requires")))).alias("target"))
    return refs.join(rules.select(F.col("rule").alias("target")), "target", "left_anti").unionByName(refs.where("rule = target")).distinct()


def folder_paths(folders: DataFrame, max_depth: int = 50) -> DataFrame:
    """Root to leaf names of each folder (id, name, parent_id), by a recursive query with a bound that also ends cycles."""
    spark = folders.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE up(id, at, path, depth) AS (
              SELECT id, parent_id, name, 0 FROM {{folders}}
              UNION ALL
              SELECT up.id, f.parent_id, concat(f.name, ' / ', up.path), up.depth + 1 FROM up JOIN {{folders}} f ON up.at = f.id WHERE up.depth < {max_depth})
            SELECT id, max_by(path, depth) AS path, max(depth) AS depth FROM up GROUP BY id""",
        folders=folders,
    )


def folder_descendants(folders: DataFrame, root: int, max_depth: int = 50) -> DataFrame:
    return folders.sparkSession.sql(
        f"""WITH RECURSIVE down(id, depth) AS (
              SELECT id, 0 FROM {{folders}} WHERE id = {int(root)}
              UNION ALL
              SELECT f.id, down.depth + 1 FROM down JOIN {{folders}} f ON f.parent_id = down.id WHERE down.depth < {max_depth})
            SELECT id, min(depth) AS depth FROM down GROUP BY id""",
        folders=folders,
    )


def reference_cycles(edges: DataFrame) -> DataFrame:
    """(start, length): each node of (src, dst) that lies on a cycle, with the length of the shortest way round.

    Nodes without a way in or out lie on no cycle and are trimmed. A node with one way in and one way out is passed over: its two edges
    become one, which keeps their length, so a chain or ring of any length is gone after a logarithmic number of rounds
    (neighbours never go in one round: the one with the larger hash does). Ways are then searched between the nodes that are left, from each
    along the edges until none gets shorter. A node that was passed over lies on its edge's shortest way round. Each round is
    a written table; only counts come to the driver.
    """
    whole = edges.select("src", "dst").dropna().distinct()
    left, inside = _without_chains(whole)
    seen = front = written(left.groupBy("src", "dst").agg(F.min("length").alias("length")).select(F.col("src").alias("start"), F.col("dst").alias("at"), "length"), "walk")
    while not front.isEmpty():
        open_ends = front.where("at <> start").select("start", F.col("at").alias("src"), "length")
        step = open_ends.join(left.withColumnRenamed("length", "more"), "src").select("start", F.col("dst").alias("at"), (F.col("length") + F.col("more")).alias("length"))
        step = step.groupBy("start", "at").agg(F.min("length").alias("length"))
        better = step.join(seen.withColumnRenamed("length", "known"), ["start", "at"], "left").where("known is null or length < known").select("start", "at", "length")
        front = written(better, "walk")
        seen = written(seen.unionByName(front).groupBy("start", "at").agg(F.min("length").alias("length")), "ways")
    own = seen.where("at = start").select("start", "length")
    back = seen.select(F.col("start").alias("dst"), F.col("at").alias("src"), F.col("length").alias("back"))
    round_ = left.join(back, ["src", "dst"], "left").withColumn("back", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.col("back")))
    passed = inside.join(round_.where("back is not null").select("edge", (F.col("length") + F.col("back")).alias("length")), "edge").select(F.col("node").alias("start"), "length")
    return own.unionByName(passed).select("start", F.col("length").cast("int").alias("length"))


def _without_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, length, edge) between the nodes that can't be passed over, and (node, edge) of those that were."""
    # numbers stay as they are, as the table is written
    left = written(edges.select("src", "dst", F.lit(1).cast("long").alias("length"), F.monotonically_increasing_id().alias("edge")), "edges")
    node = left.schema["src"].dataType.simpleString()
    inside = edges.sparkSession.createDataFrame([], f"node {node}, edge long")
    turn, before = 0, 1 << 60
    # a few that are left cost the walk no more than further rounds would
    while before - (size := left.count()) > 16:
        before = size
        # trimmed: edges that begin where none ends, or end where none begins
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = written(left.select("src", "dst", "length", "edge"), "edges")
        into = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("src"), F.min("edge").alias("first"))
        out = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"), F.min("dst").alias("dst"), F.min("edge").alias("second"))
        plain = into.where("n = 1").join(out.where("m = 1"), "node").where("src <> node").select("node", "src", "dst", "first", "second", F.xxhash64("node", F.lit(turn)).alias("h"))
        plain = written(plain, "plain")
        rival = plain.select("node", F.col("h").alias("other"))
        near = plain.join(rival.withColumnsRenamed({"node": "src", "other": "of_src"}), "src", "left").join(rival.withColumnsRenamed({"node": "dst", "other": "of_dst"}), "dst", "left")
        gone = written(near.where("(of_src is null or of_src < h) and (of_dst is null or of_dst < h)").select("node", "src", "dst", "first", "second"), "gone")
        lengths = left.select("edge", "length")
        joined = gone.join(lengths.withColumnsRenamed({"edge": "first", "length": "a"}), "first").join(lengths.withColumnsRenamed({"edge": "second", "length": "b"}), "second")
        joined = joined.select("src", "dst", (F.col("a") + F.col("b")).alias("length"), F.col("first").alias("edge"))
        kept = left.join(gone.select(F.explode(F.array("first", "second")).alias("edge")), "edge", "left_anti").select("src", "dst", "length", "edge")
        moved = inside.join(gone.select(F.col("second").alias("edge"), F.col("first").alias("to")), "edge", "left").select("node", F.coalesce("to", "edge").alias("edge"))
        inside = written(moved.unionByName(gone.select("node", F.col("first").alias("edge"))), "inside")
        left = written(kept.unionByName(joined), "edges")
        turn += 1
    return left, inside
