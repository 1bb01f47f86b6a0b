"""Rules for each passage by lexical and vector scores. Passages: (chunk, text, task, category); rules: (rule, title, text, bad_examples, mandatory, priority, scope, machine_verifiable, tasks, categories)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import stem, tokens
from docaudit.operators.combine import rule_precedence
from docaudit.sources.shared import written

LEXICAL, SEMANTIC = 0.55, 0.45
FIELD_WEIGHTS = {"identity": 0.25, "policy": 0.45, "examples": 0.30}


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): words, and stems of long words, with counts."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("token"))
    both = words.unionByName(words.select(key, stem(F.col("token")).alias("token")).where("token is not null"))
    return both.groupBy(key, "token").agg(F.count("*").alias("n"))


def rule_documents(rules: DataFrame) -> DataFrame:
    """The three texts of a rule that vectors stand for."""
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return rules.select("rule", F.concat_ws(" ", "title", join("categories")).alias("identity"), F.col("text").alias("policy"), F.concat_ws(" ", join("bad_examples"), join("good_examples")).alias("examples"))


def lexical_score(passages: DataFrame, rules: DataFrame) -> DataFrame:
    """(chunk, rule, lexical): shared words over the root of both lengths, and 1 more if the passage holds a bad example. Joined on words, so pairs without a common word never meet; the examples' first words find the rest."""
    q, r = terms(passages, "chunk", "text"), terms(rules, "rule", "text")
    size_q, size_r = q.groupBy("chunk").agg(F.sum("n").alias("lq")), r.groupBy("rule").agg(F.sum("n").alias("lr"))
    shared = q.join(r.withColumnRenamed("n", "m"), "token").groupBy("chunk", "rule").agg(F.sum(F.least("n", "m")).alias("common"))
    score = F.col("common") / F.greatest(F.lit(1.0), F.sqrt("lq") * F.sqrt("lr"))
    base = shared.join(size_q, "chunk").join(size_r, "rule").select("chunk", "rule", score.alias("s"))
    examples = rules.select("rule", F.explode("bad_examples").alias("bad")).where(F.length("bad") >= 3).withColumn("token", tokens(F.col("bad"))[0])
    held = q.join(examples, "token").join(passages.select("chunk", "text"), "chunk").where(F.contains(F.lower("text"), F.lower("bad"))).select("chunk", "rule", F.lit(1.0).alias("s")).distinct()
    return base.unionByName(held).groupBy("chunk", "rule").agg(F.sum("s").alias("lexical"))


def normalize_vectors(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rule_vectors(vectors: DataFrame) -> DataFrame:
    """(rule, r): the weighted sum of a rule's vectors of unit length. Its product with a unit vector is the weighted sum of their cosines, so a pair takes one product instead of one a field."""
    weights = F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv))
    w = weights[F.col("field")]
    one = F.struct("field", F.transform(normalize_vectors(F.col("v").cast("array<double>")), lambda x: x * w).alias("r"))
    ordered = vectors.groupBy("rule").agg(F.array_sort(F.collect_list(one)).alias("vs"))
    total = F.aggregate("vs", F.array_repeat(F.lit(0.0), F.size(F.col("vs")[0]["r"])), lambda s, x: F.zip_with(s, x["r"], lambda a, b: a + b))
    return ordered.select("rule", total.alias("r"))


def semantic_score(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk, rule, semantic): weighted cosines to a rule's vectors, for every passage (chunk, v) and every rule, in one narrow pass over the passages. A rule set is a stated set of queries; ``retrieve`` keeps k rules a passage."""
    q = passages.select("chunk", normalize_vectors(F.col("v").cast("array<double>")).alias("q"))
    return q.join(rule_vectors(vectors), F.lit(True)).select("chunk", "rule", dot(F.col("q"), F.col("r")).alias("semantic"))


def metadata_boost(task: Column, category: Column) -> Column:
    out = F.coalesce(F.col("priority"), F.lit(50)) / 1000.0
    out = out + F.when(F.array_contains("tasks", task), 0.12).otherwise(0.0) + F.when(F.array_contains("categories", category), 0.10).otherwise(0.0)
    return out + F.when(F.col("scope").isin("all", "document"), 0.06).otherwise(0.0) + F.when(F.col("machine_verifiable"), 0.02).otherwise(0.0)


def select_top_k(scored: DataFrame, k: int) -> DataFrame:
    """All mandatory rules in their precedence, then others by score, up to the larger of k and the number of mandatory ones. ``scored``: chunk, score and the rule columns."""
    order = rule_precedence()
    per = Window.partitionBy("chunk")
    rank = F.row_number().over(per.orderBy(F.desc("mandatory"), F.when(F.col("mandatory"), 0.0).otherwise(-F.col("score")), *order[1:]))
    rows = scored.withColumns({"rank": rank, "n_mandatory": F.count_if("mandatory").over(per)})
    return rows.where(F.col("rank") <= F.greatest(F.lit(k), F.col("n_mandatory"))).drop("n_mandatory")


def _leading(scored: DataFrame, per: list[str], k: int) -> DataFrame:
    """(per, rule) of the k best by ``base`` among the rules that aren't mandatory. Spark cuts to k a task before the shuffle."""
    order = Window.partitionBy(*per).orderBy(F.desc("base"), *rule_precedence())
    return scored.where(~F.col("mandatory")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*per, "rule")


def retrieve(passages: DataFrame, rules: DataFrame, k: int, vectors: DataFrame | None = None) -> DataFrame:
    """(chunk, rule, score, rank, mode) for all passages in one plan.

    mode is hybrid for a passage with a vector where rules have vectors, else lexical_only if it shares a word with a rule, else
    fallback: all rules by precedence, with score 0. Ties go by precedence. ``chunk`` is unique; task and category may be null.

    A score is a part that the words add, never below 0, and a base of the rest. So a rule without common words that is not among
    the k best bases can't be among the k best scores, and pairs are scored only for common words, the k best bases and mandatory
    rules. Without vectors the base depends on task and category alone and is worked out once for each two of them.
    """
    lexical = written(lexical_score(passages, rules), "lexical")  # read several times below
    rules = rules.withColumn("mandatory", F.coalesce("mandatory", F.lit(False)))
    boost = metadata_boost(F.col("task"), F.col("wanted"))
    asked = passages.select("chunk", "task", F.col("category").alias("wanted"), (F.struct("task", "category").cast("string")).alias("label"))
    labels = asked.select("label", "task", "wanted").distinct()
    by_label = labels.join(rules, F.lit(True)).withColumn("base", boost)
    mandatory = rules.where("mandatory").select("rule")
    lists = _leading(by_label, ["label"], k).unionByName(labels.select("label").join(mandatory, F.lit(True))).groupBy("label").agg(F.collect_list("rule").alias("rules"))
    hits = lexical.select("chunk", "rule")
    plain = asked
    if vectors is not None:
        known = rule_vectors(vectors)
        q = passages.where("v is not null").select("chunk", normalize_vectors(F.col("v").cast("array<double>")).alias("q"))
        near = q.join(asked, "chunk").join(rules.join(known, "rule", "left"), F.lit(True))
        near = near.withColumn("base", SEMANTIC * F.coalesce(dot(F.col("q"), F.col("r")), F.lit(0.0)) + boost)
        best = _leading(near, ["chunk"], k).unionByName(q.select("chunk").join(mandatory, F.lit(True)))
        plain = asked.join(q, "chunk", "left_anti")
    # passages without a common word and without a vector get every rule
    some = hits.select("chunk").distinct()
    short = plain.join(some, "chunk", "left_semi").join(lists, "label").select("chunk", F.explode("rules").alias("rule"))
    pairs = hits.unionByName(short)
    if vectors is not None:
        pairs = pairs.unionByName(best)
    pairs = pairs.distinct().join(lexical, ["chunk", "rule"], "left").join(asked, "chunk").join(rules, "rule")
    semantic, mode = F.lit(0.0), F.lit("lexical_only")
    if vectors is not None:
        pairs = pairs.join(q, "chunk", "left").join(known, "rule", "left")
        semantic = F.coalesce(dot(F.col("q"), F.col("r")), F.lit(0.0))
        mode = F.when(F.col("q").isNotNull(), "hybrid").otherwise("lexical_only")
    score = LEXICAL * F.coalesce("lexical", F.lit(0.0)) + (SEMANTIC * semantic + boost)
    scored = select_top_k(pairs.withColumns({"score": score, "mode": mode}), k)
    rest = plain.join(some, "chunk", "left_anti").join(rules, F.lit(True)).withColumns({"score": F.lit(0.0), "mode": F.lit("fallback")})
    out = ("chunk", "rule", "score", "rank", "mode")
    return scored.select(*out).unionByName(select_top_k(rest, 1 << 30).select(*out))


Model = Callable[[list[str]], list[list[float]]]


def embedded(texts: DataFrame, model: Model, batch: int = 90, cache: DataFrame | None = None) -> DataFrame:
    """(digest, v): the vector of each different text of ``texts`` (text), by its SHA-256.

    ``model`` is the user's function from a list of texts to as many vectors. It is called once for up to ``batch`` different texts, in
    the tasks, wherever Arrow's batches end; texts that ``cache`` (digest, v) holds are not sent to it. The result is written, so
    that whoever reads it several times calls no model again (a task that is lost with its executor is run anew). Null and empty
    texts have no vector. A model that returns another number of vectors is an error.
    """
    rows = texts.where("text <> ''").select(F.sha2("text", 256).alias("digest"), "text").groupBy("digest").agg(F.min("text").alias("text"))
    known = None
    if cache is not None:
        known = cache.join(rows.select("digest"), "digest", "left_semi").select("digest", F.col("v").cast("array<double>").alias("v")).dropDuplicates(["digest"])
        rows = rows.join(cache.select("digest").distinct(), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []

        def out(part: list[tuple[str, str]]) -> pd.DataFrame:
            vectors = model([t for _, t in part])
            if len(vectors) != len(part):
                raise ValueError(f"the model returned {len(vectors)} vectors for {len(part)} texts")
            return pd.DataFrame({"digest": [k for k, _ in part], "v": [[float(x) for x in v] for v in vectors]})

        for b in batches:
            held += zip(b["digest"], b["text"])
            while len(held) >= batch:
                yield out(held[:batch])
                del held[:batch]
        if held:
            yield out(held)

    made = rows.mapInPandas(run, "digest string, v array<double>")
    return written(made if known is None else made.unionByName(known), "vectors")


def retrieve_embedded(passages: DataFrame, rules: DataFrame, k: int, model: Model, cache: DataFrame | None = None) -> DataFrame:
    """``retrieve`` with vectors that ``model`` makes of the passages and of the three texts of each rule; each different text once."""
    documents = rule_documents(rules)
    fields = documents.select("rule", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELD_WEIGHTS))).alias("d")).select("rule", "d.field", "d.text")
    vectors = embedded(passages.select("text").unionByName(fields.select("text")), model, cache=cache)
    of_rules = fields.withColumn("digest", F.sha2("text", 256)).join(vectors, "digest").select("rule", "field", "v")
    asked = passages.drop("v").withColumn("digest", F.sha2("text", 256)).join(vectors, "digest", "left").drop("digest")
    return retrieve(asked, rules, k, of_rules)


def index_state(guides: DataFrame, vectors: DataFrame) -> DataFrame:
    """hybrid, lexical_only or empty for each guide (guide, rule)."""
    have = vectors.select("rule", F.lit(1).alias("v")).distinct()
    state = F.when(F.count("rule") == 0, "empty").when(F.count("v") == F.count("rule"), "hybrid").otherwise("lexical_only")
    return guides.join(have, "rule", "left").groupBy("guide").agg(state.alias("state"))


def exact_rule(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """The rule of each id from the first source that has it."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, (s.withColumn("rank", F.lit(i)) for i, s in enumerate(sources)))
    return rows.join(wanted, "rule", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("rank"))).where("r = 1").drop("r", "rank")
