"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.functions.text import decode_lossy, escape_formula
from docaudit.operators.lint import Rule, swap_rule, usable_user_rules, words_rule

FORMATS = ("txt", "md", "html")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, format, text) of txt, md and html files, and the files of other kinds that were rejected."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(kind.isin("htm", "xhtml"), "html").when(kind == "markdown", "md").otherwise(kind)
    rows = files.withColumn("format", kind)
    good = rows.where(F.col("format").isin(*FORMATS)).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source"), "format", decode_lossy(F.col("content")).alias("text"))
    return good, rows.where(~F.col("format").isin(*FORMATS)).select("path", "format", "length")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from YAML files, one rule a file, named after it: existence (raw, tokens), substitution (swap); ignorecase, exceptions, message, level. A rule set is configuration of some hundred small files."""
    import yaml

    out: list[Rule] = []
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.yml").load(path).select("path", "content").collect():
        spec = yaml.safe_load(bytes(f["content"]).decode("utf-8")) or {}
        name, message, level = PurePosixPath(f["path"]).stem, str(spec.get("message", "")), str(spec.get("level", "warning"))
        flags = "(?iU)" if spec.get("ignorecase") else "(?U)"
        if spec.get("swap"):
            out.append(swap_rule(name, {str(k): str(v) for k, v in spec["swap"].items()}, message, level, bool(spec.get("ignorecase"))))
        if spec.get("tokens"):
            made = words_rule(name, (), message, level)
            out.append(Rule(name, flags + r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(str, spec["tokens"])) + r")(?![\p{L}\p{N}_])", made.message, level, exceptions=tuple(map(str, spec.get("exceptions") or ()))))
        out += [Rule(name, flags + str(p), message, level, exceptions=tuple(map(str, spec.get("exceptions") or ()))) for p in spec.get("raw") or ()]
    return sorted(out, key=lambda r: (r.rule, r.pattern))


def read_user_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Usable rules of a JSON list (id, pattern, message, severity)."""
    schema = "id string, pattern string, message string, severity string"
    return usable_user_rules([r.asDict() for r in spark.read.schema(schema).option("multiLine", True).json(path).collect()])


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(ts, user, action, extra) from JSON lines; broken lines are dropped, further fields go to a map."""
    lines = spark.read.text(path).select("value", F.try_parse_json("value").alias("v")).where("v is not null")
    known = F.from_json("value", "ts double, user string, action string")
    everything = F.from_json("value", "map<string,string>")
    return lines.select(known.alias("k"), everything.alias("m")).where("k.ts is not null").select(
        F.timestamp_seconds("k.ts").alias("ts"), "k.user", "k.action", F.map_filter("m", lambda k, _: ~k.isin("ts", "user", "action")).alias("extra")
    )


SPEC_KEYS = ("summary", "description")


def spec_fields(specs: DataFrame) -> DataFrame:
    """(spec_id, path_str, line, key, text): text leaves under ``summary`` and ``description`` of YAML or JSON specs (spec_id, body), list items as ``[i]``; lines from 1."""

    def leaves(node, path: tuple[str, ...]) -> Iterator[tuple[str, int, str, str]]:
        import yaml

        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                if k.value in SPEC_KEYS and isinstance(v, yaml.ScalarNode):
                    yield "/".join((*path, k.value)), v.start_mark.line + 1, k.value, v.value
                else:
                    yield from leaves(v, (*path, str(k.value)))
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                yield from leaves(v, (*path, f"[{i}]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            out = []
            for k, body in zip(b["spec_id"], b["body"]):
                try:
                    root = yaml.compose(body or "")
                except yaml.YAMLError:
                    continue
                out += [(k, *leaf) for leaf in leaves(root, ())]
            yield pd.DataFrame(out, columns=["spec_id", "path_str", "line", "key", "text"])

    return specs.select(F.col("spec_id").cast("string").alias("spec_id"), "body").mapInPandas(run, "spec_id string, path_str string, line int, key string, text string")


def field_kind(path: Column) -> Column:
    return F.when(path.rlike("/summary$"), "summary").when(path.rlike("/responses/"), "response").when(path.rlike("/(properties|schemas)/"), "schema").otherwise("path")


def field_name(path: Column) -> Column:
    """The property behind the last ``properties``."""
    return F.nullif(F.regexp_extract(path, r"^.*/properties/([^/]+)", 1), F.lit(""))


def field_context(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/(summary|description)$", ""), "/", " › ")


# sinks
def report(findings: DataFrame) -> DataFrame:
    """Numbered report rows, formulas escaped."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "column", "rule"))
    return findings.select("doc_id", number.alias("number"), "line", escape_formula(F.col("text")).alias("fragment"), "severity", escape_formula(F.col("message")).alias("message"), escape_formula(F.coalesce("replacement", F.lit(""))).alias("recommendation"))


def sink_report(findings: DataFrame, path: str) -> None:
    report(findings).write.option("header", True).option("escape", '"').csv(path)


def append_snapshot(snapshots: DataFrame, path: str, text_limit: int = 200_000) -> None:
    clipped = snapshots.withColumns({"text": F.substring("text", 1, text_limit), "day": F.to_date("checked_at")})
    clipped.write.mode("append").partitionBy("day").parquet(path)


def append_usage(usage: DataFrame, path: str) -> None:
    usage.where((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0)).write.mode("append").parquet(path)


#: How many rows of the audit log, and of each user's history, are kept.
AUDIT_ROWS, HISTORY_ROWS = 2000, 50


def latest_audit(rows: DataFrame, at: str, keep: int = AUDIT_ROWS) -> DataFrame:
    """The last ``keep`` rows of the log by the column ``at``; each task passes on no more than that."""
    return rows.orderBy(F.desc(at), *(c for c in rows.columns if c != at)).limit(keep)


def latest_history(rows: DataFrame, user: str, at: str, keep: int = HISTORY_ROWS) -> DataFrame:
    """The last ``keep`` rows of every user by the column ``at``."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at), *(c for c in rows.columns if c not in (user, at))))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def append_history(summaries: DataFrame, path: str) -> None:
    """One row for each finished check with its report as JSON."""
    summaries.withColumn("report", F.to_json(F.struct(*summaries.columns))).write.mode("append").parquet(path)


def sink_eval_json(results: DataFrame, path: str) -> None:
    results.write.json(path)
