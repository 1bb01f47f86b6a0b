"""From raw documents to token ids: quality, near duplicates, private data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage returns as Parquet in the
shared folder and reads it back as the next one's documents.

Defined results, for every stage: an empty table gives no rows; null texts count as empty ones and stay null where they
are returned; rows without doc_id or source take part; repeated rows stay, but for near duplicates, of which one row stays;
further columns are carried along whatever their names, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import bpe, mixing, neardup, pii, quality
from docaudit.llm.common import table, written

#: Column of a row's digest, and whether one row with it stays.
ROW, STAYS = "row digest of near duplicates", "row stays of near duplicates"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    weights = quality.learnt(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, weights)


def row_digest(turn: int) -> Column:
    """64 bits of doc_id and text; other ones for each turn."""
    return F.xxhash64(F.lit(turn), "doc_id", F.md5("text"), F.length("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as (ROW, doc_id, text, carried): equal rows share a 64-bit number, different ones don't.

    Rows whose digests meet though doc_id or text differ (told by a second digest, of 128 bits) get another one, until none meet.
    Of 10^10 different rows some three do, so what is looked up stays small.
    """
    # only the columns at hand are named, so others may have any name
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row_digest(0).alias(ROW), "doc_id", "text", carried.alias("carried"))
    full = F.struct(F.xxhash64(F.lit(-1), "doc_id"), F.unhex(F.md5(F.concat(F.lit("/"), "text"))))
    turn = 0
    while True:
        # sums of a digest's two halves, so that counting keeps two numbers a row
        halves = [F.xxhash64(F.lit(-k), full).alias(f"half{k}") for k in (1, 2)]
        ends = [f(f"half{k}").alias(f"{n}{k}") for k in (1, 2) for n, f in (("least", F.min), ("most", F.max))]
        met = rows.select(ROW, *halves).groupBy(ROW).agg(*ends).where("least1 <> most1 or least2 <> most2").select(ROW)
        met = written(met, "met")
        if met.isEmpty():
            return rows
        turn += 1
        rows = rows.join(met.withColumn("again", F.lit(True)), ROW, "left")
        rows = rows.withColumn(ROW, F.when(F.col("again"), row_digest(turn)).otherwise(F.col(ROW))).drop("again")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id (any of those that share it; none counts as the largest).

    doc_id may be missing or repeated, so a row is known by the number that ``numbered`` gives it; rows that share one are copies.
    """
    rows = numbered(docs)
    found = neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias(ROW), "component_id")
    found = written(found.groupBy(ROW).agg(F.min("component_id").alias("component_id"), F.count("*").alias("copies")), "components")
    found = found.join(rows.select(ROW, "doc_id").distinct(), ROW)
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW))
    gone = found.select(ROW, "copies").join(stays.select(ROW, F.lit(True).alias(STAYS)), ROW, "left")
    # rows that leave, and copies of one that stays; any other row passes as it is
    odd = written(gone.where(F.col(STAYS).isNull() | (F.col("copies") > 1)).select(ROW, F.col(STAYS).isNotNull().alias(STAYS)), "odd")
    once = rows.join(odd.where(F.col(STAYS)), ROW, "left_semi").dropDuplicates([ROW])
    return rows.join(odd, ROW, "left_anti").unionByName(once).select("carried.*")


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private spans replaced by their kinds."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that keeps each source within a block of its share."""
    return mixing.interleaved(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a digest of what they decode to, and its place in the mix: slot, and number within the source.

    The order of the rows isn't kept where documents are reread, so the places are worked out here once more, from doc_id and source.
    """
    placed = mixing.mixed(docs.select("doc_id", "source", "text")).select("row.*", "slot", "at_source")
    return bpe.encoded(placed, bpe.vocabulary(), ("slot", "at_source"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_private),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL can't express the classifier, MinHash components and encoding; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
