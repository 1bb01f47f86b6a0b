"""Readings of words that a morphology table lacks, from the endings of those that it has.

``morph``: form, rank, lemma, pos, number, grammatical_case, gender; rank 0 is the best reading. All readings of a form, with
how its lemma is made from it, are its paradigm. ``endings`` gives, for each ending of known forms, the paradigm that most of
them have; a word takes the paradigm of its longest known ending. All is joins and aggregates: words are looked up once each,
however often they stand in the texts, and the table of endings is joined as Spark sees fit by its size.

Defined results: forms and words are compared in lower case; null or empty forms and words take no part; repeated rows of ``morph`` count
once; of paradigms that are equally frequent the one that sorts last is taken; a word without known ending has no reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READING = ("rank", "part", "number", "grammatical_case", "gender")
LONGEST, LEAST_FORMS = 6, 2


def _shared(a: str, b: str) -> Column:
    """Number of letters with which both columns begin."""
    return F.expr(f"aggregate(sequence(1, greatest(1, least(length({a}), length({b})))), 0, (s, i) -> if(s = i - 1 and i <= least(length({a}), length({b})) and substr({a}, i, 1) = substr({b}, i, 1), i, s))")


def paradigms(morph: DataFrame) -> DataFrame:
    """(form, paradigm): the readings of each form by rank, with ``cut``, the letters that its lemma lacks, and ``add``, those that it has instead."""
    rows = morph.select(F.lower("form").alias("form"), F.col("rank").cast("int").alias("rank"), F.lower("lemma").alias("lemma"), F.col("pos").alias("part"), "number", "grammatical_case", "gender")
    rows = rows.where("form <> '' and lemma is not null").distinct().withColumn("kept", _shared("form", "lemma"))
    reading = F.struct(*READING, (F.length("form") - F.col("kept")).alias("cut"), F.expr("substr(lemma, kept + 1)").alias("add"))
    return rows.groupBy("form").agg(F.array_sort(F.collect_list(reading)).alias("paradigm"))


def endings(morph: DataFrame, longest: int = LONGEST, least: int = LEAST_FORMS) -> DataFrame:
    """(ending, paradigm): for each ending of up to ``longest`` letters with that paradigm in ``least`` forms or more the most frequent one. A paradigm that cuts more than the ending says nothing of other words."""
    rows = paradigms(morph).withColumn("most", F.array_max(F.transform("paradigm", lambda r: r["cut"])))
    sizes = F.sequence(F.greatest(F.lit(1), "most"), F.least(F.lit(longest), F.length("form")))
    rows = rows.where(F.greatest(F.lit(1), "most") <= F.least(F.lit(longest), F.length("form")))
    rows = rows.select(F.explode(sizes).alias("size"), "form", "paradigm").select(F.expr("right(form, size)").alias("ending"), "paradigm")
    counted = rows.groupBy("ending", "paradigm").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.groupBy("ending").agg(F.max(F.struct("n", "paradigm")).alias("best")).select("ending", "best.paradigm")


def predicted(words: DataFrame, table: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Readings of ``words`` (word) by the longest ending that ``table`` (of ``endings``) holds, in the columns of a morphology table."""
    rows = words.select(F.lower("word").alias("form")).where("form <> ''").distinct()
    at = rows.select("form", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form")))).alias("size")).withColumn("ending", F.expr("right(form, size)"))
    best = at.join(table, "ending").groupBy("form").agg(F.max(F.struct("size", "paradigm")).alias("b")).select("form", F.explode("b.paradigm").alias("r"))
    lemma = F.concat(F.expr("left(form, length(form) - r.cut)"), "r.add")
    return best.select("form", "r.rank", lemma.alias("lemma"), F.col("r.part").alias("pos"), "r.number", "r.grammatical_case", "r.gender")


def completed(tokens: DataFrame, morph: DataFrame, longest: int = LONGEST, least: int = LEAST_FORMS) -> DataFrame:
    """``morph`` with predicted readings of the words of ``tokens`` (word) that it lacks; column ``guessed`` tells them apart."""
    known = morph.select(F.lower("form").alias("form")).distinct()
    lacking = tokens.select(F.lower("word").alias("form")).distinct().join(known, "form", "left_anti").withColumnRenamed("form", "word")
    guessed = predicted(lacking, endings(morph, longest, least), longest)
    return morph.withColumn("guessed", F.lit(False)).unionByName(guessed.withColumn("guessed", F.lit(True)))
