"""What both vector searches share: rows that take part, blocks of queries, and the best k of all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import new_path

QUERY_BLOCK = 8192


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: with an id, without null or non-finite components (nor all zero, if asked)."""
    v = F.col("embedding").cast("array<double>")
    ok = F.size(v) > 0
    ok = ok & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths that vectors have; those of one length are searched among themselves. A table has one, as a rule."""
    return sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())


def in_query_blocks(rows: DataFrame, is_query: Column, search: Callable[[np.ndarray, np.ndarray], DataFrame], out: str, size: int = QUERY_BLOCK) -> DataFrame:
    """What ``search`` returns (a DataFrame with the columns ``out``) for all queries among ``rows``, in blocks of about ``size``.

    Queries are written once, dealt by block. One block at a time is read, given to ``search`` and its result written, so what is
    on the driver, broadcast or in a plan at once has a bound that doesn't grow with the table. A repeated vec_id asks once, with its least vector.
    """
    spark = rows.sparkSession
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-rows.where(is_query).select("vec_id").distinct().count() // size))
    path, found = new_path(spark, "queries"), new_path(spark, "found")
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).write.partitionBy("block").parquet(path)
    queries = spark.read.schema("vec_id long, v array<double>, block long").parquet(path)
    spark.createDataFrame([], out).write.parquet(found)
    for block in range(blocks):
        part = queries.where(F.col("block") == block).select("vec_id", "v").toArrow()
        if part.num_rows:
            search(part.column(0).to_numpy(), rows_of(part.column(1).combine_chunks())).write.mode("append").parquet(found)
    return spark.read.schema(out).parquet(found)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks found for each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
