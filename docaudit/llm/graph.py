"""Connected components by random contraction, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): nodes have the same root just where a path joins them.

    In each round every node goes over to the neighbour (or itself) whose hash, drawn anew for the round, is
    least; edges within a merged node vanish. A constant share of nodes vanishes a round, whatever the
    shape, so a long chain takes logarithmically many rounds. Both sides of each join are written tables,
    so Spark splits the partition of a node with very many edges. Only the number of edges left comes to
    the driver. Self-loops and repeated edges are allowed; null ends are left out.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().distinct(), "edges")
    roots: DataFrame | None = None
    turn = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("to"))
        step = both.groupBy("a").agg(F.min(rank).alias("least")).select("a", F.least("least", own)["to"].alias("to"))
        step = written(step, "step")
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = roots.join(step, roots["root"] == step["a"], "left")
            roots = written(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = edges.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        left = left.join(step, "a").select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b")
        edges = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
        if edges.isEmpty():
            return roots
