"""Mixing sources to target weights (operator 10) by Pfair scheduling, with DataFrame and SQL functions only.

The rows of each source are cut into blocks of ``block`` rows. A source of weight w (all weights sum to 1) may place
its j-th block (from 0) from slot floor(j / w) on and has to before slot ceil((j + 1) / w). In each slot the released
block with the earliest deadline goes first (ties: the source that comes first in order). Weights are whole numbers
over their sum, and all times are worked out from them in whole numbers, so nothing drifts: at every slot each
source has been given its exact share, give or take less than one block.

The slots are cut into frames of ``FRAME`` that are scheduled side by side, one row each. For that, where each source
stands at the borders of a frame must be known without the frames before. By slot t a source has had floor(w * t)
blocks, or one more; sources whose border block (released before t, due after t) comes before t are chosen by the
same rule: in order of release, whenever the fractions of w * t so far pass the next whole number, the earliest
deadline among those seen is taken. Prefixes by release then hold enough of them and suffixes by deadline not too many,
so that within every frame all deadlines can be met, and earliest deadline first meets them.

Rows are ordered within their source by the md5 of doc_id. They are numbered without gathering a source in a task:
a window numbers the rows of each (source, first three hex digits of the md5), and the counts of those 4096 shards
per source, with partial sums, give each shard its offset. The slots of a shard's blocks are joined to the shard,
so rows are shuffled once. Nothing is dropped or repeated: when a source has no blocks left, its slots stay
empty and the others go on in their proportions; so the work grows with the slots up to the last block.

Defined results: rows without source are a source of their own (shown as null); rows without doc_id are ordered as
if it were empty; repeated rows follow each other; empty tables give no rows; extra columns are carried by ``mixed``
and left out by ``positions``. Weights: those given, by source (others, and those of 0, get no slot and come last);
without any, the square root of each source's number of rows, to the nearest whole number. Given weights are taken as they
are written in decimal; only where their common denominator passes 2 ** 40 are they rounded to multiples of 2 ** -40.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import table, written

FRAME = 512
BLOCK = 16
SHARD_DIGITS = 3
FINEST = 1 << 40


def _named(source: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source) if isinstance(source, str) else source), F.lit(""))


def _hash() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def whole(weights: dict[str, float | Decimal | Fraction]) -> dict[str, int]:
    """Whole numbers in the proportions of the weights."""
    exact = {k: Fraction(str(v)) for k, v in weights.items() if v > 0}
    total = sum(exact.values())
    scale = lcm(*(v.denominator for v in exact.values())) if exact else 1
    out = {k: int(v * scale) for k, v in exact.items()}
    common = gcd(*out.values()) if out else 1
    out = {k: v // common for k, v in out.items()}
    return out if sum(out.values()) <= FINEST else {k: max(1, round(v / total * FINEST)) for k, v in exact.items()}


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _border(slot: str, total: int) -> str:
    """For each weight in ``w``: base = floor(w * slot), rest of that division, and d = 1 where the border block comes before ``slot``."""
    product = f"CAST({slot} AS DECIMAL(18, 0)) * CAST(x AS DECIMAL(18, 0))"
    state = f"transform(w, (x, i) -> named_struct('i', i, 'w', x, 'base', CAST({product} div {total} AS BIGINT), 'rest', CAST({product} % {total} AS BIGINT)))"
    # by release; a block that is released together with others comes in order of sources
    by_release = f"""array_sort(transform(filter(st, x -> x.rest > 0), x -> named_struct(
        'released', -((x.rest + x.w - 1) div x.w), 'i', x.i, 'due', ({total} - x.rest + x.w - 1) div x.w, 'rest', x.rest)))"""
    opened = "concat(s.open, array(named_struct('due', x.due, 'i', x.i)))"
    taken = "named_struct('sum', s.sum + x.rest, 'open', filter(o, y -> y.i <> array_min(o).i), 'got', concat(s.got, array(array_min(o).i)))"
    passed = f"named_struct('sum', s.sum + x.rest, 'open', {opened}, 'got', s.got)"
    step = f"(s, x) -> CASE WHEN (s.sum + x.rest) div {total} > size(s.got) THEN {_bound(opened, 'o', taken)} ELSE {passed} END"
    start = "named_struct('sum', 0L, 'open', cast(array() as array<struct<due: bigint, i: int>>), 'got', cast(array() as array<int>))"
    fold = f"aggregate({by_release}, {start}, {step}, s -> s.got)"
    return _bound(state, "st", _bound(fold, "got", "transform(st, x -> named_struct('base', x.base, 'rest', x.rest, 'd', CAST(array_contains(got, x.i) AS BIGINT)))"))


def _frame(frame: int, total: int) -> str:
    """The blocks of frame ``c`` in order: earliest deadline first among those that are released and belong before the frame's end."""
    source = "transform(w, (x, i) -> named_struct('w', x, 'base', b0[i].base, 'rest', b0[i].rest, 'stop', b1[i].base + b1[i].d - b0[i].base))"
    late = "pmod({0}, x.w)"
    released = f"s.d[i] * {total} - x.rest"
    due = f"((s.d[i] + 1) * {total} - x.rest + x.w - 1) div x.w"
    able = f"""transform(src, (x, i) -> CASE WHEN s.d[i] < x.stop AND {released} < (t + 1) * x.w THEN named_struct('due', {due}, 'i', i, 'j', x.base + s.d[i],
        'released', ({released} - {late.format(released)}) div x.w) END)"""
    block = "named_struct('i', k.i, 'block', k.j, 'slot', c * {0} + t, 'release', c * {0} + k.released, 'deadline', c * {0} + k.due)".format(frame)
    step = f"(s, t) -> {_bound(f'array_min({able})', 'k', f"named_struct('d', transform(s.d, (v, i) -> v + CAST(i = k.i AS BIGINT)), 'out', concat(s.out, array({block})))")}"
    kind = "array<struct<i: int, block: bigint, slot: bigint, release: bigint, deadline: bigint>>"
    fold = f"aggregate(sequence(0L, {frame - 1}L), named_struct('d', transform(b0, x -> x.d), 'out', cast(array() as {kind})), {step}, s -> s.out)"
    return _bound(_border(f"(c * {frame})", total), "b0", _bound(_border(f"((c + 1) * {frame})", total), "b1", _bound(source, "src", fold)))


def schedule(spark: SparkSession, sources: list[tuple[str, int, int]], frame: int = FRAME) -> DataFrame:
    """(name, block, slot, release, deadline) of every block of the ``sources``: name, weight as a whole number, number of blocks."""
    kind = "name string, block long, slot long, release long, deadline long"
    if not sources:
        return spark.createDataFrame([], kind)
    sources = sorted(sources)
    total = sum(w for _, w, _ in sources)
    slots = max(-(-n * total // w) for _, w, n in sources)
    frames = spark.range(-(-slots // frame)).withColumnRenamed("id", "c")
    names = spark.createDataFrame([(i, name, n) for i, (name, _, n) in enumerate(sources)], "i int, name string, blocks long")
    listed = "array(" + ", ".join(f"{w}L" for _, w, _ in sources) + ")"
    blocks = frames.select(F.explode(F.expr(_bound(listed, "w", _frame(frame, total)))).alias("b")).select("b.*")
    return blocks.join(names, "i").where("block < blocks").select("name", "block", "slot", "release", "deadline")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """(row, name, at_source, block, slot, release, deadline): ``row`` is the whole row as a struct, at_source its number within its source from 0."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _named("source").alias("name"), _hash().alias("h"))
    rows = rows.withColumn("shard", F.substring("h", 1, SHARD_DIGITS))
    sizes = docs.select(_named("source").alias("name"), F.substring(_hash(), 1, SHARD_DIGITS).alias("shard")).groupBy("name", "shard").agg(F.count("*").alias("n"))
    sizes = written(sizes, "shards")
    # one row for each source comes to the driver
    counts = sizes.groupBy("name").agg(F.sum("n").alias("n"), F.round(F.sqrt(F.sum("n"))).cast("long").alias("w")).collect()
    given = {r["name"]: r["w"] for r in counts} if weights is None else {"=" + k: v for k, v in whole(weights).items()}
    plan = schedule(docs.sparkSession, [(r["name"], given[r["name"]], -(-r["n"] // block)) for r in counts if r["name"] in given], frame)
    before = F.sum("n").over(Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.select("name", "shard", "n", F.coalesce(before, F.lit(0)).alias("before")).withColumn("first", F.expr(f"before div {block}"))
    shards = written(shards, "offsets")
    # a shard holds at most a 4096th of a source's slots, give or take what chance does
    held = shards.select("name", "shard", F.explode(F.sequence("first", F.expr(f"(before + n - 1) div {block}"))).alias("block")).join(written(plan, "plan"), ["name", "block"])
    held = held.groupBy("name", "shard").agg(F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("places"))
    shards = written(shards.select("name", "shard", "before", "first").join(held, ["name", "shard"], "left"), "places")
    # both sides are dealt by source and shard already, so this join moves the shards only
    local = F.row_number().over(Window.partitionBy("name", "shard").orderBy("h")) - 1
    out = rows.withColumn("local", local).join(shards, ["name", "shard"]).withColumn("at_source", F.col("before") + F.col("local")).withColumn("block", F.expr(f"at_source div {block}"))
    place = F.expr("places[cast(block - first as int)]")
    return out.select("row", "name", "at_source", "block", *(place[c].alias(c) for c in ("slot", "release", "deadline")))


def positions(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """doc_id, source, at_source, block, slot, release and deadline of every row."""
    out = mixed(docs.select("doc_id", "source"), weights, block, frame)
    return out.select("row.doc_id", "row.source", "at_source", "block", "slot", "release", "deadline")


def interleaved(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """``docs`` in the mixed order: sorted by slot, then by number within the source; rows of sources without weight come last."""
    out = mixed(docs, weights, block, frame)
    return out.orderBy(F.asc_nulls_last("slot"), "name", "at_source").select("row.*")


def op10_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "documents"))


#: Slot after slot from the first on, without frames; every source takes part until the last block is placed.
ORACLE = f"""
WITH RECURSIVE named AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), weighted AS (
  SELECT name, CAST(round(sqrt(count(*))) AS BIGINT) AS w, (count(*) + {BLOCK - 1}) // {BLOCK} AS blocks, row_number() OVER (ORDER BY name) AS i FROM named GROUP BY name
), lists AS (
  SELECT list(w ORDER BY i) AS ws, CAST(sum(w) AS BIGINT) AS total, CAST(max((blocks * (SELECT sum(w) FROM weighted) + w - 1) // w) AS BIGINT) AS slots FROM weighted
), steps AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, ws, total, slots FROM lists WHERE total IS NOT NULL
  UNION ALL
  SELECT t, pick, list_transform(done, lambda d, i: d + CASE WHEN i = pick THEN 1 ELSE 0 END), ws, total, slots FROM (
    SELECT t, done, ws, total, slots, list_min(keys) % 1000000 AS pick FROM (
      SELECT t + 1 AS t, done, ws, total, slots, list_transform(done, lambda d, i: CASE WHEN d * total < (t + 2) * ws[i]
        THEN (((d + 1) * total + ws[i] - 1) // ws[i]) * 1000000 + i ELSE 9000000000000000000 END) AS keys FROM steps WHERE t + 1 < slots))
), slots AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM steps WHERE t >= 0
), placed AS (
  SELECT doc_id, source, name, row_number() OVER (PARTITION BY name ORDER BY h) - 1 AS at_source FROM named
), blocks AS (SELECT doc_id, source, at_source, at_source // {BLOCK} AS block, i, w FROM placed JOIN weighted USING (name))
SELECT doc_id, source, at_source, block, slot, (block * total) // w AS release, ((block + 1) * total + w - 1) // w AS deadline
FROM blocks JOIN slots USING (i, block) CROSS JOIN lists
"""
