"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

* Targets: the sources, in code-point order with null last, weigh 3, 1, 2,
  repeating, and share ``ratio`` times all words; a target stops at ``most`` times
  its source's size and the excess is shared again (solved in closed form over
  the sources ordered by limit per weight).
* Each source's documents, in a shuffled (hashed) order, are one tape of words,
  cut into blocks of ``block`` words; a pass over the tape takes its blocks in
  order.
* Slot i of the mixture gets the golden-ratio point i * phi mod 1 (in 31-bit
  integers); the cumulative shares of the sources say whose slot it is, and its
  rank among that source's slots says which block it takes.  A source's last
  slot ends at its target.  As the points are only nearly even, a source may lack
  a few slots, which follow at the end; surplus ones stay empty.

The slots are mapped to sources by an equi-join over 4096 intervals of the points,
so nothing is broadcast by hand and a hot source is spread over its intervals;
ranks and tape offsets are two-level sums.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own; an empty table gives no rows; equal hashes are
ordered by id, then by the text's hash; rows of repeated and of null ids are rows of
their own, each with its own offset and ``taken``.  Extra columns are ignored, but for
those that ``mix`` is told to carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranked, running, spread

WEIGHTS, RATIO, MOST, BLOCK = (3, 1, 2), 1.5, 2, 512
WORD = r"[^\x20\x09-\x0D]+"
_POINTS, _STEP, _CELL = 1 << 31, 1327217885, 1 << 19


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, h, x, more ...)."""
    count = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count.alias("size"), spread(F.col(id_col)).alias("h"), F.xxhash64(text_col).alias("x"), *more)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """(s, source, source_size, target): one row per source, s numbering them."""
    total = Window.partitionBy()
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = named.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    limited = numbered.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("all", F.sum("source_size").over(total) * ratio)
    order = Window.orderBy(F.col("cap") / F.col("w"), "s")
    level = limited.withColumn("spent", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(
        "left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    level = level.withColumn("level", (F.col("all") - F.col("spent")) / F.col("left")).withColumn("k", F.row_number().over(order))
    open_ = F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("k", "level"))
    water = F.min(open_).over(total)["level"]
    return level.select("s", "source", "source_size", F.least("cap", F.coalesce(F.col("w") * water, F.col("cap"))).alias("target"))


def schedule(spark, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, s, pass, block, words): which prefix of which block each slot takes."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    goal = F.floor("target").cast("long")
    full = F.floor(F.col("goal") / F.greatest(F.col("source_size"), F.lit(1)))
    wanted = goals.withColumn("goal", goal).withColumn("nb", blocks).where("goal > 0")
    wanted = wanted.withColumn("need", (full * F.col("nb") + F.ceil((F.col("goal") - full * F.col("source_size")) / block)).cast("long"))
    up_to = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = wanted.withColumn("hi", F.sum("need").over(up_to)).withColumn("slots", F.sum("need").over(Window.partitionBy()))
    edge = lambda c: F.floor(c / F.col("slots") * float(_POINTS)).cast("long")
    wanted = materialise(
        wanted.select("s", "source_size", "goal", "nb", "need", edge(F.col("hi") - F.col("need")).alias("lo"), edge(F.col("hi")).alias("hi"), "slots"), "sources"
    )
    slots = wanted.agg(F.max("slots")).first()[0] or 0
    cells = wanted.where("hi > lo").select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / _CELL), F.floor((F.col("hi") - 1) / _CELL))).alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(_POINTS)) * _STEP, F.lit(_POINTS))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") / _CELL))
    owned = drawn.join(cells, "cell").where("x >= lo and x < hi").select("slot", "s").withColumn("o", F.col("slot") * F.lit(((1 << 63) - 1) // max(1, slots)))
    numbered = materialise(ranked(owned, ["s"], "o", ["slot"]).select("slot", "s", "rank"), "slots")
    given = numbered.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(given, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    late = short.select(F.lit(None).cast("long").alias("slot"), "s", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank"))
    ranks = numbered.unionByName(late).join(wanted.select("s", "source_size", "goal", "nb", "need"), "s").where("rank < need")
    which = F.floor(F.col("rank") / F.col("nb"))
    at = F.pmod(F.col("rank"), F.col("nb"))
    room = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    done = F.col("pass") * F.col("source_size") + F.col("block") * block
    return (
        ranks.withColumn("pass", which)
        .withColumn("block", at)
        .select("slot", "s", "pass", "block", F.greatest(F.lit(0), F.least(room, F.col("goal") - done)).cast("long").alias("words"))
        .where("words > 0")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, more ...): a row per row of ``docs``."""
    spark = docs.sparkSession
    sized = materialise(sizes(docs, id_col, text_col, source_col, more), "sizes")
    goals = materialise(targets(sized), "targets")
    keyed = sized.join(goals.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).select("doc_id", "s", "size", "h", "x", "source_size", "target", *more)
    tape = materialise(running(keyed, ["s"], "h", ["doc_id", "x"], F.col("size"), "at"), "tape")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = tape.where("size > 0").select("s", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.col("block") * block
    pieces = pieces.select("s", "at", "block", F.greatest(F.col("at") - begin, F.lit(0)).alias("a"), F.least(F.col("at") + F.col("size") - begin, F.lit(block)).alias("b"))
    takes = schedule(spark, goals, block).select("s", "block", "words")
    got = pieces.join(takes, ["s", "block"]).groupBy("s", "at").agg(F.sum(F.greatest(F.least("b", "words") - F.col("a"), F.lit(0))).alias("taken"))
    # only rows without words share their place on a tape
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0)
    return tape.join(got, ["s", "at"], "left").select(
        F.col("doc_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), *more
    )


ORACLE = """
WITH w AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM w GROUP BY source),
l AS (SELECT *, CASE s % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt, n * 2.0::DOUBLE AS cap,
      sum(n) OVER () * 1.5::DOUBLE AS total FROM g),
v AS (SELECT *, row_number() OVER (ORDER BY cap / wt, s) AS k,
      (total - coalesce(sum(cap) OVER (ORDER BY cap / wt, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(wt) OVER (ORDER BY cap / wt, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, n, least(cap, coalesce(wt * (SELECT arg_min(level, k) FROM v WHERE cap > wt * level), cap)) AS target FROM v),
o AS (SELECT w.*, t.n, t.target, floor(t.target)::BIGINT AS goal,
      coalesce(sum(size) OVER (PARTITION BY w.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
      FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
       CASE WHEN n = 0 THEN 0 ELSE size * (goal // n) + greatest(0, least(size, goal - n * (goal // n) - at_)) END::BIGINT AS taken FROM o
"""
