"""Chat formatting of preference pairs (DataFrame operations only).

Turns are compared position by position: the longest common prefix of the chosen
and the rejected conversation (same role and text) is rendered once as the
prompt, what follows in either becomes a completion.  The mask of a completion
has one digit per turn, 1 where an assistant speaks (trained on), else 0; the
prompt is never trained on.

Prefix lengths come from a join on (pair, position) and an aggregate; texts are
gathered per conversation only to be rendered, which is the output row itself.

``neighbours`` makes pairs of conversations with the same first turn (in a hashed
order, two-level ranks, so a first turn that a third of all conversations share
is spread); those left over, at most one per first turn, are paired with each
other.

Defined cases: null text or role counts as empty; turns are ordered by ``turn``,
then role, then text; equal conversations have empty completions; a conversation
without partner (the last of an odd number) is in no pair; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranked, spread, spread_join


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, p, role, text): the turns of each conversation, numbered from 0."""
    empty = F.lit("")
    slim = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("t", "role", "text")) - 1
    return slim.where("c is not null").select("c", place.alias("p"), "role", "text")


def neighbours(numbered: DataFrame) -> DataFrame:
    """(chosen, rejected): conversations with equal first turns, two by two, then the ones left over."""
    firsts = numbered.where("p = 0").select("c", F.md5(F.concat_ws("\n", "role", "text")).alias("first"), spread(F.col("c")).alias("h"))
    placed = materialise(ranked(firsts, ["first"], "h", ["c"]), "firsts")
    counts = placed.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    placed = spread_join(placed, counts, "first", "c").withColumn("alone", (F.col("rank") == F.col("n") - 1) & (F.col("n") % 2 == 1))
    inside = placed.where("not alone").select("first", F.floor(F.col("rank") / 2).alias("k"), "rank", "c")
    single = placed.where("alone").select("c", (F.conv(F.substring("first", 1, 15), 16, 10).cast("long") * 8).alias("h"))
    outside = ranked(materialise(single, "single"), [], "h", ["c"]).select(F.lit("").alias("first"), F.floor(F.col("rank") / 2).alias("k"), "rank", "c")
    every = inside.unionByName(outside).groupBy("first", "k").agg(F.min_by("c", "rank").alias("chosen"), F.max_by("c", "rank").alias("rejected"), F.count(F.lit(1)).alias("n"))
    return every.where("n = 2").select("chosen", "rejected")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preferences(numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per pair: prefix length, prompt, completions with their masks, and characters trained on."""
    left = pairs.join(numbered, F.col("chosen") == F.col("c")).drop("c")
    right = pairs.join(numbered, F.col("rejected") == F.col("c")).drop("c")
    keys = ["chosen", "rejected", "p"]
    both = left.select(*keys, F.struct("role", "text").alias("x")).join(right.select(*keys, F.struct("role", "text").alias("y")), keys, "full")
    differ = F.when(F.col("x").eqNullSafe(F.col("y")), None).otherwise(F.col("p"))
    common = both.groupBy("chosen", "rejected").agg(F.coalesce(F.min(differ), F.max("p") + 1).cast("long").alias("n_prefix"))
    sides = left.select(*keys, "role", "text", F.lit(0).alias("side")).unionByName(right.select(*keys, "role", "text", F.lit(1).alias("side")))
    known = sides.join(common, ["chosen", "rejected"])
    own = known.groupBy("chosen", "rejected", "n_prefix", "side").agg(
        F.sort_array(F.collect_list(F.when(F.col("p") < F.col("n_prefix"), F.struct("p", _rendered(F.col("role"), F.col("text")).alias("r"))))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("p") >= F.col("n_prefix"), F.struct("p", _rendered(F.col("role"), F.col("text")).alias("r"), F.when(F.col("role") == "assistant", "1").otherwise("0").alias("m"))))).alias("tail"),
        F.sum(F.when((F.col("p") >= F.col("n_prefix")) & (F.col("role") == "assistant"), F.length("text")).otherwise(0)).alias("chars"),
    )
    text = own.select(
        "chosen", "rejected", "n_prefix", "side", F.array_join(F.col("head.r"), "").alias("prompt"), F.array_join(F.col("tail.r"), "").alias("body"), F.array_join(F.col("tail.m"), "").alias("mask"), "chars"
    )
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return text.groupBy("chosen", "rejected", "n_prefix").agg(
        pick(0, "prompt").alias("prompt"),
        pick(0, "body").alias("chosen_text"),
        pick(0, "mask").alias("chosen_mask"),
        pick(0, "chars").cast("long").alias("chosen_chars"),
        pick(1, "body").alias("rejected_text"),
        pick(1, "mask").alias("rejected_mask"),
        pick(1, "chars").cast("long").alias("rejected_chars"),
    )


def format_pairs(conversations: DataFrame) -> DataFrame:
    numbered = materialise(turns(conversations), "turns")  # read for the ranks and for both sides
    pairs = materialise(neighbours(numbered), "pairs")
    out = preferences(numbered, pairs)
    return out.withColumnsRenamed({"chosen": "chosen_id", "rejected": "rejected_id"})


ORACLE = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
           coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT c, md5(role || chr(10) || text) AS first, ('0x' || substr(md5(c::VARCHAR), 1, 15))::BIGINT AS h FROM t WHERE p = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY h, c) - 1 AS k, count(*) OVER (PARTITION BY first) AS n FROM f),
a AS (SELECT first, k // 2 AS g, k, c FROM r WHERE NOT (k = n - 1 AND n % 2 = 1)
      UNION ALL
      SELECT '' AS first, k // 2 AS g, k, c FROM (SELECT c, row_number() OVER (ORDER BY ('0x' || substr(first, 1, 15))::BIGINT, c) - 1 AS k FROM r WHERE k = n - 1 AND n % 2 = 1)),
q AS (SELECT arg_min(c, k) AS ch, arg_max(c, k) AS rj FROM a GROUP BY first, g HAVING count(*) = 2),
l AS (SELECT ch, rj, p, role, text FROM q JOIN t ON t.c = q.ch), m AS (SELECT ch, rj, p, role, text FROM q JOIN t ON t.c = q.rj),
x AS (SELECT coalesce(l.ch, m.ch) AS ch, coalesce(l.rj, m.rj) AS rj, coalesce(l.p, m.p) AS p,
      (l.role IS NOT DISTINCT FROM m.role AND l.text IS NOT DISTINCT FROM m.text) AS same
      FROM l FULL JOIN m ON l.ch = m.ch AND l.rj = m.rj AND l.p = m.p),
y AS (SELECT ch, rj, coalesce(min(p) FILTER (WHERE NOT same), max(p) + 1)::BIGINT AS n_prefix FROM x GROUP BY ch, rj),
s AS (SELECT *, 0 AS side FROM l UNION ALL SELECT *, 1 AS side FROM m),
z AS (SELECT s.*, y.n_prefix, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r,
      CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS d FROM s JOIN y ON s.ch = y.ch AND s.rj = y.rj)
SELECT ch AS chosen_id, rj AS rejected_id, n_prefix,
 coalesce(string_agg(r, '' ORDER BY p) FILTER (WHERE side = 0 AND p < n_prefix), '') AS prompt,
 coalesce(string_agg(r, '' ORDER BY p) FILTER (WHERE side = 0 AND p >= n_prefix), '') AS chosen_text,
 coalesce(string_agg(d, '' ORDER BY p) FILTER (WHERE side = 0 AND p >= n_prefix), '') AS chosen_mask,
 coalesce(sum(length(text)) FILTER (WHERE side = 0 AND p >= n_prefix AND role = 'assistant'), 0)::BIGINT AS chosen_chars,
 coalesce(string_agg(r, '' ORDER BY p) FILTER (WHERE side = 1 AND p >= n_prefix), '') AS rejected_text,
 coalesce(string_agg(d, '' ORDER BY p) FILTER (WHERE side = 1 AND p >= n_prefix), '') AS rejected_mask,
 coalesce(sum(length(text)) FILTER (WHERE side = 1 AND p >= n_prefix AND role = 'assistant'), 0)::BIGINT AS rejected_chars
FROM z GROUP BY ch, rj, n_prefix
"""
