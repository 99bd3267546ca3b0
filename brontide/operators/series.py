"""Ordered work within series, of which one may hold a third of all rows.

A window function puts a whole series into one task.  Here a series is cut into
periods; windows run inside a period, and what must pass from one period to the
next is one row a series and period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import bucket
from ..shared import written

DAY = 86_400 * 1_000_000_000
PERIOD = 7 * DAY


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def neighbours(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", ties: Sequence[str] = (), take: Sequence[str] = ("value",), period: int = PERIOD, back: str | None = "_prev", ahead: str | None = None
) -> DataFrame:
    """Adds the row before (``back``) and after (``ahead``) each row of its series, as structs of ``ts`` and ``take``; null at the ends."""
    row, at = F.struct(ts, *take), F.struct(ts, *ties)
    part = df.withColumn("_p", bucket(F.col(ts), period))
    inside = Window.partitionBy(*keys, "_p").orderBy(ts, *ties)
    out = part
    if back:
        out = out.withColumn(back, F.lag(row).over(inside))
    if ahead:
        out = out.withColumn(ahead, F.lead(row).over(inside))
    ends = part.groupBy(*keys, "_p").agg(F.max_by(row, at).alias("_e"), F.min_by(row, at).alias("_f"))
    across = Window.partitionBy(*keys).orderBy("_p")
    carry = ends.select(*keys, "_p", F.lag("_e").over(across).alias("_c"), F.lead("_f").over(across).alias("_d"))
    both = out.alias("a").join(carry.alias("b"), _same([*keys, "_p"]))
    made = {back: "_c", ahead: "_d"}
    return both.select(*[F.col(f"a.{c}") for c in df.columns], *[F.coalesce(f"a.{c}", f"b.{made[c]}").alias(c) for c in (back, ahead) if c])


def running(df: DataFrame, keys: Sequence[str], value: Column, name: str, ts: str = "ts", ties: Sequence[str] = (), period: int = PERIOD) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the series up to and with each row."""
    part = df.withColumn("_p", bucket(F.col(ts), period)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_p").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*keys, "_p").agg(F.sum("_v").alias("_n")).select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    both = part.withColumn("_l", F.sum("_v").over(inside)).alias("a").join(sums.alias("b"), _same([*keys, "_p"]))
    return both.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._l") + F.col("b._o")).alias(name))


def placed(counts: DataFrame, keys: Sequence[str], order: str, count: str) -> DataFrame:
    """Adds ``_before`` and ``_all``: the sums of ``count`` over the rows of the key with smaller ``order``, and over all of them.

    Rows are dealt to ranges of (keys, order) of about equal size and written once;
    sums pass from range to range as one row each, so even a single key is spread.
    """
    part = written(counts.repartitionByRange(*keys, order).withColumn("_b", F.spark_partition_id()), "ranges")
    sums = part.groupBy(*keys, "_b").agg(F.sum(count).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_l", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    both = local.alias("a").join(sums.alias("b"), _same([*keys, "_b"]))
    return both.select(*[F.col(f"a.{c}") for c in counts.columns], (F.col("a._l") + F.col("b._o")).alias("_before"), F.col("b._all"))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "percentile") -> DataFrame:
    """(keys, name): ``sorted[round(p / 100 * (n - 1))]`` of each key, exact; p outside (0, 100] counts as 95; nulls do not count.

    Equal values are counted first; no key's values are ever gathered in one place.
    """
    p = p if 0 < p <= 100 else 95.0
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    rank = F.round(F.lit(p / 100.0) * (F.col("_all") - 1)).cast("long")
    hit = placed(counts, keys, "_x", "_c").where((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")))
    return hit.select(*keys, F.col("_x").alias(name))


def exponential_average(df: DataFrame, keys: Sequence[str], alpha: float, value: str = "value", ts: str = "ts", ties: Sequence[str] = (), block: int = 256) -> DataFrame:
    """Adds ``k`` (from 1) and ``ema``, from the first value of each series.

    A series is cut into blocks of rows; a block's last average is a straight line in
    the one before it, so blocks are averaged apart from 0 and joined by one number each.
    """
    numbered = running(df, keys, F.lit(1), "k", ts, ties).withColumn("_b", F.floor((F.col("k") - 1) / block))
    first = numbered.where("k = 1").select(*keys, F.col(value).alias("_first"))
    own = numbered.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("k", F.col(value).alias("v")))).alias("_s"))
    step = lambda acc, x: F.concat(acc, F.array(F.lit(alpha) * x["v"] + F.lit(1 - alpha) * F.element_at(acc, -1)))
    own = own.withColumn("_e", F.slice(F.aggregate("_s", F.array(F.lit(0.0)), step), 2, F.size("_s")))
    # the average before each block, from what every earlier block adds
    ends = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", F.size("_s").alias("n"), F.element_at("_e", -1).alias("e")))).alias("_z")).join(first, list(keys))
    fold = lambda acc, x: F.concat(acc, F.array(x["e"] + F.pow(F.lit(1 - alpha), x["n"]) * F.element_at(acc, -1)))
    starts = ends.select(*keys, F.posexplode(F.aggregate("_z", F.array(F.col("_first").cast("double")), fold)).alias("_b", "_start"))
    each = own.join(starts, [*keys, "_b"]).select(*keys, "_start", F.posexplode(F.arrays_zip("_s", "_e")).alias("_i", "_r"))
    return each.select(*keys, F.col("_r._s.k").cast("long").alias("k"), (F.col("_r._e") + F.pow(F.lit(1 - alpha), F.col("_i") + 1) * F.col("_start")).alias("ema"))


def in_blocks(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], before: int, after: int, block: int = 1 << 16) -> DataFrame:
    """The rows with ``_n`` (their number in the series), ``_block`` and ``_own``, for windows of ``before`` rows back and ``after`` ahead.

    A series is cut into blocks of rows; rows near a block's edges are copied to the next
    block (``_own`` false), so a window over (keys, _block) sees all that its own rows reach.
    """
    numbered = running(df, keys, F.lit(1), "_n", ts, ties)
    at, b = (F.col("_n") - 1) % block, F.floor((F.col("_n") - 1) / block)
    copy = lambda where, to: F.when(where, F.struct(to.cast("long").alias("b"), F.lit(False).alias("o")))
    places = F.array(F.struct(b.cast("long").alias("b"), F.lit(True).alias("o")), copy((at < after) & (b > 0), b - 1), copy(at >= block - before, b + 1))
    return numbered.withColumn("_z", F.explode(F.filter(places, lambda x: x.isNotNull()))).withColumns({"_block": F.col("_z.b"), "_own": F.col("_z.o")}).drop("_z")


def known_around(df: DataFrame, keys: Sequence[str], ts: str, value: str, period: int = PERIOD) -> DataFrame:
    """Adds ``_a`` and ``_b``: time and value (t, v) of the last known row up to each row and of the first one from it on; nulls are unknown."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    part = df.withColumn("_p", bucket(F.col(ts), period)).withColumn("_k", known)
    inside = Window.partitionBy(*keys, "_p").orderBy(ts)
    out = part.withColumn("_a", F.last("_k", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_b", F.first("_k", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    ends = part.groupBy(*keys, "_p").agg(F.max_by("_k", F.when(F.col("_k").isNotNull(), F.col(ts))).alias("_e"), F.min_by("_k", F.when(F.col("_k").isNotNull(), F.col(ts))).alias("_f"))
    across = Window.partitionBy(*keys).orderBy("_p")
    carry = ends.select(
        *keys, "_p", F.last("_e", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_c"), F.first("_f", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_d")
    )
    both = out.alias("a").join(carry.alias("b"), _same([*keys, "_p"]))
    return both.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce("a._a", "b._c").alias("_a"), F.coalesce("a._b", "b._d").alias("_b"))
