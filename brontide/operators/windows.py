"""Windows in batch: buckets, gap filling, calendar alignment, sessions, counts, row frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import bucket
from .series import in_blocks, known_around, neighbours, running


def tumbling(ts: Column, size: int) -> Column:
    return bucket(ts, size)


def hopping(ts: Column, size: int, slide: int) -> Column:
    """All window starts, multiples of ``slide``, whose window holds ``ts``; to be exploded."""
    last = bucket(ts, slide)
    n = -(-size // slide)
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: last - k.cast("long") * slide)
    return F.filter(starts, lambda s: s + size > ts)


def calendar(ts: Column, unit: str, zone: str = "UTC") -> Column:
    """Start of the calendar unit in a time zone, as nanoseconds."""
    local = F.from_utc_timestamp(F.timestamp_micros(F.floor(ts / 1000).cast("long")), zone)
    return F.unix_micros(F.to_utc_timestamp(F.date_trunc(unit, local), zone)) * 1000


def gap_fill(df: DataFrame, keys: Sequence[str], width: int, value: str = "value", ts: str = "bucket", method: str = "linear", max_gap: int | None = None) -> DataFrame:
    """One row per window of each key between its first and last, with the missing values filled.

    linear, previous, zero or null; gaps longer than ``max_gap`` stay null.  The rows
    that are missing are made from each row and its successor, so no grid is joined.
    """
    linked = neighbours(df, keys, ts, take=(value,), back=None, ahead="_next")
    known = linked.select(*keys, F.col(ts).alias("_t"), F.col(value).alias("_v"), F.col(f"_next.{ts}").alias("_n"), F.col(f"_next.{value}").alias("_w"))
    last = F.when(F.col("_n").isNull(), F.col("_t")).otherwise(F.col("_n") - width)
    rows = known.withColumn(ts, F.explode(F.sequence("_t", F.greatest(last, F.col("_t")), F.lit(width))))
    gap = F.col("_n") - F.col("_t")
    filled = {
        "linear": F.col("_v") + (F.col("_w") - F.col("_v")) * (F.col(ts) - F.col("_t")) / gap,
        "previous": F.col("_v"),
        "zero": F.lit(0.0),
        "null": F.lit(None).cast("double"),
    }[method]
    if max_gap is not None:
        filled = F.when(gap <= max_gap, filled)
    own = F.col(ts) == F.col("_t")
    return rows.select(*keys, ts, F.when(own, F.col("_v")).otherwise(filled).alias(value), (~own).alias("filled"))


def sessions(df: DataFrame, keys: Sequence[str], gap: int, ts: str = "ts") -> DataFrame:
    """Adds ``session`` (numbered from 0 per key): a new one where more than ``gap`` passes."""
    linked = neighbours(df, keys, ts, take=(), back="_prev")
    new = F.when(F.col(ts) - F.col(f"_prev.{ts}") > gap, 1).otherwise(0)
    # of rows of one time the one after the gap comes first
    marked = linked.withColumn("_new", new).withColumn("_late", -F.col("_new"))
    return running(marked, keys, F.col("_new"), "session", ts, ["_late"]).drop("_new", "_late", "_prev")


def count_windows(df: DataFrame, keys: Sequence[str], size: int, order: Sequence[str]) -> DataFrame:
    """Adds ``window_no``: every ``size`` rows of a key are one window."""
    return running(df, keys, F.lit(1), "_n", order[0], order[1:]).withColumn("window_no", F.floor((F.col("_n") - 1) / size)).drop("_n")


def centred(function: Column, keys: Sequence[str], half: int, ts: str = "ts") -> Column:
    """An aggregate over the rows of the key at most ``half`` before or after in time."""
    return function.over(Window.partitionBy(*keys).orderBy(ts).rangeBetween(-half, half))


def cumulative(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``total`` and ``n``: the sum and count of the key's rows so far, in periods (see ``series``)."""
    return running(running(df, keys, F.col(value), "total", ts, ties), keys, F.lit(1), "n", ts, ties)


def fresh(df: DataFrame, keys: Sequence[str], lookback: int, at: int | None = None, ts: str = "ts") -> DataFrame:
    """Rows at most ``lookback`` older than ``at``, or than the key's newest row: what is not stale."""
    if at is not None:
        return df.where((F.col(ts) > at - lookback) & (F.col(ts) <= at))
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    return df.join(newest, list(keys)).where(F.col(ts) >= F.col("_newest") - lookback).drop("_newest")


def fence_events(df: DataFrame, keys: Sequence[str], inside: Column, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Rows where a key enters or leaves an area, with ``event``; before its first row a key is outside."""
    linked = neighbours(df.withColumn("_in", inside), keys, ts, ties, ["_in"])
    turned = linked.where(F.col("_in") != F.coalesce(F.col("_prev._in"), F.lit(False)))
    return turned.withColumn("event", F.when(F.col("_in"), "enter").otherwise("exit")).drop("_in", "_prev")


def moving(function: Column, keys: Sequence[str], order: Sequence[str], rows: int) -> Column:
    """An aggregate over the row and the ``rows - 1`` before it, fewer at a key's start."""
    return function.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0))


def interpolated(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "bucket") -> DataFrame:
    """Nulls become the straight line between the known neighbours; at the ends they stay."""
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col(ts) - a["t"]) / F.when(b["t"] > a["t"], b["t"] - a["t"])
    return known_around(df, keys, ts, value).withColumn(value, F.coalesce(F.col(value), line)).drop("_a", "_b")


def changepoints(df: DataFrame, keys: Sequence[str], half: int, threshold: float, value: str = "value", ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Rows where the slopes over the ``half`` rows before and after differ by more than the threshold."""
    order = Window.partitionBy(*keys, "_block").orderBy("_n")
    numbered = in_blocks(df, keys, ts, ties, half, half).withColumn("_x", F.col("_n").cast("double"))
    slope = lambda a, b: F.regr_slope(value, "_x").over(order.rowsBetween(a, b))
    out = numbered.withColumn("slope_before", slope(-half + 1, 0)).withColumn("slope_after", slope(1, half)).where("_own")
    return out.where(F.abs(F.col("slope_after") - F.col("slope_before")) > threshold).drop("_n", "_x", "_block", "_own")
