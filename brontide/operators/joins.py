"""Joins over time: as-of, range, windowed, enrichment, training sets, vector matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import bucket
from ..shared import written

DAY = 86_400 * 1_000_000_000


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], take: list[str], ts: str = "ts", right_ts: str = "ts", tolerance: int | None = None, tie: str | None = None, period: int = 30 * DAY, inclusive: bool = True
) -> DataFrame:
    """The latest right row at or before each left row, per key; nulls where none lies within ``tolerance``.

    Both sides are tagged, united and scanned once in time order.  A key may hold
    a third of all rows, so the window runs within one ``period`` of a key only and
    starts from the last right row of earlier periods (one row a key and period).
    ``take`` columns become right_<name>; ties in the right time go to the largest ``tie``.
    """
    order = F.col(tie) if tie else F.lit(0)
    payload = F.struct(F.col(right_ts).alias("t"), order.alias("o"), *[F.col(c).alias(c) for c in take])
    at_right = F.lit(0 if inclusive else 1)
    r = right.select(*keys, F.col(right_ts).alias("_t"), at_right.alias("_side"), order.cast("long").alias("_o"), payload.alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    side = F.lit(1 if inclusive else 0)
    kind = r.schema["_r"].dataType
    rows = left.select(*keys, F.col(ts).alias("_t"), side.alias("_side"), F.lit(0).cast("long").alias("_o"), F.lit(None).cast(kind).alias("_r"), F.struct(*left.columns).alias("_l"))
    both = rows.unionByName(r).withColumn("_p", bucket(F.col("_t"), period))
    inside = Window.partitionBy(*keys, "_p").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(inside)).where("_l is not null")
    # what earlier periods leave: one row per key and period
    ends = right.groupBy(*keys, bucket(F.col(right_ts), period).alias("_p")).agg(F.max_by(payload, F.struct(F.col(right_ts), order)).alias("_e"))
    periods = left.select(*keys, bucket(F.col(ts), period).alias("_p")).distinct().withColumn("_e", F.lit(None).cast(kind)).withColumn("_w", F.lit(0))
    carried = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        ends.withColumn("_w", F.lit(1)).unionByName(periods).groupBy(*keys, "_p").agg(F.max("_e").alias("_e"))
        .withColumn("_c", F.last("_e", ignorenulls=True).over(carried)).select(*keys, "_p", "_c")
    )
    same = F.col("a._p") == F.col("b._p")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = found.alias("a").join(carry.alias("b"), same, "left").select("a._l", "a._t", F.coalesce("a._m", "b._c").alias("_m"))
    if tolerance is not None:
        joined = joined.withColumn("_m", F.when(F.col("_t") - F.col("_m.t") <= tolerance, F.col("_m")))
    return joined.select("_l.*", F.col("_m.t").alias(f"right_{right_ts}"), *[F.col(f"_m.{c}").alias(f"right_{c}") for c in take])


def within(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner", ts: str = "ts") -> DataFrame:
    """Pairs with equal keys at most ``width`` apart in time; columns get l_ and r_.  Without keys only time counts.

    The left side is copied to the three windows of ``width`` that can hold a
    partner, which makes an equi-join of the range condition.
    """
    if width <= 0:
        raise ValueError("the width must be positive")
    l = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    lkeys, rkeys = l.columns, r.columns
    if how != "inner":  # numbered and written once, so that rows without partner are found by number and pairs are formed once
        l, r = (written(side.withColumn(name, F.monotonically_increasing_id()), "side") for side, name in ((l, "_l"), (r, "_r")))
    at = F.floor(F.col(f"l_{ts}") / width)
    spread = l.withColumn("_b", F.explode(F.sequence(at - 1, at + 1)))
    cells = r.withColumn("_b", F.floor(F.col(f"r_{ts}") / width))
    on = (spread["_b"] == cells["_b"]) & (F.abs(F.col(f"l_{ts}") - F.col(f"r_{ts}")) <= width)
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    pairs = spread.join(cells, on).drop("_b")
    if how == "inner":
        return pairs
    pairs = written(pairs, "pairs")
    none = lambda df, prefix: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c.startswith(prefix)]
    out = pairs.select(*lkeys, *rkeys)
    if how in ("left", "full"):
        out = out.unionByName(l.join(pairs.select("_l"), "_l", "left_anti").select(*lkeys, *none(r, "r_")))
    if how in ("right", "full"):
        out = out.unionByName(r.join(pairs.select("_r"), "_r", "left_anti").select(*none(l, "l_"), *rkeys))
    return out


def enrich(points: DataFrame, lookup: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", name: str = "lookup", ttl: int | None = None) -> DataFrame:
    """The latest value of the lookup series per key as a text tag with four decimals; with ``ttl`` only where it is no older than that at the point's time."""
    latest = lookup.groupBy(*keys).agg(F.max_by(value, ts).alias("_v"), F.max(ts).alias("_at"))
    found = F.when(F.col("_v").isNotNull(), F.format_string("%.4f", "_v"))
    if ttl is not None:
        found = F.when(F.col(ts) - F.col("_at") <= ttl, found)
    return points.join(latest, keys, "left").withColumn(name, found).drop("_v", "_at")


def training_set(spine: DataFrame, features: dict[str, DataFrame], entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    """Each feature's value at or before each (entity, time); rows without any feature go."""
    out = spine
    for name, table in features.items():
        out = asof(out, table, [entity], ["value"], ts, "ts").drop("right_ts").withColumnRenamed("right_value", name)
    return out.where(F.coalesce(*[F.col(n) for n in features]).isNotNull())


def correlate(metrics: DataFrame, traces: DataFrame, by: list[str], width: int | None = None, limit: int = 100, ts: str = "ts") -> DataFrame:
    """Rows of both signals that share ``by``, and lie within ``width`` if given; l_ and r_ columns, the first ``limit`` by time and all other columns."""
    if width is None:
        l = metrics.select([F.col(c).alias(f"l_{c}") for c in metrics.columns])
        r = traces.select([F.col(c).alias(f"r_{c}") for c in traces.columns])
        out = l.join(r, [F.col(f"l_{k}") == F.col(f"r_{k}") for k in by])
    else:
        out = within(metrics, traces, by, width)
    return out.orderBy(f"l_{ts}", f"r_{ts}", *out.columns).limit(limit) if limit else out
