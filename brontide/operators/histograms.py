"""Exponential, classic and equi-depth histograms; mergeable sketches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import placed


def exponential_index(v: Column, schema: int) -> Column:
    """Bucket i holds base**(i - 1) < |v| <= base**i, base = 2 ** (2 ** -schema)."""
    return F.ceil(F.round(F.log2(F.abs(v)) * float(2**schema), 9)).cast("int")


def exponential(df: DataFrame, keys: Sequence[str], value: str = "value", schema: int = 3) -> DataFrame:
    """Sparse histogram rows (keys, sign, idx, cnt); zeros have sign 0 and idx 0."""
    v = F.col(value)
    sign = F.signum(v).cast("int")
    idx = F.when(v == 0, 0).otherwise(exponential_index(v, schema))
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, sign.alias("sign"), idx.alias("idx")).agg(F.count(F.lit(1)).alias("cnt"))


def merged(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms of one schema add up bucket by bucket."""
    return histograms.groupBy(*keys, "sign", "idx").agg(F.sum("cnt").alias("cnt"))


def exponential_quantile(histogram: DataFrame, keys: Sequence[str], q: float, schema: int = 3) -> DataFrame:
    """Midpoint of the bucket that holds the rank; negative buckets come first."""
    base = 2 ** (2.0**-schema)
    mid = F.col("sign") * (F.pow(F.lit(base), F.col("idx")) + F.pow(F.lit(base), F.col("idx") - 1)) / 2
    placed = histogram.withColumn("mid", F.when(F.col("sign") == 0, 0.0).otherwise(mid))
    up = Window.partitionBy(*keys).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("cnt").over(Window.partitionBy(*keys))
    ranked = placed.withColumn("_c", F.sum("cnt").over(up)).withColumn("_n", total).where(F.col("_c") >= q * F.col("_n"))
    return ranked.groupBy(*keys).agg(F.min("mid").alias("quantile"))


def fraction(histogram: DataFrame, keys: Sequence[str], low: float, high: float, schema: int = 3) -> DataFrame:
    """Share of the observations in positive buckets that lie whole within [low, high]."""
    base = 2 ** (2.0**-schema)
    inside = (F.col("sign") == 1) & (F.pow(F.lit(base), F.col("idx") - 1) >= low) & (F.pow(F.lit(base), F.col("idx")) <= high)
    return histogram.groupBy(*keys).agg((F.sum(F.when(inside, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("fraction"))


def native_count(buckets: Column) -> Column:
    """Observations of a native histogram, an array of structs (sign, idx, cnt)."""
    return F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + b["cnt"])


def _middle(b: Column, schema: int) -> Column:
    base = F.lit(2 ** (2.0**-schema))
    return F.when(b["sign"] == 0, 0.0).otherwise(b["sign"] * (F.pow(base, b["idx"]) + F.pow(base, b["idx"] - 1)) / 2)


def native_sum(buckets: Column, schema: int = 3) -> Column:
    """The sum of a native histogram's observations, each taken at the middle of its bucket."""
    return F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + b["cnt"] * _middle(b, schema))


def native_avg(buckets: Column, schema: int = 3) -> Column:
    n = native_count(buckets)
    return F.when(n > 0, native_sum(buckets, schema) / n).otherwise(F.lit(float("nan")))


def native_fraction(buckets: Column, low: float, high: float, schema: int = 3) -> Column:
    """Share of the observations in positive buckets that lie whole within [low, high]."""
    base, n = F.lit(2 ** (2.0**-schema)), native_count(buckets)
    inside = lambda b: (b["sign"] == 1) & (F.pow(base, b["idx"] - 1) >= low) & (F.pow(base, b["idx"]) <= high)
    hit = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.when(inside(b), b["cnt"]).otherwise(0.0))
    return F.when(n > 0, hit / n).otherwise(F.lit(float("nan")))


def classic_to_native(classic_rows: DataFrame, keys: Sequence[str], schema: int = 3) -> DataFrame:
    """(keys, sign, idx, cnt) from cumulative classic buckets (keys, le, cnt): each bucket's own count at its upper bound's index; +Inf is left out."""
    up = Window.partitionBy(*keys).orderBy("le")
    own = classic_rows.withColumn("_n", F.col("cnt") - F.coalesce(F.lag("cnt").over(up), F.lit(0)))
    kept = own.where((F.col("_n") > 0) & (F.col("le") > 0) & (F.col("le") < float("inf")))
    return kept.groupBy(*keys, F.lit(1).alias("sign"), exponential_index(F.col("le"), schema).alias("idx")).agg(F.sum("_n").alias("cnt"))


def range_count(depth: DataFrame, low: float, high: float) -> DataFrame:
    """(estimate): rows with a value in [low, high], from equi-depth buckets; a bucket counts by the share of its span."""
    span = F.col("hi") - F.col("lo")
    part = F.greatest(F.least(F.col("hi"), F.lit(high)) - F.greatest(F.col("lo"), F.lit(low)), F.lit(0.0))
    share = F.when((F.col("hi") < low) | (F.col("lo") > high), 0.0).when(span > 0, part / span).otherwise(1.0)
    return depth.agg(F.sum(F.col("cnt") * share).alias("estimate"))


def merged_depth(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(bucket, lo, hi, cnt) of two equi-depth histograms together: at most 2k buckets, grouped by their upper bounds into about equal counts."""
    both = a.select("lo", "hi", "cnt").unionByName(b.select("lo", "hi", "cnt"))
    up = Window.orderBy("hi", "lo").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("cnt").over(up), F.lit(0)), F.sum("cnt").over(Window.partitionBy())
    at = both.withColumn("bucket", F.least(F.floor(before * k / total), F.lit(k - 1)))
    return at.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("cnt").alias("cnt"))


def bounds(idx: int, schema: int) -> tuple[float, float]:
    base = 2 ** (2.0**-schema)
    return base ** (idx - 1), base**idx


def classic_to_exponential(bounds_: Sequence[float], counts: Sequence[int], schema: int = 3) -> dict[int, int]:
    """Counts of classic buckets (not cumulative) by the index of their upper bound."""
    out: dict[int, int] = {}
    for le, n in zip(bounds_, counts, strict=False):
        if n and le > 0:
            i = math.ceil(round(math.log2(le) * 2**schema, 9))
            out[i] = out.get(i, 0) + n
    return out


def classic(df: DataFrame, keys: Sequence[str], edges: Sequence[float], value: str = "value") -> DataFrame:
    """Cumulative buckets (keys, le, cnt), +Inf last, in one aggregate."""
    le = [*map(float, edges), float("inf")]
    counts = [F.count_if(F.col(value) <= F.lit(x)).alias(f"b{i}") for i, x in enumerate(le)]
    wide = df.groupBy(*keys).agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"b{i}").alias("cnt")) for i, x in enumerate(le)])).alias("_b")
    return wide.select(*keys, rows).select(*keys, "_b.le", "_b.cnt")


def equi_depth(df: DataFrame, k: int, value: str = "value", tie: str | None = None) -> DataFrame:
    """(bucket, lo, hi, cnt, distinct_values): n div k rows a bucket, the last takes the rest.

    Ranks come from counts of distinct values, placed range by range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    at_ = placed(counts.withColumn("_one", F.lit(0)), ["_one"], "v", "c")
    at_ = at_.select("v", "c", F.col("_before").alias("lo"), (F.col("_before") + F.col("c")).alias("hi"), F.col("_all").alias("n"))
    depth = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    at = lambda r: F.least(F.floor(r / depth), F.lit(k - 1))
    parts = at_.withColumn("depth", depth).withColumn("bucket", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi") - 1))))
    begin = F.col("bucket") * F.col("depth")
    end = F.when(F.col("bucket") == k - 1, F.col("n")).otherwise(begin + F.col("depth"))
    share = F.least(F.col("hi"), end) - F.greatest(F.col("lo"), begin)
    return parts.groupBy("bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(share).alias("cnt"), F.count(F.lit(1)).alias("distinct_values"))


def distinct_sketch(df: DataFrame, keys: Sequence[str], column: str, precision: int = 12) -> DataFrame:
    """Mergeable HyperLogLog sketches; ``distinct_estimate`` reads any union of them."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def distinct_estimate(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
