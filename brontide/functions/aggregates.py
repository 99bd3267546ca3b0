"""Aggregate functions of the dialects, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NS


def first(v: Column, order: Column) -> Column:
    return F.min_by(v, order)


def last(v: Column, order: Column) -> Column:
    return F.max_by(v, order)


def plain_rate(v: Column, ts: Column, order: Column) -> Column:
    """(last - first) per second; 0 where no time passes.  Counter resets are not handled here."""
    span = (F.max(ts) - F.min(ts)) / F.lit(float(NS))
    return F.when(span > 0, (last(v, order) - first(v, order)) / span).otherwise(F.lit(0.0))


def sample_stddev(v: Column) -> Column:
    """0 where fewer than two values."""
    return F.coalesce(F.stddev_samp(v), F.lit(0.0))


def samples(v: Column, ts: Column) -> Column:
    """The window's samples in time order, as structs (t, v); NaN values are no samples.  For what cannot be done in one pass."""
    return F.array_sort(F.collect_list(F.when(~F.isnan(v), F.struct(ts.alias("t"), v.alias("v")))))


@dataclass(frozen=True)
class Steps:
    """Aggregates over samples that know the sample before them (``operators.series.neighbours``), in plain sums, minima and maxima.

    ``low``: the sample before counts only if it is later than this (the window's open start).
    """

    v: Column
    ts: Column
    before: Column
    """The value of the sample before, null at a series' start."""
    before_ts: Column
    low: Column | None = None
    tie: Column | None = None

    @property
    def _known(self) -> Column:
        known = self.before_ts.isNotNull()
        return known if self.low is None else known & (self.before_ts > self.low)

    @property
    def _at(self) -> Column:
        return self.ts if self.tie is None else F.struct(self.ts, self.tie)

    @property
    def _span(self) -> Column:
        return (F.max(self.ts) - F.min(self.ts)) / F.lit(float(NS))

    def delta(self) -> Column:
        return F.when(F.count(self.v) >= 2, F.max_by(self.v, self._at) - F.min_by(self.v, self._at))

    def counter_delta(self) -> Column:
        """last - first plus what each reset dropped, never below 0."""
        dropped = F.sum(F.when(self._known & (self.v < self.before), self.before).otherwise(0.0))
        return F.greatest(F.max_by(self.v, self._at) - F.min_by(self.v, self._at) + dropped, F.lit(0.0))

    def rate(self) -> Column:
        """Counter-aware increase per second; null with fewer than two samples."""
        return F.when((F.count(self.v) >= 2) & (self._span > 0), self.counter_delta() / self._span)

    def increase(self, window: int) -> Column:
        """The increase extrapolated to the edges: by one mean step, at most to 1.1 times the window."""
        grown = F.least(self._span + self._span / (F.count(self.v) - 1), F.lit(1.1 * window / NS))
        return F.when((F.count(self.v) >= 2) & (self._span > 0), self.counter_delta() * grown / self._span)

    def _last(self, c: Column) -> Column:
        return F.max_by(F.when(self._known, c), self._at)

    def irate(self) -> Column:
        step = F.when(self.v >= self.before, self.v - self.before).otherwise(self.v)
        return self._last(step / ((self.ts - self.before_ts) / F.lit(float(NS))))

    def idelta(self) -> Column:
        return self._last(self.v - self.before)

    def changes(self) -> Column:
        return F.count_if(self._known & (self.v != self.before)).cast("double")

    def resets(self) -> Column:
        return F.count_if(self._known & (self.v < self.before)).cast("double")


def slope(v: Column, ts: Column, origin: Column | int) -> Column:
    """Least squares slope per second; times are taken from ``origin`` so that nothing cancels."""
    x = (ts - origin) / F.lit(float(NS))
    return F.regr_slope(v, x)


def predict_linear(v: Column, ts: Column, origin: Column | int, seconds: float) -> Column:
    """The least squares line at ``origin`` plus ``seconds``."""
    x = (ts - origin) / F.lit(float(NS))
    return F.regr_intercept(v, x) + F.regr_slope(v, x) * F.lit(seconds)


def holt_winters(s: Column, sf: float, tf: float) -> Column:
    """Double exponential smoothing: level plus trend after the last sample; null unless both factors lie in (0, 1)."""
    if not (0 < sf < 1 and 0 < tf < 1):
        return F.lit(None).cast("double")
    start = F.struct(F.element_at(s, 1)["v"].alias("level"), (F.element_at(s, 2)["v"] - F.element_at(s, 1)["v"]).alias("trend"))

    def step(acc: Column, x: Column) -> Column:
        level = F.lit(sf) * x["v"] + F.lit(1 - sf) * (acc["level"] + acc["trend"])
        return F.struct(level.alias("level"), (F.lit(tf) * (level - acc["level"]) + F.lit(1 - tf) * acc["trend"]).alias("trend"))

    end = F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), start, step)
    return F.when(F.size(s) >= 2, end["level"] + end["trend"])


def bucket_quantile(q: float, buckets: Column) -> Column:
    """Quantile of classic cumulative buckets, an array of structs (le, cnt) in ``le`` order with +Inf last.

    Linear within a bucket, from the bound before (0 at first); the last finite
    bound where the rank falls beyond it; null without observations.
    """
    total = F.element_at(buckets, -1)["cnt"]
    rank = F.lit(q) * total
    index = F.size(F.filter(buckets, lambda b: b["cnt"] < rank)) + 1
    hit, finite = F.element_at(buckets, index), F.element_at(F.filter(buckets, lambda b: b["le"] < F.lit(float("inf"))), -1)["le"]
    before = F.when(index > 1, F.element_at(buckets, F.greatest(index - 1, F.lit(1))))
    low, below = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["cnt"], F.lit(0))
    inside = low + (hit["le"] - low) * (rank - below) / F.greatest(hit["cnt"] - below, F.lit(1))
    return F.when(total > 0, F.when(F.lit(q) <= 0, 0.0).when((F.lit(q) >= 1) | (hit["le"] == float("inf")), finite).otherwise(inside))


def product(v: Column) -> Column:
    return F.product(v)
