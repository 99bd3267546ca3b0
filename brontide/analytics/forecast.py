"""Forecasts and anomalies per series.

Smoothing is sequential by nature, so each series is one group for a vectorised
pandas function; everything else is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.series import in_blocks, neighbours


def smooth(values: np.ndarray, alpha: float) -> np.ndarray:
    out = np.empty(len(values))
    level = values[0] if len(values) else 0.0
    for i, v in enumerate(values):
        level = v if i == 0 else alpha * v + (1 - alpha) * level
        out[i] = level
    return out


def holt(values: np.ndarray, alpha: float, beta: float, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, forecast); fitted is level plus trend after each value."""
    level, trend = values[0], values[1] - values[0] if len(values) > 1 else 0.0
    fitted = [level + trend]
    for v in values[1:]:
        before = level
        level = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        fitted.append(level + trend)
    return np.array(fitted), level + trend * np.arange(1, horizon + 1)


def holt_winters(values: np.ndarray, period: int, alpha: float, beta: float, gamma: float, horizon: int) -> np.ndarray:
    """Multiplicative seasons; Holt where there are fewer than two of them."""
    n = len(values)
    if n < 2 * period or np.any(values[:period] == 0):
        return holt(values, alpha, beta, horizon)[1]
    level = values[:period].mean()
    trend = (values[period : 2 * period].mean() - level) / period
    season = list(values[:period] / level)
    for i in range(period, n):
        before, s = level, season[i - period]
        level = alpha * values[i] / s + (1 - alpha) * (level + trend) if s else level + trend
        trend = beta * (level - before) + (1 - beta) * trend
        season.append(gamma * values[i] / level + (1 - gamma) * s if level else s)
    return np.array([(level + k * trend) * season[n - period + (k - 1) % period] for k in range(1, horizon + 1)])


#: The longest season looked for, the season assumed where none shows, and the autocorrelation that shows one.
LONGEST_SEASON, ASSUMED_SEASON, SHOWN = 168, 4, 0.1


def seasonal_period(values: np.ndarray, longest: int = LONGEST_SEASON) -> int:
    """The lag of the largest autocorrelation, or the assumed one where none is shown."""
    x = values - values.mean()
    total = (x * x).sum()
    if total == 0:
        return ASSUMED_SEASON
    lags = range(2, min(len(x) // 2, longest) + 1)
    best = max(((x[k:] * x[:-k]).sum() / total, -k) for k in lags) if len(lags) else (0.0, -ASSUMED_SEASON)
    return -best[1] if best[0] >= SHOWN else ASSUMED_SEASON


def trend_season(values: np.ndarray, horizon: int, z: float = 1.96) -> pd.DataFrame:
    """Straight line plus the mean residual of each phase, with a widening band."""
    n = len(values)
    t = np.arange(n)
    period = seasonal_period(values)
    season = np.array([(values[t % period == k] - values.mean()).mean() if (t % period == k).any() else 0.0 for k in range(period)])
    flat = values - season[t % period]
    slope, base = np.polyfit(t, flat, 1) if n > 1 else (0.0, flat[0])
    sigma = np.sqrt(((flat - base - slope * t) ** 2).sum() / max(n - 2, 1))
    h = np.arange(1, horizon + 1)
    at = base + slope * (n - 1 + h) + season[(n - 1 + h) % period]
    band = z * sigma * np.sqrt(1 + h / n)
    return pd.DataFrame({"step": h, "forecast": at, "low": at - band, "high": at + band})


def forecast(df: DataFrame, keys: Sequence[str], method: str = "trend_season", horizon: int = 3, value: str = "value", ts: str = "ts", **how) -> DataFrame:
    """(keys, step, forecast): each series' next values."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(ts)[value].to_numpy(float)
        if method == "simple":
            out = np.full(horizon, smooth(v, how.get("alpha", 0.3))[-1])
        elif method == "holt":
            out = holt(v, how.get("alpha", 0.3), how.get("beta", 0.1), horizon)[1]
        elif method == "holt_winters":
            out = holt_winters(v, how.get("period", 24), how.get("alpha", 0.3), how.get("beta", 0.1), how.get("gamma", 0.1), horizon)
        elif method == "moving_average":
            out = np.full(horizon, v[-how.get("window", 5) :].mean())
        else:
            out = trend_season(v, horizon)["forecast"].to_numpy()
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "step": np.arange(1, horizon + 1), "forecast": out})

    return df.groupBy(*keys).applyInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["step long", "forecast double"]))


def residual_anomalies(df: DataFrame, keys: Sequence[str], rows: int, threshold: float, value: str = "value", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows further than ``threshold`` deviations from the mean of the ``rows`` before them."""
    before = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-rows, -1)
    cut = in_blocks(df, keys, order[0], list(order[1:]), rows, 0)
    out = cut.withColumn("fitted", F.avg(value).over(before)).withColumn("spread", F.stddev_pop(value).over(before)).where("_own").drop("_n", "_block", "_own")
    return out.where((F.col("spread") > 0) & (F.abs(F.col(value) - F.col("fitted")) > threshold * F.col("spread")))


def outliers(df: DataFrame, keys: Sequence[str], value: str = "value", z: float = 3.0, fence: float = 1.5) -> DataFrame:
    """z-scores and Tukey's fences per series, joined back to the rows."""
    v = F.col(value)
    quart = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    stats = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"), quart.alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    joined = df.join(stats, list(keys))
    score = F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")).otherwise(0.0)
    out = joined.withColumn("z", score).withColumn("z_outlier", F.abs(score) > z)
    return out.withColumn("iqr_outlier", (v < low - fence * (high - low)) | (v > high + fence * (high - low))).drop("_m", "_s", "_q")


def welch(df: DataFrame, side: str, value: str = "value") -> DataFrame:
    """(mean_a, mean_b, t, cohens_d, differs) of rows with side 'a' and 'b'."""
    part = lambda f, s: f(F.when(F.col(side) == s, F.col(value)))
    stats = df.agg(*[part(f, s).alias(f"{n}_{s}") for s in "ab" for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    t = (F.col("mean_a") - F.col("mean_b")) / error
    return stats.select("mean_a", "mean_b", t.alias("t"), ((F.col("mean_a") - F.col("mean_b")) / pooled).alias("cohens_d"), (F.abs(t) > 2).alias("differs"))


def quality_issues(df: DataFrame, keys: Sequence[str], max_gap: int, value: str = "value", ts: str = "ts", sigma: float = 3.0, rows: int = 20, ties: Sequence[str] = (), skew: float | None = None) -> DataFrame:
    """(keys, ts, issue): nan, infinite, gap, duplicate and outlier rows; with ``skew`` also series (ts null) that are more skewed.

    Outliers and skew are judged on finite values only, which NaN and infinity cannot hide.
    """
    v, step = F.col(value), F.col(ts) - F.col(f"_prev.{ts}")
    linked = neighbours(df, keys, ts, ties, [])
    found = F.array(F.when(F.isnan(v), "nan"), F.when(F.abs(v) == float("inf"), "infinite"), F.when(step > max_gap, "gap"), F.when(step == 0, "duplicate"))
    out = linked.select(*keys, ts, found.alias("_i")).select(*keys, ts, F.explode(F.filter("_i", lambda x: x.isNotNull())).alias("issue"))
    finite = df.where(~F.isnan(v) & (F.abs(v) < float("inf")))
    far = residual_anomalies(finite, keys, rows, sigma, value, [ts, *ties]).select(*keys, ts, F.lit("outlier").alias("issue"))
    out = out.unionByName(far)
    if skew is not None:
        lean = finite.groupBy(*keys).agg(F.skewness(value).alias("_s")).where(F.abs("_s") > skew)
        out = out.unionByName(lean.select(*keys, F.lit(None).cast(df.schema[ts].dataType).alias(ts), F.lit("skewed").alias("issue")))
    return out


def correlations(df: DataFrame, bucket: str, series: str, value: str = "value") -> DataFrame:
    """(a, b, n, pearson) of all pairs of series over the buckets that both have."""
    left = df.select(F.col(bucket).alias("_b"), F.col(series).alias("a"), F.col(value).alias("x"))
    right = df.select(F.col(bucket).alias("_b"), F.col(series).alias("b"), F.col(value).alias("y"))
    return left.join(right, "_b").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"))


def granger(x: np.ndarray, y: np.ndarray, lag: int = 2) -> float:
    """F statistic: do ``lag`` past values of x help to predict y beyond y's own."""
    n = len(y) - lag
    if n <= 2 * lag + 1:
        return float("nan")
    past = lambda s: np.column_stack([s[lag - k - 1 : len(s) - k - 1] for k in range(lag)])
    target, own = y[lag:], np.column_stack([np.ones(n), past(y)])
    rss = lambda m: ((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()
    small, large = rss(own), rss(np.column_stack([own, past(x)]))
    return float((small - large) / lag / (large / (n - 2 * lag - 1))) if large > 0 else float("inf")
