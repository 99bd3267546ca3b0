"""Tag, value, document and log predicates."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_path, masked
from ..model import Points, bucket

LONGEST_PATTERN = 1024


def tag_is(p: Points, key: str, value: str) -> Column:
    """Exact tag map: a missing tag equals the empty string."""
    return F.coalesce(p.tag(key), F.lit("")) == value if value == "" else p.tag(key) == value


def tag_matches(p: Points, key: str, op: str, value) -> Column:
    """=, !=, in, not_in, =~ and !~.

    = needs the key and != passes without it; in and the regexes see a missing
    tag as the empty string.  Regexes search anywhere in the tag.
    """
    text = F.coalesce(p.tag(key), F.lit(""))
    if op == "=":
        return F.coalesce(p.tag(key) == value, F.lit(False))
    if op in ("!=", "<>"):
        return ~p.tag(key).eqNullSafe(F.lit(value))
    if op in ("in", "not_in"):
        found = text.isin(*value)
        return found if op == "in" else ~found
    if op in ("=~", "!~"):
        if len(value) > LONGEST_PATTERN:
            raise ValueError("the pattern is too long")
        found = F.rlike(text, F.lit(value))
        return found if op == "=~" else ~found
    if op == "like":
        return text.like(value)
    raise ValueError(f"unknown operator {op}")


def compare(v: Column, op: str, x) -> Column:
    """Numeric comparisons; anything compared with NaN is false."""
    ops = {
        "=": lambda: v == x, "==": lambda: v == x, "!=": lambda: v != x, "<>": lambda: v != x, ">": lambda: v > x, ">=": lambda: v >= x,
        "<": lambda: v < x, "<=": lambda: v <= x, "in": lambda: v.isin(*x), "not_in": lambda: ~v.isin(*x),
    }
    if op not in ops:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(~F.isnan(v.cast("double")) & ops[op](), F.lit(False))


def predicate(p: Points, tree: dict) -> Column:
    """{"and": [...]}, {"or": [...]}, {"not": ...} or {"field", "op", "value"}; a field is value, time or a tag."""
    for word, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in tree:
            return reduce(join, [predicate(p, x) for x in tree[word]])
    if "not" in tree:
        return ~predicate(p, tree["not"])
    name, op, value = tree["field"], tree["op"], tree["value"]
    if op == "between":
        return predicate(p, {"and": [{"field": name, "op": ">=", "value": value[0]}, {"field": name, "op": "<=", "value": value[1]}]})
    if name == "value":
        return compare(F.col(p.value), op, value)
    if name in ("time", "timestamp", "ts"):
        return compare(F.col(p.ts), op, value)
    if op in (">", ">=", "<", "<="):
        return compare(F.expr(f"try_cast(`{p.tags.get(name, name)}` AS DOUBLE)"), op, float(value))
    return tag_matches(p, name, op, [str(x) for x in value] if isinstance(value, (list, tuple)) else str(value))


def document_matches(doc: Column, query: dict) -> Column:
    """$eq $ne $gt $gte $lt $lte $in $regex on dotted paths; numbers are compared as numbers."""
    parts = []
    for path, wanted in query.items():
        text = json_path(doc, path)
        for op, x in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            left = text.try_cast("double") if isinstance(x, (int, float)) and not isinstance(x, bool) else text
            parts.append({
                "$eq": lambda l=left, x=x: l == F.lit(x), "$ne": lambda l=left, x=x: ~l.eqNullSafe(F.lit(x)), "$gt": lambda l=left, x=x: l > x,
                "$gte": lambda l=left, x=x: l >= x, "$lt": lambda l=left, x=x: l < x, "$lte": lambda l=left, x=x: l <= x,
                "$in": lambda t=text, x=x: t.isin(*[str(i) for i in x]), "$regex": lambda t=text, x=x: F.rlike(t, F.lit(x)),
            }[op]())
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")


def level_at_least(level: Column, least: str) -> Column:
    rank = reduce(lambda acc, x: acc.when(F.lower(level) == x[1], x[0]), enumerate(LEVELS), F.when(F.lit(False), -1))
    return rank >= LEVELS.index(least)


def logs(df: DataFrame, start: int | None = None, end: int | None = None, least: str | None = None, contains: str | None = None, tags: dict | None = None, ts: str = "ts", level: str = "level", message: str = "message") -> DataFrame:
    """Log rows with times in [start, end], both ends included, at least a level, holding a text (any case), and with equal tags."""
    conditions = [F.col(ts) >= start] if start is not None else []
    conditions += [F.col(ts) <= end] if end is not None else []
    conditions += [level_at_least(F.col(level), least)] if least else []
    conditions += [F.contains(F.lower(message), F.lit(contains.lower()))] if contains else []
    conditions += [F.col(k) == F.lit(v) for k, v in (tags or {}).items()]
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def masked_for(df: DataFrame, policies: Sequence[dict], role: str, metric: str = "metric") -> DataFrame:
    """Columns masked by policies {column, how: redact|hash|truncate, secret, except: [roles], prefix: of the metrics it holds for}; the first that fits a row decides."""
    out = df
    for column in dict.fromkeys(p["column"] for p in policies):
        shown = F.col(column).cast("string")
        for p in reversed([p for p in policies if p["column"] == column and role not in p.get("except", ())]):
            shown = F.when(F.col(metric).startswith(p.get("prefix", "")), masked(F.col(column).cast("string"), p["how"], p.get("secret"))).otherwise(shown)
        out = out.withColumn(column, shown)
    return out


def sampled(key: Column, ts: Column, rate: float) -> Column:
    """Like ``hash_sampled``, by MD5, which other systems can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), ts.cast("string"))), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32))


def adaptive_rates(df: DataFrame, keys: Sequence[str], width: int, budget: int, ts: str = "ts") -> DataFrame:
    """(keys, bucket, seen, rate): the rate that keeps about ``budget`` rows of each group and window, from how many were seen in the window before (1 at first)."""
    counts = df.groupBy(*keys, bucket(F.col(ts), width).alias("bucket")).agg(F.count(F.lit(1)).alias("seen"))
    last = F.lag("seen").over(Window.partitionBy(*keys).orderBy("bucket"))
    return counts.withColumn("rate", F.coalesce(F.least(F.lit(1.0), budget / last), F.lit(1.0)))


def hash_sampled(key: Column, ts: Column, rate: float) -> Column:
    """The same rows on every run: the hash of series and time within the rate."""
    return F.pmod(F.xxhash64(key, ts), F.lit(1_000_000)) < int(rate * 1_000_000)
