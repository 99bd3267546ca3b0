"""Streaming SQL: windowed queries, continuous queries, join and pattern statements, and rules over a stream.

    SELECT avg(value) [AS a], ... FROM s [JOIN t ON k WITHIN 5s] [WHERE e] [GROUP BY k, ...]
      [WINDOW TUMBLING [SIZE] 5m | HOPPING|SLIDING [SIZE] 10m ADVANCE|SLIDE 1m | SESSION [SIZE] 30m [GAP 5m] | GLOBAL | COUNT n]
      [HAVING e] [LATENESS d [DROP|UPDATE]] [EMIT CHANGES|FINAL | TO metric]
    PATTERN name (a, b, ...) WITHIN 5m
    ON INSERT|UPDATE|DELETE|ANY [INTO m] [WHERE value op x] [EMIT METRIC|ALERT|LOG target]

``plan`` gives a DataFrame, streaming if the source is.  EMIT FINAL is the append mode
(a window once, when the watermark has passed it); CHANGES the update mode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.durations import duration
from . import engine

_AGGS = {
    "count": lambda v: F.count(v), "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "first": lambda v: F.first(v), "last": lambda v: F.last(v),
    "count_distinct": F.approx_count_distinct,
}
_WORDS = ("from", "join", "where", "group by", "window", "having", "lateness", "emit")


@dataclass
class Statement:
    source: str
    fields: list[tuple[str, str, str]] = field(default_factory=list)
    """(function or '', argument, alias)."""
    where: str | None = None
    group_by: list[str] = field(default_factory=list)
    window: dict | None = None
    having: str | None = None
    join: dict | None = None
    lateness: int = 0
    late: str = "drop"
    emit: str = "changes"
    target: str | None = None


@dataclass
class Pattern:
    name: str
    steps: list[str]
    within: int


@dataclass
class Rule:
    trigger: str
    metric: str | None = None
    op: str | None = None
    threshold: float | None = None
    action: str | None = None
    target: str = ""


def _time(text: str) -> int:
    """5m, 5 MINUTES or 500ms, in nanoseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    unit = m[2].lower()
    return duration(m[1] + (unit if unit == "ms" else unit[0]))


def _window(text: str) -> dict:
    m = re.fullmatch(r"(tumbling|hopping|sliding|session|global|count)\s*(?:size\s+)?(.*?)(?:\s+(?:advance(?:\s+by)?|slide|gap)\s+(.+))?", text.strip(), re.I | re.S)
    if not m:
        raise ValueError(f"no window: {text!r}")
    kind = m[1].lower()
    if kind == "global":
        return {"kind": kind}
    if kind == "count":
        return {"kind": kind, "size": int(m[2])}
    out = {"kind": "hopping" if kind == "sliding" else kind, "size": _time(m[2])}
    if out["kind"] == "hopping":
        out["slide"] = _time(m[3]) if m[3] else out["size"]
    if kind == "session":
        out["gap"] = _time(m[3]) if m[3] else out["size"]
    return out


def parse(text: str) -> Statement | Pattern | Rule:
    text = " ".join(text.split())
    if m := re.fullmatch(r"pattern (\w+) \((.+)\) within (.+)", text, re.I):
        return Pattern(m[1], [x.strip() for x in m[2].split(",")], _time(m[3]))
    if re.match(r"on ", text, re.I):
        return _rule(text)
    if not re.match(r"select .+", text, re.I):
        raise ValueError("expected SELECT, PATTERN or ON")
    at = [(m.start(), m.end(), m[1].lower()) for m in re.finditer(r"(?<= )(" + "|".join(_WORDS) + r")(?= )", text, re.I)]
    if not at or at[0][2] != "from":
        raise ValueError("no FROM")
    parts = {"select": text[7 : at[0][0]].strip()}
    for i, (_, end, word) in enumerate(at):
        parts[word] = text[end : at[i + 1][0] if i + 1 < len(at) else len(text)].strip()
    fields = []
    for item in re.split(r",(?![^(]*\))", parts["select"]):
        body, _, alias = re.sub(r"\s+as\s+", "\0", item.strip(), flags=re.I).partition("\0")
        call = re.fullmatch(r"(\w+)\s*\((.*)\)", body.strip())
        if call and call[1].lower() not in _AGGS:
            raise ValueError(f"unknown aggregate {call[1]}")
        fn, arg = (call[1].lower(), call[2].strip()) if call else ("", body.strip())
        fields.append((fn, arg, alias.strip() or (f"{fn}_{arg}" if fn and arg != "*" else fn or arg)))
    out = Statement(parts["from"], fields, parts.get("where"), [x.strip() for x in parts["group by"].split(",")] if "group by" in parts else [])
    out.window = _window(parts["window"]) if "window" in parts else None
    out.having = parts.get("having")
    if "join" in parts:
        m = re.fullmatch(r"(\w+) on (\w+) within (.+)", parts["join"], re.I)
        if not m:
            raise ValueError("no JOIN t ON k WITHIN d")
        out.join = {"table": m[1], "key": m[2], "within": _time(m[3])}
    if "lateness" in parts:
        m = re.fullmatch(r"(.+?)(?: (drop|update))?", parts["lateness"], re.I)
        out.lateness, out.late = _time(m[1]), (m[2] or "drop").lower()
    if "emit" in parts:
        m = re.fullmatch(r"(changes|final)|to (\S+)", parts["emit"], re.I)
        if not m:
            raise ValueError(f"no EMIT mode: {parts['emit']!r}")
        out.emit, out.target = (m[1] or "changes").lower(), m[2]
    return out


def _rule(text: str) -> Rule:
    m = re.fullmatch(r"on (insert|update|delete|any)(?: into (\S+))?(?: where (\S+) (\S+) (\S+))?(?: emit (metric|alert|log)(?: (.+))?)?", text, re.I)
    if not m:
        raise ValueError(f"no rule: {text!r}")
    if m[3] and (m[3].lower() != "value" or m[4] not in (">", "<", ">=", "<=", "=", "==")):
        raise ValueError("WHERE takes value and a comparison")
    return Rule(m[1].lower(), m[2], m[4], float(m[5]) if m[5] else None, m[6].lower() if m[6] else None, m[7] or "")


def plan(q: Statement, tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """The statement over tables or streams with a timestamp column ``ts``."""
    if q.source not in tables:
        raise ValueError(f"unknown stream {q.source!r}")
    df, seconds = tables[q.source], lambda ns: f"{ns // 1_000_000} milliseconds"
    if q.join:
        df = engine.join_within(df, tables[q.join["table"]], q.join["key"], f"{max(1, q.join['within'] // 10**9)} SECONDS", ts)
    if q.where:
        df = df.where(q.where)
    aggs = [(_AGGS[fn](F.lit(1) if arg == "*" else F.col(arg))).alias(alias) for fn, arg, alias in q.fields if fn]
    if not aggs:
        return df if q.fields and q.fields[0][1] == "*" else df.select(*[F.col(a).alias(n) for _, a, n in q.fields])
    # UPDATE takes rows of any lateness that the watermark allows; DROP nothing behind it
    late = seconds(q.lateness if q.late == "update" else 0)
    w = q.window or {"kind": "global"}
    if w["kind"] == "tumbling":
        out = engine.tumbling(df, ts, seconds(w["size"]), q.group_by, aggs, late)
    elif w["kind"] == "hopping":
        out = engine.tumbling(df, ts, seconds(w["size"]), q.group_by, aggs, late, seconds(w["slide"]))
    elif w["kind"] == "session":
        out = engine.session(df, ts, seconds(w["gap"]), q.group_by, aggs, late)
    elif w["kind"] == "count":
        raise ValueError("count windows need a table: see operators.windows.count_windows")
    else:
        out = df.groupBy(*q.group_by).agg(*aggs)  # a global window never closes
    return out.where(q.having) if q.having else out


def matches(p: Pattern, df: DataFrame, key: str, kind: str = "metric", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, t0, t1, ...): a PATTERN statement over rows whose column ``kind`` names the metric; times in nanoseconds."""
    return engine.sequence(df, key, [F.col(kind) == s for s in p.steps], p.within, ts, tie)


def mode(q: Statement) -> str:
    """The output mode that EMIT asks for; without a window only whole results can be emitted."""
    aggregated = any(fn for fn, _, _ in q.fields)
    if not aggregated:
        return "append"
    if q.emit == "final" and q.window and q.window["kind"] != "global":
        return "append"
    return "complete" if not q.window or q.window["kind"] == "global" else "update"


def applied(rule: Rule, changes: DataFrame) -> DataFrame:
    """(action, target, metric, value, ts) of the change rows (op, metric, value, ts) that a rule takes."""
    out = changes if rule.trigger == "any" else changes.where(F.lower("op") == rule.trigger)
    out = out.where(F.col("metric") == rule.metric) if rule.metric else out
    if rule.op:
        v, x = F.col("value"), F.lit(rule.threshold)
        out = out.where({">": v > x, "<": v < x, ">=": v >= x, "<=": v <= x, "=": v == x, "==": v == x}[rule.op])
    return out.select(F.lit(rule.action or "none").alias("action"), F.lit(rule.target).alias("target"), "metric", "value", "ts")


def route(rules: list[Rule], changes: DataFrame, sinks: dict[str, object]) -> None:
    """Sends what the rules take to sinks (functions of a DataFrame) by action; for ``foreachBatch``, so a stream is read once for all rules."""
    changes.persist()
    try:
        for rule in rules:
            if rule.action in sinks:
                sinks[rule.action](applied(rule, changes))
    finally:
        changes.unpersist()
