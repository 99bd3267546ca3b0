"""Smaller front ends: ClickHouse-style SQL, dict builders, CORRELATE, language detection."""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Points
from ..operators.filters import tag_matches
from ..plans.query import Agg, TSQuery, plan
from . import promql, sql
from .durations import UNITS

_STARTS = {"tostartofsecond": "s", "tostartofminute": "m", "tostartoffiveminutes": "5m", "tostartoftenminutes": "10m", "tostartofhour": "h", "tostartofday": "d"}
_AGGS = {"count": "count", "sum": "sum", "avg": "mean", "mean": "mean", "min": "min", "max": "max", "stddevsamp": "stddev", "any": "first", "anylast": "last"}


def clickhouse(text: str, now: int = 0) -> TSQuery:
    """SELECT [toStartOfX(time) [AS a],] agg(value) [AS a], ... FROM m [WHERE ...] [GROUP BY ...] [LIMIT n]; no time bound means all."""
    m = re.fullmatch(r"\s*select\s+(.+?)\s+from\s+([\w.]+)(.*)", text, re.I | re.S)
    if not m:
        raise ValueError("no SELECT ... FROM")
    rest = re.sub(r"\s+format\s+\w+\s*$", "", m[3], flags=re.I)
    group = re.search(r"\sgroup\s+by\s+(.+?)(?=\s+order\s|\s+limit\s|$)", rest, re.I | re.S)
    q = sql.parse("SELECT * FROM " + m[2] + re.sub(r"\sgroup\s+by\s+.+?(?=\s+order\s|\s+limit\s|$)", "", rest, flags=re.I | re.S), now)
    q.columns = []
    window = None
    for item in re.split(r",(?![^(]*\))", m[1]):
        name, _, alias = re.sub(r"\s+as\s+", "\0", item.strip(), flags=re.I).partition("\0")
        call = re.fullmatch(r"(\w+)\s*\((.*)\)", name.strip())
        if call and call[1].lower() in _STARTS:
            window = _STARTS[call[1].lower()]
        elif call and call[1].lower() in _AGGS:
            fn = _AGGS[call[1].lower()]
            q.aggs.append(Agg(fn, alias.strip() or fn, "*" if call[2].strip() in ("", "*") else "value"))
        elif call:
            raise ValueError(f"unknown function {call[1]}")
        elif name.strip() != "*":
            q.columns.append(name.strip())
    for g in re.split(r",(?![^(]*\))", group[1]) if group else []:
        call = re.fullmatch(r"\s*(\w+)\s*\(.*\)\s*", g)
        if call and call[1].lower() in _STARTS:
            window = _STARTS[call[1].lower()]
        elif g.strip() not in ("t", "time", "bucket"):
            q.group_by.append(g.strip())
    if window:
        number = re.match(r"\d*", window)[0]
        q.window = int(number or 1) * UNITS[window[len(number) :]]
    if q.aggs:
        q.columns = []
    return q


def builder(spec: dict) -> TSQuery:
    """A query as a dict: source, select [{function, field, alias}], filters [{field, op, value}], logic, group_by, window, order_by, limit, offset."""
    from .durations import duration

    ops = {"not_in": "not_in", "regex": "=~", "is_null": "=", "is_not_null": "!="}
    filters = [{"field": f["field"], "op": ops.get(f["op"], f["op"]), "value": f.get("value", "")} for f in spec.get("filters", [])]
    tree = None if not filters else filters[0] if len(filters) == 1 else {spec.get("logic", "and").lower(): filters}
    aggs = [Agg(s["function"].lower(), s.get("alias") or s["function"].lower(), s.get("field", "value")) for s in spec.get("select", []) if s.get("function")]
    return TSQuery(
        spec["source"], aggs, [s["field"] for s in spec.get("select", []) if not s.get("function")], tree, spec.get("start"), spec.get("end"),
        duration(spec["window"]) if spec.get("window") else None, group_by=list(spec.get("group_by", [])),
        order_by=[(o["field"], o.get("direction", "asc").lower() != "desc") for o in spec.get("order_by", [])], limit=spec.get("limit"), offset=spec.get("offset"),
    )


_JOINS = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL OUTER", "full": "FULL OUTER"}


def builder_sql(spec: dict) -> str:
    """The SQL text of a builder's dict with joins: source, alias, select, joins [{type, source, alias, on}], filters, group_by, order_by, limit."""
    item = lambda s: (f"{s['function']}({s.get('field', '*')})" if s.get("function") else s["field"]) + (f" AS {s['alias']}" if s.get("alias") else "")
    named = lambda s: s["source"] + (f" {s['alias']}" if s.get("alias") else "")
    text = lambda v: str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    out = f"SELECT {', '.join(map(item, spec.get('select') or [{'field': '*'}]))} FROM {named(spec)}"
    for j in spec.get("joins", []):
        out += f" {_JOINS[j.get('type', 'inner').lower()]} JOIN {named(j)} ON {j['on']}"
    if spec.get("filters"):
        out += " WHERE " + f" {spec.get('logic', 'and').upper()} ".join(f"{f['field']} {f['op']} {text(f['value'])}" for f in spec["filters"])
    if spec.get("group_by"):
        out += f" GROUP BY {', '.join(spec['group_by'])}"
    if spec.get("order_by"):
        out += " ORDER BY " + ", ".join(f"{o['field']} {o.get('direction', 'asc').upper()}" for o in spec["order_by"])
    return out + (f" LIMIT {int(spec['limit'])}" if spec.get("limit") else "")


def correlate(text: str) -> dict:
    """CORRELATE left WITH right [WHERE a op 'b' AND ...] [WITHIN d] [LIMIT n] as a dict."""
    m = re.fullmatch(r"\s*correlate\s+(\w+)\s+with\s+(\w+)(?:\s+where\s+(.+?))?(?:\s+within\s+(\w+))?(?:\s+limit\s+(\d+))?\s*", text, re.I | re.S)
    if not m:
        raise ValueError("no CORRELATE ... WITH")
    conditions = []
    for part in re.split(r"\s+and\s+", m[3], flags=re.I) if m[3] else []:
        c = re.fullmatch(r"\s*([\w.]+)\s*(=~|!=|=)\s*'?([^']*)'?\s*", part)
        if not c:
            raise ValueError(f"no condition: {part!r}")
        conditions.append({"field": c[1], "op": c[2], "value": c[3]})
    return {"left": m[1].lower(), "right": m[2].lower(), "where": conditions, "within": m[4], "limit": int(m[5] or 100)}


def to_promql(q: TSQuery) -> str:
    """The PromQL text of a one-aggregate query; ValueError for what PromQL cannot say."""
    if q.where and "or" in q.where:  # series of either side
        return " or ".join(to_promql(replace(q, where=x)) for x in q.where["or"])
    matchers, tests = [], []
    for x in (q.where or {}).get("and", [q.where] if q.where else []):
        if "field" not in x:
            raise ValueError("PromQL has no nested conditions on labels")
        name, op, value = x["field"], x["op"], x["value"]
        if name == "value":
            tests.append(f" {'==' if op == '=' else op} {float(value):g}")
        elif op in ("in", "not_in"):
            matchers.append(f'{name}{"=~" if op == "in" else "!~"}"{"|".join(re.escape(str(v)) for v in value)}"')
        elif op in ("=", "!=", "<>", "=~", "!~"):
            matchers.append(f'{name}{"!=" if op == "<>" else op}"{value}"')
        else:
            raise ValueError(f"PromQL has no {op} on labels")
    metric = f"{q.metric}{{{','.join(matchers)}}}" if matchers else q.metric
    if tests and q.window:
        raise ValueError("PromQL cannot filter the samples of a range by value")
    metric += "".join(tests)
    if not q.aggs:
        return metric
    fn = {"mean": "avg"}.get(q.aggs[0].fn, q.aggs[0].fn)
    if q.window:
        metric = f"{fn}_over_time({metric}[{q.window // 10**9}s])" if fn != "rate" else f"rate({metric}[{q.window // 10**9}s])"
    return f"{'sum' if fn == 'rate' else fn}({metric})" + (f" by ({', '.join(q.group_by)})" if q.group_by else "")


def detect(text: str) -> str:
    """sql, cql, clickhouse, correlate, builder or promql."""
    head = text.lstrip()
    if head.startswith("{"):
        try:
            return "builder" if "source" in json.loads(text) else "promql"
        except ValueError:
            return "promql"
    if re.match(r"correlate\s", head, re.I):
        return "correlate"
    if not re.match(r"select\s", head, re.I):
        return "promql"
    if re.search(r"tostartof|\bformat\s+\w+\s*$|system\.", head, re.I):
        return "clickhouse"
    return "cql" if re.search(r"\b(window|gap_fill|align|asof|last)\b", head, re.I) else "sql"


class Engine:
    """engine.query(text): any dialect over named tables of points; plain SQL goes to Spark."""

    def __init__(self, spark: SparkSession, tables: dict[str, Points], now: int = 0, tie: str | None = None) -> None:
        self.spark, self.tables, self.now, self.tie = spark, tables, now, tie
        for name, p in tables.items():
            p.df.createOrReplaceTempView(name)

    def correlated(self, spec: dict) -> DataFrame:
        """Rows of two signals that share trace, service or every common tag, and lie within a time if one is given; ordered by time."""
        from ..operators.joins import correlate as joined
        from .durations import duration

        sides = []
        for name in (spec["left"], spec["right"]):
            p = self.tables[name]
            for c in spec["where"]:
                field = c["field"].split(".")
                if len(field) == 1 or field[0] == name:
                    p = p.where(tag_matches(p, field[-1], c["op"], c["value"]))
            sides.append(p)
        left, right = sides
        shared = [k for k in ("trace_id", "service") if k in left.tags and k in right.tags][:1] or sorted(set(left.tags) & set(right.tags))
        if not shared:
            raise ValueError("the signals share no tag")
        rows = [p.df.select(*[p.tag(k).alias(k) for k in sorted(p.tags)], F.col(p.ts).alias("ts"), F.col(p.value).alias("value")) for p in sides]
        return joined(rows[0], rows[1], shared, duration(spec["within"]) if spec["within"] else None, spec["limit"])

    def query(self, text: str, lang: str | None = None, start: int | None = None, end: int | None = None, step: int = 60 * 10**9) -> DataFrame:
        lang = lang or detect(text)
        if lang == "promql":
            e = promql.Evaluator(self.tables)
            at = self.now if start is None else start
            return e.range_query(text, at, at if end is None else end, step)
        if lang == "spark":
            return self.spark.sql(text)
        if lang == "correlate":
            return self.correlated(correlate(text))
        q = clickhouse(text, self.now) if lang == "clickhouse" else builder(json.loads(text)) if lang == "builder" else sql.parse(text, self.now)
        return plan(q, self.tables, self.tie)
