"""PromQL: parser, and evaluation as DataFrame plans.

An expression becomes a table of (labels ..., t, value), one row per series and
grid step.  A range selector copies each sample to the steps whose window
(t - range, t] holds it -- at most ceil(range / step) rows -- and the range
functions are aggregates over (series, step); no sample ever meets a step that
does not need it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..model import NS, Points
from ..operators import histograms as H
from ..operators.series import neighbours
from .durations import duration

LOOKBACK = 300 * NS


@dataclass
class Selector:
    metric: str
    matchers: list[tuple[str, str, str]] = field(default_factory=list)
    range: int | None = None
    offset: int = 0
    at: int | None = None


@dataclass
class Call:
    fn: str
    args: list
    by: list[str] | None = None
    without: list[str] | None = None


@dataclass
class Binary:
    op: str
    left: object
    right: object
    is_bool: bool = False
    on: list[str] | None = None
    ignoring: list[str] | None = None
    #: left or right: the side of which many series may match one of the other's.
    many: str = ""
    include: list[str] = field(default_factory=list)


@dataclass
class Subquery:
    expr: object
    range: int
    step: int | None
    offset: int = 0


AGGREGATES = ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values", "group")
RANGE = (
    "rate", "increase", "irate", "idelta", "delta", "deriv", "predict_linear", "changes", "resets", "holt_winters", "double_exponential_smoothing", "avg_over_time", "min_over_time", "max_over_time",
    "sum_over_time", "count_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "last_over_time", "present_over_time", "absent_over_time",
)
TIMES = ("hour", "minute", "month", "year", "day_of_month", "day_of_week", "days_in_month", "day_of_year", "timestamp")
_TOKEN = re.compile(
    r"\s*(?:(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|((?:\d+(?:ms|[smhdwy]))+(?![\w.]))|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|[Ii]nf|NaN)(?![\w:])|(=~|!~|!=|==|>=|<=|[-+*/%^=<>(){}\[\],:@])|([A-Za-z_:][\w:]*))"
)
_LEVELS = [("or",), ("and", "unless"), ("==", "!=", ">", "<", ">=", "<="), ("+", "-"), ("*", "/", "%")]


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind = next(k for k, x in zip(("str", "dur", "num", "op", "id"), m.groups(), strict=True) if x is not None)
            self.tokens.append((kind, m[0].strip()))
            at = m.end()
        self.at = 0
        if not self.tokens:
            raise ValueError("an empty query")

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        if self.at >= len(self.tokens) or (wanted and self.peek() != wanted):
            raise ValueError(f"expected {wanted or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self):
        out = self.level(0)
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()!r}")
        return out

    def level(self, k: int):
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.peek() in _LEVELS[k]:
            left = self.joined(self.take(), left, lambda: self.level(k + 1))
        return left

    def joined(self, op: str, left, right) -> Binary:
        """A binary operator's modifiers and its right side."""
        out = Binary(op, left, None, self.peek() == "bool" and bool(self.take()))
        if self.peek() in ("on", "ignoring"):
            setattr(out, self.take(), self.names())
        if self.peek() in ("group_left", "group_right"):
            out.many = self.take()[6:]
            out.include = self.names() if self.peek() == "(" else []
        out.right = right()
        return out

    def unary(self):
        """A sign binds more loosely than ^, which groups from the right: -a ^ b is -(a ^ b)."""
        if self.peek() in ("-", "+"):
            return Binary("*", -1.0, self.unary()) if self.take() == "-" else self.unary()
        left = self.suffixes(self.atom())
        return self.joined(self.take(), left, self.unary) if self.peek() == "^" else left

    def atom(self):
        kind, text = self.kind(), self.peek()
        if text == "(":
            self.take()
            out = self.level(0)
            self.take(")")
            return out
        if kind == "num":
            return float(self.take())
        if kind == "str":
            return self.take()[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if text == "{":
            return self.selector("")
        if kind != "id":
            raise ValueError(f"unexpected {text!r}")
        name = self.take()
        if name in AGGREGATES and self.peek() in ("by", "without", "("):
            grouping = self.grouping()
            call = Call(name, self.arguments(), *grouping)
            if self.peek() in ("by", "without"):
                call.by, call.without = self.grouping()
            return call
        if self.peek() == "(":
            return Call(name, self.arguments())
        return self.selector(name)

    def grouping(self) -> tuple[list[str] | None, list[str] | None]:
        if self.peek() not in ("by", "without"):
            return None, None
        word, names = self.take(), self.names()
        return (names, None) if word == "by" else (None, names)

    def names(self) -> list[str]:
        out = []
        self.take("(")
        while self.peek() != ")":
            out.append(self.take())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def arguments(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.level(0))
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def selector(self, metric: str) -> Selector:
        out = Selector(metric)
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                label, op = self.take(), self.take()
                if op not in ("=", "!=", "=~", "!~") or self.kind() != "str":
                    raise ValueError(f"no matcher: {label} {op} {self.peek()}")
                value = self.take()[1:-1]
                if label == "__name__" and op == "=":
                    out.metric = value
                else:
                    out.matchers.append((label, op, value))
                if self.peek() == ",":
                    self.take()
            self.take("}")
        return out

    def suffixes(self, node):
        while self.peek() in ("[", "offset", "@"):
            word = self.take()
            if word == "[":
                size = duration(self.take())
                if self.peek() == ":":
                    self.take()
                    node = Subquery(node, size, duration(self.take()) if self.kind() == "dur" else None)
                elif isinstance(node, Selector):
                    node.range = size
                else:
                    raise ValueError("only a selector or a subquery takes a range")
                self.take("]")
            elif word == "offset":
                sign = -1 if self.peek() == "-" and self.take() else 1
                node.offset = sign * duration(self.take())
            else:
                node.at = int(float(self.take()) * NS)
        return node


def parse(text: str):
    return Parser(text).parse()


@dataclass
class Vector:
    """Rows (labels ..., t, value); a scalar has no rows but a number."""

    df: DataFrame | None
    labels: list[str]
    number: float | None = None


@dataclass
class Grid:
    start: int
    end: int
    step: int


class Evaluator:
    """Evaluates over tables of points by metric name."""

    def __init__(self, tables: dict[str, Points]) -> None:
        self.tables = tables

    def range_query(self, text: str, start: int, end: int, step: int) -> DataFrame:
        out = self.of(parse(text), Grid(start, end, step))
        if out.number is not None:
            raise ValueError("a number is no series")
        return out.df

    def instant_query(self, text: str, at: int) -> DataFrame:
        return self.range_query(text, at, at, NS)

    def of(self, node, grid: Grid) -> Vector:
        if isinstance(node, float):
            return Vector(None, [], node)
        if isinstance(node, Selector):
            if node.range is not None:
                raise ValueError("a range needs a function")
            rows, labels = self.windowed(node, LOOKBACK, grid)
            return Vector(rows.groupBy(*labels, "t").agg(F.max_by("value", "ts").alias("value")), labels)
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        raise ValueError(f"cannot evaluate {node!r}")

    def windowed(self, node, width: int, grid: Grid, linked: bool = False, panes: bool = False) -> tuple[DataFrame, list[str]]:
        """The samples of every (series, step), as rows (labels ..., t, ts, value).

        ``linked``: with the sample before in the series (``_prev``), which may lie outside the window.
        ``panes``: sums, counts, extremes and last values of panes in place of samples; a
        pane is as long as the greatest common divisor of range and step, so each
        window is made of whole panes and copies no longer grow with the samples.
        """
        if isinstance(node, Subquery):
            step = node.step or grid.step
            first = -(-(grid.start - node.offset - width + 1) // step) * step
            inner = self.of(node.expr, Grid(first, grid.end - node.offset, step))
            rows, labels = inner.df.select(*inner.labels, F.col("t").alias("ts"), "value"), inner.labels
            offset, at = node.offset, None
        else:
            if node.metric not in self.tables:
                raise ValueError(f"unknown metric {node.metric!r}")
            p = self.tables[node.metric]
            offset, at = node.offset, node.at
            low = (at if at is not None else grid.start) - offset - width
            high = (at if at is not None else grid.end) - offset
            p = p.between(low + 1, high + 1)
            for label, op, value in node.matchers:
                p = p.where(matched(p.tag(label), op, value))
            labels = sorted(p.tags)
            rows = p.df.where(~F.isnan(p.value)).select(*[p.tag(k).alias(k) for k in labels], F.col(p.ts).alias("ts"), F.col(p.value).alias("value"))
        s, e, d = F.lit(grid.start), grid.end, grid.step
        if at is not None:
            steps = F.sequence(F.lit(0).cast("long"), F.lit((e - grid.start) // d).cast("long"))
        else:
            seen = F.col("ts") + F.lit(offset)
            lo = F.greatest(F.ceil((seen - s) / F.lit(d)), F.lit(0)).cast("long")
            # t - range < ts: the last step before ts + range
            hi = F.least(F.floor((seen + (width - 1) - s) / F.lit(d)), F.lit((e - grid.start) // d)).cast("long")
            steps = F.when(lo <= hi, F.sequence(lo, hi))
        if linked:
            rows = neighbours(rows, labels, "ts", ["value"])
        if panes:
            size = math.gcd(width, d)
            end = s + F.ceil((F.col("ts") + F.lit(offset) - s) / F.lit(size)).cast("long") * size - offset
            v = F.col("value")
            rows = rows.groupBy(*labels, (end if at is None else F.lit(high)).cast("long").alias("_end")).agg(
                F.sum(v).alias("s"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.max_by(v, "ts").alias("last")
            ).withColumnRenamed("_end", "ts")
        out = rows.withColumn("_k", F.explode(steps)).withColumn("t", s + F.col("_k") * d).drop("_k")
        return out, labels

    def call(self, node: Call, grid: Grid) -> Vector:
        fn, args = node.fn, node.args
        if fn in AGGREGATES:
            return self.aggregate(node, grid)
        if fn in RANGE:
            return self.over_range(fn, args, grid)
        if fn == "histogram_quantile":
            q, inner = args[0], self.of(args[1], grid)
            labels = [k for k in inner.labels if k != "le"]
            le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(le AS DOUBLE)"))
            buckets = F.array_sort(F.collect_list(F.struct(le.alias("le"), F.col("value").alias("cnt"))))
            return Vector(inner.df.groupBy(*labels, "t").agg(A.bucket_quantile(q, buckets).alias("value")), labels)
        if fn == "vector":
            n = self.of(args[0], grid)
            if n.number is None:
                return Vector(n.df.select("t", "value"), [])
            return Vector(self.steps(grid).withColumn("value", F.lit(float(n.number))), [])
        if fn == "time":
            return Vector(self.steps(grid).withColumn("value", F.col("t") / F.lit(1e9)), [])
        if fn == "pi":
            return Vector(None, [], math.pi)
        if fn == "absent":
            return self.without_steps(self.of(args[0], grid).df, args[0], grid)
        if fn in TIMES and not args:
            args = [Call("time", [])]
        if fn == "histogram_fraction":
            low, high, inner = self.number(args[0], grid), self.number(args[1], grid), self.of(args[2], grid)
            return self.native(inner, lambda h: H.native_fraction(h, low, high))
        inner = self.of(args[0], grid)
        v = F.col("value")
        if fn in ("histogram_count", "histogram_sum", "histogram_avg"):
            return self.native(inner, getattr(H, fn.replace("histogram", "native")))
        if inner.number is not None:
            inner = self.call(Call("vector", [inner.number]), grid)
        if fn == "scalar":
            return Vector(inner.df.groupBy("t").agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(F.lit(float("nan"))).alias("value")), [])
        if fn in ("sort", "sort_desc"):
            return Vector(inner.df.orderBy(v.asc() if fn == "sort" else v.desc()), inner.labels)
        if fn in ("label_replace", "label_join"):
            if fn == "label_replace":
                _, to, replacement, source, pattern = args
                old = F.col(to) if to in inner.labels else F.lit(None).cast("string")
                new = S.label_replace(F.col(source) if source in inner.labels else F.lit(""), pattern, re.sub(r"\$\{?(\d+)\}?", r"$\1", replacement), old)
            else:
                to, separator, *sources = args[1:]
                new = F.concat_ws(separator, *[F.col(x) for x in sources if x in inner.labels])
            return Vector(inner.df.withColumn(to, new), sorted({*inner.labels, to}))
        if fn == "round" and len(args) > 1:
            to = self.number(args[1], grid)
            new = F.floor(v / to + 0.5) * to
        elif fn in S.MATH:
            new = S.MATH[fn](v)
        elif fn in TIMES:
            new = S.time_part(fn, F.col("t") if fn == "timestamp" else (v * NS).cast("long"))
        elif fn == "clamp":
            new = S.clamp(v, self.number(args[1], grid), self.number(args[2], grid))
        elif fn == "clamp_min":
            new = F.greatest(v, F.lit(self.number(args[1], grid)))
        elif fn == "clamp_max":
            new = F.least(v, F.lit(self.number(args[1], grid)))
        else:
            raise ValueError(f"unknown function {fn}")
        return Vector(inner.df.withColumn("value", new), inner.labels)

    def steps(self, grid: Grid) -> DataFrame:
        spark = next(iter(self.tables.values())).df.sparkSession
        return spark.range((grid.end - grid.start) // grid.step + 1).select((F.lit(grid.start) + F.col("id") * grid.step).alias("t"))

    def number(self, node, grid: Grid) -> float:
        got = self.of(node, grid)
        if got.number is None:
            raise ValueError("a number is expected")
        return got.number

    def native(self, inner: Vector, read) -> Vector:
        """A function of native histograms, given as series with a bucket index in the label ``idx``."""
        labels = [k for k in inner.labels if k not in ("idx", "sign")]
        sign = F.col("sign").cast("int") if "sign" in inner.labels else F.lit(1)
        h = F.struct(F.collect_list(F.struct(sign.alias("sign"), F.col("idx").cast("int").alias("idx"), F.col("value").alias("cnt"))).alias("buckets"))
        return Vector(inner.df.groupBy(*labels, "t").agg(h.alias("h")).select(*labels, "t", read(F.col("h.buckets")).alias("value")), labels)

    def over_range(self, fn: str, args: list, grid: Grid) -> Vector:
        node = next(a for a in args if isinstance(a, (Selector, Subquery)))
        if node.range is None:
            raise ValueError(f"{fn} needs a range")
        numbers = [-1.0 * a.right if isinstance(a, Binary) else a for a in args if isinstance(a, float) or (isinstance(a, Binary) and isinstance(a.right, float))]
        width = node.range
        if fn == "absent_over_time":
            rows, _ = self.windowed(node, width, grid)
            return self.without_steps(rows, node, grid)
        v, ts = F.col("value"), F.col("ts")
        whole = {
            "sum_over_time": F.sum("s"), "count_over_time": F.sum("n").cast("double"), "avg_over_time": F.sum("s") / F.sum("n"), "min_over_time": F.min("lo"), "max_over_time": F.max("hi"),
            "last_over_time": F.max_by("last", "ts"), "present_over_time": F.lit(1.0),
        }
        direct = {
            "stddev_over_time": F.stddev_pop(v), "stdvar_over_time": F.var_pop(v), "quantile_over_time": F.percentile(v, F.lit(numbers[0] if numbers else 0.5)),
            "deriv": A.slope(v, ts, F.col("t")), "predict_linear": A.predict_linear(v, ts, F.col("t"), numbers[0] if numbers else 0.0),
        }
        if fn in whole:
            rows, labels = self.windowed(node, width, grid, panes=True)
            value = whole[fn]
        elif fn in direct:
            rows, labels = self.windowed(node, width, grid)
            value = direct[fn]
        elif fn in ("holt_winters", "double_exponential_smoothing"):
            rows, labels = self.windowed(node, width, grid)
            value = A.holt_winters(A.samples(v, ts), *(numbers or [0.5, 0.5]))
        else:
            rows, labels = self.windowed(node, width, grid, linked=True)
            fixed = isinstance(node, Selector) and node.at is not None
            low = F.lit(node.at - node.offset - width) if fixed else F.col("t") - F.lit(node.offset + width)
            s = A.Steps(v, ts, F.col("_prev.value"), F.col("_prev.ts"), low)
            value = s.increase(width) if fn == "increase" else getattr(s, fn)()
        out = rows.groupBy(*labels, "t").agg(value.alias("value"))
        return Vector(out.where(F.col("value").isNotNull()), labels)

    def without_steps(self, rows: DataFrame, node, grid: Grid) -> Vector:
        """1 at each step that ``rows`` lack, with the labels that the selector's equalities name."""
        steps = self.call(Call("vector", [1.0]), grid).df
        fixed = {k: v for k, op, v in node.matchers if op == "="} if isinstance(node, Selector) else {}
        out = steps.join(rows.select("t").distinct(), "t", "left_anti")
        return Vector(out.withColumns({k: F.lit(v) for k, v in fixed.items()}), sorted(fixed))

    def aggregate(self, node: Call, grid: Grid) -> Vector:
        inner = self.of(node.args[-1], grid)
        param = node.args[0] if len(node.args) > 1 else None
        keys = [k for k in inner.labels if k in node.by] if node.by is not None else [k for k in inner.labels if k not in node.without] if node.without is not None else []
        v = F.col("value")
        if node.fn in ("topk", "bottomk"):
            order = v.desc() if node.fn == "topk" else v.asc()
            rank = F.row_number().over(Window.partitionBy(*keys, "t").orderBy(order, *inner.labels))
            return Vector(inner.df.withColumn("_r", rank).where(F.col("_r") <= int(param)).drop("_r"), inner.labels)
        if node.fn == "count_values":
            named = inner.df.withColumn(param, S.plain_number(v))
            return Vector(named.groupBy(*keys, param, "t").agg(F.count(F.lit(1)).cast("double").alias("value")), sorted([*keys, param]))
        value = {
            "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v).cast("double"), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v),
            "quantile": F.percentile(v, F.lit(param if param is not None else 0.5)), "group": F.max(F.lit(1.0)),
        }[node.fn]
        return Vector(inner.df.groupBy(*keys, "t").agg(value.alias("value")), keys)

    def binary(self, node: Binary, grid: Grid) -> Vector:
        left, right, op = self.of(node.left, grid), self.of(node.right, grid), node.op
        if op in ("and", "or", "unless"):
            keys = self.matching(node, left, right)
            name = lambda k: f"_m_{k}"
            marked = lambda x: x.df.withColumns({name(k): self.label(x, k) for k in keys} | {name("t"): F.col("t")})
            on = [name(k) for k in (*keys, "t")]
            l, r = marked(left), marked(right)
            if op in ("and", "unless"):
                return Vector(l.join(r.select(*on).distinct(), on, "left_semi" if op == "and" else "left_anti").drop(*on), left.labels)
            new = r.join(l.select(*on).distinct(), on, "left_anti").drop(*on)
            return Vector(left.df.unionByName(new, allowMissingColumns=True), sorted({*left.labels, *right.labels}))
        if left.number is not None and right.number is not None:
            a, b = left.number, right.number
            return Vector(None, [], _numbers(op, a, b))
        if left.number is not None or right.number is not None:
            base = right if left.number is not None else left
            a = F.lit(left.number) if left.number is not None else F.col("value")
            b = F.lit(right.number) if right.number is not None else F.col("value")
            return self.applied(op, base.df, a, b, base.labels, node.is_bool)
        keys = self.matching(node, left, right)
        many, one = (right, left) if node.many == "right" else (left, right)
        extra = [k for k in node.include if k in one.labels]
        # one series a label set and step; a second one is an error where it meets a partner
        single = one.df.groupBy(*[self.label(one, k).alias(f"_m_{k}") for k in keys], F.col("t").alias("_t")).agg(
            F.max("value").alias("_b"), F.count(F.lit(1)).alias("_n"), *[F.max(k).alias(f"_x_{k}") for k in extra]
        )
        on = [self.label(many, k) == F.col(f"_m_{k}") for k in keys] + [F.col("t") == F.col("_t")]
        joined = many.df.join(single, on)
        twice = "several series of one side match, and no group_left or group_right says which side is many"
        joined = joined.withColumn("_b", F.when(F.col("_n") > 1, F.raise_error(F.lit(twice)).cast("double")).otherwise(F.col("_b")))
        if node.many:
            labels = sorted({*many.labels, *extra})
            joined = joined.select(*[F.col(f"_x_{k}").alias(k) if k in extra else F.col(k) for k in labels], "t", F.col("value").alias("_a"), "_b")
        else:
            labels = sorted(k for k in keys if k in many.labels)
            joined = joined.groupBy(*labels, "t").agg(F.max("value").alias("_a"), F.max("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
            joined = joined.withColumn("_a", F.when(F.col("_n") > 1, F.raise_error(F.lit(twice)).cast("double")).otherwise(F.col("_a")))
        a, b = (F.col("_b"), F.col("_a")) if node.many == "right" else (F.col("_a"), F.col("_b"))
        return self.applied(op, joined, a, b, labels, node.is_bool)

    @staticmethod
    def matching(node: Binary, left: Vector, right: Vector) -> list[str]:
        """The labels that both sides must share: all of them, those of ``on``, or all but those of ``ignoring``."""
        if node.on is not None:
            return sorted(node.on)
        return sorted({*left.labels, *right.labels} - set(node.ignoring or ()))

    @staticmethod
    def label(side: Vector, k: str) -> Column:
        """A label's text; one that is missing is empty."""
        return F.coalesce(F.col(k).cast("string"), F.lit("")) if k in side.labels else F.lit("")

    @staticmethod
    def applied(op: str, df: DataFrame, a: Column, b: Column, labels: list[str], is_bool: bool) -> Vector:
        keep = [*labels, "t"]
        if op in S.ARITHMETIC:
            return Vector(df.select(*keep, S.ARITHMETIC[op](a, b).alias("value")), labels)
        test = S.COMPARE[op](a, b)
        if is_bool:
            return Vector(df.select(*keep, test.cast("double").alias("value")), labels)
        return Vector(df.where(test).select(*keep, (F.col("value") if "value" in df.columns else a).alias("value")), labels)


def _numbers(op: str, a: float, b: float) -> float:
    if op in ("==", "!=", ">", "<", ">=", "<="):
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else a * math.copysign(math.inf, b), "%": math.fmod(a, b) if b else math.nan, "^": a**b}[op]


def label_names(tables: dict[str, Points]) -> list[str]:
    """All labels of all metrics, the metric's name among them."""
    return sorted({"__name__", *(k for p in tables.values() for k in p.tags)})


def label_values(tables: dict[str, Points], label: str) -> DataFrame:
    """(value): the distinct values of a label, as one column; metrics' names need no scan."""
    found = [p.df.select(p.tag(label).alias("value")) for p in tables.values() if label in p.tags]
    if label == "__name__":
        spark = next(iter(tables.values())).df.sparkSession
        return spark.createDataFrame([(k,) for k in sorted(tables)], "value string")
    if not found:
        raise ValueError(f"no metric has the label {label}")
    return reduce(lambda a, b: a.unionByName(b), found).where("value is not null").distinct()


def series(tables: dict[str, Points], selector: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The distinct label sets that a selector matches, with ``__name__``."""
    node = parse(selector)
    p = tables[node.metric].between(start, end)
    for label, op, value in node.matchers:
        match = matched(p.tag(label), op, value)
        p = p.where(match)
    return p.df.select(F.lit(node.metric).alias("__name__"), *[p.tag(k).alias(k) for k in sorted(p.tags)]).distinct()


def matched(tag: Column, op: str, value: str) -> Column:
    """A label matcher; regexes match the whole value, a missing label is empty."""
    text = F.coalesce(tag, F.lit(""))
    match = text == value if op in ("=", "!=") else F.rlike(text, F.lit(f"^(?:{value})$"))
    return match if op in ("=", "=~") else ~match


@dataclass(frozen=True)
class Rule:
    """A recording rule: the expression's result becomes points of the metric ``record``, with ``labels`` added."""

    record: str
    expr: str
    labels: dict[str, str] = field(default_factory=dict)


def recorded(tables: dict[str, Points], rules: list[Rule], at: int) -> dict[str, Points]:
    """The rules evaluated at one time, in order, each over what the ones before recorded; (metric, labels ..., ts, value)."""
    known, out = dict(tables), {}
    for rule in rules:
        df = Evaluator(known).instant_query(rule.expr, at)
        df = df.withColumns({k: F.lit(v) for k, v in rule.labels.items()}).withColumn("metric", F.lit(rule.record)).withColumnRenamed("t", "ts")
        made = Points(df, {k: k for k in df.columns if k not in ("metric", "ts", "value")})
        known[rule.record] = out[rule.record] = made
    return out
