"""Text and JSON sources as tables of points, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "metric STRING, tags MAP<STRING,STRING>, value DOUBLE, ts BIGINT"


def line_protocol(lines: DataFrame, column: str = "value") -> DataFrame:
    """``measurement,tag=v field=1[,field=2] [ns]`` as points: one per numeric field, metric measurement.field.

    Backslashes escape commas, blanks and equal signs.  Lines that do not parse
    have a null metric and keep their text in ``bad``.
    """
    line = F.trim(F.col(column))
    rx = r"^((?:\\.|[^,\s\\])+)((?:,(?:\\.|[^,=\s\\])+=(?:\\.|[^,\s\\])*)*)\s+((?:\"(?:\\.|[^\"])*\"|\\.|[^\s\\\"])+)(?:\s+(-?\d+))?$"
    part = lambda k: F.regexp_extract(line, rx, k)
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    pairs = lambda c: F.filter(F.split(c, r"(?<!\\),"), lambda x: x != "")
    side = lambda x, k: F.regexp_extract(x, r"^((?:\\.|[^=\\])+)=(.*)$", k)
    tags = F.map_from_entries(F.array_distinct(F.transform(pairs(part(2)), lambda x: F.struct(plain(side(x, 1)), plain(side(x, 2))))))
    rows = lines.where((line != "") & ~line.startswith("#")).select(line.alias("line"), F.rlike(line, F.lit(rx)).alias("ok"), plain(part(1)).alias("m"), tags.alias("tags"), part(4).alias("at"), pairs(part(3)).alias("fields"))
    good = rows.where("ok").select("line", "m", "tags", "at", F.explode("fields").alias("f"))
    number = F.when(side(F.col("f"), 2).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?[iu]?$"), F.regexp_replace(side(F.col("f"), 2), "[iu]$", "").cast("double"))
    name = plain(side(F.col("f"), 1))
    points = good.select(
        F.when(number.isNotNull(), F.when(name == "value", F.col("m")).otherwise(F.concat_ws(".", "m", name))).alias("metric"), "tags", number.alias("value"),
        F.when(F.col("at") != "", F.col("at").try_cast("long")).alias("ts"), F.when(number.isNull(), F.col("line")).alias("bad"),
    )
    nothing = rows.where("not ok").selectExpr("CAST(NULL AS STRING) metric", "CAST(NULL AS MAP<STRING,STRING>) tags", "CAST(NULL AS DOUBLE) value", "CAST(NULL AS BIGINT) ts", "line bad")
    return points.unionByName(nothing)


def statsd(lines: DataFrame, column: str = "value", prefix: str = "", ts: Column | None = None) -> DataFrame:
    """``name:value|type[|@rate][|#k:v,...]``; counters are divided by their rate; other lines land in ``bad``."""
    rx = r"^([^:|\s]+):([-+]?\d+(?:\.\d+)?)\|(c|g|ms|h|s|d)(?:\|@(0?\.\d+|1(?:\.0+)?))?(?:\|#(.*))?$"
    line, ok = F.trim(F.col(column)), F.rlike(F.trim(F.col(column)), F.lit(rx))
    part = lambda k: F.regexp_extract(line, rx, k)
    rate = F.coalesce(part(4).try_cast("double"), F.lit(1.0))
    value = F.when(part(3) == "c", part(2).try_cast("double") / rate).otherwise(part(2).try_cast("double"))
    return lines.select(
        F.when(ok, F.concat(F.lit(prefix), part(1))).alias("metric"), F.when(ok & (part(5) != ""), F.str_to_map(part(5), F.lit(","), F.lit(":"))).alias("tags"),
        F.when(ok, value).alias("value"), F.when(ok, part(3)).alias("kind"), (ts if ts is not None else F.lit(None).cast("long")).alias("ts"), F.when(~ok, line).alias("bad"),
    )


_ATTR = "ARRAY<STRUCT<key:STRING,value:STRUCT<stringValue:STRING,intValue:STRING,doubleValue:DOUBLE,boolValue:BOOLEAN>>>"
_NUM = f"STRUCT<dataPoints:ARRAY<STRUCT<attributes:{_ATTR},timeUnixNano:STRING,asDouble:DOUBLE,asInt:STRING>>>"
_HIST = f"STRUCT<dataPoints:ARRAY<STRUCT<attributes:{_ATTR},timeUnixNano:STRING,count:STRING,sum:DOUBLE,bucketCounts:ARRAY<STRING>,explicitBounds:ARRAY<DOUBLE>>>>"
_SUMM = f"STRUCT<dataPoints:ARRAY<STRUCT<attributes:{_ATTR},timeUnixNano:STRING,count:STRING,sum:DOUBLE,quantileValues:ARRAY<STRUCT<quantile:DOUBLE,value:DOUBLE>>>>>"
OTLP = f"resourceMetrics ARRAY<STRUCT<scopeMetrics:ARRAY<STRUCT<metrics:ARRAY<STRUCT<name:STRING,gauge:{_NUM},sum:{_NUM},histogram:{_HIST},summary:{_SUMM}>>>>>>"


def otlp_json(docs: DataFrame, column: str = "value") -> DataFrame:
    """OTLP metrics in JSON: gauges and sums as they are, histograms as _count, _sum and cumulative _bucket{le}, summaries with a quantile tag."""
    m = docs.select(F.from_json(column, OTLP).alias("j")).select(F.explode("j.resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m")).select("m.*")
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    tags = lambda d: F.map_from_entries(F.transform(F.coalesce(d["attributes"], F.array().cast(_ATTR)), lambda a: F.struct(a["key"], text(a["value"]))))
    plus = lambda d, k, v: F.map_concat(tags(d), F.create_map(F.lit(k), v))
    row = lambda metric, t, value, d: F.struct(metric.alias("metric"), t.alias("tags"), value.cast("double").alias("value"), d["timeUnixNano"].cast("long").alias("ts"))
    number = lambda c: m.where(F.col(c).isNotNull()).select("name", F.explode(f"{c}.dataPoints").alias("d")).select(row(F.col("name"), tags(F.col("d")), F.coalesce(F.col("d.asDouble"), F.col("d.asInt").cast("double")), F.col("d")).alias("p"))
    h = m.where("histogram is not null").select("name", F.explode("histogram.dataPoints").alias("d"))
    d, n = F.col("d"), F.col("name")
    totals = F.array(row(F.concat(n, F.lit("_count")), tags(d), d["count"], d), row(F.concat(n, F.lit("_sum")), tags(d), d["sum"], d))
    upto = lambda i: F.aggregate(F.slice(d["bucketCounts"], 1, i + 1), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    le = lambda i: F.coalesce(F.get(d["explicitBounds"], i).cast("string"), F.lit("+Inf"))
    buckets = F.transform(d["bucketCounts"], lambda _, i: row(F.concat(n, F.lit("_bucket")), plus(d, "le", le(i)), upto(i), d))
    hist = h.select(F.explode(F.concat(totals, buckets)).alias("p"))
    s = m.where("summary is not null").select("name", F.explode("summary.dataPoints").alias("d"))
    quant = F.transform(d["quantileValues"], lambda x: row(n, plus(d, "quantile", x["quantile"].cast("string")), x["value"], d))
    summ = s.select(F.explode(F.concat(totals, quant)).alias("p"))
    return number("gauge").unionByName(number("sum")).unionByName(hist).unionByName(summ).select("p.*")


def select_metrics(points: DataFrame, include: list[str] = (), exclude: list[str] = (), prefix: str = "") -> DataFrame:
    """Metrics that hold one of ``include`` and none of ``exclude``, with a prefix."""
    m, keep = F.col("metric"), F.lit(True)
    if include:
        keep = F.array_contains(F.array(*[F.contains(m, F.lit(x)) for x in include]), True)
    for x in exclude:
        keep = keep & ~F.contains(m, F.lit(x))
    return points.where(keep).withColumn("metric", F.concat(F.lit(prefix), m))


def remote_write(requests: DataFrame, column: str = "timeseries") -> DataFrame:
    """Points from decoded write requests: an array of (labels [(name, value)], samples [(value, timestamp in ms)]); series without a name are skipped."""
    s = requests.select(F.explode(column).alias("s"))
    name = F.filter("s.labels", lambda x: x["name"] == "__name__")[0]["value"]
    tags = F.map_from_entries(F.transform(F.filter("s.labels", lambda x: x["name"] != "__name__"), lambda x: F.struct(x["name"], x["value"])))
    named = s.where(F.coalesce(F.get(F.filter("s.labels", lambda x: x["name"] == "__name__"), F.lit(0))["value"], F.lit("")) != "")
    return named.select(name.alias("metric"), tags.alias("tags"), F.explode("s.samples").alias("p")).select("metric", "tags", F.col("p.value").alias("value"), (F.col("p.timestamp") * 1_000_000).alias("ts"))


def exposition(lines: DataFrame, column: str = "value", ts: Column | None = None) -> DataFrame:
    """Points from scraped text, a line a row: ``name{k="v",...} value [ms]``; comments are skipped, other lines land in ``bad``."""
    line = F.trim(F.col(column))
    rx = r'^([a-zA-Z_:][\w:]*)(?:\{(.*)\})?\s+([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+|Inf|NaN))(?:\s+(-?\d+))?$'
    part = lambda k: F.regexp_extract(line, rx, k)
    pairs = F.regexp_extract_all(part(2), F.lit(r'(\w+="(?:[^"\\]|\\.)*")'), F.lit(1))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\w+)=", 1), F.regexp_replace(F.regexp_extract(x, r'="(.*)"$', 1), r"\\(.)", "$1"))
    number = F.when(part(3).rlike("Inf"), F.when(part(3).startswith("-"), float("-inf")).otherwise(float("inf"))).when(part(3) == "NaN", float("nan")).otherwise(part(3).try_cast("double"))
    ok = F.rlike(line, F.lit(rx))
    at = F.when(part(4) != "", part(4).try_cast("long") * 1_000_000).otherwise(ts if ts is not None else F.lit(None).cast("long"))
    return lines.where((line != "") & ~line.startswith("#")).select(
        F.when(ok, part(1)).alias("metric"), F.when(ok, F.map_from_entries(F.transform(pairs, pair))).alias("tags"), F.when(ok, number).alias("value"), F.when(ok, at).alias("ts"), F.when(~ok, line).alias("bad")
    )


def typed(rows: DataFrame, kinds: dict[str, str], tags: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Points from wide rows: a column per metric; ``kinds`` says of each column whether it is a gauge or a counter (kept as the tag ``kind``). Nulls are no points."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for c, k in kinds.items()])
    labels = F.map_from_arrays(F.array(*[F.lit(t) for t in (*tags, "kind")]), F.array(*[F.col(t).cast("string") for t in tags], F.col("p.kind")))
    return rows.select(ts, *tags, F.explode(each).alias("p")).where("p.value is not null").select("p.metric", labels.alias("tags"), "p.value", F.col(ts).alias("ts"))


def changes(log: DataFrame, metrics: Sequence[str] = (), operations: Sequence[str] = (), tags: dict[str, str] | None = None) -> DataFrame:
    """Change events (metric, op, tags, ...) that a subscriber wants; an empty list means all.  Works on a table or a stream of changes."""
    out = log.where(F.col("metric").isin(*metrics)) if metrics else log
    out = out.where(F.upper("op").isin(*[o.upper() for o in operations])) if operations else out
    for k, v in (tags or {}).items():
        out = out.where(F.col("tags")[k] == v)
    return out


def replay(df: DataFrame, start: int, end: int, speed: float, now: int, ts: str = "ts") -> DataFrame:
    """Rows of [start, end) with ``emit_at``: when a replay that begins at ``now`` and runs ``speed`` times as fast shows them."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end)).withColumn("emit_at", F.lit(now) + F.floor((F.col(ts) - start) / float(speed)).cast("long"))


def accepted(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points to write, points refused with ``reason``): names and tag keys are checked, values must be numbers."""
    from ..functions.scalars import valid_metric, valid_tag_key

    tags = F.forall(F.map_keys(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), valid_tag_key)
    reason = F.when(~valid_metric(F.col("metric")), "metric").when(~tags, "tag").when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "value")
    judged = points.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def archive(points: DataFrame, path: str, before: int, ts: str = "ts") -> DataFrame:
    """Writes rows older than ``before`` by day, and gives the rows that stay."""
    export(points.where(F.col(ts) < before), path, day_from=ts)
    return points.where(F.col(ts) >= before)


def export(points: DataFrame, path: str, fmt: str = "parquet", day_from: str | None = "ts", bloom: Sequence[str] = (), rows_a_file: int = 5_000_000) -> None:
    """csv, json or parquet; Parquet is laid out by day, so that time ranges prune folders.

    Days are dealt to tasks by ranges of (day, time), so one large day is spread over
    many files; columns in ``bloom`` get Bloom filters, which skip row groups that lack a value.
    """
    if fmt == "parquet" and day_from:
        day = F.to_date(F.timestamp_micros(F.floor(F.col(day_from) / 1000).cast("long")))
        writer = points.withColumn("date", day).repartitionByRange("date", day_from).write.partitionBy("date").option("maxRecordsPerFile", rows_a_file)
        for c in bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.mode("append").parquet(path)
        return
    flat = points.withColumn("tags", F.to_json("tags")) if fmt == "csv" and "tags" in points.columns else points
    writer = flat.write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else getattr(writer, fmt)(path)


def rendered(df: DataFrame, fmt: str = "JSONEachRow") -> DataFrame:
    """One text column per row: JSONEachRow, JSONCompact, TSV or CSV."""
    if fmt == "JSONEachRow":
        return df.select(F.to_json(F.struct("*")).alias("line"))
    if fmt == "JSONCompact":
        return df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("line"))
    if fmt == "CSV":
        return df.select(F.to_csv(F.struct("*")).alias("line"))
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]).alias("line"))


def split_bad(points: DataFrame, known: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows for quarantine)."""
    return points.where(F.coalesce(known, F.lit(False))), points.where(~F.coalesce(known, F.lit(False)))
