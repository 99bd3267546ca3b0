"""Ties, NaN, gaps, missing tags and odd input."""

import math

import pytest
from pyspark.sql import functions as F

from brontide.analytics import forecast as N
from brontide.functions import aggregates as A
from brontide.functions import scalars as X
from brontide.lang import promql, sql
from brontide.operators.series import exponential_average, nearest_rank, neighbours, running
from brontide.lang.durations import duration, epoch, moment
from brontide.lang.others import Engine, builder, clickhouse, correlate, detect, to_promql
from brontide.model import Points, from_map
from brontide.operators import filters, graph, histograms, joins, relabel, sets, windows
from brontide.plans import views
from brontide.plans.query import Agg, TSQuery, plan
from brontide.sources import ingest
from brontide.streaming import engine as T

S = 10**9


def points(spark, rows):
    return Points(spark.createDataFrame(rows, "host string, value double, ts long"), {"host": "host"})


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_durations():
    assert duration("1h30m") == 5400 * S and duration("250ms") == 250_000_000
    assert moment("now() - 1m", 100 * 60 * S) == 99 * 60 * S and moment("2024-01-01T00:00:00Z", 0) == 1_704_067_200 * S
    assert epoch("1704067200", 0) == 1_704_067_200 * S
    for bad in ("", "5", "5x", "m5"):
        with pytest.raises(ValueError):
            duration(bad)


@pytest.mark.parametrize("text", ["", " ", "SELECT", "SELECT FROM m", "SELECT foo(value) FROM m", "SELECT * FROM", "SELECT \0 FROM m", "DROP TABLE m", "SELECT * FROM m WHERE", "SELECT * FROM m LIMIT x", "SELECT * FROM m; DROP"])
def test_bad_sql(text):
    with pytest.raises(ValueError):
        sql.parse(text)


@pytest.mark.parametrize("text", ["", "sum(", "m{", 'm{a="b"', "m[5m", "rate()+", 'm{a>"b"}', "1 +", "m offset", "))"])
def test_bad_promql(text):
    with pytest.raises((ValueError, IndexError)):
        promql.parse(text)


def test_sql_forms():
    q = sql.parse("SELECT count(*), mean(value) AS m FROM cpu WHERE host IN ('a', 'b') AND time >= 5 AND time <= 9 GROUP BY time(5m), host ORDER BY time DESC LIMIT 3 OFFSET 1")
    assert (q.start, q.end, q.window, q.group_by, q.limit, q.offset) == (5, 10, 300 * S, ["host"], 3, 1) and q.aggs[1].alias == "m" and q.order_by == [("time", False)]
    assert sql.parse("SELECT mean(value) FROM m", second_windows=True).window == S
    assert sql.explain("SELECT * FROM a ASOF JOIN b TOLERANCE 5s") == {"metric": "a", "columns": ["*"], "zone": "UTC", "asof": "b", "tolerance": 5 * S}


def test_detect_and_front_ends(spark):
    assert [detect(x) for x in ("SELECT * FROM m", "SELECT mean(value) FROM m WINDOW 5m", "sum(m)", "CORRELATE a WITH b", '{"source": "m"}')] == ["sql", "cql", "promql", "correlate", "builder"]
    assert correlate("CORRELATE metrics WITH traces WHERE service = 'a' AND env != 'b' LIMIT 5")["limit"] == 5
    assert clickhouse("SELECT toStartOfFiveMinutes(time) AS t, max(value) AS m FROM cpu GROUP BY t").window == 300 * S
    assert builder({"source": "m", "filters": [{"field": "host", "op": "=", "value": "a"}]}).where["field"] == "host"
    assert to_promql(sql.parse("SELECT mean(value) FROM m WHERE host = 'a' GROUP BY time(1m), host")) == 'avg(avg_over_time(m{host="a"}[60s])) by (host)'
    e = Engine(spark, {"m": points(spark, [("a", 1.0, 5 * S), ("a", 3.0, 6 * S)])}, now=10 * S)
    assert values(e.query("SELECT sum(value) FROM m"), "sum") == [(4.0,)]
    assert values(e.query("m"), "value") == [(3.0,)]
    assert values(e.query('{"source": "m", "select": [{"function": "max"}]}'), "max") == [(3.0,)]


def test_missing_tags(spark):
    p = from_map(spark.createDataFrame([({"a": "1"}, 1.0, 1), ({}, 2.0, 2)], "tags map<string,string>, value double, ts long"))
    got = lambda op, v: values(p.where(filters.tag_matches(p, "a", op, v)).df, "value")
    assert got("=", "1") == [(1.0,)] and got("!=", "1") == [(2.0,)] and got("in", ["", "1"]) == [(1.0,), (2.0,)] and got("=~", "^$") == [(2.0,)]
    assert values(p.where(filters.tag_is(p, "a", "")).df, "value") == [(2.0,)]
    assert [r[0] for r in p.df.select(p.series_key("m")).collect()] == ["m|a=1", "m|"]
    with pytest.raises(ValueError):
        filters.tag_matches(p, "a", "=~", "x" * 2000)


def test_aggregate_rules(spark):
    p = points(spark, [("a", 1.0, 1), ("a", 9.0, 1), ("a", 5.0, 3), ("b", 7.0, -1), ("c", 4.0, 2)])
    aggs = [Agg(f, f, "value", p_) for f, p_ in (("stddev", None), ("rate", None), ("percentile", 50), ("count", None))]
    got = {r["host"]: r for r in plan(TSQuery("m", aggs, group_by=["host"]), {"m": p}).collect()}
    assert got["b"]["stddev"] == 0 and got["b"]["rate"] == 0 and got["a"]["percentile"] == 5.0 and got["a"]["count"] == 3
    buckets = plan(TSQuery("m", [Agg("count", "n")], window=2), {"m": p})
    assert values(buckets, "bucket", "n") == [(-2, 1.0), (0, 2.0), (2, 2.0)]


def test_counter_kernels(spark):
    df = spark.createDataFrame([(1 * S, 10.0), (2 * S, 14.0), (3 * S, 2.0), (4 * S, 5.0), (5 * S, float("nan"))], "ts long, v double")
    s = A.Steps(F.col("v"), F.col("ts"), F.col("_prev.v"), F.col("_prev.ts"))
    linked = neighbours(df.where(~F.isnan("v")), [], "ts", take=["v"], period=2 * S)
    r = linked.agg(s.rate().alias("rate"), s.increase(10 * S).alias("inc"), s.irate().alias("irate"), s.resets().alias("resets"), s.changes().alias("changes"), s.delta().alias("delta")).first()
    assert (r["rate"], r["inc"], r["irate"], r["resets"], r["changes"], r["delta"]) == (3.0, 12.0, 3.0, 1.0, 3.0, -5.0)
    level, trend = 10.0, 4.0
    for v in (14.0, 2.0, 5.0):
        new = 0.5 * v + 0.5 * (level + trend)
        level, trend = new, 0.5 * (new - level) + 0.5 * trend
    assert df.agg(A.holt_winters(A.samples(F.col("v"), F.col("ts")), 0.5, 0.5)).first()[0] == pytest.approx(level + trend)
    one = linked.limit(1).agg(s.rate().alias("rate"), s.irate().alias("irate")).first()
    assert one["rate"] is None and one["irate"] is None


def test_bucket_quantile(spark):
    rows = [(0.5, 10), (1.0, 30), (float("inf"), 40)]
    df = spark.createDataFrame(rows, "le double, cnt long")
    b = F.array_sort(F.collect_list(F.struct("le", "cnt")))
    r = df.agg(*[A.bucket_quantile(q, b).alias(f"q{i}") for i, q in enumerate((0.0, 0.25, 0.5, 0.9, 1.0))]).first()
    assert [r[f"q{i}"] for i in range(5)] == [0.0, 0.5, 0.75, 1.0, 1.0]


def test_asof_edges(spark):
    left = spark.createDataFrame([("k", 5), ("k", 10), ("k", 99), ("x", 7), (None, 3)], "key string, ts long")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 8, 2.0), ("k", 8, 3.0), ("y", 1, 9.0)], "key string, ts long, value double")
    got = values(joins.asof(left, right, ["key"], ["value"], tie="value", period=10).where("key is not null"), "key", "ts", "right_value")
    assert sorted(got, key=str) == sorted([("k", 5, 1.0), ("k", 10, 3.0), ("k", 99, 3.0), ("x", 7, None)], key=str)
    strict = {r["ts"]: r["right_value"] for r in joins.asof(left, right, ["key"], ["value"], tie="value", inclusive=False).where("key = 'k'").collect()}
    assert strict == {5: None, 10: 3.0, 99: 3.0}
    near = {r["ts"]: r["right_value"] for r in joins.asof(left, right, ["key"], ["value"], tie="value", tolerance=2).where("key = 'k'").collect()}
    assert near == {5: 1.0, 10: 3.0, 99: None}


def test_within_outer(spark):
    a = spark.createDataFrame([("h", 10), ("g", 50)], "k string, ts long")
    b = spark.createDataFrame([("h", 12), ("h", 40)], "k string, ts long")
    assert values(joins.within(a, b, ["k"], 5), "l_ts", "r_ts") == [(10, 12)]
    full = {(r["l_ts"], r["r_ts"]) for r in joins.within(a, b, ["k"], 5, "full").collect()}
    assert full == {(10, 12), (50, None), (None, 40)}
    assert values(joins.within(a, b, [], 10), "l_ts", "r_ts") == [(10, 12), (50, 40)]


def test_gap_fill(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 30, 4.0), ("b", 10, 7.0)], "k string, bucket long, value double")
    fill = lambda **x: {r["bucket"]: r["value"] for r in windows.gap_fill(df, ["k"], 10, **x).where("k = 'a'").collect()}
    assert fill() == {0: 1.0, 10: 2.0, 20: 3.0, 30: 4.0} and fill(method="previous")[20] == 1.0 and fill(method="zero")[10] == 0.0
    assert fill(max_gap=20)[10] is None and windows.gap_fill(df, ["k"], 10).where("k = 'b'").count() == 1


def test_calendar_and_hopping(spark):
    df = spark.createDataFrame([(1_711_846_800 * S,)], "ts long")  # 2024-03-31 01:00 UTC, the day the clocks change in Berlin
    assert df.select(windows.calendar(F.col("ts"), "day", "Europe/Berlin").alias("d")).first()["d"] == 1_711_839_600 * S
    assert sorted(df.select(F.explode(windows.hopping(F.lit(25), 20, 10)).alias("s")).toPandas()["s"]) == [10, 20]


def test_sets_and_versions(spark):
    v = spark.createDataFrame([("a", 1, "INSERT", 1.0), ("a", 3, "DELETE", 1.0), ("b", 2, "UPDATE", 5.0)], "k string, version_ts long, op string, value double")
    assert values(sets.as_of(v, ["k"], 2), "k") == [("a",), ("b",)] and values(sets.as_of(v, ["k"], 9), "k") == [("b",)]
    x = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double")
    y = spark.createDataFrame([(2, 3.0), (3, 4.0)], "k int, value double")
    assert values(sets.diff(x, y, ["k"]), "k", "change") == [(1, "removed"), (2, "modified"), (3, "added")]
    assert values(sets.either(x, y, ["k"]), "k") == [(1,), (2,), (3,)]


def test_scalars(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first()["x"]
    assert math.isnan(f(X.divide(F.lit(1.0), F.lit(0.0)))) and math.isnan(f(X.MATH["ln"](F.lit(-1.0)))) and f(X.MATH["ln"](F.lit(0.0))) == -math.inf
    assert f(X.derived("ratio", F.lit(1.0), F.lit(0.0))) == 0 and math.isnan(f(X.clamp(F.lit(1.0), 5, 1)))
    import hashlib
    import hmac

    assert f(X.hmac_sha256(F.lit("abc"), "key")) == hmac.new(b"key", b"abc", hashlib.sha256).hexdigest()
    assert f(X.geohash(F.lit(57.64911), F.lit(10.40744), 8)) == "u4pruydq"
    lat, lon = X.geohash_center("u4pruydq")
    assert abs(lat - 57.649) < 1e-2 and abs(lon - 10.407) < 1e-2
    assert f(X.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111_194.9, abs=1)
    assert f(X.in_box(F.lit(0.0), F.lit(179.5), -1, 179, 1, -179)) is True


def test_line_protocol_and_statsd(spark):
    lines = spark.createDataFrame([(x,) for x in ("cpu,host=a\\ b usage=1.5,idle=2i 7", "mem value=3", "bad line here", "cpu,host=a f=\"text\" 5", "# note", "")], "value string")
    got = sorted(((r["metric"], r["value"], r["ts"], (r["tags"] or {}).get("host")) for r in ingest.line_protocol(lines).collect()), key=str)
    assert ("cpu.usage", 1.5, 7, "a b") in got and ("cpu.idle", 2.0, 7, "a b") in got and ("mem", 3.0, None, None) in got and len(got) == 5
    s = spark.createDataFrame([("a:4|c|@0.5|#k:v",), ("b:1.5|g",), ("nope",)], "value string")
    assert sorted(((r["metric"], r["value"], r["bad"]) for r in ingest.statsd(s).collect()), key=str) == sorted([("a", 8.0, None), ("b", 1.5, None), (None, None, "nope")], key=str)


def test_otlp(spark):
    doc = '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"g","gauge":{"dataPoints":[{"attributes":[{"key":"h","value":{"stringValue":"a"}}],"timeUnixNano":"5","asDouble":1.5}]}},{"name":"h","histogram":{"dataPoints":[{"timeUnixNano":"6","count":"3","sum":4.0,"bucketCounts":["1","2"],"explicitBounds":[0.5]}]}},{"name":"s","summary":{"dataPoints":[{"timeUnixNano":"7","count":"2","sum":3.0,"quantileValues":[{"quantile":0.5,"value":1.0}]}]}}]}]}]}'
    got = {(r["metric"], r["tags"].get("le") or r["tags"].get("quantile")): r["value"] for r in ingest.otlp_json(spark.createDataFrame([(doc,)], "value string")).collect()}
    assert got == {("g", None): 1.5, ("h_count", None): 3.0, ("h_sum", None): 4.0, ("h_bucket", "0.5"): 1.0, ("h_bucket", "+Inf"): 3.0, ("s_count", None): 2.0, ("s_sum", None): 3.0, ("s", "0.5"): 1.0}


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.5, 86_400 * S)], "metric string, value double, ts long")
    ingest.export(df, f"file://{tmp_path}/p")
    assert values(spark.read.parquet(f"file://{tmp_path}/p"), "metric", "value", "ts") == [("m", 1.5, 86_400 * S)]


def test_relabel_scope(spark):
    df = spark.createDataFrame([("cpu", {"a": "1", "b": "2"}), ("mem", {"a": "1"})], "metric string, tags map<string,string>")
    out = {r["metric"]: r["tags"] for r in relabel.relabel(df, [{"action": "keep", "keys": ["a"]}, {"action": "rename", "key": "a", "to": "z", "metric": "^cpu"}]).collect()}
    assert out == {"cpu": {"z": "1"}, "mem": {"a": "1"}}


def test_graph_and_cycles(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "x"), (1, 4, "y")], "src long, dst long, type string")
    assert values(graph.reach(e, [1], 5, "x"), "node", "hops") == [(1, 0), (2, 1), (3, 2)]
    assert views.cycles({"a": ["b"], "b": ["c"], "c": ["a"]}) == ["a", "b", "c", "a"] and views.cycles({"a": ["b"]}) is None


def test_views(spark):
    assert views.parse("CREATE CONTINUOUS AGGREGATE v AS SELECT mean(value) FROM m GROUP BY time(1h), host")[1].window == 3600 * S
    assert views.parse("DROP CONTINUOUS AGGREGATE v") == ("drop", "v")
    with pytest.raises(ValueError):
        views.parse("CREATE VIEW v")
    v = views.View("v", "m", 60 * S, ["host"])
    assert not views.answers(v, TSQuery("m", [Agg("percentile", "p")], window=60 * S)) and not views.answers(v, TSQuery("m", [Agg("sum", "s")], window=90 * S))


def test_refresh(spark, tmp_path):
    p = points(spark, [("a", 1.0, 5 * S), ("a", 2.0, 86_400 * S + 5 * S)])
    v = views.View("v", "m", 60 * S, ["host"])
    views.refresh(spark, v, p, f"file://{tmp_path}/v")
    more = points(spark, [("a", 1.0, 5 * S), ("a", 2.0, 86_400 * S + 5 * S), ("a", 4.0, 86_400 * S + 6 * S)])
    views.refresh(spark, v, more, f"file://{tmp_path}/v", since=86_400 * S)
    assert values(spark.read.parquet(f"file://{tmp_path}/v"), "bucket", "sum") == [(0, 1.0), (86_400 * S, 6.0)]


def test_histograms(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, -4.0, 0.0)], "k string, value double")
    h = histograms.exponential(df, ["k"], schema=0)
    assert values(h, "sign", "idx", "cnt") == [(-1, 2, 1), (0, 0, 1), (1, 0, 1), (1, 1, 2)]
    assert histograms.classic_to_exponential([1, 2, 4], [1, 0, 3], 0) == {0: 1, 2: 3}
    assert sum(r["cnt"] for r in histograms.equi_depth(df, 3).collect()) == 5


def test_forecasts():
    import numpy as np

    line = np.arange(10.0)
    assert N.holt(line, 0.5, 0.5, 2)[1] == pytest.approx([10, 11])
    assert N.trend_season(line, 2)["forecast"].iloc[0] == pytest.approx(10, abs=1.5)
    wave = np.tile([1.0, 5.0, 2.0, 9.0, 4.0, 3.0], 8)
    assert N.seasonal_period(wave) == 6 and N.seasonal_period(np.ones(9)) == 4
    assert N.holt_winters(wave, 6, 0.3, 0.1, 0.1, 6) == pytest.approx(wave[:6], rel=0.2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = np.r_[0, x[:-1]] + rng.normal(size=200) * 0.1
    assert N.granger(x, y) > 50 > 5 > N.granger(y, rng.normal(size=200))


def test_promql_forms(spark):
    p = points(spark, [("a", float(i), i * 60 * S) for i in range(1, 11)] + [("b", 10.0 * i, i * 60 * S) for i in range(1, 11)])
    e = promql.Evaluator({"m": p})
    at = lambda text: sorted((r.asDict().get("host"), r["value"]) for r in e.instant_query(text, 600 * S).collect())
    assert at("m") == [("a", 10.0), ("b", 100.0)] and at('m{host=~"a|x"} + 2 * 3') == [("a", 16.0)]
    assert at("sum(m)") == [(None, 110.0)] and at("sum without (host) (m)") == [(None, 110.0)] and at("topk(1, m)") == [("b", 100.0)]
    assert at("m > 50") == [("b", 100.0)] and at("m > bool 50") == [("a", 0.0), ("b", 1.0)]
    assert at("m and m > 50") == [("b", 100.0)] and at('m or m{host="a"}') == [("a", 10.0), ("b", 100.0)]
    assert at('m{host="a"} offset 2m') == [("a", 8.0)]
    assert at('delta(m{host="a"}[5m])') == [("a", 4.0)] and at("2 ^ 3 ^ 0 * vector(1)") == [(None, 2.0)]
    assert at('absent(m{host="zz"})') == [("zz", 1.0)] and at("clamp(m, 20, 50)") == [("a", 20.0), ("b", 50.0)]
    assert at('label_replace(m{host="a"}, "host", "x-$1", "host", "(.*)")') == [("x-a", 10.0)]
    assert at("quantile(0.5, m)") == [(None, 55.0)] and at("-m") == [("a", -10.0), ("b", -100.0)]


def test_pipeline_and_routes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 9.0)], "k string, value double")
    routes = T.Pipeline(df).filter(F.col("value") > 0).route({"high": F.col("value") > 4, "a": F.col("k") == "a"})
    assert {k: v.count() for k, v in routes.items()} == {"high": 2, "a": 1, "other": 0}


def test_time_range_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    p = points(spark, [("a", float(i), i * S) for i in range(200)])

    @settings(max_examples=8, deadline=None)
    @given(st.integers(-5, 210), st.integers(-5, 210))
    def check(a, b):
        got = {r["ts"] // S for r in plan(TSQuery("m", start=a * S, end=b * S), {"m": p}).collect()}
        assert got == {i for i in range(200) if a <= i < b}

    check()


def test_series_across_periods(spark):
    """Neighbours, running sums, exact ranks and averages do not notice how a series is cut."""
    import random

    rnd = random.Random(4)
    rows = [("ab"[i % 3 == 0], rnd.randrange(50), i, float(rnd.randrange(9))) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, ts long, i long, v double").repartition(3)
    for period in (1, 7, 1000):
        got = {r["i"]: r for r in running(neighbours(df, ["k"], "ts", ["i"], ["v"], period, "p", "n"), ["k"], F.col("v"), "s", "ts", ["i"], period).collect()}
        for key in "ab":
            own = sorted((t, i, v) for k, t, i, v in rows if k == key)
            for j, (_, i, _) in enumerate(own):
                near = lambda n: None if not 0 <= n < len(own) else (own[n][0], own[n][2])  # noqa: E731, B023
                assert [None if got[i][c] is None else tuple(got[i][c]) for c in "pn"] == [near(j - 1), near(j + 1)] and got[i]["s"] == sum(x[2] for x in own[: j + 1])
    for p in (1, 33, 50, 90, 100):
        for key, v in values(nearest_rank(df, ["k"], "v", p), "k", "percentile"):
            own = sorted(x[3] for x in rows if x[0] == key)
            assert v == own[round(p / 100 * (len(own) - 1) + 1e-9)]
    assert nearest_rank(df, [], "v", 50).count() == 1
    out = exponential_average(df.withColumnRenamed("k", "key"), ["key"], 0.3, "v", "ts", ["i"], block=7)
    got = {(r["key"], r["k"]): r["ema"] for r in out.collect()}
    for key in "ab":
        e = None
        for n, (_, _, v) in enumerate(sorted((t, i, v) for k, t, i, v in rows if k == key), 1):
            e = v if e is None else 0.3 * v + 0.7 * e
            assert got[key, n] == pytest.approx(e)


def test_promql_matching(spark):
    rows = [("a", "x", 0, 8.0), ("a", "y", 0, 2.0), ("b", "x", 0, 4.0)]
    m = Points(spark.createDataFrame(rows, "host string, dc string, ts long, value double"), {"host": "host", "dc": "dc"})
    n = Points(spark.createDataFrame([("a", 0, 10.0), ("b", 0, 100.0)], "host string, ts long, value double"), {"host": "host"})
    e = promql.Evaluator({"m": m, "n": n})
    ask = lambda q: sorted(tuple(r[c] for c in sorted(x for x in r.__fields__ if x != "t")) for r in e.instant_query(q, 0).collect())
    assert ask("m / sum(m)") == [] and ask("sum(m) / sum(m)") == [(1.0,)]
    assert ask("sum by (host) (m) + n") == [("a", 20.0), ("b", 104.0)]
    assert ask("m * on(host) group_left n") == [("x", "a", 80.0), ("x", "b", 400.0), ("y", "a", 20.0)]
    assert ask("n - ignoring(dc) group_right m") == [("x", "a", 2.0), ("x", "b", 96.0), ("y", "a", 8.0)]
    assert ask("m and on(host) (n > 50)") == [("x", "b", 4.0)]
    assert ask("m unless on(host) (n > 50)") == [("x", "a", 8.0), ("y", "a", 2.0)]
    with pytest.raises(Exception, match="several series"):
        ask("m * on(host) n")
    assert ask("-n ^ 2") == [("a", -100.0), ("b", -10000.0)] and ask("2 ^ 3 ^ 2 * sum(n) / sum(n)") == [(512.0,)]
    assert ask("count_values(\"v\", m)") == [("2", 1.0), ("4", 1.0), ("8", 1.0)]
    assert ask("vector(time())") == [(0.0,)] and ask("absent(m{host=\"z\"})") == [("z", 1.0)] and ask("scalar(n) * 2")[0][0] != ask("scalar(n) * 2")[0][0]
    assert promql.label_names({"m": m, "n": n}) == ["__name__", "dc", "host"] and values(promql.label_values({"m": m}, "dc"), "value") == [("x",), ("y",)]
    assert promql.series({"m": m}, 'm{dc="y"}').collect()[0].asDict() == {"__name__": "m", "dc": "y", "host": "a"}
    made = promql.recorded({"m": m}, [promql.Rule("s", "sum by (host) (m)", {"job": "r"}), promql.Rule("t", "s * 2")], 0)
    assert values(made["t"].df, "metric", "host", "job", "ts", "value") == [("t", "a", "r", 0, 20.0), ("t", "b", "r", 0, 8.0)]


def test_to_promql_forms():
    say = lambda q: to_promql(sql.parse(q))
    assert say("SELECT sum(value) FROM m WHERE host = 'a' OR host = 'b'") == 'sum(m{host="a"}) or sum(m{host="b"})'
    assert say("SELECT sum(value) FROM m WHERE host IN ('a', 'b.c')") == 'sum(m{host=~"a|b\\.c"})'
    assert say("SELECT sum(value) FROM m WHERE value > 5") == "sum(m > 5)"
    promql.parse(say("SELECT sum(value) FROM m WHERE value > 5 AND host = 'a'"))


def test_correlate_runs(spark):
    a = Points(spark.createDataFrame([("t1", "s", 10, 1.0), ("t2", "s", 20, 2.0)], "trace_id string, service string, ts long, value double"), {"trace_id": "trace_id", "service": "service"})
    b = Points(spark.createDataFrame([("t1", "u", 10 + 2 * S, 5.0), ("t9", "u", 10, 6.0)], "trace_id string, service string, ts long, value double"), {"trace_id": "trace_id", "service": "service"})
    e = Engine(spark, {"metrics": a, "traces": b})
    assert values(e.query("CORRELATE metrics WITH traces WITHIN 5s"), "l_value", "r_value") == [(1.0, 5.0)]
    assert e.query("CORRELATE metrics WITH traces WITHIN 1s").count() == 0 and e.query("CORRELATE metrics WITH traces WHERE metrics.service = 'x'").count() == 0


def test_isolation_forest_finds_planted_rows(spark):
    from brontide.analytics.anomaly import isolation_scores

    rows = [(i, (i * 37 % 100) / 100.0, (i * 61 % 100) / 100.0) for i in range(400)] + [(1000, 9.0, 9.0), (1001, -8.0, 7.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = isolation_scores(df, "id", ["x", "y"], trees=12, sample=64)
    top = [r["id"] for r in got.orderBy(F.col("score").desc()).limit(2).collect()]
    assert sorted(top) == [1000, 1001] and got.where("score < 0 or score > 1").count() == 0
    assert isolation_scores(df.limit(0), "id", ["x", "y"]).count() == 0


def test_stream_dialect():
    from brontide.streaming import dialect

    q = dialect.parse("SELECT COUNT(*) AS cnt, AVG(value) FROM cpu.usage WHERE value > 80 GROUP BY host WINDOW SLIDING 10m SLIDE 1m HAVING cnt > 2 LATENESS 5s UPDATE EMIT TO cpu.avg")
    assert (q.source, q.group_by, q.window, q.target, q.late, q.lateness) == ("cpu.usage", ["host"], {"kind": "hopping", "size": 600 * S, "slide": 60 * S}, "cpu.avg", "update", 5 * S)
    assert [f[2] for f in q.fields] == ["cnt", "avg_value"] and dialect.mode(q) == "update"
    assert dialect.parse("SELECT SUM(value) FROM m WINDOW HOPPING SIZE 10 MINUTES ADVANCE 1 MINUTE").window["slide"] == 60 * S
    assert dialect.parse("SELECT COUNT(*) FROM e WINDOW SESSION SIZE 30 SECONDS EMIT FINAL").window["gap"] == 30 * S
    assert dialect.parse("PATTERN spike (a.b, c.d) WITHIN 5m") == dialect.Pattern("spike", ["a.b", "c.d"], 300 * S)
    assert dialect.parse("ON ANY INTO m WHERE value >= 5 EMIT ALERT too hot") == dialect.Rule("any", "m", ">=", 5.0, "alert", "too hot")
    for bad in ("SELECT * WHERE value > 0", "ON INSERT WHERE host = 5", "SELECT foo(x) FROM m", "SELECT * FROM m WINDOW TUMBLING", "DROP x", "SELECT * FROM m EMIT SOMETIMES"):
        with pytest.raises(ValueError):
            dialect.parse(bad)


def test_outer_range_join_keeps_equal_rows(spark):
    """Rows that are alike each keep their place, with and without a partner."""
    a = spark.createDataFrame([("k", 0), ("k", 0), ("k", 100), ("z", 0)], "k string, ts long")
    b = spark.createDataFrame([("k", 5), ("k", 500), ("k", 500)], "k string, ts long")
    got = [(r["l_k"], r["l_ts"], r["r_ts"]) for r in joins.within(a, b, ["k"], 10, "full").collect()]
    assert sorted(got, key=str) == sorted([("k", 0, 5), ("k", 0, 5), ("k", 100, None), ("z", 0, None), (None, None, 500), (None, None, 500)], key=str)
