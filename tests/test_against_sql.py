"""Rows that the driver's tables lack give what DuckDB gives for the query's SQL."""

import math
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from brontide.analytics import anomaly
from brontide.catalog import QUERIES, SQL
from brontide.llm import minhash_dedup
from brontide.operators import features

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Times whose nanoseconds, divided by a million as doubles, fall below the whole millisecond.
MILLIS = [datetime(2024, 1, 2, 0, 8, 40, 618_000), datetime(2024, 1, 22, 13, 48, 20, 226_000), datetime(2024, 1, 26, 20, 38, 46, 426_000)]


def both(spark, path, name, **tables):
    """The sorted rows of a query and of its SQL over small tables, given as (schema, rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    wanted = con.sql(SQL[name])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    got = QUERIES[name](spark, str(path)).select(wanted.columns).collect()
    return sorted(tuple(map(text, r)) for r in got), sorted(tuple(map(text, r)) for r in wanted.fetchall())


def test_exposition_keeps_milliseconds(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "s10_exposition", events=(EVENTS, [(i, t, 7, "view", 2.5, "{}") for i, t in enumerate(MILLIS)]))
    assert got == wanted and len(got) == len(MILLIS)


def test_remote_write_keeps_milliseconds(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "s9_remote_write", events=(EVENTS, [(i, t, 7, "view", 2.5, "{}") for i, t in enumerate(MILLIS)]))
    assert got == wanted and len(got) == len(MILLIS)


def test_root_causes_tell_suppliers_from_callees(spark, tmp_path):
    calls = [(p, s) for s in (5, 999, 1000, 1003, 1006, 1007) for p in range(s % 4, s % 4 + 3)]
    got, wanted = both(spark, tmp_path, "n20_root_causes", lineitem=("l_partkey long, l_suppkey long", calls), supplier=("s_suppkey long", [(s,) for s in (5, 999, 1000, 1003, 1006, 1007)]))
    assert got == wanted and len(got) > 6


def test_vectors_are_divided_by_zero(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 30)
    pairs = [(1, 4.0, 0.0), (2, 0.0, 0.0), (3, 4.0, 16.0), (4, 4.0, 8.0), (5, 4.0, 7.0), (6, -4.0, 0.0), (7, 4.0, None), (None, 4.0, 1.0)]
    rows = [(10 * i + j, at, u, kind, v, "{}") for i, (u, *vs) in enumerate(pairs) for j, (kind, v) in enumerate(zip(("click", "view"), vs, strict=True))]
    got, wanted = both(spark, tmp_path, "j14_promql_vector_matching", events=(EVENTS, rows))
    assert got == wanted and {r[0] for r in got} == {"1", "2", "5"}


def test_math_of_odd_numbers(spark, tmp_path):
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.4, -0.5, 0.5, 2.5, -2.5, 0.49999999999999994, 9.995, 10.0, 1e300, -1e300, 2.0**53 + 2, 4503599627370497.5, 5e-324]
    got, wanted = both(spark, tmp_path, "x1_math", events=(EVENTS, [(i, MILLIS[0], 7, "view", v, "{}") for i, v in enumerate(odd)]))
    assert got == wanted and len(got) == len(odd)


def test_near_dedup_looks_up_components_not_members(spark, tmp_path, monkeypatch):
    """Of a large group of near copies and its odd ones, no lookup by bucket takes a row for each member."""
    words = [f"w{i}" for i in range(60)]
    copies = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(0, 60, 2)]
    apart = [" ".join([*words[:45], *[f"y{k}{i}" for i in range(8)]]) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate([" ".join(words), *copies, *apart])), "doc_id long, text string")
    sizes, kept = {}, minhash_dedup.materialise

    def counted(df, name="t"):
        out = kept(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "materialise", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_groups(docs).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((r["doc_id"], r["text"].split()) for r in docs.collect())}
    reach = {i: i for i in sets}
    for _ in sets:
        for u in sets:
            for v in sets:
                if 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v]):
                    reach[u] = reach[v] = min(reach[u], reach[v])
    assert got == reach and len(set(reach.values())) > 1
    assert 3 * sizes["apart"][0] < sizes["buckets"][0]


def test_density_clusters_of_many_copies(spark, tmp_path, monkeypatch):
    """Points at one place are no pairs of their own."""
    spots = [(10, 900.0), (10, 902.0), (11, 902.0), (30, 950.0), (30, 970.5), (30, 991.0), (31, 970.5), (50, 999.0), (50, 900.0)]
    part = [(i, *spots[i]) for i in range(len(spots))] + [(100 + i, 10, 904.0) for i in range(3)] + [(200, None, 904.0)] + [(300 + i, 40 + i % 2, 940.0 + i // 2) for i in range(6)]
    got, wanted = both(spark, tmp_path, "n9_dbscan", part=("p_partkey long, p_size int, p_retailprice double", part))
    assert got == wanted and len({r[1] for r in got}) > 2
    sizes, kept = {}, anomaly.written

    def counted(df, name="t"):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(anomaly, "written", counted)
    many = spark.range(1000).select(F.col("id").alias("p_partkey"), (F.col("id") % 2).alias("p_size"), F.lit(930.0).alias("p_retailprice"))
    assert anomaly.dbscan(many, "p_partkey", ["p_size", "p_retailprice"], 1.0, 4).where("cluster = 0").count() == 1000
    assert sizes["pairs"] == 4


def test_nearest_in_parts_and_by_key(spark):
    """Copies at one distance go by id, parts and keys change nothing, rows that cannot be compared are not indexed."""
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = v.where("id % 50 = 0")
    want = {(q, i, round(math.dist(w, x), 9), r) for q, w in rows if q % 50 == 0 for r, (_, i, x) in enumerate(sorted((math.dist(w, x), i, x) for i, x in rows if i != q)[:5], 1)}
    for parts in (1, 3):
        assert {(r["q"], r["id"], round(r["distance"], 9), r["rank"]) for r in features.nearest(v, queries, 5, parts=parts).collect()} == want
    odd = v.unionByName(spark.createDataFrame([(900, None), (950, [1.0]), (1000, [1.0, None, 2.0])], "id long, vector array<float>"))
    index = features.lsh(odd, "id", "vector", 3, 2, 4).cache()
    assert index.count() == 480 and index.select("id").distinct().count() == 120
    keys = {(r["id"], r["table"]): r["key"] for r in index.collect()}
    met = {(q, i) for q in (0, 50, 100) for i in range(120) if i != q and any(keys[q, t] == keys[i, t] for t in range(4))}
    found = {(r["q"], r["id"], r["rank"]) for r in features.ann(index, index.where("id % 50 = 0"), 5).collect()}
    place = dict(rows)
    assert found == {(q, i, r) for q in (0, 50, 100) for r, (_, i) in enumerate(sorted((math.dist(place[q], place[i]), i) for x, i in met if x == q)[:5], 1)}
