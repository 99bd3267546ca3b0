"""MinHash near-dedup with tensored banding.

Two small collections of ``tables`` half keys (each of ``rows`` minhashes) are
computed per document; the table keys are all pairs of a half key of the first
and one of the second collection, so ``tables**2`` tables need only
``2 * tables * rows`` minhashes.  With 16 and 3 a pair of similarity 0.75 has no
common table with probability 0.0003, one of 0.8 with 0.00002.

Half keys that only one class has are dropped before pairs are formed, so most
documents never reach the tables.  Equal shingle sets are one class from the
start.  In every table bucket the members are first compared with one of them, the
one whose half keys most classes share (a star, never all pairs), unless their sizes
rule a link out.  Where members other than that one still lie in different components,
the members of these components are compared with each other, in pairs that share one
of the rarest shingles of both sets, as any two similar sets do.  So every pair that shares a table is linked,
ruled out on its full shingle sets (64-bit hashes), or within one component already.

``exact_links`` needs no tables: all links, by the shared rarest shingles of all
classes.  It reads and shuffles every shingle of every class.

Only the texts of documents that share a half key are read again: a one-probe Bloom
filter of ``BLOOM`` bits (2 MB, broadcast as at most ``BLOOM / 64`` rows) keeps most
others out of that shuffle; it may let rows through, never drops one.  No other table
is broadcast: joins of tables that grow with the data ask for a merge.

Defined cases: a text without words, or null, has an empty set and is linked with
nothing; ids are integers (any other type raises TypeError); with fewer than ``shingle`` words the whole sequence is the only
shingle; ties cannot arise, the smallest id represents a group; a repeated id is
one document in links and a row each in the result; a row with a null id is kept
and linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, discard, integer_ids, materialise, spread_join
from .components import components
from .hashing import Segments, U, Words, blocks, mix

SHINGLE, TABLES, ROWS = 5, 16, 3
#: Bits of the filter of wanted ids.
BLOOM = 1 << 24


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block of texts, and each text's bounds in them."""
    count = words.last - words.first
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.first, each)
    length = np.repeat(np.minimum(count, k), each)
    return Segments(words.hash).of(start, start + length), bounds


def _signatures(k: int, tables: int, rows: int):
    rng = np.random.default_rng(7)
    flip, times = (rng.integers(0, 1 << 63, 2 * tables * rows, dtype=np.int64).astype(U) for _ in range(2))
    times |= U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, texts in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                grams, bounds = _shingles(Words(texts, lower=True), k)
                full = np.flatnonzero(bounds[1:] > bounds[:-1])
                n, k1, k2 = (np.zeros(len(texts), np.int64) for _ in range(3))
                for j in full:
                    own = np.unique(grams[bounds[j] : bounds[j + 1]])
                    n[j] = len(own)
                    k1[j] = mix(own).sum(dtype=U).view(np.int64)
                    k2[j] = mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)
                half = np.zeros((len(texts), 2 * tables), np.int64)
                if len(full):
                    for t in range(2 * tables):
                        key = np.full(len(full), t, U)
                        for r in range(t * rows, t * rows + rows):
                            least = mix(np.minimum.reduceat((grams ^ flip[r]) * times[r], bounds[full]))
                            key = mix(key * U(31) + least)
                        half[full, t] = key.view(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(half.ravel()), 2 * tables).cast(pa.list_(pa.int64()))
                yield pa.record_batch([ids.slice(i, len(texts)), pa.array(n), pa.array(k1), pa.array(k2), flat], ["d", "n", "k1", "k2", "half"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, texts in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                grams, bounds = _shingles(Words(texts, lower=True), k)
                sets = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch([ids.slice(i, len(texts)), pa.array(sets, pa.list_(pa.int64()))], ["d", "s"])

    return run


def _only(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``slim`` whose ``d`` is in ``wanted`` (distinct), one a ``d``."""
    bit = F.pmod(F.xxhash64("d"), F.lit(BLOOM))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    # at most BLOOM / 64 rows of two numbers, whatever the input
    filled = wanted.select(F.shiftright(bit, 6).alias("_w"), one(bit).alias("_x")).groupBy("_w").agg(F.bit_or("_x").alias("_x"))
    passed = slim.withColumn("_w", F.shiftright(bit, 6)).join(F.broadcast(filled), "_w").where(F.col("_x").bitwiseAND(one(bit)) != 0).select(slim.columns)
    # an inner join: a semi join would be pushed below the filter
    return passed.join(wanted.hint("merge"), "d").dropDuplicates(["d"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough.  The set of a ``u`` of many pairs is copied to few tasks, not to each pair."""
    known = pairs.join(sets.select(F.col("d").alias("v"), F.col("s").alias("sv")).hint("merge"), "v")
    joined = spread_join(known, sets.select(F.col("d").alias("u"), F.col("s").alias("su")), "u", "v")
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    total = F.size("su") + F.size("sv")
    return joined.where(100 * both >= percent * (total - both)).select("u", "v")


def _close(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of (d, c, s) rows of different components c whose sets s may be similar enough.

    Two similar sets share an element among the first few of each, in any common
    order; with the rarest elements first that leaves few pairs, and the places of
    the shared element bound the intersection.  No similar pair is missed.  In each
    element's list, rows of its largest component are not paired with one another.
    """
    n = F.col("n")
    items = sets.select("d", "c", F.size("s").alias("n"), F.explode("s").alias("w"))
    often = materialise(items.groupBy("w").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    known = items.join(often.hint("merge"), "w").groupBy("d", "c", "n").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("r"))
    # Elements of one set only come first of all: they take places, but join with nothing.
    alone = n - F.size("r")
    longer, shorter = n - F.ceil(n * percent / 100) + 1, n - F.ceil(2 * n * percent / (100 + percent)) + 1
    first = known.select("d", "c", "n", alone.alias("alone"), shorter.cast("int").alias("most"), F.slice("r", 1, F.greatest(longer.cast("int") - alone, F.lit(0))).alias("r"))
    heads = materialise(first.select("d", "c", "n", "most", "alone", F.posexplode("r").alias("i", "r")).select("d", "c", "n", "most", (F.col("alone") + F.col("i")).alias("at"), "r.w"), "heads")
    discard(often)
    sizes = heads.groupBy("w", "c").agg(F.count(F.lit(1)).alias("k"))
    lists = materialise(sizes.groupBy("w").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("cs")).where("cs > 1").select("w", F.col("m.c").alias("main")), "lists")
    shared = materialise(heads.join(lists.hint("merge"), "w"), "heads")
    discard(heads, lists)
    u, v = (shared.select("w", *[F.col(x).alias(f"{side}_{x}") for x in ("d", "c", "n", "most", "at", "main")]) for side in "uv")
    before = (F.col("u_n") < F.col("v_n")) | ((F.col("u_n") == F.col("v_n")) & (F.col("u_d") < F.col("v_d")))
    rest = F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at"))
    fits = (
        (F.col("u_c") != F.col("v_c"))
        & F.when(before, F.col("u_at") < F.col("u_most")).otherwise(F.col("v_at") < F.col("v_most"))
        & (100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
        & ((100 + percent) * rest >= percent * (F.col("u_n") + F.col("v_n")))
    )
    pairs = materialise(u.where("u_c != u_main").join(v.hint("merge"), "w").where(fits).select(F.least("u_d", "v_d").alias("u"), F.greatest("u_d", "v_d").alias("v")).distinct(), "pairs")
    discard(shared)
    return pairs


def _base(docs: DataFrame, id_col: str, text_col: str, shingle: int, tables: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id and text, a row per row with its set's size and hashes, a row per class of equal sets with its half keys)."""
    arrow_batches(docs.sparkSession)
    integer_ids(docs, id_col)
    slim = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    every = materialise(slim.mapInArrow(_signatures(shingle, tables, rows), "d long, n long, k1 long, k2 long, half array<long>"), "minhash")
    filled = every.where("n > 0 and d is not null")
    classes = materialise(filled.groupBy("k1", "k2", "n").agg(F.min("d").alias("d"), F.first("half").alias("half")), "classes")
    base = materialise(every.select("d", "n", "k1", "k2"), "base")
    discard(every)
    return slim, base, classes


def exact_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """(u, v): all links between the smallest ids of the classes of equal sets, without tables."""
    slim, _, classes = _base(docs, id_col, text_col, shingle, 1, 1)
    sets = materialise(_only(slim, classes.select("d")).mapInArrow(_sets(shingle), "d long, s array<long>"), "sets")
    return _confirmed(_close(sets.withColumn("c", F.col("d")), percent), sets, percent)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE, tables: int = TABLES, rows: int = ROWS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    id_type = docs.schema[id_col].dataType
    slim, base, classes = _base(docs, id_col, text_col, shingle, tables, rows)
    # a half key's table is hashed into it; its lowest bit tells the collection
    second = lambda h, i: h.bitwiseAND(F.lit(-2)) + (i >= tables).cast("long")
    halves = classes.select("d", "n", F.explode(F.transform("half", second)).alias("h"))
    # counts are written first: a join of two plain exchanges is one whose hot keys Spark can split
    common = materialise(halves.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "common")
    own = halves.join(common.hint("merge"), "h").groupBy("d", "n").agg(
        F.collect_list(F.when(F.col("h") % 2 == 0, F.col("h"))).alias("x"), F.collect_list(F.when(F.col("h") % 2 != 0, F.col("h"))).alias("y"), F.sum("c").alias("w")
    )
    keyed = materialise(
        own.select("d", "n", "w", "y", F.explode("x").alias("a")).select("d", "n", "w", "a", F.explode("y").alias("b")).select("d", "n", "w", F.xxhash64("a", "b").alias("key")), "tables"
    )
    discard(common)
    named = classes.select("k1", "k2", "n", "d")
    leader = F.max(F.struct("w", (-F.col("d")).alias("d"), "n"))
    leaders = materialise(keyed.groupBy("key").agg(leader.alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", (-F.col("m.d")).alias("u"), F.col("m.n").alias("u_n")), "leaders")
    members = materialise(keyed.join(leaders.hint("merge"), "key").where("d != u").select("key", "d", "n", "u", "u_n"), "buckets")
    discard(keyed, leaders)
    alike = 100 * F.least("n", "u_n") >= percent * F.greatest("n", "u_n")
    star = materialise(members.where(alike).select(F.least("d", "u").alias("u"), F.greatest("d", "u").alias("v")).distinct(), "stars")
    # a set is wanted if a star needs it, or a bucket of more than two that may stay apart; only members that no star needs are looked up
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    wanted = star.select(F.col("u").alias("d")).unionByName(star.select(F.col("v").alias("d"))).unionByName(members.where(~alike).join(several.hint("merge"), "key", "left_semi").select("d"))
    wanted = materialise(wanted.distinct(), "wanted")
    sets = materialise(_only(slim, wanted).mapInArrow(_sets(shingle), "d long, s array<long>"), "sets")
    discard(wanted)
    links = materialise(_confirmed(star, sets, percent), "links")
    found = components(links, "u", "v")
    # What the stars left apart: components that share a bucket, the star's centre aside, whose pairs are all settled.  One row a
    # bucket and component is looked up, not one a member; all members of such components are compared.
    component = found.withColumnRenamed("node", "d").hint("merge")
    apart = members.select("key", "d").join(component, "d", "left").select("key", F.coalesce("component", "d").alias("c")).distinct()
    apart = materialise(apart, "apart")
    split = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    unsettled = materialise(apart.join(split.hint("merge"), "key", "left_semi").select("c").distinct(), "unsettled")
    own = sets.select("d").join(component, "d", "left").select("d", F.coalesce("component", "d").alias("c"))
    open_ = spread_join(own, unsettled, "c", "d").select("d", "c")
    open_ = materialise(sets.join(open_.hint("merge"), "d"), "open")
    discard(apart, members, sets, unsettled)
    pairs = _close(open_, percent).join(star.hint("merge"), ["u", "v"], "left_anti")
    more = materialise(_confirmed(pairs, open_, percent), "links")
    if not more.isEmpty():
        both = materialise(links.unionByName(more), "links")
        found = components(both, "u", "v")
    discard(star, open_, links, more)
    of = named.join(found.withColumnRenamed("node", "d").hint("merge"), "d", "left").select("k1", "k2", "n", F.coalesce("component", "d").alias("c"))
    of = materialise(of, "named")
    discard(classes)
    out = base.join(of.hint("merge"), ["k1", "k2", "n"], "left").withColumn("c", F.when(F.col("d").isNotNull() & (F.col("n") > 0), F.coalesce("c", "d")).otherwise(F.col("d")))
    return out.select(
        F.col("d").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("c").cast(id_type).alias("component_id"), F.coalesce(F.col("d") == F.col("c"), F.lit(True)).alias("kept")
    )
