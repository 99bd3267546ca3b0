"""Document fingerprints: SimHash (DataFrame operations only).

Terms are pairs of neighbouring words (lower-cased; the last word also stands
alone), weighted by how often they occur.  Each term's 64-bit hash votes with its
bits.  The 64 vote counters of a document are kept as 32 long sums with two
32-bit lanes each, so that a document costs one hash aggregate that is complete
before anything is shuffled; bit k is set if more than half of the votes are.

``within`` finds all fingerprints within a Hamming radius by permuted block
tables: the 64 bits are cut into ``radius + 2`` blocks, of which two always agree;
every pair of blocks keys one table.  A table's bucket is never paired with itself: the
queries, one row in ``EVERY``, meet all fingerprints.

Defined cases: null counts as empty, and the empty text is one empty term; equal texts
have equal fingerprints; fewer than two words make one term; an empty table gives no
rows; rows are ordered by id (null last), then by the text's hash, so rows of one id are
rows of their own, each followed by the next, and rows of one id and one text are
followed by one another; ids are integers (any other type raises TypeError); extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import integer_ids, materialise

#: The search takes the documents whose id this divides as queries, and counts neighbours at most RADIUS bits away.
EVERY, RADIUS = 50, 3
_LANES = 0x0000000100000001


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(""))))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys ..., fp): the fingerprint of each row's text as a long; keys must be unique."""
    terms = texts.select(*keys, F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES))).alias(f"v{k}") for k in range(32)]
    voted = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes)
    bits = []
    for k in range(64):
        lane = F.col(f"v{k % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(f"v{k % 32}", 32)
        bits.append(F.when(2 * lane > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    joined = [reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + 16]) for i in range(0, 64, 16)]
    return voted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), joined).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


_KEY = ["z", "d", "x"]


def following(rows: DataFrame) -> DataFrame:
    """Adds the key (n_z, n_d, n_x) of the next row by (z, d, x) to distinct keys; the first follows the last.

    Rows are dealt to ranges of about equal size; the ends of the ranges (one row a
    partition) are linked in one small window.
    """
    part = materialise(rows.repartitionByRange(*_KEY).withColumn("_b", F.spark_partition_id()), "ranges")
    key = F.struct(*_KEY)
    heads = part.groupBy("_b").agg(F.min(key).alias("head"))
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("_b", F.coalesce(F.lead("head").over(Window.orderBy("_b")), F.first("head").over(whole)).alias("head"))
    inside = part.withColumn("_n", F.lead(key).over(Window.partitionBy("_b").orderBy(*_KEY)))
    linked = inside.join(after, "_b").withColumn("_n", F.coalesce("_n", "head"))
    return linked.select(*rows.columns, *[F.col(f"_n.{k}").alias(f"n_{k}") for k in _KEY])


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text (see the query's contract), next to the following document's.

    ``n_near``: for ids that ``EVERY`` divides, how many other fingerprints of the table lie within ``RADIUS`` bits; else null.
    """
    integer_ids(docs, id_col)
    kind = docs.schema[id_col].dataType
    d, t = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(d.isNull().cast("int").alias("z"), F.coalesce(d, F.lit(0)).alias("d"), F.xxhash64(t).alias("x"), t.alias("t"))
    counts = slim.groupBy(*_KEY).agg(F.first(F.length("t")).cast("long").alias("n"), F.count(F.lit(1)).alias("m"))
    order = materialise(following(counts), "order")
    texts = slim if order.where("m > 1").isEmpty() else slim.dropDuplicates(_KEY)
    # at the following document: the part of it that the edited text takes
    at_next = order.select(*[F.col(k).alias(f"for_{k}") for k in _KEY], "n", *[F.col(f"n_{k}").alias(k) for k in _KEY])
    heads = texts.join(at_next.hint("merge"), _KEY).select(*[F.col(f"for_{k}").alias(k) for k in _KEY], F.substr("t", F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("head"))
    known = texts.join(heads.hint("merge"), _KEY).join(order.select(*_KEY, "n", "m").hint("merge"), _KEY)
    quarter = F.floor(F.col("n") / 4).cast("int")
    begin = F.substr("t", F.lit(1), (F.col("n") - quarter).cast("int"))
    # of rows that are alike the last one is followed by another document, the others by themselves
    edits = F.array(F.col("t"), F.concat(begin, "head"), F.when(F.col("m") > 1, F.concat(begin, F.substr("t", F.lit(1), quarter))))
    each = known.select(*_KEY, F.posexplode(edits).alias("which", "text")).where("text is not null")
    prints = fingerprints(each.select(*_KEY, "which", "text", F.sha2("text", 256).alias("sha")), [*_KEY, "which", "sha"])
    pick = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c)))
    rows = prints.groupBy(*_KEY).agg(pick(0, "fp").alias("fp"), pick(1, "fp").alias("efp"), pick(1, "sha").alias("esha"), pick(2, "fp").alias("sfp"), pick(2, "sha").alias("ssha"))
    rows = materialise(rows, "prints")
    found = within(rows, rows.where((F.col("z") == 0) & (F.col("d") % EVERY == 0)), RADIUS)
    near = materialise(found.groupBy("q").agg((F.count(F.lit(1)) - 1).alias("n_near")), "near")
    rows = rows.join(order.hint("merge"), _KEY).join(near.hint("merge"), F.col("fp") == F.col("q"), "left").drop("q")
    other = materialise(rows.select(*_KEY, "fp"), "fps").select(*[F.col(k).alias(f"n_{k}") for k in _KEY], F.col("fp").alias("nfp"))
    joined = rows.join(other.hint("merge"), [f"n_{k}" for k in _KEY])
    last = F.struct(F.col("esha").alias("sha"), F.col("efp").alias("e"), F.col("nfp").alias("o"))
    alike = F.struct(F.col("ssha").alias("sha"), F.col("sfp").alias("e"), F.col("fp").alias("o"))
    # copies in blocks, so that no array grows with their number
    many = joined.where("m > 1").withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 2) / 65536))))
    many = many.withColumn("_j", F.explode(F.sequence(F.lit(1), F.least(F.col("m") - 1 - F.col("_k") * 65536, F.lit(65536))))).withColumn("y", alike)
    every = joined.withColumn("y", last).unionByName(many.drop("_k", "_j"))
    return every.select(
        F.when(F.col("z") == 0, F.col("d")).cast(kind).alias(id_col),
        F.col("n").alias("n_chars"),
        F.col("y.sha").alias("edited_sha256"),
        hex64(F.col("fp")).alias("fingerprint"),
        hex64(F.col("y.e")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("y.e")).alias("near_edited"),
        likeness(F.col("fp"), F.col("y.o")).alias("near_next"),
        F.when((F.col("z") == 0) & (F.col("d") % EVERY == 0), F.col("n_near")).alias("n_near"),
    )


def within(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(q, fp): for each distinct fingerprint ``fp`` of ``queries`` all distinct ones of ``prints`` at most ``radius`` bits away."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = F.array(*[F.struct(F.lit(k).alias("table"), block[i].alias("x"), block[j].alias("y")) for k, (i, j) in enumerate(combinations(range(n), 2))])
    table = lambda df, name: df.select("fp").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("key"))
    return table(queries, "q").join(table(prints, "p").hint("merge"), "key").where(F.bit_count(F.col("q").bitwiseXOR(F.col("p"))) <= radius).select("q", F.col("p").alias("fp")).distinct()
