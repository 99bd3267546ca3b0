"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shared import shared_dir

#: Rows and bytes in one Arrow batch handed to Python.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage so that a lost executor never restarts the whole job; the
    files go with ``discard``, else when the session's JVM ends.  The driver's JVM
    is asked to collect, upon which Spark removes the finished job's shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brontide-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    spark._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def integer_ids(docs: DataFrame, id_col: str) -> None:
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must hold integers, not {kind.simpleString()}")


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, by: str, salts: int = 256) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row a key) on ``key``, of which one may hold a third of all rows.

    Rows of a key are dealt to ``salts`` parts by a hash of ``by``; a looked-up row
    is copied once to each part of its key that has rows.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    parts = dealt.select(key, "_salt").distinct().join(lookup.hint("merge"), key)
    return dealt.join(parts.hint("merge"), [key, "_salt"]).drop("_salt")


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker's batch, in rows and in bytes; rows of text can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_TOP = (1 << 63) - 1


def spread(column: Column) -> Column:
    """An even, reproducible number in 0 .. 2**63 for a column's text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") * 8


def running(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, buckets: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same ``keys`` that come before, by ``order`` (0 .. 2**63), then ``ties``.

    Two levels, so a key that holds a third of the rows is still spread: the sums
    of ranges of ``order`` are added up (at most ``buckets`` rows a key), and rows are
    then summed within one range only.  ``order`` should be evenly spread; ``df`` is
    read twice.
    """
    bucket = F.shiftright(F.col(order).bitwiseAND(F.lit(_TOP)), 63 - (buckets.bit_length() - 1)).cast("int")
    part = df.withColumn("_b", bucket).withColumn("_v", value.cast("long"))
    sums = part.groupBy(*keys, "_b").agg(F.sum("_v").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = F.col("_b") == F.col("_b2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(before, same)
    kept = [F.col(c) for c in df.columns]
    return joined.select(*kept, (F.col("_before") + F.col("_local")).cast("long").alias(name))


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str], buckets: int = 1024, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row within ``keys``, spread as in ``running``."""
    return running(df, keys, order, ties, F.lit(1), name, buckets)
