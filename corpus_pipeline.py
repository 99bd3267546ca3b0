"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet into the shared folder and reads again as the next one's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import minhash_dedup, mixing, packing, substring_dedup, toxicity
from brontide.llm.common import materialise, table
from brontide.llm.registry import fold, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score 0.7 and more) go."""
    weights = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1))
    # one struct, whose fields cannot be taken for the score
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.score(rows, weights, "row").where("score < 0.7").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    groups = minhash_dedup.near_groups(docs)
    return docs.join(groups.where("not kept").select("doc_id"), "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that appear earlier go; every document stays, with what is left of it."""
    return substring_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and the first words of one at the end of a source's target."""
    # numbered in a written table: ids may be null or repeated; one struct, whose fields cannot be taken for columns of this stage
    numbered = materialise(docs.select(F.struct(*docs.columns).alias("own"), "doc_id", "text", "source", F.monotonically_increasing_id().alias("row")), "rows")
    taken = mixing.mix(numbered, more=("row",)).where("taken > 0").select("row", "size", "taken")
    full = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - full * F.col("size")
    shares = F.array(*[F.when(full >= k, F.col("size")) for k in range(1, mixing.MOST + 1)], F.when(rest > 0, rest))
    copies = taken.select("row", "size", F.explode(F.filter(shares, lambda x: x.isNotNull())).alias("words"))
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    cut = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("words").cast("int")), " "))
    given = numbered.join(copies.hint("merge"), "row").withColumn("cut", cut)
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return given.select([new[c].alias(c) if c in new else F.col("own")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenisation and the trained classifier cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
