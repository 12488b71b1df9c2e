"""The corpus pipeline: quality, exact dedup, near dedup, source mix, packing.

Each stage reads what its predecessor wrote. All but the last return the columns of
documents. Decisions are made on narrow tables of row numbers; texts meet them in a
shuffled hash join, at every size the same: texts are shuffled once, never sorted, and
only decisions are held. Rows with a null doc_id can't be named by a decision: the dedup
stages keep them and the mix takes them once. Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, packing, quality, simhash
from millrace.llm.common import crc_mod, numbered, staged
from millrace.session import ship, table


def decisions(df: DataFrame, name: str) -> DataFrame:
    """df, one narrow row per decision, staged: the side of a join that is hashed."""
    return staged(df, name).hint("shuffle_hash")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_quality(docs, table(ship(spark), sf_dir, "labels"), crc_mod("doc_id", 5) != 0)


def by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a column __row that names each row, and docs under these names as doc_id.

    __row is doc_id where no doc_id repeats. Else it numbers the rows in the order of
    doc_id, so that the smallest stays the smallest. It is null for a null doc_id.
    """
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1)
    if repeated.isEmpty():
        rows = docs.withColumn("__row", F.col("doc_id"))
    else:
        order = ["doc_id", F.xxhash64("text"), F.xxhash64(*docs.columns)]
        rows = staged(numbered(docs, order, "__row", "pipeline-numbers"), "pipeline-rows")
        rows = rows.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.col("__row")))
    return rows, rows.withColumn("doc_id", F.col("__row")).drop("__row")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows but for those whose __row is among the doc_ids of dropped; one row each."""
    return rows.join(decisions(dropped.select(F.col("doc_id").alias("__row")), "pipeline-dropped"), "__row", "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows, named = by_row(docs)
    return without(rows, exact_dedup.exact_dedup(named).where(~F.col("kept"))).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints."""
    rows, named = by_row(docs)
    return without(rows, simhash.near_components(named).where(F.col("doc_id") != F.col("component_id"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows, named = by_row(docs)
    taken = mixing.mix(named).where(F.col("doc_id").isNotNull() & (F.col("size") > 0))
    copies = decisions(taken.where("taken > 0").select(F.col("doc_id").alias("__row"), F.expr("cast(taken div size as int)").alias("__copies")), "mix-copies")
    times = F.coalesce("__copies", F.when(F.col("doc_id").isNull(), 1).otherwise(0)).cast("int")
    rows = rows.join(copies, "__row", "left").withColumn("__times", F.array_repeat(F.lit(1), times))
    return rows.select(*docs.columns, F.explode("__times").alias("__time")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Scores, fingerprints and tokens have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
