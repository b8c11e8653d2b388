"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All
but the last return the columns of the documents they keep; the last returns the placed pieces. A
stage's result is written before the next stage is called, which first removes the tables that the
one before it wrote on its way.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm.bloom import unlisted
from kinetable.llm.decontaminate import contaminated
from kinetable.llm.exact import exact_duplicates
from kinetable.llm.minhash import near_duplicates
from kinetable.llm.packing import pack
from kinetable.llm.tables import row_keyed, step, stored
from kinetable.llm.toxicity import fit, toxicity


_ROW = "_row_key"


def _stage(work):
    @wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with step(spark):
            return work(spark, docs, sf_dir)

    return staged


def _others_of_groups(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Of each group all rows but the one with the smallest id, rows without an id last.

    ``groups`` has the row key and a group, which is named by the smallest key in it.
    """
    moved = groups.where(F.col(_ROW) != F.col(group)).select(_ROW, F.col(group).alias("_group"))
    members = stored(moved.union(moved.select("_group", "_group").distinct()), "members")
    placed = members.join(rows.select(_ROW, "doc_id"), _ROW)
    first = placed.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", F.col(_ROW).alias("row"))).alias("_first"))
    return members.join(first, "_group").where(F.col(_ROW) != F.col("_first.row")).select(_ROW)


def _without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key is not listed; the texts stay where they are read."""
    return unlisted(rows, _ROW, stored(dropped, "dropped")).select(*columns)


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half. The model learns from ``docs`` and the labels of ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = spark.sparkContext.broadcast(fit(docs, labels))
    return docs.withColumn("_toxicity", toxicity(F.col("text"), model)).where(F.col("_toxicity") < 0.5).drop("_toxicity")


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest id, rows without an id last."""
    rows = row_keyed(docs, _ROW)
    return _without(rows, _others_of_groups(rows, exact_duplicates(rows, _ROW), "keep_id"), docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, rows without an id last."""
    rows = row_keyed(docs, _ROW)
    return _without(rows, _others_of_groups(rows, near_duplicates(rows, _ROW), "component_id"), docs.columns)


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, with or without an id."""
    rows = row_keyed(docs, _ROW)
    found = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _ROW)
    return _without(rows, found.select(_ROW).distinct(), docs.columns)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed into sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The score of a trained model decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    with step(spark):
        return docs
