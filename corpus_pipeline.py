"""Documents to packed training sequences: quality rules, toxicity, near duplicates, packing.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents, for the rows
they keep.  Nulls, empty and repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacatlas.llm import near_dedup, packing, quality_rules, toxicity
from vacatlas.llm.common import table, written

TOXIC = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the floor and that no learned rule rejects.  Empty texts fail the floor."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_rules.decide(F.col("text"), rules)["kept"])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below TOXIC."""
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(fitted, F.col("text")) < TOXIC)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the first by doc_id, of equal ones a single one."""
    first = written(near_dedup.classes(docs).filter("representative").select(F.col("doc_id").alias("_id"), F.col("node").alias("_first"))
                    .distinct())
    # the row travels as one value, so its columns may have any names
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), near_dedup.node_column(F.col("text")).alias("_node"))
    own = own.join(first, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_first")))
    nth = F.row_number().over(W.partitionBy("_id", "_first").orderBy("_id"))
    return own.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of every document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("near_dedup", distinct), ("packing", packed)]

#: Learned rules, Viterbi decoding and alignment are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
