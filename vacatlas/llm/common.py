"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vacatlas-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and go on from the written table: a lost executor re-reads files."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of smallest key hash: the same rows however the table is split.

    A top-k, so every task keeps ``rows`` rows at most; the result has a proven bound.
    """
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int,
             per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    Groups are cut into buckets by a hash of ``order``; rows are numbered inside a bucket and the
    bucket's start is a running sum over the bucket counts, a table of groups x buckets.  ``rows``
    is the size of ``df`` (it sets the number of buckets, never the result's completeness).
    """
    buckets = max(16, -(-rows // per_bucket))
    part = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    starts = (part.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(
                  W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
                  F.lit(0)).alias("_start")))
    inside = part.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    on = [inside[k].eqNullSafe(starts[k]) for k in [*keys, "_bucket"]]
    return inside.join(starts, on).select(
        *[inside[c] for c in df.columns], (F.col(name) + F.col("_start")).cast("long").alias(name))
