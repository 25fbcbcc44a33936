"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard of a key: the smallest of one exponential draw per shard, at the shard's rate.

    Every (key, shard) pair has its own draw, so a further shard can only win rows for itself and a
    removed one only gives its own rows away.  A shard of weight 0 gets nothing.  A null key is a
    key of its own.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and not all zero")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    uniform = lambda s: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), text, s), 11).cast("double") + 0.5) / float(1 << 53)
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in enumerate(weights) if w > 0])
    draws = F.transform(shards, lambda x: F.struct((-F.log(uniform(x["s"])) / x["w"]).alias("d"), x["s"].alias("s")))
    return F.array_min(draws)["s"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
           grown: Sequence[float] | None = None, overhead: int = 16, seed: int = 0) -> DataFrame:
    """One row per input row: key, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    ``grown`` are the weights after a change (null column without them).  ``slot`` numbers the rows
    of a shard from 0.  Rows with the same key share a shard and get a slot each; a null text has
    size ``overhead``; an empty table gives no rows; other columns are not looked at.
    Only ids, sizes and checksums are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), rendezvous(F.col(key), weights, seed).alias("shard"),
        (rendezvous(F.col(key), grown, seed) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    out = numbered(rows, ["shard"], [key, "text_crc32", "size"], "slot", docs.count())
    return out.select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
