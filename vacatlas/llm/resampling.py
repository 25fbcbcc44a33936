"""Importance resampling of documents towards a target corpus.

Hashed word runs are counted over all documents and over the target; every bucket gets a gain, the
scaled log ratio of its smoothed shares.  The gains are one array of fixed length, so a document's
weight is a sum of array entries.  Gumbel noise made from the id turns "draw by weight" into "take
the highest scores".

The cutoff is found without sorting the table.  Each round takes the exact median key of every block
of remaining keys, weighted by the block's size; the weighted median of these has at least a quarter
of the remaining keys on either side, so one side goes.  Only the winners are sorted.

Keys end in a number per row, so equal rows never tie and the number drawn is exact.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Keys per block whose median is taken, and how few remaining keys end the search.
BLOCK, FEW = 1 << 20, 4096
MEMO = 200_000
#: Bytes to lower case; everything that is no digit, letter or byte of a longer character to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KEY = ["minus", "no_id", "id", "n_features", "row"]


def _slices(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a slice ends between words."""
    at = 0
    while text and at < len(text):
        end = at + SLICE
        part = text[at:end].translate(_WORDS)
        while end < len(text) and not part.endswith(b" "):
            more = text[end:end + SLICE].translate(_WORDS)
            cut = more.find(b" ") + 1
            part += more[:cut] if cut else more
            end += cut or len(more)
        yield part.split()
        at = end


def _features(text: bytes | None, longest: int) -> Iterator[list[bytes]]:
    """All runs of 1 to ``longest`` consecutive words, some at a time."""
    before: list[bytes] = []
    for words in _slices(text):
        out = list(words)
        for n in range(2, longest + 1):
            line = before[max(0, len(before) - n + 1):] + words
            out += [b" ".join(line[i:i + n]) for i in range(len(line) - n + 1)]
        before = (before + words)[-(longest - 1):] if longest > 1 else before
        yield out


def _counted(docs: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """Features per bucket: one array per task, summed by Spark."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def fold() -> None:
            n = np.fromiter(seen.values(), np.int64, len(seen))
            at = np.fromiter((zlib.crc32(f) % buckets for f in seen), np.int64, len(seen))
            np.add.at(total, at, n)
            seen.clear()

        for b in it:
            for t in b.column(0):
                for features in _features(t.as_py(), longest):
                    seen.update(features)
                    if len(seen) > MEMO:
                        fold()
        fold()
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(text).cast("binary")).mapInArrow(batches, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed share in the target over that in the documents."""
    s, t = (_counted(x, text, buckets, longest) for x in (docs, target))
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
                     for a, b in zip(s, t)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``key``, n_features, n_words and weight of every whole text."""
    kind, buckets = docs.schema[key].dataType.simpleString(), len(gain)
    values = gain.tolist()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in it:
            counts, words, weights = [], [], []
            for t in b.column(1):
                t, n, weight = t.as_py(), 0, 0
                n_words = 0
                for features in _features(t, longest):
                    if len(memo) > MEMO:
                        memo.clear()
                    for f in set(features).difference(memo):
                        memo[f] = values[zlib.crc32(f) % buckets]
                    n += len(features)
                    weight += sum(map(memo.__getitem__, features))
                    n_words += len(features) if longest == 1 else sum(1 for f in features if b" " not in f)
                counts.append(n)
                words.append(n_words)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (counts, words, weights))], [key, "n_features", "n_words", "weight"])

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(
        batches, f"`{key}` {kind}, n_features long, n_words long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Scaled Gumbel noise that depends on the id alone; a null id counts as empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted_median(keys: list[tuple], sizes: list[int]) -> tuple:
    """The least key at which the sizes so far reach half of all."""
    half, so_far = sum(sizes) / 2, 0
    for k, n in sorted(zip(keys, sizes)):
        so_far += n
        if so_far >= half:
            return k
    raise ValueError("no keys")


def _up_to(k: tuple, strict: bool = False) -> Column:
    """Keys before ``k`` in the order, and ``k`` itself unless ``strict``."""
    out = F.lit(not strict)
    for name, value in reversed(list(zip(_KEY, k))):
        c = F.col(name)
        out = (c < value) | ((c == value) & out)
    return out & (F.col(_KEY[0]) <= k[0])  # this much reaches the scan as a pushed filter


def _medians(keys: DataFrame) -> list[tuple[tuple, int]]:
    """The middle key of every block of at most BLOCK keys, and the block's size."""

    def of(columns: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort(columns[::-1])
        at = order[(len(order) - 1) // 2]
        return pa.RecordBatch.from_arrays([pa.array([int(c[at])], pa.int64()) for c in columns] + [pa.array([len(order)], pa.int64())],
                                          [*_KEY, "size"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            held.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
            if n >= BLOCK:
                yield of([np.concatenate(c) for c in zip(*held)])
                held, n = [], 0
        if n:
            yield of([np.concatenate(c) for c in zip(*held)])

    rows = keys.select(*_KEY).mapInArrow(batches, ", ".join(f"{k} long" for k in _KEY) + ", size long").collect()
    return [(tuple(r)[:-1], r["size"]) for r in rows]


def cutoff(keys: DataFrame, drawn: int) -> tuple | None:
    """The ``drawn``-th key of a written table of distinct keys, or None for none.

    The driver sees one key per block of BLOCK remaining keys, and the last FEW keys.
    """
    remaining, left, wanted = keys.select(*_KEY), keys.count(), drawn
    if not 0 < wanted <= left:
        return None
    stored = left
    while left > FEW:
        found = _medians(remaining)
        pivot = weighted_median([k for k, _ in found], [n for _, n in found])
        low = remaining.filter(_up_to(pivot)).count()
        if low == wanted:
            return pivot
        if low > wanted:
            remaining, left = remaining.filter(_up_to(pivot, strict=True)), low - 1
        else:
            remaining, left, wanted = remaining.filter(~_up_to(pivot)), left - low, wanted - low
        if left * 4 < stored:  # later rounds read what is left, not the whole table
            remaining, stored = written(remaining), left
    return sorted(tuple(r) for r in remaining.collect())[wanted - 1]


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number rows 1, 2, ... by ``order`` through ranges: no task sorts more than its range."""
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(  # a row per range
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("rank", own).join(starts, "_part").withColumn("rank", F.col("rank") + F.col("_start")).drop("_part", "_start")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 10_000, longest: int = 1,
             percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``key``, n_features, weight, score and rank of every document; rank is null where it was not drawn.

    Of the N documents of at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest
    scores, ties to the smaller id, a null id last.  Ids are whole numbers.  A null or empty text has no
    features and weight 0.  Repeated rows take part one by one; which of equal rows is drawn makes no
    difference to the result.  An empty table gives none, an empty target only smoothed shares.  Other
    columns are not looked at.
    """
    gain = gains(docs, target, text, buckets, longest)
    table = weighed(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), gain, "id", "text", longest)
    table = table.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    table = written(table.withColumns({
        "own_id": F.col("id"), "id": F.coalesce(F.col("id"), F.lit(0)).cast("long"), "no_id": F.col("id").isNull().cast("long"),
        "minus": -F.col("score"), "row": F.monotonically_increasing_id()}))
    fit = F.col("n_words") >= least_words
    number = table.filter(fit).count() * percent // 100
    last = cutoff(table.filter(fit), number)
    drawn = fit & _up_to(last) if last else F.lit(False)
    out = [F.col("own_id").alias(key), *[F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score")]]
    winners = ranked(table.filter(drawn), _KEY).select(*out, F.col("rank").cast("long").alias("rank"))
    return winners.unionByName(table.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
