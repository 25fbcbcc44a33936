"""Best-fit packing planned on the histogram of lengths.

The plan never sees a document: best-fit decreasing runs over (length, count) pairs and works on
whole groups of equal sequences at once, so its cost depends on the sequence size only.  A piece
then takes the planned slot of its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .common import numbered, written


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of ``size``, but for the first."""
    head = n % size
    starts = ([0] if head else []) + list(range(head, n, size))
    return [(s, (head if s == 0 and head else size)) for s in starts]


def pieces(docs: DataFrame, path: str, size: int, end_id: int, key: str, text: str, with_ids: bool = False) -> DataFrame:
    """Encoded pieces of every document: ids, then ``end_id``, cut to at most ``size``."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(path, library=True), struct.pack("<I", end_id)
        for b in it:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for r, t in enumerate(b.column(1)):
                ids = c.encode(t.as_py()) + end
                for p, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    own = ids[4 * s:4 * (s + n)]
                    row.append(r), piece.append(p), start.append(s), length.append(n)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        kept.append(own)
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_ids, names)

    out = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, out)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first, last, sequence, copies, offset)`` rows.

    The pieces of ``length`` with ranks first..last-1 go to sequences ``sequence``, ``sequence`` + 1
    and so on, ``copies`` to each, the first of them at ``offset``.  Sequences that are alike are one
    group; a group is split when only some of its members take a piece.
    """
    if any(not 0 < n <= size for n in histogram):
        raise ValueError("lengths must be between 1 and the sequence size")
    rows: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, count)
    free: list[int] = []  # spaces in use, ascending
    made = 0

    def add(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in groups:
                bisect.insort(free, space)
            groups.setdefault(space, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):  # nothing has room: open sequences, each with as many as fit
                copies = min(size // length, left)
                count = left // copies
                first, space, made = made, size, made + count
            else:
                space = free[at]
                first, count = groups[space].pop()
                if not groups[space]:
                    del groups[space], free[at]
                copies = min(space // length, left)
                used = min(count, left // copies)
                add(space, first + used, count - used)
                count = used
            rows.append((length, rank, rank + count * copies, first, copies, size - space))
            add(space - copies * length, first, count)
            rank, left = rank + count * copies, left - count * copies
    return rows


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and its ids).

    A null or empty text is the end id alone.  Repeated rows are packed each, an empty table gives
    no rows, other columns are not looked at.  The driver holds at most ``size`` histogram rows and
    a plan of a few rows per length.
    """
    spark = docs.sparkSession
    out = written(pieces(docs, path, size, end_id, key, text, with_ids))
    counts = {r["length"]: r["count"] for r in out.groupBy("length").count().collect()}
    ranked = numbered(out, ["length"], [key, "piece", "start", "ids_crc32"], "_rank", sum(counts.values()))
    fields = [("length", T.LongType())] + [(n, T.LongType()) for n in ("_from", "_to", "_sequence", "_copies", "_at")]
    slots = spark.createDataFrame(plan(counts, size), T.StructType([T.StructField(n, t) for n, t in fields]))
    own = slots.groupBy(F.col("length").alias("_length")).agg(F.sort_array(F.collect_list(
        F.struct("_from", "_to", "_sequence", "_copies", "_at"))).alias("_slots"))
    # bounded: one row per length, at most ``size`` of them
    found = ranked.join(F.broadcast(own), F.col("length") == F.col("_length")).withColumn(
        "_slot", F.filter("_slots", lambda s: (F.col("_rank") >= s["_from"]) & (F.col("_rank") < s["_to"]))[0])
    nth = F.col("_rank") - F.col("_slot._from")
    copies = F.col("_slot._copies")
    return found.select(
        *out.columns, (F.col("_slot._sequence") + F.floor(nth / copies)).cast("long").alias("sequence_id"),
        (F.col("_slot._at") + F.pmod(nth, copies) * F.col("length")).cast("long").alias("offset"))
