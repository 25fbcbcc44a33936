"""Free text over whole postings: lists of the rows that hold each run of three characters.

Rows are dealt into blocks and numbered inside them; a list holds the numbers of one block, sorted, so no
list outgrows its block however common its run is.  A term is looked up through the rarest of its runs: their
lists are intersected, and what remains is verified against the text.  Nothing is cut: a term is found
wherever it stands.

Lists, texts and terms meet where the block is: a list goes there once, however many terms ask for it, a term goes to
the blocks that hold its rarest run, and a pair of term and row is only made there.

An index is a folder of additions.  Rows that changed are added again; lists that have gone out of date only
cost a verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scale import cut_lineage

#: Rows of a block and their characters on average, how many of a term's runs are looked up, and the most tasks that blocks are dealt to.
BLOCK, CHARACTERS, RAREST, TASKS = 1 << 12, 1 << 24, 4, 10_000
#: Rows and terms of a block that are held against one another at a time.
ROWS, TERMS = 1 << 8, 1 << 15


#: Behind a text, so that every one and two characters of it begin a run.
_END = "\x00\x00"


def runs(text: Column) -> Column:
    """Every run of three characters of a text, once, by one pass over it; none for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def searchable(*columns: str) -> Column:
    """Lower-case text of several columns, a line each."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def _codes(text: str) -> np.ndarray:
    """Every run of a text once, as one number of three times 21 bits; the last two runs hold what ends it."""
    c = np.frombuffer((text + _END).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def _listed(block: int, places: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
    """The lists of a block whose texts, in the order of their places, have these runs."""
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    code, place = code[order], np.repeat(np.array(places, np.int32), [len(c) for c in codes])[order]
    first = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
    ends = np.append(first, len(code)).astype(np.int32)
    code = code[first]
    letters = np.stack([code >> np.uint64(42), code >> np.uint64(21), code], axis=1) & np.uint64((1 << 21) - 1)
    every = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.RecordBatch.from_arrays(
        [pa.array([every[i:i + 3] for i in range(0, len(every), 3)], pa.string()), pa.array(np.full(len(code), block, np.int32)),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), pa.array(np.diff(ends))], ["run", "block", "places", "n"])


def _lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, block, places, n) of rows (block, place, text) in that order; a task holds the runs of one block."""
    at, places, codes = None, [], []
    for b in it:
        for block, place, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if block != at and places:
                yield _listed(at, places, codes)
                places, codes = [], []
            at = block
            places.append(place)
            codes.append(_codes(text.as_py()))
    if places:
        yield _listed(at, places, codes)


def _rows_of(near: pa.Table) -> tuple[list[str], np.ndarray]:
    """The ids of a block by place, and at every place the first one with the same id."""
    some = near.filter(pc.is_valid(near.column("place")))
    place, ids = some.column("place").to_pylist(), some.column("id").to_pylist()
    named: list = [None] * (max(place, default=-1) + 1)
    same, first = np.arange(len(named)), {}
    for p, i in sorted(zip(place, ids, strict=True)):
        named[p] = i
        same[p] = first.setdefault(i, p)
    return named, same


def _meetings(near: pa.Table, same: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(terms, place, number of the term) of the rows of a block that may hold the terms it was asked for, ROWS and TERMS at a time.

    A place has a bit; a list is a number with the bits of its places.
    """
    size = -(-len(same) // 8)
    listed = near.filter(pc.is_valid(near.column("run")))
    bits, rows = {}, {}
    for run, places in zip(listed.column("run").to_pylist(), listed.column("places"), strict=True):
        at = same[places.values.to_numpy()]
        own = np.zeros(8 * size, np.uint8)
        own[at] = 1
        bits[run], rows[run] = int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little"), len(at)
    asked = list(dict.fromkeys(t for own in near.column("terms").to_pylist() if own for t in own))
    heads = dict.fromkeys((t for t in asked if len(t) < 3), 0)
    for run, own in bits.items() if heads else ():
        for head in (run[:1], run[:2]):
            if head in heads:
                heads[head] |= own

    def held(term: str) -> int:
        if len(term) < 3:
            return heads[term]
        every = {term[i:i + 3] for i in range(len(term) - 2)}
        here = sorted((r for r in every if r in bits), key=rows.__getitem__)
        if len(here) < min(RAREST, len(every)):  # a run that was looked up has no list here
            return 0
        return reduce(int.__and__, [bits[r] for r in here[:RAREST]])

    for i in range(0, len(asked), TERMS):
        found = [(t, m) for t in asked[i:i + TERMS] if (m := held(t))]
        terms = [t for t, _ in found]
        matrix = np.frombuffer(b"".join(m.to_bytes(size, "little") for _, m in found), np.uint8).reshape(len(found), size)
        for first in range(0, size, ROWS // 8):
            own = np.unpackbits(matrix[:, first:first + ROWS // 8], axis=1, bitorder="little")
            place, term = np.nonzero(own.T)
            if len(place):
                yield terms, place + 8 * first, term


def _each(terms: list[str], place: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """Every place and its terms."""
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(place)), strict=True):
        yield int(place[a]), [terms[t] for t in term[a:b].tolist()]


def _possible(near: pa.Table) -> pa.Table:
    """(id, terms) of a block; an id may have several rows."""
    ids, same = _rows_of(near)
    rows = [(ids[p], own) for x in _meetings(near, same) for p, own in _each(*x)]
    return pa.table({"id": pa.array([i for i, _ in rows], pa.string()), "terms": pa.array([t for _, t in rows], pa.list_(pa.string()))})


def _holding(texts: pa.Table, near: pa.Table) -> pa.Table:
    """(terms, key) of the texts of a block that hold the terms; a text may have several rows."""
    ids, same = _rows_of(near)
    at: dict = {}
    for k, i in enumerate(texts.column("id").to_pylist()):
        at.setdefault(i, []).append(k)
    every, keys, out = texts.column("text").to_pylist(), texts.column("key").combine_chunks(), []
    for x in _meetings(near, same):
        rows, terms = [], []
        for p, asked in _each(*x):
            for k in at.get(ids[p], ()):
                text = every[k]
                held = [t for t in asked if t in text] if text else ()
                if held:
                    rows.append(k)
                    terms.append(held)
        out.append(pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.string())), keys.take(pa.array(rows, pa.int64()))], ["terms", "key"]))
    return pa.Table.from_batches(out, pa.schema([("terms", pa.list_(pa.string())), ("key", keys.type)]))


@dataclass(frozen=True)
class TextIndex:
    """An index under ``root``; ``add`` rows, then ``find`` terms in them."""

    root: str

    def add(self, rows: DataFrame, text: Column, addition: int, key: str = "id") -> None:
        """Index ``text`` of rows with unique keys as one addition; adding it again replaces it.

        Rows with a null or empty text are in no list.
        """
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
        n = max(1, -(-size["n"] // BLOCK), -(-size["chars"] // CHARACTERS))
        own = rows.select(F.col(key).cast("string").alias("id"), text.alias("_text"))
        own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        place = F.row_number().over(W.partitionBy("block").orderBy("id"))  # a block is a bounded group
        (own.select("id", "block").repartition(min(n, TASKS), "block").withColumn("place", place).withColumn("blocks", F.lit(n))
         .write.mode("overwrite").parquet(f"{self.root}/places/addition={addition}"))
        # a text goes to its block once; its runs are listed there and never become rows
        held = own.repartition(min(n, TASKS), "block").withColumn("place", place).filter(F.col("id").isNotNull())
        # numbering has sorted the rows of a block, and its lists come in the order of their runs
        held = held.select("block", "place", F.nullif("_text", F.lit("")).alias("_text")).filter("_text is not null")
        (held.mapInArrow(_lists, "run string, block int, places array<int>, n int")
         .write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/lists/addition={addition}"))

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{name}")

    def candidates(self, terms: DataFrame) -> DataFrame:
        """(term, id) of indexed rows that may hold each lower-case ``term``."""
        return self._terms(terms).select(F.explode("terms").alias("term"), "id")

    def _terms(self, terms: DataFrame) -> DataFrame:
        """(id, terms) of indexed rows and the distinct terms that each may hold."""
        near, blocks = self._near(terms)
        found = (near.repartition(blocks, "addition", "block").groupBy("addition", "block")
                 .applyInArrow(_possible, "id string, terms array<string>"))
        return found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))

    def _near(self, terms: DataFrame) -> tuple[DataFrame, int]:
        """What a block needs to know which of its rows may hold the lower-case terms, and the number of blocks, TASKS at most.

        Rows of (addition, block) with a list (run, places) that is looked up, or terms whose rarest run has a list there,
        or a row's place and id.
        """
        lists, places = self._read(terms.sparkSession, "lists"), self._read(terms.sparkSession, "places")
        asked = cut_lineage(terms.filter("term <> ''").select("term").distinct())
        known = cut_lineage(lists.groupBy("run").agg(F.sum("n").alias("all")))
        long = asked.filter(F.length("term") >= 3).select("term", F.explode(runs(F.col("term"))).alias("run"))
        nth = F.row_number().over(W.partitionBy("term").orderBy("all", "run"))
        # a term with a run that no row holds is looked for nowhere, as its first run has no list
        rare = long.join(known, "run", "left").withColumn("all", F.coalesce("all", F.lit(0))).withColumn("nth", nth).filter(F.col("nth") <= RAREST)
        # one or two characters begin several runs
        heads = F.explode(F.array(F.substring("run", 1, 1), F.substring("run", 1, 2)))
        short = known.select("run", heads.alias("term")).join(asked.filter(F.length("term") < 3), "term").select("term", "run", F.lit(1).alias("nth"))
        wanted = cut_lineage(rare.select("term", "run", "nth").union(short))
        sent = cut_lineage(wanted.filter("nth = 1").groupBy("run").agg(F.collect_set("term").alias("terms")))
        each = {"run": "string", "places": "array<int>", "terms": "array<string>", "place": "int", "id": "string"}
        kind = lambda df, *names: df.select("addition", "block", *[F.col(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in each.items()])
        near = (kind(lists.join(cut_lineage(wanted.select("run").distinct()), "run", "left_semi"), "run", "places")
                .union(kind(lists.select("addition", "block", "run").join(sent, "run").drop("run"), "terms"))
                .union(kind(places, "place", "id")))
        return near, min(max(1, places.select("addition", "block").distinct().count()), TASKS)

    def find(self, rows: DataFrame, text: Column, terms: DataFrame, key: str = "id") -> DataFrame:
        """(term, ``key``) for every row whose text holds a term, letter case aside; null and empty terms find nothing.

        Rows must have been added.  In an index of one addition, texts are looked at where their block is.
        """
        asked = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct()
        own = rows.select(F.col(key).alias("key"), F.col(key).cast("string").alias("id"), text.alias("text"))
        sizes = self._read(rows.sparkSession, "places").select("addition", "blocks").distinct().collect()
        if len(sizes) == 1:
            near, blocks = self._near(asked)
            texts = own.filter("id is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(sizes[0]["blocks"])).cast("int"))
            held = (texts.repartition(blocks, "block").groupBy("block").cogroup(near.drop("addition").repartition(blocks, "block").groupBy("block"))
                    .applyInArrow(_holding, T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("key", own.schema["key"].dataType)])))
        else:
            held = self._terms(asked).join(own, "id").select(F.filter("terms", lambda t: F.contains(F.col("text"), t)).alias("terms"), "key")
        return held.select(F.explode("terms").alias("term"), F.col("key").alias(key))
