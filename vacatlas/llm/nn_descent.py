"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Equal vectors are one node.  The graph starts from hashed neighbours.  Each round joins neighbours
with their reverse neighbours in Spark, compares the neighbours of a node with each other (neighbours
of neighbours meet there) and keeps the best K per node; it ends when few entries change.  Vectors
and the finished graph lie in fixed-width files in the shared folder, which tasks map and of which
they read the rows they need (a mounted, ``file:`` folder).

Largest inner products are nearest points once every vector has one more component that gives all
the same length (queries: 0); the graph is built on those, in double precision.  Few vectors far longer
than the rest would press all others into one spot, so the LONGEST longest ones stand in the graph by
their direction only, as long as the next one, and every query is compared with them.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, shared_dir, written

NEIGHBOURS = 32
REVERSE = 32
KEPT = 12  # of the neighbours of a node, how many are proposed to each other
PROPOSED = 48  # best proposals for a node that a task passes on
ROUNDS = 40  # far more than it takes to settle; ending there is an error
BEAM = 200  # of up to BEAM_AT nodes, and half as many more for each doubling
BEAM_AT = 2000
WIDTH = 8  # nodes opened at a time
PIVOTS = 64  # starting nodes, and one more for each square root of the number of nodes
LONGEST = 256  # vectors that every query is compared with


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Rows:
    """A file of fixed-width rows; tasks write disjoint rows, so a repeated task writes the same again."""

    def __init__(self, path: str, rows: int, width: int, kind: str):
        self.path, self.rows, self.width, self.kind = path, rows, width, kind

    def create(self) -> Rows:
        with open(self.path, "wb") as f:
            f.truncate(max(1, self.rows * self.width * np.dtype(self.kind).itemsize))
        return self

    def put(self, numbers: np.ndarray, values: np.ndarray) -> None:
        size = self.width * np.dtype(self.kind).itemsize
        with open(self.path, "r+b") as f:
            for n, v in zip(numbers.tolist(), np.ascontiguousarray(values, self.kind), strict=True):
                os.pwrite(f.fileno(), v.tobytes(), n * size)

    def mapped(self) -> np.ndarray:
        return np.memmap(self.path, self.kind, "r", shape=(self.rows, self.width))


def _folder(spark) -> str:
    address = urlparse(shared_dir(spark))
    if address.scheme not in ("", "file"):
        raise ValueError(f"the graph needs a shared folder that is mounted on the executors (a file: address), not {address.scheme}:")
    path = f"{address.path}/graph-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _hashed(node: np.ndarray, count: int, total: int) -> np.ndarray:
    """``count`` pseudo-random other nodes per node."""
    x = node.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    step = (x >> np.uint64(11)) % np.uint64(max(1, total - 1))
    return ((node.astype(np.uint64)[:, None] + np.uint64(1) + step) % np.uint64(total)).astype(np.int64)


ENTRY = "array<struct<s:double,id:long>>"
_STRUCT = pa.struct([("s", pa.float64()), ("id", pa.int64())])


def _entries(offsets: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(sims.astype(np.float64)), pa.array(ids.astype(np.int64))], fields=list(_STRUCT))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _start(nodes: DataFrame, vectors: Rows) -> DataFrame:
    """(no, near): hashed neighbours with their similarities."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.mapped()
        for b in it:
            no = b.column(0).to_numpy()
            ids = [np.unique(r) for r in _hashed(no, NEIGHBOURS, vectors.rows)]
            sims = [v[i] @ v[n] for n, i in zip(no, ids, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            yield pa.RecordBatch.from_arrays([b.column(0), _entries(ends, np.concatenate(sims), np.concatenate(ids))], ["no", "near"])

    return nodes.select("no").mapInArrow(batches, f"no long, near {ENTRY}")


def _both(graph: DataFrame) -> DataFrame:
    """(no, ids): neighbours and reverse neighbours.  Of the reverse ones a hash slot keeps the most
    similar, so no list is longer than NEIGHBOURS + REVERSE, however many point to a node."""
    back = (graph.select(F.col("no").alias("id"), F.explode("near").alias("e"))
            .groupBy(F.col("e.id").alias("no"), F.pmod(F.xxhash64("id"), F.lit(REVERSE)).alias("slot"))
            .agg(F.max(F.struct(F.col("e.s").alias("s"), F.col("id"))).alias("e"))
            .groupBy("no").agg(F.collect_list("e.id").alias("back")))
    return graph.join(back, "no", "left").select("no", F.array_union(
        F.transform("near", lambda e: e["id"]), F.coalesce("back", F.array().cast("array<long>"))).alias("ids"))


def _best_per(key: np.ndarray, sims: np.ndarray, ids: np.ndarray, most: int, own: np.ndarray | None = None):
    """Per key the ``most`` best (similarity, id), an id once and never the key itself: distinct keys, list offsets,
    similarities, ids, and which of them are ``own`` entries."""
    own = np.zeros(len(key), bool) if own is None else own
    order = np.lexsort((~own, ids, key))  # the same pair may have been computed twice, with another rounding
    key, sims, ids, own = key[order], sims[order], ids[order], own[order]
    fresh = ids != key
    fresh[1:] &= (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, sims, ids, own = key[fresh], sims[fresh], ids[fresh], own[fresh]
    order = np.lexsort((ids, -sims, key))
    key, sims, ids, own = key[order], sims[order], ids[order], own[order]
    start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    keep = np.arange(len(key)) - np.repeat(start, size) < most
    return key[start], np.concatenate([[0], np.cumsum(np.minimum(size, most))]), sims[keep], ids[keep], own[keep]


def _merged(graph: DataFrame, met: DataFrame) -> DataFrame:
    """(no, near, _new): the best of a node's entries and its proposals, and how many of them are new.

    The rows of a node stand together in a sorted partition and are merged a batch at a time; a task
    of ``_meetings`` proposes a node a bounded number of times, however popular it is.
    """
    rows = (graph.select("no", "near", F.lit(True).alias("own")).union(met.select("no", "near", F.lit(False)))
            .repartition("no").sortWithinPartitions("no"))

    def merge(t: pa.Table) -> pa.RecordBatch:
        near = t.column("near").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        size = np.diff(near.offsets.to_numpy())
        entries = near.flatten()
        repeat = lambda c: np.repeat(t.column(c).to_numpy(zero_copy_only=False), size)
        no, ends, sims, ids, own = _best_per(repeat("no"), entries.field("s").to_numpy(), entries.field("id").to_numpy(),
                                             NEIGHBOURS, repeat("own").astype(bool))
        new = np.add.reduceat(np.append(~own, False).astype(np.int64), ends[:-1]) if len(no) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(no), _entries(ends, sims, ids), pa.array(new)], ["no", "near", "_new"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in it:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            no = t.column("no").to_numpy()
            whole = int(np.searchsorted(no, no[-1])) if len(no) else 0  # the last node may go on in the next batch
            if whole:
                yield merge(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield merge(rest)

    return rows.mapInArrow(batches, f"no long, near {ENTRY}, _new long")


def _meetings(both: DataFrame, vectors: Rows, flush: int = 128) -> DataFrame:
    """(no, near): for every node, the best of those it meets in the lists of its neighbours.

    Proposals are put together over ``flush`` lists.  More would give fewer rows on small tables, where
    a node stands in many of the lists, and a number of rows that first grows with the square of the
    nodes; over few lists it follows the lists' length at every size.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.mapped()

        def made(lists: list[np.ndarray]) -> pa.RecordBatch:
            key, sims, ids = [], [], []
            for own in lists:
                x = v[own]
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(KEPT, len(own) - 1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                key.append(np.repeat(own, k)), ids.append(own[at].ravel())
                sims.append(np.take_along_axis(s, at, 1).ravel())
            no, ends, s, i, _ = _best_per(*map(np.concatenate, (key, sims, ids)), PROPOSED)
            return pa.RecordBatch.from_arrays([pa.array(no), _entries(ends, s, i)], ["no", "near"])

        lists: list[np.ndarray] = []
        for b in it:
            for own, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(ids.values.to_numpy(), own)
                if len(ids) > 2:
                    lists.append(ids)
                if len(lists) == flush:
                    yield made(lists)
                    lists = []
        if lists:
            yield made(lists)

    return both.select("no", "ids").mapInArrow(batches, f"no long, near {ENTRY}")


def build(nodes: DataFrame, vectors: Rows, rounds: int = ROUNDS, settled: float = 0.02) -> DataFrame:
    """(no, near): the neighbour graph, best first.  ``nodes`` has the numbers from 0 without gaps."""
    graph = written(_start(nodes, vectors))
    for _ in range(rounds if vectors.rows > NEIGHBOURS + 1 else 1):
        after = written(_merged(graph, _meetings(_both(graph), vectors)))
        changed = after.agg(F.sum("_new")).first()[0] or 0
        graph = after.drop("_new")
        if changed <= settled * NEIGHBOURS * vectors.rows:
            return graph
    if vectors.rows > NEIGHBOURS + 1:
        raise RuntimeError("the neighbour graph did not settle")
    return graph


def beam_of(nodes: int) -> int:
    """How many nodes a search holds: more in larger graphs."""
    return int(BEAM * (1 + max(0.0, np.log2(max(1, nodes) / BEAM_AT)) / 2))


def greedy(query: np.ndarray, starts: np.ndarray, vectors: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search: opens the nearest unopened nodes of the beam until it holds none."""
    seen = set(starts.tolist())
    ids = np.array(sorted(seen), np.int64)
    sims = vectors[ids] @ query
    opened: set[int] = set()
    while True:
        if len(ids) > beam:
            at = np.argpartition(-sims, beam - 1)[:beam]
            ids, sims = ids[at], sims[at]
        closed = [(-s, i) for s, i in zip(sims.tolist(), ids.tolist(), strict=True) if i not in opened]
        if not closed:
            return ids, sims
        now = [i for _, i in heapq.nsmallest(WIDTH, closed)]
        opened.update(now)
        fresh = set(np.unique(graph[now]).tolist()) - seen
        fresh.discard(-1)
        seen |= fresh
        if fresh:
            new = np.fromiter(sorted(fresh), np.int64, len(fresh))
            ids, sims = np.concatenate([ids, new]), np.concatenate([sims, vectors[new] @ query])


def search(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key and score of the ``k`` nearest other rows found for every query row.

    Score is the inner product in double precision; ties go to the smaller key.  Unusable vectors
    (see ``usable``) and those not of the commonest length take no part.  Rows with equal vectors
    share a node of which the k + 1 smallest keys can be answers; keys are taken to be unique, a
    repeated row is one more candidate.  Fewer rows than k: all of them.  Empty table: no rows.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"),
                      F.coalesce(is_query, F.lit(False)).alias("q")).filter(usable(F.col("x")))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["d"]
    own = written(own.filter(F.size("x") == dim))
    distinct = own.groupBy("x").agg(F.min("key").alias("key"))
    nodes = written(numbered(written(distinct), [], ["key"], "no", lengths["n"]))
    total = nodes.count()
    # lengths by the largest component, so that squares of very long or short vectors stay finite
    largest = F.array_max(F.transform("x", F.abs))
    length = largest * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / largest) * (v / largest)))
    top = nodes.select("no", length.alias("l")).orderBy(F.desc("l"), "no").limit(LONGEST + 1).collect()
    longest = float(top[-1]["l"]) if len(top) > LONGEST else float(top[0]["l"])
    always = np.array(sorted(r["no"] for r in top[:LONGEST]), np.int64)

    folder = _folder(spark)
    vectors = Rows(f"{folder}/vectors", total, dim + 1, "<f8").create()
    exact = Rows(f"{folder}/exact", total, dim, "<f8").create()

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, dim)
            no = b.column(0).to_numpy()
            largest = np.abs(x).max(1, keepdims=True)
            unit = x / largest
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            # the share of the greatest length, through logarithms: neither may leave the range of doubles
            share = np.exp(np.minimum(0.0, np.log(largest[:, 0]) + np.log(np.sqrt(((x / largest) ** 2).sum(1))) - np.log(longest)))
            vectors.put(no, np.column_stack([unit * share[:, None], np.sqrt(np.maximum(0.0, 1 - share * share))]))
            exact.put(no, x)
            yield pa.RecordBatch.from_arrays([pa.array([len(no)], pa.int64())], ["n"])

    nodes.select("no", "x").mapInArrow(store, "n long").agg(F.sum("n")).collect()
    graph = build(nodes, vectors)
    lists = Rows(f"{folder}/lists", total, NEIGHBOURS + REVERSE, "<i4" if total < 1 << 31 else "<i8").create()

    def store_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = np.full((b.num_rows, lists.width), -1, np.int64)
            for r, ids in enumerate(b.column(1)):
                out[r, :len(ids)] = ids.values.to_numpy()
            lists.put(b.column(0).to_numpy(), out)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    _both(graph).mapInArrow(store_lists, "n long").agg(F.sum("n")).collect()

    placed = written(own.join(nodes.select("x", "no"), "x").select("key", "no", "q"))
    first = (placed.withColumn("_r", F.row_number().over(W.partitionBy("no").orderBy("key"))).filter(F.col("_r") <= k + 1)
             .groupBy("no").agg(F.sort_array(F.collect_list("key")).alias("members")))

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, x, g = vectors.mapped(), exact.mapped(), lists.mapped()
        pivots = np.unique(np.linspace(0, total - 1, min(total, PIVOTS + int(total ** 0.5))).astype(np.int64))
        beam = beam_of(total)
        for b in it:
            query, node, score = [], [], []
            for q, no in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # the direction is enough to search by, and stays finite
                ids, _ = greedy(np.append(x[no] / np.abs(x[no]).max(), 0.0), np.append(pivots, no), v, g, beam)
                ids = np.union1d(ids, always)
                with np.errstate(over="ignore", invalid="ignore"):
                    s = x[ids] @ x[no]
                at = np.argsort(-s, kind="stable")
                cut = s[at[min(k, len(at) - 1)]]  # a query's own node may hold only the query: one more than k
                at = at[s[at] >= cut]
                query += [q] * len(at)
                node += ids[at].tolist()
                score += s[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(node, pa.int64()), pa.array(score, pa.float64())],
                                             ["query_id", "no", "score"])

    near = placed.filter("q").select("key", "no").mapInArrow(found, "query_id long, no long, score double")
    answers = near.join(first, "no").select("query_id", "score", F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
