"""Near-duplicate classes of texts by Order MinHash and banded alignment.

A text is its sequence of words; its items are the windows of five words, each with the number of
its occurrence.  A sketch takes the two smallest items under a random order of all items and keeps
them in text order, so two texts agree on it only if they share items and the items' order.  Texts
that agree on a sketch are compared with the bucket's hub, and a banded alignment of the words
decides: a pair is a link if its edit similarity is 0.8 or more.

Texts with the same words are one node from the start.  Two open rounds compare a bucket's members
with one hub, the member that shares most buckets, as far as they are in other classes; hubs then
leave the bucket.  What is left in buckets of two classes is dealt by rare words: an edit takes one word, two runs of
two and three runs of three from a text at most, so texts of n words that are a link lack 0.2, 0.4 and 0.6 n of each
other's at most.  A text has no partner in another class if more than that stand in texts of its own class only; it
leaves, which makes more runs rare, until few leave.  The others are compared where they share one of their
0.2 n + 1 rarest words, in the bucket of the first one they share, and where the words from there on allow a link;
rounds go on until no bucket holds members of two classes.  So of the pairs that agree on a sketch
no link is lost.  With 16 sketches two texts of window similarity 0.8 agree on none with a probability of
(1 - 0.8 ** 2) ** 16, under one in ten million; texts that are similar only word by word may agree on none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WINDOW = 5
SKETCHES = 16
ITEMS = 2
SIMILARITY = 0.8
OPEN_ROUNDS = 2  # with one hub a bucket, before what is left is dealt by rare runs
RUNS = (2, 3, 1)  # words of the runs by which nodes leave that have no partner, in this order
RUN = 1  # words of the runs that decide which of the nodes left are compared
LACKED = (1 - SIMILARITY) * RUN  # of its runs, times its words, that a node may lack in common with a similar one
CHUNKS, CHUNK_RUNS = 16, 1 << 20  # least number of chunks in which runs are counted, and runs in one
BEFORE = 12  # runs that a row holds of those before it in its node's list
CELLS = 4_000_000  # of a band, up to which an alignment follows its diagonals

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20_240_131).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def windows(codes: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a word sequence, and the same with the occurrence number mixed in."""
    k = min(size, len(codes))
    n = len(codes) - k + 1 if k else 0
    plain = np.zeros(n, np.uint64)
    for j in range(k):
        plain += codes[j:j + n] * _PLACES[j]
    plain = _mixed(plain)
    order = np.argsort(plain, kind="stable")
    run = plain[order]
    new = np.append(True, run[1:] != run[:-1]) if n else np.zeros(0, bool)
    nth = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    labelled = np.empty(n, np.uint64)
    labelled[order] = run + nth.astype(np.uint64) * _PLACES[0]
    return plain, _mixed(labelled)


def sketches(codes: np.ndarray) -> list[int]:
    """Order MinHash values of a word sequence; none for an empty one."""
    plain, labelled = windows(codes)
    if not len(plain):
        return []
    out = []
    for seed in _SEEDS:
        value = (labelled ^ seed) * _ODD
        value ^= value >> np.uint64(32)
        if len(value) > ITEMS:
            at = np.sort(np.argpartition(value, ITEMS - 1)[:ITEMS])
        else:
            at = np.arange(len(value))
        total = np.uint64(0)
        for p in plain[at].tolist():
            total = np.uint64((int(total) * 0x100000001B3 + p) & 0xFFFFFFFFFFFFFFFF)
        out.append(int(total) - (1 << 63))
    return out


def window_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the occurrence-labelled windows."""
    x, y = windows(a)[1], windows(b)[1]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance if it is at most ``most``: furthest reach per diagonal inside a band of that width."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    k = np.arange(-most, most + 1, dtype=np.int32)
    i = np.arange(n + 1, dtype=np.int32)
    # row r holds b from place r - most on, so that it stands against a along diagonal r - most
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(most, b.dtype), b, np.zeros(n + most + 1, b.dtype)]), n + 1)
    differ = shifted[:len(k)] != np.append(a, np.zeros(1, a.dtype))
    differ |= (i < -k[:, None]) | (i >= np.minimum(n, m - k)[:, None])
    # from every cell of a diagonal, the next one where the words differ
    stop = np.where(differ, i, n)[:, ::-1]
    np.minimum.accumulate(stop, axis=1, out=stop)  # in place: the band is the largest thing a task holds
    stop = stop[:, ::-1]
    low, high = np.maximum(0, -k), np.minimum(n, m - k)
    reach = np.full(len(k) + 2, -2)  # one more diagonal on either side
    reach[most + 1] = stop[most, 0]
    row = np.arange(len(k))
    for e in range(most + 1):
        if reach[m - n + most + 1] >= n:
            return e
        at = np.minimum(np.maximum(np.maximum(reach[1:-1] + 1, reach[:-2]), reach[2:] + 1), high)
        reach[1:-1] = np.where((at >= low) & (high >= low), stop[row, np.clip(at, 0, n)], -2)
    return None


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The same by filling the band, all cells of an anti-diagonal at once: for many edits."""
    n, m, far = len(a), len(b), most + 1
    if abs(n - m) > most:
        return None
    # a cell (i, j) is kept under k = j - i + most; neighbours on the two anti-diagonals before
    width = 2 * most + 1
    before, last = np.full(width + 2, far, np.int64), np.full(width + 2, far, np.int64)
    for d in range(n + m + 1):
        lo, hi = max(d - m, (d - most + 1) // 2, 0), min(d, n, (d + most) // 2)
        i = np.arange(lo, hi + 1)
        j = d - i
        k = j - i + most + 1  # one cell of margin on either side
        now = np.full(width + 2, far, np.int64)
        if len(i):
            step = np.minimum(last[k - 1], last[k + 1]) + 1
            inner = (i > 0) & (j > 0)
            same = np.zeros(len(i), bool)
            same[inner] = a[i[inner] - 1] == b[j[inner] - 1]
            diagonal = np.where(inner, before[k] + ~same, far)
            now[k] = np.minimum(np.minimum(step, diagonal), far)
            if d == 0:
                now[k] = 0
        before, last = last, now
    total = int(last[m - n + most + 1])
    return total if total <= most else None


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1] * _PLACES[0] + codes[1:] * _PLACES[1]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two sequences have in common, repeated ones as often as both hold them."""
    (x, p), (y, q) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(p[at], q[to]).sum())


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """Whether an alignment finds an edit similarity of the threshold."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    # an edit takes one word, and two pairs of neighbours, from what both texts have in common
    if longer - _common(a, b) > most or longer - 1 - _common(_pairs(a), _pairs(b)) > 2 * most:
        return False
    widest = min(most, CELLS // (2 * longer + 1))
    band = min(16, widest)
    while True:  # few edits need a narrow band only
        if edit_distance(a, b, band) is not None:
            return True
        if band >= widest:
            return most > band and banded_distance(a, b, most) is not None
        band = min(4 * band, widest)


def _codes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _node(tokens: list[bytes]) -> str:
    return xxhash.xxh3_128_hexdigest(b"\x1f".join(tokens))


def node_column(text: Column) -> Column:
    """The node of a text: equal for texts with the same words."""
    @F.pandas_udf("string")
    def nodes(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: _node(words(t if isinstance(t, str) else None)))

    return nodes(text)


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, sketch, size: number of words, _h: a hash of the text) of every row; rows with the same words share the node."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes, values, sizes = [], [], []
            for t in b.column(1):  # one text's words at a time
                tokens = words(t.as_py())
                nodes.append(_node(tokens))
                values.append(sketches(_codes(tokens)))
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.string()), pa.array(values, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), b.column(2)],
                [key, "node", "sketch", "size", "_h"])

    return docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("_h")).mapInArrow(
        batches, f"`{key}` {kind}, node string, sketch array<long>, size long, _h long")


def _coded(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, codes) of the nodes asked for (node, _own, _h): the words as 4-byte codes, read from the row with that key and text."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes, codes = [], []
            for t, n in zip(b.column(1), b.column(0).to_pylist(), strict=True):
                tokens = words(t.as_py())
                if _node(tokens) == n:  # else: another text with that hash
                    nodes.append(n)
                    codes.append(_codes(tokens).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(codes, pa.binary())], ["node", "codes"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_t"))
    found = nodes.join(rows, F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_t") == F.col("_h")))
    return found.select("node", "_text").mapInArrow(batches, "node string, codes binary").dropDuplicates(["node"])


def _wide(codes: pa.Scalar) -> np.ndarray:
    return _mixed(np.frombuffer(codes.as_py(), "<u4").astype(np.uint64) + np.uint64(1))


def _held(codes: DataFrame, run: int, listed: bool) -> DataFrame:
    """(node, size, alone, runs, held) of a node's runs of ``run`` words that fall into one chunk; ``codes`` has the nodes' classes.

    ``alone`` counts those that no node of another class has.  ``runs`` are the others, if they are to be listed, and ``held``
    says how many nodes have each.  A chunk is a share of all runs by their hash, so it holds a run once a node at most.
    """
    chunks = max(CHUNKS, (codes.agg(F.sum(F.length("codes"))).first()[0] or 0) // (4 * CHUNK_RUNS))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for n, c, of in zip(b.column(0), b.column(1), b.column(2), strict=True):
                own = windows(_wide(c), run)[1]
                to = (own % np.uint64(chunks)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                chunk, first = np.unique(to[order], return_index=True)
                k = len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk), pa.array([n.as_py()] * k, pa.string()), pa.array([len(c.as_py()) // 4] * k, pa.int64()),
                     pa.array([of.as_py()] * k, pa.int64()), pa.array([x.tobytes() for x in np.split(own[order], first[1:])], pa.binary())],
                    ["chunk", "node", "size", "of", "runs"])

    def together(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("runs")]
        ends = np.cumsum([len(x) for x in parts])
        run = np.concatenate(parts)
        of = np.repeat(rows.column("of").to_numpy(), [len(x) for x in parts])
        order = np.lexsort((of, run))
        run_, of_ = run[order], of[order]
        first = np.flatnonzero(np.append(True, run_[1:] != run_[:-1]))
        last = np.append(first[1:], len(run)) - 1
        held = np.empty(len(run), np.uint32)
        held[order] = np.repeat(np.where(of_[first] != of_[last], last - first + 1, 0), last - first + 1)
        helds = np.split(held, ends[:-1])
        return pa.table({
            "node": rows.column("node"), "size": rows.column("size"), "alone": pa.array([int((h == 0).sum()) for h in helds], pa.int64()),
            "runs": pa.array([x[h > 0].tobytes() if listed else None for x, h in zip(parts, helds)], pa.binary()),
            "held": pa.array([h[h > 0].tobytes() if listed else None for h in helds], pa.binary())})

    return (codes.select("node", "codes", F.xxhash64("component").alias("of"))
            .mapInArrow(batches, "chunk int, node string, size long, of long, runs binary")
            .groupBy("chunk").applyInArrow(together, "node string, size long, alone long, runs binary, held binary"))


def _crowded(codes: DataFrame) -> DataFrame:
    """The nodes (node, codes, component) that can have a similar one of another class among ``codes``, and maybe others.

    A run that only nodes of one class have is in nothing that a node of that class could still be linked to; a node with
    more of those than its edits can take leaves.  Counts are exact; those who leave make more runs rare.
    """
    left = codes.count()
    while left:
        before = left
        for run in RUNS:
            alone = _held(codes, run, False).groupBy("node").agg(F.sum("alone").alias("alone"), F.first("size").alias("size"))
            stay = alone.filter(F.col("alone") <= (1 - SIMILARITY) * run * F.col("size") + 1e-6).select("node")
            codes = written(codes.join(stay, "node"))
        left = codes.count()
        if left >= 0.9 * before:
            break
    return codes


def _by_rare_runs(codes: DataFrame) -> DataFrame:
    """(bucket, node, size, rest, before): the runs that begin a node's list, as many as one of has to be in common with any
    similar node.  Any order that is the same for all nodes does; here runs of one class stand first, then rare ones.  A run
    of one class makes no row.  ``rest`` is how many runs of more classes the list has from there on, ``before`` the last
    ones before: two nodes are compared in the bucket of the first run they share, so neither has to be met in a later one."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for n, size, alone, parts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own = np.concatenate([np.frombuffer(p["runs"], np.uint64) for p in parts])
                own = own[np.lexsort((own, np.concatenate([np.frombuffer(p["held"], np.uint32) for p in parts])))]
                k = min(len(own), max(0, int(LACKED * size + 1e-6) + 1 - alone))
                own, rest = own.view(np.int64), len(own) - np.arange(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[:k]), pa.array([n] * k, pa.string()), pa.array(np.full(k, size)), pa.array(rest),
                     pa.array([own[max(0, i - BEFORE):i] for i in range(k)], pa.list_(pa.int64()))],
                    ["bucket", "node", "size", "rest", "before"])

    lists = _held(codes, RUN, True).groupBy("node").agg(
        F.first("size").alias("size"), F.sum("alone").alias("alone"), F.collect_list(F.struct("runs", "held")).alias("parts"))
    return lists.mapInArrow(batches, "bucket long, node string, size long, rest long, before array<long>")


def _can_link(size: Column, rest: Column, before: Column, other: Column, other_rest: Column, other_before: Column) -> Column:
    """Whether texts of so many words, with so many from here on that the other may have, can be similar and first meet here."""
    return ((F.least(rest, other_rest) >= SIMILARITY * F.greatest(size, other) - 1e-6) & ~F.arrays_overlap(before, other_before))


def _shared(kept: DataFrame) -> DataFrame:
    """The rows (bucket, node) of buckets with more than one node, and the bucket's size ``n``."""
    return kept.join(kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket")


def _verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = pa.array([similar(_wide(x), _wide(y)) for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    both = (pairs.join(codes.select(F.col("node").alias("a"), F.col("codes").alias("x")), "a")
            .join(codes.select(F.col("node").alias("b"), F.col("codes").alias("y")), "b").select("a", "b", "x", "y"))
    return both.mapInArrow(batches, "a string, b string")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its smallest node.

    Alternating star contraction: every node points its larger neighbours, then its smaller ones, to
    the smallest node next to it.  Neighbours are only ever reduced to a minimum or joined, never
    gathered; the number of rounds grows with the logarithm of the size.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = written(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ``class_id`` (the smallest key of its class), ``node`` and ``representative``.

    ``representative`` is true for the rows whose key is the class's smallest and whose words are
    those of the first such row: one text per class.  Texts without words are one class; texts of
    fewer than five words are compared as one window; null keys come last; repeated rows are in one
    class; an empty table gives no rows; other columns are not looked at.
    """
    rows = written(sketched(docs, key, text))
    lowest = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("own"), F.col("_h").alias("h")))
    nodes = written(rows.groupBy("node").agg(lowest.alias("_l"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
                    .select("node", F.col("_l.own").alias("_own"), F.col("_l.h").alias("_h"), "sketch", "size"))
    kept = (nodes.select("node", "size", F.posexplode("sketch").alias("band", "value"))
            .select("node", "size", F.xxhash64("band", "value").alias("bucket")))
    shared = written(_shared(kept))
    asked = written(shared.groupBy("node").agg(F.sum("n").alias("weight"), F.first("size").alias("size"))
                    .select("*", F.col("size").alias("rest"), F.array().cast("array<long>").alias("before")))
    codes = written(_coded(docs, nodes.select("node", "_own", "_h").join(asked.select("node"), "node"), key, text))
    left = shared.select("bucket", "node").join(asked, "node")
    links, labels, tested, r = None, None, None, 0
    while True:
        own = left.withColumn("component", F.col("node")) if labels is None else (
            left.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        mixed = own.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high")
        own = written(own.join(mixed.select("bucket"), "bucket"))
        if own.isEmpty():
            break
        if r == OPEN_ROUNDS:
            codes = _crowded(written(codes.join(own.select("node", "component").distinct(), "node")))
            left = written(_shared(written(_by_rare_runs(codes))).drop("n").join(asked.select("node", "weight"), "node"))
            r += 1
            continue
        slots = 1 if r < OPEN_ROUNDS else 16 ** (r - OPEN_ROUNDS)
        of = F.xxhash64("node", "bucket", F.lit(r))
        hubs = (own.groupBy("bucket", F.pmod(of, F.lit(slots)).alias("_slot"))
                .agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("component").alias("_c"), F.col("size").alias("_s"),
                                       F.col("rest").alias("_r"), F.col("before").alias("_b")),
                              F.struct("weight", of)).alias("h")).select("bucket", "h.*"))
        hubs = written(hubs)
        near = _can_link(*(F.col(c) for c in ("size", "rest", "before", "_s", "_r", "_b")))
        pairs = (own.join(hubs, "bucket").filter((F.col("component") != F.col("_c")) & near)
                 .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        found = written(_verified(pairs, codes))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = written(components(links))
        left = own.drop("component").join(hubs.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
        r += 1
    in_class = nodes.select("node", "_own").withColumn("component", F.col("node")) if labels is None else (
        nodes.select("node", "_own").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = in_class.groupBy("component").agg(F.min(F.struct(F.col("_own").isNull(), F.col("_own"), F.col("node"))).alias("_f"))
    member = in_class.join(first, "component").select("node", F.col("_f._own").alias("class_id"), F.col("_f.node").alias("_first"))
    return rows.join(member, "node").select(
        key, "class_id", "node", ((F.col("node") == F.col("_first")) & F.col(key).eqNullSafe(F.col("class_id"))).alias("representative"))
