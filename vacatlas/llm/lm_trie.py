"""Language-model scores from a compact, memory-mapped n-gram trie.

Level 1 holds the words: their hashes in order, so a word's place is its number.  Level m holds the runs of m words as
(place of the first m - 1 in the level before, number of the last) in order, so the runs that go on from one context
stand together.  Keys are kept by Elias and Fano: the high parts in unary, a one per key and a zero behind every
run of keys with the same high part, the low parts packed to their width in bits.  Where a run begins and ends
is read by selecting zeros, with a sample of how many stand before each block of bits.  A key is found by a
successor search inside the run of its context.  Probabilities are kept as one byte, rounded down.

Every run of words that was learned from is kept, those seen once, too.  Tasks add up the keys of many texts and send
them to the shard of their context as coded blocks, never as rows; a context is in one shard, which its task writes as
a raw file into the shared folder.  Scoring tasks map the files and read the pages they need.
That folder has to be mounted on the executors (a ``file:`` address).

    P(w)       = (c + 0.1) / (N + 0.1 (V + 1))
    P(w | v)   = max(n(vw) - D, 0) / n(v) + rest(v) * P(w)
    P(w | uv)  = max(n(uvw) - D, 0) / n(uv) + rest(uv) * P(w | v)

``rest`` is what the discounts of a context leave over: D for each of its followers.  A context without followers
leaves all.  A text begins behind an end; no context reaches over it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

DISCOUNT = 0.75
LEAST_PAIR = 1  # every run of words is kept
STEP = 1 / 24  # of a quantised log10
END = b" "  # no word is a blank: the end of a text, and the context of its first word
BLOCK = 1 << 19  # words handled at a time
ADDED = 1 << 20  # keys of a task that are added up before Spark gets them


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words of a text (or its UTF-8) with A-Z in lower case, then the end."""
    out = (text.encode() if isinstance(text, str) else text).lower().split() if text else []
    out.append(END)
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first row, row after, token lists) of consecutive rows with about BLOCK tokens; a long text is whole."""
    lists, n, start = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):
        lists.append(tokens(t.as_py()))
        n += len(lists[-1])
        if n >= BLOCK:
            yield start, i + 1, lists
            lists, n, start = [], 0, i + 1
    if lists:
        yield start, len(column), lists


def _hashed(lists: list[list[bytes]]) -> np.ndarray:
    """Token hashes of the lists one after another, with an end before the first."""
    flat = [END]
    for x in lists:
        flat += x
    # hashing a word takes less time than finding it in a table of words
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned keys as signed ones of the same order, for Spark."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64) ^ np.uint64(1 << 63)


def quantised(p: np.ndarray) -> np.ndarray:
    """One byte per probability, never more than it; 255 stands for zero."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log10(np.maximum(p, 1e-300)) / STEP - 1e-9)
    return np.clip(code, 0, 255).astype(np.uint8)


VALUE = np.concatenate([10.0 ** (-STEP * np.arange(255)), [0.0]])


_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.uint8)
#: Where the k-th zero of a byte is, lowest bit first.
_ZERO_AT = np.array([([i for i in range(8) if not b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
_U = np.uint64
_EACH = {x: _U(x * 0x0101010101010101) for x in (0x01, 0x0f, 0x33, 0x55, 0x80)}  # a byte eight times
SELECT = 32  # bytes of a block of the unary part; one sample is kept per block


class Unary:
    """How many keys have each high part: a one per key, and a zero behind the keys of a high part."""

    @staticmethod
    def parts(high: np.ndarray, runs: int) -> dict[str, np.ndarray]:
        bits = np.zeros(len(high) + runs, bool)
        bits[high.astype(np.int64) + np.arange(len(high))] = True
        unary = np.packbits(np.append(bits, np.ones(-len(bits) % (8 * SELECT), bool)), bitorder="little")
        zeros = _ZEROS[unary].reshape(-1, SELECT).sum(axis=1, dtype=np.int64)
        return {"unary": unary, "samples": (np.cumsum(zeros) - zeros).astype(np.uint32 if runs < 1 << 32 else np.uint64)}

    def __init__(self, unary: np.ndarray, samples: np.ndarray):
        self.words, self.samples = unary.view("<u8").reshape(-1, SELECT // 8), samples
        self.eight = np.ndarray(len(unary) - 7, "<u8", unary, strides=(1,))  # from every byte on

    def before(self, high: np.ndarray) -> np.ndarray:
        """How many keys have a smaller high part: the ones before the zero that ends the high part before."""
        out = np.zeros(len(high), np.int64)
        some = np.nonzero(high > 0)[0]
        k = high[some] - 1
        block = np.searchsorted(self.samples, k.astype(self.samples.dtype), "right") - 1
        rest = k - self.samples[block].astype(np.int64)
        # the word of eight bytes that holds the zero, then the byte
        word = np.zeros(len(some), np.int64)
        upto = passed = word
        for i in range(SELECT // 8 - 1):
            upto = upto + (64 - np.bitwise_count(self.words[block, i]))
            beyond = upto <= rest
            word = word + beyond
            passed = np.where(beyond, upto, passed)
        own, rest = self.words[block, word], (rest - passed).astype(np.uint64)
        # zeros up to the end of every byte, all eight in one number
        x = ~own
        x = x - ((x >> _U(1)) & _EACH[0x55])
        x = (x & _EACH[0x33]) + ((x >> _U(2)) & _EACH[0x33])
        x = ((x + (x >> _U(4))) & _EACH[0x0f]) * _EACH[0x01]
        byte = np.bitwise_count(((rest * _EACH[0x01] | _EACH[0x80]) - x) & _EACH[0x80]).astype(np.uint64) * _U(8)
        rest -= ((x << _U(8)) >> byte) & _U(0xff)
        out[some] = (block * SELECT + word * 8) * 8 + byte.astype(np.int64) + _ZERO_AT[(own >> byte) & _U(0xff), rest] - k
        return out

    def after(self, high: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How many keys have no larger high part, from how many have a smaller one: the ones up to the next zero."""
        bit = high + before
        byte = np.minimum(bit >> 3, len(self.eight) - 1)
        shift = bit - 8 * byte
        own = ~(self.eight[byte] >> shift.astype(np.uint64))
        ones = np.bitwise_count((own & (~own + _U(1))) - _U(1)).astype(np.int64)
        out = before + ones
        far = np.nonzero(ones >= 64 - shift)[0]  # the zero is not among these bits
        out[far] = self.before(high[far] + 1)
        return out


class Packed:
    """Numbers of the same width in bits, one behind the other."""

    @staticmethod
    def raw(values: np.ndarray, width: int, step: int = 1 << 16) -> np.ndarray:
        out = [np.zeros(0, np.uint8)]
        for i in range(0, len(values) if width else 0, step):  # a whole number of bytes each, but the last
            own = np.ascontiguousarray(values[i:i + step].astype("<u8")).view(np.uint8).reshape(-1, 8)
            out.append(np.packbits(np.unpackbits(own, axis=1, bitorder="little")[:, :width], bitorder="little"))
        return np.concatenate([*out, np.zeros(9, np.uint8)])  # so that nine bytes can be read anywhere

    def __init__(self, raw: np.ndarray, width: int):
        self.bytes, self.width, self.mask = raw, width, np.uint64((1 << width) - 1)
        self.eight = np.ndarray(len(raw) - 8, "<u8", raw, strides=(1,))  # from every byte on

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.width
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        value = self.eight[byte] >> shift
        if self.width > 57:  # the ninth byte may hold the last bits
            value |= np.where(shift > 0, self.bytes[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return value & self.mask


class Level:
    """Sorted distinct 64-bit keys by Elias and Fano: high parts in unary, low parts packed, mapped from a file."""

    @staticmethod
    def save(path: str, keys: np.ndarray, columns: dict[str, np.ndarray], shift: int | None = None) -> None:
        """``shift``: how many bits are low; by default so many that there are about as many high parts as keys."""
        first = int(keys[0]) if len(keys) else 0
        span = (int(keys[-1]) - first) if len(keys) else 0
        if shift is None:
            shift = max(0, span.bit_length() - max(1, len(keys)).bit_length())
        base = first >> shift
        high = (keys >> np.uint64(shift)) - np.uint64(base) if len(keys) else np.zeros(0, np.uint64)
        runs = int(high[-1]) + 1 if len(keys) else 0
        low = keys & np.uint64((1 << shift) - 1)
        width = int(low.max()).bit_length() if len(keys) else 0
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            parts = {**Unary.parts(high, runs), "low": Packed.raw(low, width), **columns}
            head = repr({"base": base, "shift": shift, "n": len(keys), "runs": runs, "width": width,
                         "parts": [(k, v.dtype.str, len(v)) for k, v in parts.items()]}).encode()
            f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
            for v in parts.values():
                raw = v.tobytes()
                f.write(raw + b"\0" * (-len(raw) % 8))
        os.replace(own, path)  # a repeated task writes the same file again

    def __init__(self, path: str):
        import ast
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = ast.literal_eval(raw[8:8 + size].tobytes().decode())
        self.base, self.shift, self.n, self.runs = head["base"], np.uint64(head["shift"]), head["n"], head["runs"]
        at, parts = 8 + size + -size % 8, {}
        for name, kind, n in head["parts"]:
            width = np.dtype(kind).itemsize * n
            parts[name] = raw[at:at + width].view(kind)
            at += width + -width % 8
        self.high = Unary(parts.pop("unary"), parts.pop("samples"))
        self.low = Packed(parts.pop("low"), head["width"])
        for name, values in parts.items():
            setattr(self, name, values)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, or -1."""
        return self.search(keys)[0]

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every key, or -1, and which run it belongs to, or -1."""
        out = np.full(len(keys), -1, np.int64)
        high = (keys >> self.shift) - np.uint64(self.base)  # those before the first become very large
        high = np.where(high < np.uint64(self.runs), high, np.uint64(1 << 63)).view(np.int64)
        at = np.nonzero(high >= 0)[0]
        low = keys[at] & np.uint64((1 << int(self.shift)) - 1)
        # keys that follow one another mostly have the high part in common: its run is looked up once
        new = np.append(True, high[at][1:] != high[at][:-1])[:len(at)]
        run, own = np.cumsum(new) - 1, high[at[new]]
        a = self.high.before(own)
        end = self.high.after(own, a)[run]
        a = a[run]
        open_ = np.nonzero(a < end)[0]
        x, y, z = a[open_], end[open_], low[open_]
        while len(open_):  # successor search, all keys at once
            mid = (x + y) >> 1
            less = self.low[mid] < z
            x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
            a[open_] = x
            left = x < y
            open_, x, y, z = open_[left], x[left], y[left], z[left]
        hit = a < end
        hit[hit] = self.low[a[hit]] == low[hit]
        out[at[hit]] = a[hit]
        return out, np.maximum(high, -1)


class Shards:
    """The files of a level, in the order of their keys; opened when first used."""

    def __init__(self, files: list[tuple[int, int, str]]):
        """(first key, number of keys before it, path)"""
        self.files = sorted(files)
        self.first = np.array([f[0] for f in self.files], np.uint64)
        self.open: dict[int, Level] = {}

    def level(self, k: int) -> Level:
        if k not in self.open:
            self.open[k] = Level(self.files[k][2])
        return self.open[k]

    def find(self, keys: np.ndarray, columns: dict[str, np.dtype], missing: dict[str, int],
             by_run: tuple[str, ...] = ()) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Overall place of every key (-1: none) and the named columns there; those in ``by_run`` have a value per run.

        ``keys`` must be in order.
        """
        place = np.full(len(keys), -1, np.int64)
        out = {c: np.full(len(keys), missing[c], t) for c, t in columns.items()}
        bounds = np.append(np.searchsorted(keys, self.first), len(keys))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                level = self.level(k)
                own, run = level.search(keys[a:b])
                hit = own >= 0
                place[a:b][hit] = own[hit] + self.files[k][1]
                for c in columns:
                    at = run if c in by_run else own
                    out[c][a:b][at >= 0] = getattr(level, c)[at[at >= 0]]
        return place, out


class Model:
    """What the driver knows: numbers and file names."""

    def __init__(self, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.word_files, self.level_files = [], []
        self.bits = distinct.bit_length()  # of a word's number; none has all of them set

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.total + 0.1 * (self.distinct + 1))


def _folder(spark) -> str:
    address = urlparse(shared_dir(spark))
    if address.scheme not in ("", "file"):
        raise ValueError("the trie needs a shared folder that is mounted on the executors (a file: address), "
                         f"not {address.scheme}:")
    path = f"{address.path}/trie-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _emit(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(counts.astype(np.int64))], ["k", "n"])


def _sums(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of blocks of keys; about ADDED keys are added up at a time."""
    held, n = [], 0
    for keys in blocks:
        held.append(keys)
        n += len(keys)
        if n >= ADDED:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def _counted(texts: DataFrame, keyed) -> DataFrame:
    """(k, n) of the keys that ``keyed()`` makes of the tokens of a block; added up in tasks, ADDED keys at a time, then in Spark."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = keyed()
        for keys, counts in _sums(make(_hashed(lists)) for b in it for _, _, lists in _blocks(b.column(0))):
            yield _emit(keys, counts)

    return texts.mapInArrow(batches, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _placed(made: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], int]:
    """(first key, keys before, path) of files in the order of their keys from (first key, keys, path), and the number of keys."""
    sizes = [n for _, n, _ in made]
    return [(k, sum(sizes[:i]), path) for i, (k, _, path) in enumerate(made)], sum(sizes)


def _saved(rows: DataFrame, folder: str, name: str, shift: int | None, shards: int) -> tuple[list[tuple[int, int, str]], int]:
    """Range-partitions (k, values...) rows, writes a level file per partition; the files and the number of keys.

    The driver gets one row per shard.
    """
    values = rows.columns[1:]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            keys = _unsigned(t.column(0).to_numpy())
            order = np.argsort(keys, kind="stable")
            columns = {v: t.column(v).to_numpy()[order] for v in values}
            columns = {v: x.astype(np.uint32 if x.max() < 1 << 32 else np.uint64) for v, x in columns.items()}
            path = f"{folder}/{name}-{int(keys[order[0]]):016x}"
            Level.save(path, keys[order], columns, shift)
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[order[0]]) - (1 << 63)], pa.int64()), pa.array([len(keys)], pa.int64()),
                                              pa.array([path], pa.string())], ["k", "n", "path"])

    made = sorted((r["k"] + (1 << 63), r["n"], r["path"]) for r in rows.repartitionByRange(shards, "k")
                  .mapInArrow(batches, "k long, n long, path string").collect())
    return _placed(made)


def _coded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in order and their counts: differences and counts less one, a plane per byte, compressed."""
    planes = [np.diff(keys, prepend=np.uint64(0)).astype("<u8"), (counts - 1).astype("<u8")]
    raw = b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in planes)
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 16 * n, asbytes=True), np.uint8).reshape(2, 8, n)
    deltas, more = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw)
    return np.cumsum(deltas, dtype=np.uint64), more.astype(np.int64) + 1


def _keys(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """A word that is not known (-1) becomes a number that no word has."""
    return (context.astype(np.uint64) << np.uint64(bits)) | (word.astype(np.uint64) & np.uint64((1 << bits) - 1))


def _climbed(levels: list[Shards], bits: int, number: np.ndarray, first: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(code, rest) of every token at each level, and the place of its context for the level above, or -1.

    ``number`` has the words' numbers with an end before the first, ``first`` tells which tokens begin a text.
    """
    context, word, found = number[:-1], number[1:], []
    for level in levels:
        at = np.nonzero(context >= 0)[0]
        asked, back = np.unique(_keys(context[at], word[at], bits), return_inverse=True)
        place, got = level.find(asked, {"code": np.uint8, "rest": np.uint8}, {"code": 255, "rest": 0}, ("rest",))
        code, rest, own = np.full(len(word), 255, np.uint8), np.zeros(len(word), np.uint8), np.full(len(word), -1, np.int64)
        code[at], rest[at], own[at] = got["code"][back], got["rest"][back], place[back]
        found.append((code, rest))
        context = np.append(-1, own[:-1])[:len(word)]
        context[first] = -1  # a text does not go on from the one before
    return found, context


def _grown(texts: DataFrame, model: Model, folder: str, contexts: int, keys_per_shard: int) -> tuple[list[tuple[int, int, str]], int]:
    """Counts the runs of words of the next level and writes it, a file per shard; as ``_saved``.

    A shard has the contexts of a range of places, whole; its files do not depend on the order in which blocks come.
    """
    words, below, bits = model.word_files, list(model.level_files), model.bits
    if contexts.bit_length() + bits > 64:
        raise ValueError("a context and a word have 64 bits together")
    shards = min(contexts, -(-model.total // keys_per_shard))
    name = f"{folder}/level-{len(below) + 2}"

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, levels = Shards(words), [Shards(x) for x in below]
        end = np.uint64(xxhash.xxh3_64_intdigest(END))

        def keys(h: np.ndarray) -> np.ndarray:
            distinct, back = np.unique(h, return_inverse=True)
            number = known.find(distinct, {}, {})[0][back]
            context = _climbed(levels, bits, number, h[:-1] == end)[1]
            return _keys(context, number[1:], bits)[context >= 0]

        for own, counts in _sums(keys(_hashed(lists)) for b in it for _, _, lists in _blocks(b.column(0))):
            shard = (own >> np.uint64(bits)) * np.uint64(shards) // np.uint64(contexts)
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[:len(own)]
            ends = np.append(starts[1:], len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[starts].astype(np.int64)),
                 pa.array([_coded(own[a:b], counts[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())], ["shard", "coded"])

    def merged(t: pa.Table) -> pa.Table:
        parts = [_decoded(x) for x in t.column("coded").to_pylist()]
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[new], np.add.reduceat(n[order], new)
        context = (keys >> np.uint64(bits)).astype(np.int64)
        run = context - context[0]
        total, followers = np.bincount(run, n), np.bincount(run)
        rest = np.where(followers, DISCOUNT * followers / np.maximum(total, 1), 1.0)
        shard = t.column("shard")[0].as_py()
        path = f"{name}-{shard:08d}"
        Level.save(path, keys, {"code": quantised((n - DISCOUNT) / total[run]), "rest": quantised(rest)}, bits)
        return pa.table({"k": pa.array([int(context[0])], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "path": pa.array([path], pa.string())})

    made = sorted((r["k"], r["n"], r["path"]) for r in texts.mapInArrow(blocks, "shard long, coded binary").repartition(shards, "shard")
                  .groupBy("shard").applyInArrow(merged, "k long, n long, path string").collect())
    return _placed([(k << bits, n, path) for k, n, path in made])


def fit(docs: DataFrame, train: Column, text: str = "text", keys_per_shard: int = 2_000_000, order: int = 2) -> Model:
    """Builds the trie of ``order`` levels from the rows where ``train`` holds; a null text is empty and counts as an end."""
    spark = docs.sparkSession
    folder = _folder(spark)
    texts = docs.filter(train).select(text)
    words = written(_counted(texts, lambda: lambda h: h[1:]))
    size = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    model = Model(int(size["n"]), int(size["v"]))
    if not model.distinct:
        return model
    model.word_files, n = _saved(words.select("k", F.col("n").alias("count")), folder, "words", None, -(-model.distinct // keys_per_shard))
    for _ in range(1, order):
        files, n = _grown(texts, model, folder, n, keys_per_shard)
        if not n:  # no text has so many words
            break
        model.level_files.append(files)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, n_known, base_score and score of every whole text.

    A null or empty text is one end token.  Repeated rows give a row each, an empty table none,
    other columns are not looked at.  With nothing learned every word has the unknown word's share.
    """
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels = Shards(model.word_files), [Shards(x) for x in model.level_files]
        for b in it:
            for first, after, lists in _blocks(b.column(1)):
                h = _hashed(lists)
                distinct, back = np.unique(h, return_inverse=True)
                place, got = words.find(distinct, {"count": np.uint64}, {"count": 0})
                c = got["count"][back][1:].astype(np.float64)
                sizes = np.array([len(x) for x in lists])
                starts = np.cumsum(sizes) - sizes
                p = model.unigram(c)
                base = np.log10(p)
                for code, rest in _climbed(levels, model.bits, place[back], starts)[0]:
                    p = VALUE[code] + VALUE[rest] * p
                total = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, after - first), pa.array(sizes.astype(np.int64)),
                     pa.array(total((c > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(np.log10(p)))],
                    [key, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(
        batches, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double")
