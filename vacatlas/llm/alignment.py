"""Alignment of two tokenizations of the same text by an associative fragment monoid.

A byte range of a text owns the tokens that start in it.  Its *fragment* holds three things: the open
prefix (tokens up to the first place where tokens of both kinds end), what follows from the closed
groups between two such places, and the open suffix (tokens behind the last one).  Two neighbouring
fragments compose by scanning only the suffix of the left with the prefix of the right, and any way
to bracket a row of them gives the same result.

So a short text is one fragment, and a very long one is cut at byte ranges that tasks of their own
encode; a tree of groupings, FAN fragments at a time, composes them.  To encode a range a task needs
the words that reach into it and no more: neither coder joins anything across a single space between
other characters.  A stretch without such a space that is longer than a range stays with one task.

How often two ids are linked in the whole corpus is counted per task, summed by Spark and written as
sorted raw files to the shared folder, which tasks map into memory to look counts up.  The ids of short
texts are written in between, so that every text is encoded once.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import shared_dir, written

#: Characters of a range, fragments composed at a time, and links held before a task adds them up.
RANGE, FAN, HELD = 1 << 16, 16, 1 << 20
#: Bytes of short texts, or of their ids, that are worked on together.
PART = 1 << 20
#: Words whose fragments a worker remembers, up to so many characters each.
MEMO, MEMO_LENGTH = 150_000, 40
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Coders:
    """Both coders and the bytes of their entries; one per worker and pair of files."""

    def __init__(self, path_a: str, path_b: str):
        v = Vocabulary(path_a)
        if any(v.ids[v.bytes_of[a] + v.bytes_of[b]] != r + 256 for (a, b), r in v.rank.items()):
            raise ValueError("the ids of the first vocabulary must follow its merges")
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of the second vocabulary must not hold a space behind other characters")
        own = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = v.bytes_of, own
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # an id and what follows it in the written groups: the next id of the group, or the group's other part
        self.shown = [f"{i}{s}" for ends, n in ((",|", len(v.bytes_of)), (",;", len(own))) for s in ends for i in range(n)]
        self.space = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes, str] | None] = {}
        self.kinds = [np.dtype("<u2" if n <= 1 << 16 else "<u4") for n in (len(v.bytes_of), len(own))]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by both coders, or None where either loses bytes."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


    def aligned(self, texts: list[str]) -> list[tuple[bytes, bytes, str] | None]:
        """Packed ids of both kinds and the written groups of every text; None where a coder loses bytes.

        A word with the space before it is a fragment without open ends, so fragments of words are
        remembered and a text's are their concatenation.
        """
        words = [[t] if t.startswith(" ") or _RUN.search(t) else t.split(" ") for t in texts]
        known = self.known
        new = list(dict.fromkeys(w for own in words for w in own if w not in known))
        found = dict(zip(new, self._fragments(new)))
        out = []
        for own in words:
            parts = [known[w] if w in known else found[w] for w in own]
            good = None not in parts
            out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts]), "".join([p[2] for p in parts])) if good else None)
        if len(known) < MEMO:
            known.update((w, f) for w, f in found.items() if len(w) <= MEMO_LENGTH)
        return out

    def _fragments(self, words: list[str]) -> list[tuple[bytes, bytes, str] | None]:
        """Of every word with a space before it, all in one pass."""
        if not words:
            return []
        both = [[self.a.encode_ordinary(" " + w) for w in words], [ids or [self.space] for ids in self.b.encode(words)]]
        raw = [(" " + w).encode() for w in words]
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in both]
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in both]
        ends = [np.cumsum(n[x]) for n, x in zip((self.length_a, self.length_b), ids)]
        wanted = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        same = all(np.array_equal(e[np.cumsum(n) - 1], wanted) and b"".join(map(of.__getitem__, x.tolist())) == b"".join(raw)
                   for e, n, of, x in zip(ends, sizes, (self.bytes_a, self.bytes_b), ids))
        if not same:  # some word is at fault
            good = [i for i, r in enumerate(raw) if all(b"".join([of[t] for t in x[i]]) == r for of, x in zip((self.bytes_a, self.bytes_b), both))]
            out: list = [None] * len(words)
            for i, f in zip(good, self._fragments([words[i] for i in good])):
                out[i] = f
            return out
        shown = list(map(self.shown.__getitem__, written_order(self, ids[0], ends[0], ids[1], ends[1])[0].tolist()))
        at = np.cumsum(sizes[0] + sizes[1]).tolist()
        packed = [x.astype(k).tobytes() for x, k in zip(ids, self.kinds)]
        to = [(np.cumsum(n) * k.itemsize).tolist() for n, k in zip(sizes, self.kinds)]
        return [(packed[0][a:a1], packed[1][b:b1], "".join(shown[s:s1]))
                for a, a1, b, b1, s, s1 in zip([0, *to[0]], to[0], [0, *to[1]], to[1], [0, *at], at)]


_CODERS: dict[tuple[str, str], Coders] = {}


def coders(path_a: str, path_b: str) -> Coders:
    if (path_a, path_b) not in _CODERS:
        _CODERS[path_a, path_b] = Coders(path_a, path_b)
    return _CODERS[path_a, path_b]


_NO = np.zeros((0, 3), np.int64)
_NONE = np.zeros(0, np.int64)


@dataclass
class Closed:
    """What closed groups add up to; ``shown`` ends every group with a semicolon."""

    shown: str = ""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    links: list[np.ndarray] = field(default_factory=list)  # A id << 32 | B id, one per link

    def __add__(self, other: Closed) -> Closed:
        return Closed(self.shown + other.shown, self.n_a + other.n_a, self.n_b + other.n_b,
                      self.n_groups + other.n_groups, self.links + other.links)


@dataclass
class Fragment:
    """Tokens are rows of (id, start, end) in bytes of the whole text.

    ``closed`` is None as long as no place is known where both kinds end; then all is prefix.
    """

    head_a: np.ndarray = field(default_factory=lambda: _NO)
    head_b: np.ndarray = field(default_factory=lambda: _NO)
    closed: Closed | None = None
    tail_a: np.ndarray = field(default_factory=lambda: _NO)
    tail_b: np.ndarray = field(default_factory=lambda: _NO)


def _marks(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where tokens end, in order, and which kinds end there: 1, 2 or both."""
    mark = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    ends = np.flatnonzero(mark)
    return ends, mark[ends]


def _links(ids_a: np.ndarray, ids_b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A id << 32 | B id of every link.

    Between two neighbouring ends lies one stretch, which one token of each kind covers: a link.
    """
    in_a, in_b = kind & 1 > 0, kind & 2 > 0
    return ids_a[np.cumsum(in_a) - in_a] << 32 | ids_b[np.cumsum(in_b) - in_b]


def written_order(c: Coders, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that begin and end together as places in ``c.shown``, in the order they are written, and the kinds of their ends.

    Ends count from where the tokens begin.
    """
    _, kind = _marks(ends_a, ends_b)
    last_a, last_b = kind[kind & 1 > 0] == 3, kind[kind & 2 > 0] == 3
    # groups stand one after the other, of each its A part and then its B part
    close_a, close_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.append(0, close_b)[group_a]] = ids_a + last_a * len(c.bytes_a)
    order[np.arange(len(ids_b)) + close_a[group_b]] = 2 * len(c.bytes_a) + ids_b + last_b * len(c.bytes_b)
    return order, kind


def close(c: Coders, a: np.ndarray, b: np.ndarray) -> Closed:
    """The closed groups of tokens that begin and end together."""
    if not len(a):
        return Closed()
    order, kind = written_order(c, a[:, 0], a[:, 2] - a[0, 1], b[:, 0], b[:, 2] - a[0, 1])
    return Closed("".join(map(c.shown.__getitem__, order.tolist())), len(a), len(b), int((kind == 3).sum()), [_links(a[:, 0], b[:, 0], kind)])


def scan(c: Coders, a: np.ndarray, b: np.ndarray) -> Fragment:
    """The fragment of neighbouring tokens."""
    both = np.intersect1d(a[:, 2], b[:, 2], assume_unique=True)
    if not len(both):
        return Fragment(a, b)
    (a0, a1), (b0, b1) = (np.searchsorted(x[:, 2], both[[0, -1]], "right") for x in (a, b))
    return Fragment(a[:a0], b[:b0], close(c, a[a0:a1], b[b0:b1]), a[a1:], b[b1:])


def compose(c: Coders, x: Fragment, y: Fragment) -> Fragment:
    """Associative; the empty fragment is neutral."""
    open_a, open_b = (x.head_a, x.head_b) if x.closed is None else (x.tail_a, x.tail_b)
    middle = scan(c, np.concatenate([open_a, y.head_a]), np.concatenate([open_b, y.head_b]))
    if x.closed is None:
        if y.closed is None or middle.closed is None:
            return middle
        return Fragment(middle.head_a, middle.head_b, middle.closed + y.closed, y.tail_a, y.tail_b)
    if middle.closed is None:  # then the right one is open, too
        return Fragment(x.head_a, x.head_b, x.closed, middle.head_a, middle.head_b)
    closed = x.closed + close(c, middle.head_a, middle.head_b) + middle.closed
    if y.closed is None:
        return Fragment(x.head_a, x.head_b, closed, middle.tail_a, middle.tail_b)
    return Fragment(x.head_a, x.head_b, closed + y.closed, y.tail_a, y.tail_b)


def whole(c: Coders, x: Fragment) -> Closed:
    """The groups of a whole text, which begins and ends as a group does."""
    return close(c, x.head_a, x.head_b) + (x.closed or Closed())


def of_range(c: Coders, words: str, at: int, start: int, end: int) -> Fragment | None:
    """The fragment of bytes ``start`` to ``end``; ``words`` are those that reach into it, their space at byte ``at``.

    None where a coder loses bytes.
    """
    found = c.tokens(words)
    if found is None:
        return None
    kept = []
    for ids, length in zip(found, (c.length_a, c.length_b)):
        ends = at + np.cumsum(length[ids])
        starts = ends - length[ids]
        own = (starts >= start) & (starts < end)
        kept.append(np.stack([ids, starts, ends], axis=1)[own])
    return scan(c, *kept)


def ranges(text: str, size: int = RANGE) -> Iterator[tuple[str, int, int, int]]:
    """(words, at, start, end) of the byte ranges of a space and the text, about ``size`` characters each."""
    cuts = np.array([m.start() for m in _CUT.finditer(text)] + [len(text)], np.int64)
    left, left_byte = 0, 0  # the cut before the range, and its byte
    start, start_byte = 0, 0
    while start < len(text):
        end = min(len(text), start + size)
        right = int(cuts[np.searchsorted(cuts, end)])
        if right - end > size:  # nothing to cut at nearby: the stretch stays in one piece
            end = right
        here = text[left + (left > 0):right]
        end_byte = start_byte + len(text[start:end].encode()) + (start == 0)
        yield here, left_byte, start_byte, end_byte
        place = int(np.searchsorted(cuts, end, "right")) - 1
        before = max(left, int(cuts[place]) if place >= 0 and cuts[place] <= end else 0)
        # bytes are those of a space and the text, so a cut's own space is one byte further on
        left_byte = end_byte - len(text[before:end].encode()) if before else 0
        left, start, start_byte = before, end, end_byte


# --- Spark ------------------------------------------------------------------------------------------

_OPEN = ["head_a", "head_b", "tail_a", "tail_b"]
_FRAGMENT = ("doc string, place long, good boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, is_closed boolean, "
             "shown string, n_a long, n_b long, n_groups long, links binary, counts binary")


def _summed(links: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links and how often each occurs."""
    if not links:
        return _NONE, _NONE
    keys = np.concatenate(links)
    if counts is None:
        return np.unique(keys, return_counts=True)
    distinct, back = np.unique(keys, return_inverse=True)
    n = np.zeros(len(distinct), np.int64)
    np.add.at(n, back, np.concatenate(counts))
    return distinct, n


def _row(doc: str, place: int, x: Fragment | None, links: np.ndarray, counts: np.ndarray) -> dict:
    f = x or Fragment()
    done = f.closed or Closed()
    return {"doc": doc, "place": place, "good": x is not None, **{o: getattr(f, o).tobytes() for o in _OPEN},
            "is_closed": f.closed is not None, "shown": done.shown, "n_a": done.n_a, "n_b": done.n_b, "n_groups": done.n_groups,
            "links": links.tobytes(), "counts": counts.astype(np.int64).tobytes()}


def _composed(c: Coders, rows: list[dict]) -> tuple[Fragment | None, np.ndarray, np.ndarray]:
    """Neighbouring rows as one fragment; links of composed groups join the counted ones."""
    total, links, counts = Fragment(), [], []
    for r in rows:
        if not r["good"]:
            return None, _NONE, _NONE
        done = Closed(r["shown"], r["n_a"], r["n_b"], r["n_groups"]) if r["is_closed"] else None
        x = Fragment(*(np.frombuffer(r[o], np.int64).reshape(-1, 3) for o in _OPEN[:2]), done,
                     *(np.frombuffer(r[o], np.int64).reshape(-1, 3) for o in _OPEN[2:]))
        total = compose(c, total, x)
        links.append(np.frombuffer(r["links"], np.int64))
        counts.append(np.frombuffer(r["counts"], np.int64))
    own, n = _summed(total.closed.links if total.closed else [])
    if total.closed:
        total.closed.links = []
    return total, *_summed([*links, own], [*counts, n])


def _long(docs: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """One row per long text: ``key``, its whole fragment's groups and its links with counts."""
    spark, kind = docs.sparkSession, docs.schema["key"].dataType.simpleString()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, t in enumerate(b.column(1)):
                doc = uuid.uuid4().hex  # rows may repeat, so a row is named here and kept by the written table
                for place, r in enumerate(ranges(t.as_py(), size)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x]) for x in (doc, place, *r))],
                                                     ["key", "doc", "place", "words", "at", "start", "end"])

    pieces = written(docs.mapInArrow(cut, f"key {kind}, doc string, place long, words string, at long, start long, end long"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coders(*paths)
        for b in it:
            for r in b.to_pylist():
                x = of_range(c, r["words"], r["at"], r["start"], r["end"])
                links, n = _summed(x.closed.links if x and x.closed else [])
                yield pa.RecordBatch.from_pylist([_row(r["doc"], r["place"], x, links, n)], schema)

    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
                        for n, t in (p.split(" ") for p in _FRAGMENT.split(", "))])
    most = pieces.agg(F.max("place")).first()[0]
    level = pieces.select("doc", "place", "words", "at", "start", "end").repartition("doc", "place").mapInArrow(encode, _FRAGMENT)

    def grouped(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        return pa.Table.from_pylist([_row(rows[0]["doc"], rows[0]["place"] // FAN, *_composed(coders(*paths), rows))], schema)

    while most:
        level = level.groupBy("doc", F.floor(F.col("place") / FAN).alias("above")).applyInArrow(grouped, _FRAGMENT)
        most //= FAN
    keys = pieces.filter("place = 0").select("doc", "key")
    return written(level.join(keys, "doc"))


def _saved_counts(counts: DataFrame, rows_per_file: int = 1_000_000) -> list[tuple[int, str]]:
    """Sorted raw files of (link, count, best); a list of each file's first link and place."""
    spark = counts.sparkSession
    folder = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError("spark.checkpoint.dir must be a folder that the executors have mounted")
    files = max(1, -(-counts.count() // rows_per_file))

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in it if b.num_rows]
        if not held:
            return
        k, n, best = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(k)
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{int(k[order[0]])}.npy"
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, np.stack([k[order], n[order], best[order]]))
        os.replace(own, path)  # a repeated task writes the same file again
        yield pa.RecordBatch.from_arrays([pa.array([int(k[order[0]])]), pa.array([path])], ["first", "path"])

    rows = counts.select("link", "n", "best").repartitionByRange(files, "link").mapInArrow(save, "first long, path string").collect()
    return sorted((r["first"], r["path"]) for r in rows)


class Counts:
    """Looks links up in the mapped files."""

    def __init__(self, files: list[tuple[int, str]]):
        self.first = np.array([f for f, _ in files], np.int64)
        self.files = [np.load(p, mmap_mode="r") for _, p in files]

    def find(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of links, and whether each is the highest of its B id."""
        n, best = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
        file = np.searchsorted(self.first, links, "right") - 1
        for i in np.unique(file):
            own = file == i
            at = np.searchsorted(self.files[i][0], links[own])
            n[own], best[own] = self.files[i][1][at], self.files[i][2][at]
        return n, best


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about PART bytes of its second column at a time."""
    ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in b.column(1)]) // PART
    first = 0
    for i in range(1, b.num_rows + 1):
        if i == b.num_rows or ends[i] != ends[first]:
            yield b.slice(first, i - first)
            first = i


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False,
          size: int = RANGE) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every whole text.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids of both files; with ``digest`` it is its SHA-256 as
    ``groups_sha256``, made in the same task.  A text that is null, empty, or that one of the coders does
    not give back byte by byte has no tokens: zeros and an empty string, and it adds nothing to the
    counts.  Repeated rows count and give a row each, an empty table none; other columns are not looked
    at.  Ties for the highest count of a B id all count as best.
    """
    paths = path_a, path_b
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > size, F.lit(False))
    name = "groups_sha256" if digest else "groups"
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"key {kind}, {', '.join(n + ' long' for n in numbers)}, {name} string"

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coders(*paths)
        for b in it:
            for part in _parts(b):
                texts = part.column(1).to_pylist()
                found = iter(c.aligned([t for t in texts if t]))
                out = []
                for t in texts:
                    a, b_ids, groups = (next(found) if t else None) or (b"", b"", "")
                    n_a, n_b, n = len(a) // c.kinds[0].itemsize, len(b_ids) // c.kinds[1].itemsize, groups.count(";")
                    # every end of a token closes a link, and an end of both kinds closes one
                    out.append((n_a, n_b, n, n_a + n_b - n, shown(groups), a, b_ids))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))],
                                                 ["key", *numbers[:4], name, "a", "b"])

    def shown(groups: str) -> str:
        return hashlib.sha256(groups[:-1].encode()).hexdigest() if digest and groups else groups[:-1]

    def links(row_a: bytes, row_b: bytes) -> np.ndarray:
        c = coders(*paths)
        a, b = (np.frombuffer(x, k).astype(np.int64) for x, k in zip((row_a, row_b), c.kinds))
        return _links(a, b, _marks(np.cumsum(c.length_a[a]), np.cumsum(c.length_b[b]))[1]) if len(a) else _NONE

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sums = [], 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*zip(*sums))], ["link", "n"])

        for b in it:
            for a_ids, b_ids in zip(*b.columns):
                held.append(links(a_ids.as_py(), b_ids.as_py()))
                n += len(held[-1])
                if n > HELD:
                    sums.append(_summed(held))
                    held, n = [], 0
                    if sum(len(k) for k, _ in sums) > HELD:
                        sums = [_summed(*zip(*sums))]
                        if len(sums[0][0]) > HELD:
                            yield out()
                            sums = []
        sums.append(_summed(held))
        yield out()

    def counted_long(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                x, links, n = _composed(coders(*paths), [r])
                if x is not None:
                    # the first group of a text is open until here
                    head, m = _summed(close(coders(*paths), x.head_a, x.head_b).links)
                    links, n = _summed([links, head], [n, m])
                yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(n)], ["link", "n"])

    # ids are kept, so texts are encoded once and the counts can be looked up in them
    encoded = written(rows.filter(~is_long).mapInArrow(
        encode, f"key {kind}, {', '.join(n + ' long' for n in numbers[:4])}, {name} string, a binary, b binary"))
    long = _long(rows.filter(is_long), paths, size)
    long_rows = long.select(*[p.split(" ")[0] for p in _FRAGMENT.split(", ")], "key")
    # the sums are written, so the highest counts are taken from the same rows
    counts = written(encoded.select("a", "b").mapInArrow(counted, "link long, n long").union(long_rows.mapInArrow(counted_long, "link long, n long"))
                     .groupBy("link").agg(F.sum("n").alias("n")))
    of_b = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    files = _saved_counts(counts.withColumn("b", of_b).join(highest, "b").select(
        "link", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))

    def answers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counts(files)
        for b in it:
            for part in _parts(b.select(["a", "b", *b.schema.names])):
                own = [links(x.as_py(), y.as_py()) for x, y in zip(part.column(0), part.column(1))]
                sizes = np.array([len(x) for x in own])
                sums = [np.append(0, np.cumsum(x))[np.append(0, np.cumsum(sizes))] for x in found.find(np.concatenate(own))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ["key", *numbers[:4]]), *(pa.array(np.diff(x)) for x in reversed(sums)), part.column(name)],
                    ["key", *numbers, name])

    def answers_long(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, found = coders(*paths), Counts(files)
        for b in it:
            for i, r in enumerate(b.to_pylist()):
                x, keys, times = _composed(c, [r])
                out = (0, 0, 0, 0, 0, 0, "")
                if x is not None:
                    done, head = whole(c, x), close(c, x.head_a, x.head_b)
                    keys, times = _summed([keys, *head.links], [times, *(np.ones(len(h), np.int64) for h in head.links)])
                    n, best = found.find(keys)
                    out = (done.n_a, done.n_b, done.n_groups, int(times.sum()), int((times * best).sum()), int((times * n).sum()), shown(done.shown))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), *(pa.array([v]) for v in out)], ["key", *numbers, name])

    return encoded.mapInArrow(answers, schema).union(long_rows.mapInArrow(answers_long, schema)).withColumnRenamed("key", key)
