"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one token that its encoding ends with.  That token is a suffix
of the prefix (an automaton over the vocabulary lists those) and fits the last token of the prefix
before it: merging the bytes of both gives the two tokens back.  So one pass from left to right
stores the last token of every prefix, and the ids are read off backwards.

Texts are first cut as the vocabulary file demands.  Cuts at single spaces are always cuts of the
file's pattern too, so words with their leading space are encoded once per worker and remembered
(``MEMO`` entries at most; beyond that they are computed each time, with the same result).
"""

from __future__ import annotations

import array
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 300_000
LIBRARY_MEMO = 50_000
MEMO_LENGTH = 64
#: Fixed value: the public byte-level pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AFTER_SPACE = re.compile(r"\s ")


def _byte_of() -> dict[str, int]:
    """The printable stand-in that the vocabulary file uses for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """Remembers what ``make`` gives, up to a number of short keys."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and (isinstance(key, int) or len(key) <= MEMO_LENGTH):
            self[key] = value
        return value


class Vocabulary:
    """A byte-level BPE vocabulary file: tokens as bytes, the order of merges, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of()
        raw = lambda t: bytes(to_byte[c] for c in t)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.ids[raw(left)], self.ids[raw(right)]
            self.rank[pair] = r
            self.made_of.setdefault(self.ids[raw(left) + raw(right)], (*pair, r))
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()


class Codec:
    """Encodes and decodes whole texts; one per worker and vocabulary file.

    With ``library`` the words are encoded by tiktoken under the same vocabulary instead of the
    dynamic programme: the same ids, for operators that only need them.
    """

    def __init__(self, path: str, library: bool = False):
        self.vocabulary = v = Vocabulary(path)
        self.length = [len(t) for t in v.bytes_of]
        self.pieces = regex.compile(PATTERN)
        self.added = re.compile("|".join(map(re.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None
        self.fits = _Memo(self._fits, 1_000_000)
        self.of_piece = _Memo(self._piece)
        self.encoding = self._encoding() if library else None
        self.matches = ahocorasick.Automaton()
        if self.encoding is None:
            for t, i in v.ids.items():
                self.matches.add_word(t.decode("latin-1"), i)
            self.matches.make_automaton()
        else:  # the library has tables of its own
            v.rank, v.made_of, self.length = {}, {}, []
        # by the word behind a space; the library computes a rare one fast
        self.of_word = _Memo(lambda w: self._word(" " + w), LIBRARY_MEMO if self.encoding is not None else MEMO)

    def _encoding(self) -> tiktoken.Encoding | None:
        """The library's coder, if the order of the ids is that of the merges, as it takes for granted."""
        v = self.vocabulary
        if any(v.ids[v.bytes_of[a] + v.bytes_of[b]] != r + 256 for (a, b), r in v.rank.items()):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={})

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one end of ``token`` while it is being merged, each with the rank that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.vocabulary.made_of:
                return out
            parts = self.vocabulary.made_of[token]
            token, until = parts[side], parts[2]

    def _fits(self, pair: int) -> bool:
        """Whether no merge joins the two tokens' bytes across their border before both are complete.

        Equal ranks are the same rule: it is applied from the left, so the left token's own merge
        goes before one across the border and that one before the right token's.
        """
        a, b = pair >> 20, pair & 0xFFFFF
        rank, starts = self.vocabulary.rank, self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in starts:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _piece(self, piece: str) -> bytes:
        text = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ids.get(text)
        if whole is not None:
            return whole.to_bytes(4, "little")
        length, fits = self.length, self.fits
        last = [-1] * (len(text) + 1)
        for at, token in self.matches.iter(text.decode("latin-1")):
            end = at + 1
            if last[end] < 0:
                before = end - length[token]
                if before == 0 or (last[before] >= 0 and fits[last[before] << 20 | token]):
                    last[end] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _word(self, word: str) -> bytes:
        if self.encoding is not None:
            return array.array("I", self.encoding.encode_ordinary(word)).tobytes()
        return b"".join([self.of_piece[p] for p in self.pieces.findall(word)])

    def _plain(self, text: str) -> bytes:
        if _AFTER_SPACE.search(text):  # a run of white space that a cut at spaces would split
            return self._word(text)
        first, *rest = text.split(" ")
        return self._word(first) + b"".join(map(self.of_word.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; no ids for a null or empty text."""
        if not text:
            return b""
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self._plain(text[at:m.start()]) if m.start() > at else b"",
                    self.vocabulary.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:]) if at < len(text) else b""])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        of = self.vocabulary.bytes_of
        return b"".join([of[i] for i in array.array("I", ids)]).decode("utf-8", "replace")


_CODECS: dict[tuple[str, bool], Codec] = {}


def codec(path: str, library: bool = False) -> Codec:
    if (path, library) not in _CODECS:
        _CODECS[path, library] = Codec(path, library)
    return _CODECS[path, library]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of every whole text.

    A null text counts as empty: no ids and an empty decoded text.  Repeated rows give a row each,
    an empty table none; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in it:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(i) for i in ids], pa.string())],
                [key, "ids", "decoded"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, f"`{key}` {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``encode`` gives, reduced in the same tasks to counts and SHA-256 digests."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in it:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids))
                text_sha.append(sha(c.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(
        batches, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
