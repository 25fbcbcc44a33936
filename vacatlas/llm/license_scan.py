"""Licence notices by conditional compression.

Stretches around licence cues are compressed alone and with each template as a raw zstandard dictionary.
The templates are ranked by how much smaller they make a block; the best are laid against the block
word by word, and the one with fewest differences wins if they are few enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Memo
from .license_templates import CUES, TEMPLATES

LEVEL = 19
REACH = 1200  # characters around a cue that a notice may take
CORE = 70  # characters around a cue that are compressed
LEAST_GAIN = 0.1  # bytes saved, as a share of the template
ALLOWED = 0.1  # differing words per template word

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*|<[a-z]+>")
_FREE = re.compile(r"<[a-z]+>$")


@dataclass
class Found:
    license: str
    start: int
    end: int
    gain: float
    missing: list[str]
    extra: list[str]


def cues(text: str) -> list[int]:
    """Where the cues stand in a text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return sorted({m.start() for cue in CUES if cue in low for m in re.finditer(re.escape(cue), low)})


def blocks(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, cores): the surroundings of cues, joined where they touch; the core of each cue, relative to the start.
    Both are widened to word borders."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    around = lambda p, n: (_border(text, max(0, p - n), -1), _border(text, min(len(text), p + n), 1))
    for p in cues(text):
        (a, b), core = around(p, REACH), around(p, CORE)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b, [*out[-1][2], core]
        else:
            out.append((a, b, [core]))
    return [(a, b, [(x - a, y - a) for x, y in cores]) for a, b, cores in out]


def _border(text: str, at: int, step: int) -> int:
    """The next white space from ``at``, at most 60 characters away."""
    for k in range(60):
        p = at + step * k
        if p <= 0 or p >= len(text):
            return min(max(p, 0), len(text))
        if text[p].isspace():
            return p
    return at


class Scanner:
    """Templates ready for compression and comparison; one per worker."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0,
                                                                 write_content_size=0, write_dict_id=0)
        self.alone = zstandard.ZstdCompressor(compression_params=options)
        self.names = [n for n, _ in templates]
        self.words = [[w.lower() for w in _WORD.findall(t)] for _, t in templates]
        self.given = [zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(
            (" ".join(w) + " ").encode() * 3, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.of_block = _Memo(self._scan, 50_000)

    def gains(self, core: str) -> list[tuple[float, int]]:
        """(bytes saved as a share of the template, its number), best first, for every template."""
        plain = " ".join(w.lower() for w in _WORD.findall(core)).encode()
        size = len(self.alone.compress(plain))
        out = []
        for k, c in enumerate(self.given):
            own = max(1, min(size, len(" ".join(self.words[k]))))
            out.append(((size - len(c.compress(plain))) / own, k))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def _scan(self, block: tuple[str, tuple[tuple[int, int], ...]]) -> list[Found]:
        block, cores = block
        tokens = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
        found: list[Found] = []
        best: dict[int, float] = {}
        for a, b in cores:
            for gain, k in self.gains(block[a:b]):
                best[k] = max(gain, best.get(k, gain))
        for k, gain in sorted(best.items(), key=lambda x: (-x[1], x[0])):
            if gain < LEAST_GAIN:
                break
            for lo, hi, missing, extra in placements([t[0] for t in tokens], self.words[k]):
                found.append(Found(self.names[k], tokens[lo][1], tokens[hi - 1][2], round(gain, 4), missing, extra))
        # fewest differences first, then the longer wording, then the greater gain; no two overlap
        found.sort(key=lambda f: (len(f.missing) + len(f.extra), f.start - f.end, -f.gain, f.license))
        out: list[Found] = []
        for f in found:
            if all(f.end <= o.start or f.start >= o.end for o in out):
                out.append(f)
        return sorted(out, key=lambda f: f.start)

    def scan(self, text: str | None) -> list[Found]:
        if not text:
            return []
        return [Found(f.license, f.start + a, f.end + a, f.gain, f.missing, f.extra)
                for a, b, cores in blocks(text) for f in self.of_block[text[a:b], tuple(cores)]]


def placements(block: list[str], template: list[str]) -> list[tuple[int, int, list[str], list[str]]]:
    """(first word, word after, template words missing, block words extra) of all places where the template stands
    with at most ALLOWED differences per word; those of numbers and names of versions are never allowed."""
    most = int(ALLOWED * len(template))
    out, after = [], 0
    anchors = [i for i, w in enumerate(block) if w == template[0]] + [i - 1 for i, w in enumerate(block) if len(template) > 1 and w == template[1] and i]
    for start in sorted(set(anchors)):
        if start >= after and (got := _laid(block, start, template, most)):
            end, missing, extra = got
            out.append((start, end, missing, extra))
            after = end
    return out


def _laid(block: list[str], start: int, template: list[str], most: int) -> tuple[int, list[str], list[str]] | None:
    """The template against the block from ``start`` on, with the fewest differing words (at most ``most``)."""
    states: dict[int, tuple[int, tuple[str, ...], tuple[str, ...]]] = {start: (0, (), ())}
    for k, w in enumerate(template):
        after: dict[int, tuple[int, tuple[str, ...], tuple[str, ...]]] = {}

        def put(i: int, s: tuple[int, tuple[str, ...], tuple[str, ...]], after=after) -> None:
            if s[0] <= most and i <= len(block) and (i not in after or s[0] < after[i][0]):
                after[i] = s

        for i, (n, missing, extra) in states.items():
            if _FREE.match(w):
                for j in range(1, 9):
                    put(i + j, (n, missing, extra))
                continue
            for j in range(most - n + 1):  # extra words before it
                if i + j < len(block) and block[i + j] == w:
                    put(i + j + 1, (n + j, missing, (*extra, *block[i:i + j])))
            if not any(c.isdigit() for c in w):
                put(i, (n + 1, (*missing, w), extra))
        states = after
        if not states:
            return None
    end = min(states, key=lambda i: (states[i][0], i))
    n, missing, extra = states[end]
    return (end, list(missing), list(extra)) if end > start else None


FOUND = "license string, start long, end long, gain double, missing array<string>, extra array<string>"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice found: key, license, start, end (characters), gain, missing, extra.

    Every cue of every whole text is looked at.  Null and empty texts have no notices; repeated
    rows give their rows each; an empty table gives none; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates)
        for b in it:
            rows = [(i, f) for i, t in enumerate(b.column(1)) for f in s.scan(t.as_py())]
            cols = [pa.array([getattr(f, n) for _, f in rows], t) for n, t in (
                ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()),
                ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int64())), *cols],
                                             [key, "license", "start", "end", "gain", "missing", "extra"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, f"`{key}` {kind}, {FOUND.replace(' end ', ' `end` ')}")
