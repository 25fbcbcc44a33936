"""Toxicity of texts behind disguises: a noisy channel undone by Viterbi search, then a word score.

A disguised word is a lattice: leetspeak signs may stand for letters, separators may be noise or
word borders, repeated letters may stand for one or two.  The path that a character trigram model of
the corpus likes best is the restored word.  A word without any disguise has one path, itself.

Restored words are scored by the share of toxic documents among the labelled ones that hold the
word or its beginning, drawn towards the base rate; a document has the score of its worst word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _Memo
from .common import crc_fold, hash_sample

#: Letters that a sign may stand for, and signs used as separators inside words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = ".-_*'~/\\"
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
SIGNS = 28  # border, a to z, any other letter
PREFIXES = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[\s.\-_*]+\S(?!\S)){2,}")
_MANY = re.compile(r"([^\W\d_])\1|[0-9@$!|+€£(¡.\-_*'~/\\]")  # what has more than one path in a lattice
_SHARP = re.compile(r"[!(|]")  # punctuation that may stand for letters
_EDGES = ".,;:?!\"'()[]{}<>#%&*|"


def _sign(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


_TABLE = np.zeros(256, np.int64)
_TABLE[97:123] = np.arange(1, 27)
_TABLE[65:91] = np.arange(1, 27)
_TABLE[128:] = 27


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three signs follow each other in all texts: SIGNS ** 3 numbers, added up in Spark."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS ** 3, np.int64)
        for b in it:
            for t in b.column(0):
                raw = (t.as_py() or "").encode()
                for at in range(0, len(raw), 1 << 20):  # a long text in parts that overlap
                    x = _TABLE[np.frombuffer(raw[max(0, at - 2):at + (1 << 20)], np.uint8)]
                    if len(x) > 2:
                        total += np.bincount(x[:-2] * SIGNS ** 2 + x[1:-1] * SIGNS + x[2:], minlength=SIGNS ** 3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(SIGNS ** 3, np.int64)
    for r in docs.select(text).mapInArrow(batches, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def language_model(counts: np.ndarray, weight: float = 8.0) -> list[float]:
    """Log probabilities of a sign after two others, interpolated with shorter contexts."""
    c3 = counts.reshape(SIGNS, SIGNS, SIGNS).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIGNS)
    p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
    p3 = (c3 + weight * p2) / (c3.sum(2, keepdims=True) + weight)
    return np.log(p3).ravel().tolist()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters, what it may stand for and at what cost."""
    runs = [(c, len(list(g))) for c, g in groupby(word)]
    out = []
    for k, (c, n) in enumerate(runs):
        edge = k in (0, len(runs) - 1)
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, 2.0)] if n == 2 else [(c, 0.5), (c * 2, 0.5)])
        elif c in LEET:
            out.append([x for o in LEET[c] for x in ((o, 1.0), (o * 2, 2.0))[:1 if n == 1 else 2]]
                       + [("", 3.0 if edge else 9.0), (" ", 4.0)])
        elif c in SEPARATORS:
            out.append([("", 0.5), (" ", 1.0)] + [(v, 3.0) for v in "aeiou" if c == "*"])
        else:
            out.append([(" ", 0.5)] if c != " " else [("", 0.5), (" ", 1.0)])
    return out


class Restorer:
    """Best paths under the character model; per worker."""

    def __init__(self, model: list[float]):
        self.model = model

    def best(self, word: str) -> str:
        """The restored form of a lower-case word or spaced-out run."""
        # a path is (path before, emitted), so a long word takes time in proportion to its length
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        model = self.model
        for options in [*lattice(word), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for emitted, cost in options:
                    x, y, s = a, b, score - cost
                    for c in emitted:
                        if c == " " and y == 0:  # one border is enough
                            continue
                        z = _sign(c)
                        s += model[(x * SIGNS + y) * SIGNS + z]
                        x, y = y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = s, (path, emitted)
            states = after
        path, parts = max(states.values(), key=lambda x: x[0])[1], []
        while path:
            path, emitted = path
            parts.append(emitted)
        return "".join(reversed(parts)).strip()


class Sieve:
    """Whether any path of a word's lattice, likely or not, holds something of the lexicon.

    Paths differ from one another in repeated letters, so letters are compared with repeats taken out.  A word
    that fails has the same score whatever its best path is; only the others are decoded.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.found, self.begun = set(), {""}
        for f in lexicon:
            whole, short = f[:1] == "=", "".join(c for c, _ in groupby(f.lstrip("=")))
            self.found.add("=" + short if whole else short)
            self.begun.update(short[:n] for n in range(1, len(short) + 1))

    def passes(self, word: str) -> bool:
        states: set[str | None] = {""}  # letters since the last border, or None where no entry begins like that
        plain = word.isalpha()
        for c, _ in groupby(word):
            if c.isalpha():
                options: tuple[str, ...] = (c,)
            elif c in LEET:
                options = (*LEET[c], "", " ")
            elif c in SEPARATORS:
                options = ("", " ", *("aeiou" if c == "*" else ""))
            else:
                options = ("", " ")
            after = set()
            for s in states:
                for o in options:
                    if o == " ":
                        if s and "=" + s in self.found:
                            return True
                        after.add("")
                    elif o == "" or s is None:
                        after.add(s)
                    else:
                        t = s if s.endswith(o) else s + o
                        if t in self.found:
                            return True
                        after.add(t if t in self.begun else None)
            states = after
            if plain and states == {None}:
                return False
        return any(s and "=" + s in self.found for s in states)


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


class Scorer:
    """Restores and scores texts; built in the worker from the model that the driver sends."""

    def __init__(self, model: list[float], lexicon: dict[str, float], floor: float):
        self.restorer, self.sieve, self.lexicon, self.floor = Restorer(model), Sieve(lexicon), lexicon, floor
        self.of_word = _Memo(self._of_word, 150_000)

    def restore_word(self, word: str) -> str:
        core = word.strip(_EDGES)
        return self._restored(core) if core else ""

    def _restored(self, core: str) -> str:
        if not _MANY.search(core) or core.isalpha() and "=" + core in self.lexicon:
            return core  # one path, or a word that is evidence as it stands
        return self.restorer.best(core)

    def readings(self, raw: str, sieve: Sieve | None = None) -> list[str]:
        """Restored words of a raw word; signs at its edges are read as punctuation and as letters.

        With a ``sieve`` only forms that can hold an entry of the lexicon.
        """
        core = raw.strip(_EDGES)
        forms = dict.fromkeys([core])
        if core or any(c in LEET for c in raw):
            left, right = raw[:len(raw) - len(raw.lstrip(_EDGES))], raw[len(raw.rstrip(_EDGES)):] if core else ""
            left = left[len(left.rstrip("!(|")):]
            right = right[:len(right) - len(right.lstrip("!(|"))]
            forms.update(dict.fromkeys([left + core, core + right, left + core + right]))
        return [w for f in forms if f and (sieve is None or not _MANY.search(f) or sieve.passes(f))
                for w in _WORD.findall(self._restored(f))]

    def words(self, text: str) -> list[str]:
        """Restored words of a text."""
        return [w for raw in self.raw(text) for w in self.readings(raw)]

    def raw(self, text: str) -> set[str]:
        """Distinct lower-case words of a text, spaced-out runs as one word more."""
        if not text.isascii():
            text = text.translate(INVISIBLE)
        text = text.lower()
        out = set(text.split())
        for m in _SPACED.finditer(text):
            out.add(re.sub(r"[\s.\-_*]+", "-", m[0]))
        return out

    def _of_word(self, raw: str) -> float:
        known = self.lexicon
        best = 0.0
        core = raw.strip(_EDGES)
        if core.isalpha() and not _MANY.search(core) and not _SHARP.search(raw):  # one path, itself
            if core[:4] not in self.sieve.begun:
                return 0.0
            words = [core]
        else:
            words = self.readings(raw, self.sieve)
        for w in words:
            for f in features(w):
                best = max(best, known.get(f, 0.0))
        return best

    def score(self, text: str | None) -> float:
        if not text:
            return self.floor
        of = self.of_word  # long words are not kept
        return max(self.floor, max((of[w] if len(w) <= 200 else self._of_word(w) for w in self.raw(text)), default=0.0))


def _near_key(text: str) -> int:
    """Copies and near copies of a text mostly share it, others do not: the smallest hash of its five-word windows."""
    words = text.lower().split()
    return min(zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, prior: float = 5.0, least: int = 3,
        key: str = "doc_id", text: str = "text") -> tuple[list[float], dict[str, float], float]:
    """(character model, word lexicon, score without evidence).

    The character model counts all texts.  The lexicon is learned from at most ``sample_rows``
    labelled rows outside fold 1 of 3, those of smallest key hash; of copies and near copies (same
    smallest window hash) one counts.  Without such rows the lexicon is empty.
    """
    model = language_model(trigram_counts(docs, text))
    chosen = hash_sample(labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & (crc_fold(F.col(key), 3) != 1))
                         .groupBy(key).agg(F.max("toxic").alias("_toxic")), key, sample_rows)

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, {}, 0.0)
        for b in it:
            rows = [sorted(set(scorer.words(t.as_py() or ""))) for t in b.column(0)]
            keys = [_near_key(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.string())), pa.array(keys, pa.int64()), b.column(1)], ["words", "near", "toxic"])

    # bounded by sample_rows
    sample = (docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text", "_toxic")
              .mapInArrow(own, "words array<string>, near long, toxic int")
              .groupBy("near").agg(F.min_by("words", F.size("words")).alias("words"), F.max("toxic").alias("toxic")))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, n = Counter(), Counter(), [0, 0]
        for b in it:
            for words, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                (bad if toxic else good).update({f for w in words for f in features(w)})
        names = ["", *bad, *(f for f in good if f not in bad)]
        bad[""], good[""] = n[1], n[0]
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([bad[f] for f in part], pa.int64()),
                                              pa.array([good[f] for f in part], pa.int64())], ["f", "bad", "good"])

    totals = (sample.select("words", "toxic").mapInArrow(counted, "f string, bad long, good long")
              .groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
              .filter((F.col("bad") >= least) & (5 * F.col("bad") >= F.col("good")) | (F.col("f") == "")).collect())
    found = {r["f"]: (r["bad"], r["good"]) for r in totals}
    bad, good = found.pop("", (0, 0))
    rate = (bad + 1) / (bad + good + 2)
    # a beginning is shared by words of other kinds: clean texts that hold it count more
    lexicon = {f: round((b + prior * rate) / (b + (2 if f[:1] == "=" else 4) * g + prior), 6) for f, (b, g) in found.items()}
    lexicon = {f: p for f, p in lexicon.items() if p > 2 * rate}
    return model, lexicon, min(rate, 0.5) / 2


def score(docs: DataFrame, fitted: tuple[list[float], dict[str, float], float], key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every whole text.

    A null or empty text has the score without evidence; repeated rows give a row each; an empty
    table gives no rows; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*fitted)
        for b in it:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([scorer.score(t.as_py()) for t in b.column(1)], pa.float64())], [key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, f"`{key}` {kind}, score double")


def score_column(fitted: tuple[list[float], dict[str, float], float], text: Column) -> Column:
    """The score as a column, for filters that keep whole rows."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*fitted)
        for b in batches:
            yield b.map(lambda t: scorer.score(t if isinstance(t, str) else None)).astype(float)

    return scores(text)


def restored(fitted: tuple[list[float], dict[str, float], float], word: str) -> str:
    """The restored form of one word or spaced-out run."""
    scorer = Scorer(*fitted)
    return " ".join(scorer.restore_word(w) for w in scorer.raw(word) if len(scorer.raw(word)) == 1 or "-" in w)
