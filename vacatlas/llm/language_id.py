"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its runs of 1 to 4 letters, with the edges of words marked; each has a row of a
table of embeddings, found by a hash.  The mean row goes through one linear layer and a softmax.

Training is stochastic gradient descent in numpy over a bounded sample of labelled rows (``ROWS``,
dealt evenly over the languages); Spark reduces each of them to its subword counts beforehand.  A
part of the sample is kept back: on it the temperature of the softmax is fitted, and the confidence
from which predictions are accepted is chosen so that those accepted are wrong no more often than
``ERROR``.

As the model is linear behind the mean, a subword's row and the layer are multiplied once; scoring
adds up those products over the whole text, some characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bound of the labelled sample, and the share of it (one in KEPT_BACK) that calibrates.
ROWS, KEPT_BACK = 6000, 5
BUCKETS, LONGEST, DIM, EPOCHS, RATE = 1 << 16, 4, 16, 6, 0.5
#: Share of wrong ones among accepted predictions.
ERROR = 0.01
#: Characters that are hashed at a time.
SLICE = 1 << 20
NONE = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of a text, some at a time.

    A subword is a window of up to LONGEST characters of the text in lower case, everything but
    letters and marks being an edge; edges may only stand at its ends.
    """
    text = text.lower()
    for at in range(0, len(text), SLICE):
        # a window belongs to the slice that it starts in and looks beyond its end
        part = _OTHER.sub(" ", text[at:at + SLICE + LONGEST])
        if at == 0:
            part = " " + part
        if at + SLICE + LONGEST >= len(text):
            part += " "
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        own = len(c) if at + SLICE >= len(text) else min(len(c), SLICE + (at == 0))
        edge = c == 32
        h = np.zeros(own, np.uint64)
        inner = np.zeros(own, bool)  # whether the window so far has an edge that would be inside
        for n in range(1, LONGEST + 1):
            own = min(own, len(c) - n + 1)
            if own <= 0:
                break
            last, h, inner = edge[n - 1:n - 1 + own], h[:own], inner[:own]
            h = (h ^ (c[n - 1:n - 1 + own] + np.uint64(n))) * _MIX
            h ^= h >> np.uint64(29)
            good = ~inner & ~(edge[:own] & last)
            yield (h[good] >> np.uint64(7)) % np.uint64(BUCKETS)
            if n > 1:
                inner = inner | last


def subwords(text: str | None) -> np.ndarray:
    """Counts of a text's subwords by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    if text and _LETTER.search(text):
        for h in _hashes(text):
            total += np.bincount(h.astype(np.int64), minlength=BUCKETS)
    return total


@dataclass
class Model:
    """``scores`` holds a row per bucket: its embedding times the linear layer."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in _hashes(text):
            total += self.scores[h.astype(np.int64)].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the prediction is accepted."""
        if not text or not self.languages or not _LETTER.search(text):
            return NONE, 0.0, False
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] >= self.accept)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, layer and bias after EPOCHS passes over rows of (buckets, shares), one row a step."""
    r = np.random.default_rng(7)
    embedding = r.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, classes)), np.zeros(classes)
    steps = EPOCHS * len(rows)
    for step in range(steps):
        if step % len(rows) == 0:
            order = r.permutation(len(rows))
        i = order[step % len(rows)]
        at, share = rows[i]
        mean = share @ embedding[at]
        error = softmax(mean @ layer + bias)
        error[y[i]] -= 1
        rate = RATE * (1 - step / steps)
        back = layer @ error
        layer -= rate * np.outer(mean, error)
        bias -= 0.1 * rate * error
        # many subwords share one step, so each moves by its share of the text times their number
        embedding[at] -= rate * np.outer(share * len(at) ** 0.5, back)
    return embedding, layer, bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the least confidence at which accepted rows err at most ERROR."""
    temperatures = np.geomspace(0.02, 20, 121)
    losses = [-np.mean(np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12)) for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    p = softmax(logits / temperature)
    sure, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-sure, kind="stable")
    errs = np.cumsum(wrong[order]) / np.arange(1, len(y) + 1)
    sure = sure[order]
    good = np.nonzero((errs <= ERROR) & np.append(sure[1:] < sure[:-1], True))[0]  # equal ones are accepted together
    return temperature, float(sure[good[-1]]) if len(good) else 1.0


def _sample(docs: DataFrame, train: Column, key: str, text: str, label: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """At most ROWS rows as (language, buckets, shares): of every language in turn the row of least hash.

    Keys are chosen on the narrow columns; only texts of chosen keys are counted.  A key that repeats
    counts once per language: the row of least text hash.
    """
    some = docs.filter(train & F.col(label).isNotNull())
    keys = some.select(F.col(label).alias("y"), F.xxhash64(F.col(key)).alias("h")).distinct()
    # of a frequent language only hashes so small that some 2 * ROWS remain are ranked
    small = F.pmod("h", F.lit(1 << 40))
    often = keys.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    few = keys.join(often, "y").filter(small * F.col("n").cast("double") <= F.lit(float(2 * ROWS * (1 << 40))))
    nth = F.row_number().over(W.partitionBy("y").orderBy(small, "h"))
    chosen = few.withColumn("nth", nth).filter(F.col("nth") <= ROWS).orderBy("nth", small, "h", "y").limit(ROWS).select("y", "h")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, t in enumerate(b.column(3)):
                n = subwords(t.as_py())
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(j).slice(i, 1) for j in range(3)), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                     pa.array([n[at].astype(np.uint32).tobytes()], pa.binary())], ["y", "h", "t", "at", "n"])

    texts = some.select(F.col(label).alias("y"), F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
    own = texts.join(F.broadcast(chosen), ["y", "h"])  # at most ROWS small rows
    first = own.groupBy("y", "h").agg(F.min("t").alias("t"))
    own = own.join(F.broadcast(first), ["y", "h", "t"]).select("y", "h", "t", "x")
    rows = (own.mapInArrow(batches, "y string, h long, t long, at binary, n binary")
            .groupBy("y", "h").agg(F.min_by(F.struct("at", "n"), F.col("t")).alias("r")).select("y", "h", "r.*"))
    out = []
    for r in sorted(rows.collect(), key=lambda r: (r["h"], r["y"])):
        n = np.frombuffer(r["n"], np.uint32).astype(np.float64)
        if len(n):
            out.append((r["y"], np.frombuffer(r["at"], np.uint16).astype(np.int64), n / n.sum()))
    return out


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Learns from rows where ``train`` holds and the label is not null; texts without letters teach nothing."""
    sample = _sample(docs, F.coalesce(train, F.lit(False)), key, text, label)
    languages = sorted({y for y, _, _ in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {y: i for i, y in enumerate(languages)}
    y = np.array([number[r[0]] for r in sample])
    rows = [r[1:] for r in sample]
    back = np.arange(len(rows)) % KEPT_BACK == KEPT_BACK - 1
    learn = [i for i in range(len(rows)) if not back[i]]
    embedding, layer, bias = descend([rows[i] for i in learn], y[learn], len(languages))
    model = Model(languages, (embedding @ layer).astype(np.float32), bias)
    if back.any():
        logits = np.array([rows[i][1] @ model.scores[rows[i][0]] + bias for i in np.nonzero(back)[0]])
        model.temperature, model.accept = calibrate(logits, y[back])
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred, score and accepted of every whole text.

    A text that is null, empty or without a letter is ``und`` with score 0 and not accepted; so is every
    text if nothing was learned.  Repeated rows give a row each, an empty table none; other columns are
    not looked at.  Of equally likely languages the first by name is taken.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of as many floats as languages

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in it:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], [key, "lang_pred", "score", "accepted"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(
        batches, f"`{key}` {kind}, lang_pred string, score double, accepted boolean")
