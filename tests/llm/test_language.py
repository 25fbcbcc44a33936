"""Language identification: features against single windows, held-out accuracy, rejection."""

import random
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from vacatlas.llm import language_id as li


def windows(text):
    """All subwords by looking at one window at a time."""
    line = " " + regex.sub(r"[^\p{L}\p{M}]", " ", text.lower()) + " "
    out = Counter()
    for n in range(1, li.LONGEST + 1):
        for i in range(len(line) - n + 1):
            w = line[i:i + n]
            if " " not in w[1:-1] and not (w[0] == " " and w[-1] == " "):
                out[w] += 1
    return out


def one(w):
    h = np.uint64(0)
    for n, c in enumerate(w, 1):
        with np.errstate(over="ignore"):
            h = (h ^ np.uint64(ord(c) + n)) * li._MIX
        h ^= h >> np.uint64(29)
    return int((h >> np.uint64(7)) % np.uint64(li.BUCKETS))


def test_subwords_are_those_of_single_windows_in_any_slices(monkeypatch):
    r = random.Random(1)
    for size in (li.SLICE, 1, 3, 7):
        monkeypatch.setattr(li, "SLICE", size)
        for _ in range(60):
            text = "".join(r.choice("aB éñ漢,.1 \n-ß") for _ in range(r.randint(1, 30)))
            want = np.zeros(li.BUCKETS, np.int64)
            if regex.search(r"\p{L}", text):
                for w, n in windows(text).items():
                    want[one(w)] += n
            assert (li.subwords(text) == want).all(), (size, text)


def test_calibration():
    r = np.random.default_rng(2)
    y = r.integers(0, 3, 4000)
    logits = r.normal(size=(4000, 3)) + 1.5 * np.eye(3)[y]
    t, accept = li.calibrate(logits * 5, y)
    assert 3 < t < 8  # the true scale is 1/1.5 of the noise
    p = li.softmax(logits * 5 / t)
    assert np.mean(p.argmax(1)[p.max(1) >= accept] != y[p.max(1) >= accept]) <= li.ERROR
    assert li.calibrate(np.zeros((4, 2)), np.array([0, 1, 0, 1]))[1] == 1.0  # nothing can be told apart


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = li.fit(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    assert model.languages == sorted({x.lang for x in rows})
    got = {x.doc_id: x for x in li.identify(docs, model).collect()}
    out = [x for x in rows if held(x.doc_id)]
    assert np.mean([got[x.doc_id].lang_pred == x.lang for x in out]) >= 0.98
    sure = [x for x in out if got[x.doc_id].accepted]
    assert len(sure) >= 0.9 * len(out) and np.mean([got[x.doc_id].lang_pred == x.lang for x in sure]) >= 0.98
    # what is no text of any of these languages is less sure
    assert model.predict("zzxq wkj vvv qqq")[1] < np.median([got[x.doc_id].score for x in out])


def test_odd_rows(spark, odd_docs, no_docs):
    labelled = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 5, None).when(F.col("doc_id") == 9, "zh").otherwise("xx"))
    model = li.fit(labelled, F.lit(True))
    assert model.languages == ["xx", "zh"]
    got = li.identify(labelled, model).collect()
    assert len(got) == labelled.count()
    assert {(x.lang_pred, x.score, x.accepted) for x in got if x.doc_id in (1, 2, 3)} == {("und", 0.0, False)}
    assert all(0 <= x.score <= 1 and x.lang_pred in ("xx", "zh") for x in got if x.doc_id and x.doc_id > 3)
    nothing = li.fit(no_docs, F.lit(True))
    assert {x.lang_pred for x in li.identify(labelled, nothing).collect()} == {"und"}
    assert li.identify(no_docs, model).count() == 0


def test_the_sample_is_bounded_and_takes_turns(spark, monkeypatch):
    monkeypatch.setattr(li, "ROWS", 20)
    rows = [(i, f"wort {i} ja", "a") for i in range(200)] + [(i, f"word {i} no", "b") for i in range(5)] + [(7, "word word", "b")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = Counter(y for y, _, _ in li._sample(docs, F.lit(True), "doc_id", "text", "lang"))
    assert got == {"a": 14, "b": 6}
