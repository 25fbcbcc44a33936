"""Resampling against a plain computation, and the selection against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from vacatlas.llm import resampling


def features(text, longest):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, longest, percent, least):
    s, t = Counter(), Counter()
    for total, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            total.update(zlib.crc32(f) % buckets for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows, keys = [], []
    for n, (i, x) in enumerate(docs):
        words, own = features(x, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in (zlib.crc32(f) % buckets for f in own))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), weight, score, None])
        if len(words) >= least:
            keys.append((-score, i is None, i or 0, len(own), n))
    for rank, k in enumerate(sorted(keys)[:len(keys) * percent // 100], 1):
        rows[k[-1]][-1] = rank
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, odd_docs, no_docs, longest, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 3)
    monkeypatch.setattr(resampling, "BLOCK", 7)
    monkeypatch.setattr(resampling, "SLICE", 50)
    r = random.Random(6)
    pool = ["Alpha", "beta", "x1", "ÉTÉ", "漢字", "the-end", "don't", "0", "Ω"]
    docs = [(r.randint(0, 60), " ".join(r.choice(pool) for _ in range(r.randint(0, 40)))) for _ in range(150)]
    docs += [(x.doc_id, x.text) for x in odd_docs.collect()] + [(70, "same words here " * 8)] * 30
    target = ["beta beta x1", None, "", "the end of ÉTÉ"]
    table = spark.createDataFrame([(i, t, 1.0, 2) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(5)
    got = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), buckets=50, longest=longest, percent=30, least_words=10)
    assert Counter(map(tuple, got.collect())) == brute(docs, target, 50, longest, 30, 10)
    assert resampling.resample(no_docs, odd_docs).count() == 0
    assert resampling.resample(odd_docs, no_docs).count() == odd_docs.count()


def test_cutoff_is_the_sorted_key(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 5)
    monkeypatch.setattr(resampling, "BLOCK", 11)
    r = random.Random(7)
    rows = [(r.randint(-3, 3), r.randint(0, 1), r.randint(0, 5), 4, n) for n in range(500)]
    keys = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in resampling._KEY)).repartition(7).cache()
    for drawn in (1, 2, 250, 499, 500):
        assert resampling.cutoff(keys, drawn) == sorted(rows)[drawn - 1]
    assert resampling.cutoff(keys, 0) is None and resampling.cutoff(keys, 501) is None


def test_a_median_leaves_a_quarter_on_either_side():
    r = random.Random(8)
    for _ in range(200):
        blocks = [sorted((r.randint(0, 50), r.random()) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 12))]
        pivot = resampling.weighted_median([b[(len(b) - 1) // 2] for b in blocks], [len(b) for b in blocks])
        every = [k for b in blocks for k in b]
        assert sum(k <= pivot for k in every) * 4 >= len(every) and sum(k >= pivot for k in every) * 4 >= len(every)
