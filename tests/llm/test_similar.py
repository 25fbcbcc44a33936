"""Near duplicates, nearest neighbours and language-model scores against brute force."""

import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacatlas.llm import lm_trie, near_dedup, nn_descent


def labelled_windows(text):
    words, seen, out = (text or "").lower().encode().split(), Counter(), set()
    for g in zip(*[words[i:] for i in range(5)], strict=False):
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def test_edit_distance():
    r = random.Random(3)
    for _ in range(1500):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 12))]
        b = [x for x in a if r.random() > 0.2] + [r.randint(0, 3) for _ in range(r.randint(0, 3))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        most = r.randint(0, 8)
        got = near_dedup.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
        assert got == (row[-1] if row[-1] <= most else None)


def test_both_alignments_agree():
    r = random.Random(12)
    for _ in range(300):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 14))]
        b = [r.randint(0, 4) if r.random() < 0.3 else x for x in a][:r.randint(0, 14)] + [r.randint(0, 4) for _ in range(r.randint(0, 3))]
        most = r.randint(0, 12)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert near_dedup.banded_distance(x, y, most) == near_dedup.edit_distance(x, y, most), (a, b, most)


def test_alignment_decides():
    r = random.Random(13)
    a = np.array([r.randint(0, 9999) for _ in range(400)], np.uint64)
    scattered = a.copy()
    scattered[::20] = 77777                        # 20 changed words: window similarity 0.6, edit similarity 0.95
    assert near_dedup.window_similarity(a, scattered) < 0.7 and near_dedup.similar(a, scattered)
    many = a.copy()
    many[::5] = 77777                              # 80 of 400
    assert near_dedup.similar(a, many) and not near_dedup.similar(a, np.append(many[1:], [5, 6, 7, 8]).astype(np.uint64))
    assert not near_dedup.similar(a, np.roll(a, 200))


def test_classes_are_those_of_all_pairs(spark):
    r = random.Random(4)
    text = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    passage, rows = text(60), []
    for k in range(60):
        base = text(r.choice([40, 120, 400]))
        rows.append(base)
        for _ in range(r.choice([0, 1, 4])):  # near copies
            copy = list(base)
            for _ in range(max(1, len(copy) // 120)):
                copy[r.randrange(len(copy))] = "changed"
            rows.append(copy)
        if k % 5 == 0:
            rows.append(list(base))
        rows.append(text(150) + passage)  # a passage in common makes no copy
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x for x in near_dedup.classes(docs).collect()}
    own = [labelled_windows(" ".join(t)) for t in rows]

    def joined(together):
        root = list(range(len(rows)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        for i in range(len(rows)):
            for j in range(i):
                if together(i, j):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
        return [top(i) for i in range(len(rows))]

    def by_windows(i, j):
        both = len(own[i] & own[j])
        return both >= 0.8 * (len(own[i]) + len(own[j]) - both)

    def by_words(i, j):
        numbers = {w: n for n, w in enumerate(dict.fromkeys(rows[i] + rows[j]))}
        return by_windows(i, j) or near_dedup.similar(*(np.array([numbers[w] for w in rows[k]], np.uint64) for k in (i, j)))
    # no link of similar windows is missing, and nothing is joined that an alignment does not join
    least, most = joined(by_windows), joined(by_words)
    for i in range(len(rows)):
        assert got[i].class_id == got[least[i]].class_id and most[i] == most[got[i].class_id], i
    assert len({x.class_id for x in got.values()}) <= len(set(least))
    assert sum(x.representative for x in got.values()) == len({x.class_id for x in got.values()})


def test_copies_alike_only_to_their_base_are_one_class(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [base]
    for k in range(1000):
        copy = list(base)
        for i in r.sample(range(400), 8):
            copy[i] = f"own{k}x{i}"
        rows.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    own = [labelled_windows(" ".join(t)) for t in rows]
    alike = [len(own[0] & x) >= 0.8 * len(own[0] | x) for x in own]
    assert sum(alike) > 900
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    assert all(got[i] == 0 for i in range(len(rows)) if alike[i])


def test_links_inside_buckets_of_unlike_texts_are_found(spark):
    r = random.Random(11)
    passage, rows = [f"p{i}" for i in range(120)], []
    for k in range(120):  # half the words in common: many buckets, no link; every third text has a near copy
        text = passage + [f"own{k}x{r.randint(0, 10 ** 6)}" for _ in range(100)]
        rows.append(text)
        if k % 3 == 0:
            copy = list(text)
            copy[r.randrange(len(copy))] = "changed"
            copy[r.randrange(len(copy))] = "again"
            rows.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    own = [labelled_windows(" ".join(t)) for t in rows]
    first = {i: next(j for j in range(i + 1) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])) for i in range(len(rows))}
    assert len(set(first.values())) == 120
    assert {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()} == first


def test_short_texts_are_compared_by_their_words(spark):
    """Ten words and the first eight of them: an edit similarity of 0.8, though four windows stand against six."""
    rows = []
    for k in range(40):
        text = [f"w{k}x{i}" for i in range(10)]
        rows += [text, text[:8]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    codes = [np.array([near_dedup.xxhash.xxh3_64_intdigest(w) for w in t], np.uint64) for t in rows]
    agree = [bool(set(zip(range(16), near_dedup.sketches(codes[i]))) & set(zip(range(16), near_dedup.sketches(codes[i + 1])))) for i in range(0, 80, 2)]
    assert sum(agree) >= 38
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(40) if agree[k])


def test_scattered_copies_inside_buckets_of_unlike_texts_are_found(spark):
    """A passage in common keeps buckets open; the copies' windows are less alike than 0.8, their words more."""
    passage, rows = [f"p{i}" for i in range(120)], []
    for k in range(100):
        text = passage + [f"own{k}x{i}" for i in range(100)]
        rows.append(text)
        if k % 2 == 0:
            copy = list(text)
            for i in range(122 + k % 5, 220, 10):
                copy[i] = f"new{k}x{i}"
            rows.append(copy)
    own = [labelled_windows(" ".join(t)) for t in rows]
    pairs = [i for i in range(1, len(rows)) if len([w for w in rows[i] if w in set(rows[i - 1])]) == 210]
    assert len(pairs) == 50 and all(len(own[i] & own[i - 1]) < 0.75 * len(own[i] | own[i - 1]) for i in pairs)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    assert [got[i] for i in pairs] == [i - 1 for i in pairs] and len(set(got.values())) == 100


def test_rare_runs_keep_every_similar_pair():
    """Two texts that are similar lack LACKED runs per word of each other at most."""
    r = random.Random(31)
    for _ in range(400):
        a = [r.randint(0, 30) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 1 + len(a) // 5)):
            i = r.randrange(len(b) + 1)
            b[i:i + r.randint(0, 1)] = [r.randint(0, 30)] * r.randint(0, 1)
            b = b or [1]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        if near_dedup.similar(x, y):
            p, q = near_dedup.windows(x, near_dedup.RUN)[1], near_dedup.windows(y, near_dedup.RUN)[1]
            both = len(np.intersect1d(p, q))
            assert len(p) - both <= near_dedup.LACKED * len(a) + 1e-6 and len(q) - both <= near_dedup.LACKED * len(b) + 1e-6, (a, b)


def test_runs_of_every_length_bound_what_similar_texts_lack():
    r = random.Random(32)
    for _ in range(300):
        a = [r.randint(0, 30) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 1 + len(a) // 5)):
            i = r.randrange(len(b) + 1)
            b[i:i + r.randint(0, 1)] = [r.randint(0, 30)] * r.randint(0, 1)
            b = b or [1]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        if near_dedup.similar(x, y):
            for run in near_dedup.RUNS:
                p, q = near_dedup.windows(x, run)[1], near_dedup.windows(y, run)[1]
                both = len(np.intersect1d(p, q))
                assert len(p) - both <= 0.2 * run * len(a) + 1e-6 and len(q) - both <= 0.2 * run * len(b) + 1e-6, (a, b, run)


def test_texts_that_share_half_their_words_are_not_all_compared(spark, monkeypatch):
    """Compared pairs grow with the texts, not with their square; the near copies among them are found."""
    r = random.Random(12)
    passage, rows = [f"p{i}" for i in range(110)], []
    for k in range(300):  # own words from one vocabulary: single words are no one's own
        text = passage + [f"w{r.randint(0, 3000)}" for _ in range(90)]
        rows.append(text)
        if k % 10 == 0:
            rows.append(text[:150] + ["changed"] + text[151:])
    compared, write = [], near_dedup.written

    def counted(df):
        out = write(df)
        if sys._getframe(1).f_code.co_name == "classes" and out.columns == ["a", "b"]:
            compared.append(out.count())
        return out
    monkeypatch.setattr(near_dedup, "written", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    copies = [i for i, t in enumerate(rows) if "changed" in t]
    assert len(copies) == 30 and [got[i] for i in copies] == [i - 1 for i in copies] and len(set(got.values())) == 300
    assert sum(compared) < 15 * len(rows), compared


def test_no_link_of_a_group_near_the_threshold_is_lost(spark):
    """A base with own words at its end, some more and some fewer than a link can take."""
    r = random.Random(13)
    base = [f"p{i}" for i in range(60)]
    rows = [base + [f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 60))] for _ in range(160)]
    codes = [near_dedup._wide(pa.scalar(near_dedup._codes([w.encode() for w in t]).astype("<u4").tobytes())) for t in rows]
    marks = [set(enumerate(near_dedup.sketches(near_dedup._codes([w.encode() for w in t])))) for t in rows]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    alike = [(i, j) for i in range(160) for j in range(i) if near_dedup.similar(codes[i], codes[j])]
    assert 1 < len(set(got.values())) < 160
    assert all(got[i] == got[j] for i, j in alike if marks[i] & marks[j])
    top = list(range(160))
    for i, j in sorted(alike, key=lambda x: x[1]):  # nothing is joined that no chain of links joins
        a, b = sorted((top[i], top[j]))
        top = [a if t == b else t for t in top]
    assert all(top[i] == top[got[i]] for i in range(160))


def test_order_matters(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50:] + words[:50]))], "doc_id long, text string")
    assert {r.class_id for r in near_dedup.classes(docs).collect()} == {1, 2}


def test_classes_of_odd_rows(odd_docs, no_docs):
    got = near_dedup.classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[5] == by[7] == {4} and by[6] == {6} and by[9] == {9} and by[8] == {8}
    assert by[None] == {1, 4}
    assert near_dedup.classes(no_docs).count() == 0


def test_long_chains_become_one_component(spark):
    links = spark.range(40).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b"))
    assert {(r.component) for r in near_dedup.components(links).collect()} == {"n000"}
    assert near_dedup.components(links.limit(0)).count() == 0


def exact(x, ids, query, k):
    s = x @ x[query]
    return [int(ids[i]) for i in np.lexsort((ids, -s)) if i != query][:k]


@pytest.mark.parametrize("kind", ["clusters", "scattered"])
def test_recall(spark, kind):
    r = np.random.default_rng(1)
    n, dim = 1500, 24
    x = r.normal(size=(n, dim)) if kind == "scattered" else r.normal(size=(10, dim))[r.integers(0, 10, n)] + 0.2 * r.normal(size=(n, dim))
    x = x.astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for a in nn_descent.search(rows, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(a.query_id, {})[a["rank"]] = (a.vec_id, a.score)
    hits = 0
    for q in range(0, n, 20):
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for v, s in got[q].values())
        hits += len({v for v, _ in got[q].values()} & set(exact(x, np.arange(n), q, 20)))
    assert hits >= 0.95 * 20 * len(got)


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.0, 1.0]), (200, None), (220, [0.0, 0.0]), (240, [nan, 1.0]), (260, [inf, 1.0]),
            (280, [None, 1.0]), (300, []), (320, [1.0, 2.0, 3.0]), (None, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = nn_descent.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 100}
    for q in (0, 20, 40):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert own == [i for i in range(60) if i != q][:20]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nn_descent.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert nn_descent.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_level_finds_what_it_holds(tmp_path):
    r = np.random.default_rng(2)
    for n in (1, 7, 5000):
        for keys, shift in ((np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)), None),
                            (np.unique(r.integers(0, 40, n, dtype=np.uint64) << np.uint64(32) | r.integers(0, 1 << 30, n, dtype=np.uint64)), 32)):
            path = str(tmp_path / f"{n}-{shift}")
            lm_trie.Level.save(path, keys, {"code": np.arange(len(keys)).astype(np.uint8)}, shift)
            level = lm_trie.Level(path)
            assert (level.find(keys) == np.arange(len(keys))).all()
            other = np.setdiff1d(np.concatenate([keys + np.uint64(1), r.integers(0, 1 << 63, 100, dtype=np.uint64)]), keys)
            assert (level.find(np.sort(other)) == -1).all()


def test_levels_are_coded_by_elias_and_fano(tmp_path):
    """Unary high parts and packed low ones: near the bound of 2 + log2(range / keys) bits a key, in runs of any size."""
    r = np.random.default_rng(5)
    for n, span, most in ((50_000, 1 << 62, 2 + 62 - 15.6 + 2), (50_000, 1 << 20, 2 + 20 - 15.6 + 2), (3, 1 << 63, 9_000), (1, 5, 9_000)):
        keys = np.unique(r.integers(0, span, n, dtype=np.uint64))
        lm_trie.Level.save(str(tmp_path / "x"), keys, {})
        assert (tmp_path / "x").stat().st_size * 8 / len(keys) <= most
        assert (lm_trie.Level(str(tmp_path / "x")).find(keys) == np.arange(len(keys))).all()
    # pairs: runs of a context, some of them empty, one of them very long
    first = np.concatenate([np.full(20_000, 700), r.integers(0, 1 << 16, 20_000)]).astype(np.uint64)
    keys = np.unique((first << np.uint64(32)) | r.integers(0, 1 << 17, 40_000, dtype=np.uint64))
    lm_trie.Level.save(str(tmp_path / "p"), keys, {}, 32)
    level = lm_trie.Level(str(tmp_path / "p"))
    assert (level.find(keys) == np.arange(len(keys))).all() and (level.find(keys + np.uint64(1 << 20)) == -1).all()
    assert (tmp_path / "p").stat().st_size * 8 / len(keys) <= 17 + 1 + 2 * 1.25 + 1
    high = np.arange(level.runs + 1)
    assert (level.high.before(high) == np.searchsorted((keys >> np.uint64(32)) - (keys[0] >> np.uint64(32)), high.astype(np.uint64))).all()
    for width in (1, 7, 31, 57, 63, 64):
        values = r.integers(0, 1 << 63, 1000, dtype=np.uint64) & np.uint64((1 << width) - 1)
        assert (lm_trie.Packed(lm_trie.Packed.raw(values, width, 64), width)[np.arange(1000)] == values).all()


def test_the_run_of_a_context_is_looked_up_once(tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    keys = np.unique(r.integers(0, 5, 5000).astype(np.uint64) << np.uint64(32) | r.integers(0, 1 << 18, 5000).astype(np.uint64))
    lm_trie.Level.save(str(tmp_path / "p"), keys, {}, 32)
    asked, real = [], lm_trie.Unary.before
    monkeypatch.setattr(lm_trie.Unary, "before", lambda self, high: asked.append(len(high)) or real(self, high))
    level = lm_trie.Level(str(tmp_path / "p"))
    assert (level.find(keys) == np.arange(len(keys))).all() and max(asked) <= 5
    assert (level.find(keys[::-1] ^ np.uint64(1)) >= 0).sum() == len(np.intersect1d(keys, keys ^ np.uint64(1)))
    assert (level.find(keys[:0]) == []).all()



def test_scores_are_those_of_the_formula(spark, odd_docs, no_docs):
    r = random.Random(6)
    common = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(common) if r.random() < 0.9 else f"rare{r.randint(0, 500)}" for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [r_.text for r_ in odd_docs.collect() if len(r_.text or "") < 10_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = lm_trie.fit(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    got = {x.doc_id: x for x in lm_trie.score(docs, model).collect()}
    tokens = [lm_trie.tokens(t) for t in texts]
    words, pairs, kept = Counter(), Counter(), Counter()
    for i, t in enumerate(tokens):
        if not held(i):
            words.update(t)
            pairs.update(zip([lm_trie.END, *t], t, strict=False))
    for (v, _), n in pairs.items():
        kept[v] += (n - lm_trie.DISCOUNT) * (n >= lm_trie.LEAST_PAIR)
    total, distinct = sum(words.values()), len(words)
    assert (model.total, model.distinct) == (total, distinct)
    for i, t in enumerate(tokens):
        p = [(words[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in t]
        assert got[i].n_tokens == len(t) and got[i].n_known == sum(words[w] > 0 for w in t)
        assert math.isclose(got[i].base_score, sum(map(math.log10, p)), rel_tol=1e-9)
        full = 0.0
        for v, w, q in zip([lm_trie.END, *t], t, p, strict=False):
            n = pairs[v, w]
            full += math.log10(((n - lm_trie.DISCOUNT) / words[v] if n >= lm_trie.LEAST_PAIR else 0)
                               + (1 - kept[v] / words[v] if words[v] else 1) * q)
        assert 0 <= full - got[i].score + 1e-9 <= len(t) * (lm_trie.STEP + 1e-6)  # a byte is rounded down
    assert lm_trie.score(odd_docs, model).count() == odd_docs.count() and lm_trie.score(no_docs, model).count() == 0
    nothing = lm_trie.fit(no_docs, F.lit(True))
    assert (nothing.total, nothing.distinct) == (0, 0) and lm_trie.score(odd_docs, nothing).count() == odd_docs.count()


def test_every_run_of_two_and_three_words_is_kept(spark, odd_docs, monkeypatch):
    """Scores of order three by the formula, over several shards and blocks; runs seen once count, no run goes over the end of a text."""
    monkeypatch.setattr(lm_trie, "BLOCK", 300)
    monkeypatch.setattr(lm_trie, "ADDED", 700)
    r = random.Random(8)
    texts = [" ".join(r.choice([f"w{r.randint(0, 12)}", f"rare{r.randint(0, 300)}"]) for _ in range(r.randint(0, 40))) for _ in range(200)]
    texts += ["only once in all", "only once in all but not like this", None, ""]
    docs = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(3)
    model = lm_trie.fit(docs, F.col("train"), keys_per_shard=600, order=3)
    tokens = [lm_trie.tokens(t) for t in texts]
    counts = [Counter(), Counter(), Counter()]
    for i, t in enumerate(tokens):
        if i % 5:
            counts[0].update((w,) for w in t)
            counts[1].update(zip([lm_trie.END, *t], t, strict=False))
            counts[2].update(zip([lm_trie.END, *t], t, t[1:], strict=False))
    assert len(model.level_files) == 2 and all(len(x) > 2 for x in model.level_files)
    for files, own in zip(model.level_files, counts[1:], strict=True):
        assert sum(lm_trie.Level(path).n for _, _, path in files) == len(own)
        assert min(own.values()) == 1
    followed = [Counter(), Counter(), Counter()]  # occurrences of a context and its different followers
    followers = [Counter(), Counter(), Counter()]
    for m in (1, 2):
        for g, n in counts[m].items():
            followed[m][g[:-1]] += n
            followers[m][g[:-1]] += 1
    total, distinct = sum(counts[0].values()), len(counts[0])
    for x in lm_trie.score(docs, model).collect():
        t, want = tokens[x.doc_id], 0.0
        for i, w in enumerate(t):
            p = (counts[0][w,] + 0.1) / (total + 0.1 * (distinct + 1))
            for m, context in ((1, (t[i - 1] if i else lm_trie.END,)), (2, ((lm_trie.END, *t)[i - 1:i + 1] if i else None))):
                if context and followed[m][context]:
                    c = followed[m][context]
                    p = max(counts[m][(*context, w)] - lm_trie.DISCOUNT, 0) / c + lm_trie.DISCOUNT * followers[m][context] / c * p
            want += math.log10(p)
        assert 0 <= want - x.score + 1e-9 <= len(t) * (2 * lm_trie.STEP + 1e-6), x
    again = lm_trie.fit(docs.repartition(5), F.col("train"), keys_per_shard=600, order=3)
    assert sorted(lm_trie.score(docs, again).collect()) == sorted(lm_trie.score(docs, model).collect())
    only = lm_trie.fit(spark.createDataFrame([(None,)], "text string"), F.lit(True), order=3)  # ends without a word before
    assert [len(x) for x in only.level_files] == [1] and lm_trie.score(odd_docs, only).count() == odd_docs.count()


def test_keys_of_several_blocks_are_added_up_before_they_leave_a_task(monkeypatch):
    blocks = [np.random.default_rng(i).integers(0, 50, 100).astype(np.uint64) for i in range(20)]
    assert len(list(lm_trie._sums(iter(blocks)))) == 1  # a row per key, not one per key and block
    monkeypatch.setattr(lm_trie, "ADDED", 250)
    total = Counter()
    made = list(lm_trie._sums(iter(blocks)))
    for keys, counts in made:
        assert len(set(keys.tolist())) == len(keys)
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert len(made) == 7 and total == Counter(np.concatenate(blocks).tolist())
    assert list(lm_trie._sums(iter([]))) == []
    assert lm_trie.tokens("Ab \u00c4b\tc".encode()) == lm_trie.tokens("Ab \u00c4b\tc")


def test_the_band_of_a_long_text_is_held_once_in_four_bytes_a_cell():
    words = np.random.default_rng(1).integers(0, 1 << 40, 4000).astype(np.uint64)
    other = np.delete(words, np.arange(0, 4000, 50))  # 80 edits
    tracemalloc.start()
    found = near_dedup.edit_distance(words, other, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == near_dedup.banded_distance(words, other, 100) == 80
    assert peak < 8 * 201 * 4001
