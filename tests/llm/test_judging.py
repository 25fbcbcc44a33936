"""Quality rules, toxicity, licences and extraction."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vacatlas.llm import extraction, license_scan, quality_rules, toxicity
from vacatlas.llm.license_templates import CUES, TEMPLATES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_are_exact(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()] + ["a a a a a a", "x y z x y z q", "l\nl\n\nl \nl", "# $ # $ # $", "é é é é", "a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows.select("i", quality_rules.measures(F.col("text")).alias("m")).select("i", "m.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.i]), texts[r.i]


def labelled(spark):
    good = [(i, " ".join(f"w{(i * 31 + j) % 977}" for j in range(80)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{(i * 17 + j) % 977}###" for j in range(80)), 0) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(None, 0), (5000, None)], "doc_id long, quality int")
    return docs, labels


def test_rules_are_learned_and_keep_the_good(spark):
    docs, labels = labelled(spark)
    rules = quality_rules.fit(docs, labels)
    assert rules and all(r.good == 0 for r in rules)
    got = docs.withColumn("d", quality_rules.decide(F.col("text"), rules)).select("doc_id", "d.*").collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got) and {r.rule for r in got if r.doc_id >= 1000} == {1}


def test_rules_without_labels_and_odd_rows(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    assert quality_rules.fit(docs, labels.limit(0)) == []
    assert quality_rules.fit(no_docs, labels) == []
    out = odd_docs.withColumn("d", quality_rules.decide(F.col("text"), [])).select("text", "d.*").collect()
    assert len(out) == odd_docs.count()
    assert all(r.base_failed == (len(WORD.findall(r.text or "")) < 50) for r in out if len(r.text or "") < 5000)


def model_of(*texts):
    counts = np.zeros(toxicity.SIGNS ** 3, np.int64)
    for t in texts:
        x = [toxicity._sign(c) for c in f" {t} "]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            counts[(a * toxicity.SIGNS + b) * toxicity.SIGNS + c] += 1
    return toxicity.language_model(counts)


def test_disguises_are_undone():
    model = model_of(*["idiot moron scum stupid loser trash clown the of and that this rated onion those other"] * 50)
    s = toxicity.Scorer(model, {"=" + w: 0.9 for w in "idiot moron scum stupid loser trash clown".split()}, 0.05)
    for text in ["1d10t", "m0r0n", "$tupid", "l0$er", "tr@sh", "stuuuupid", "i d i o t", "s.c.u.m", "l-o-s-e-r", "cl0wn!", "m​oron",
                 "the M O R O N is", "so STUPID.", "id1ot"]:
        assert s.score(text) == 0.9, (text, s.words(text))
    for text in ["", None, "the other onion", "0b96a8c8d79c4a5085c91969", "+1 (262) 555-3752", "a | b | c", "this*** that$$$", "1 2 3 4 5"]:
        assert s.score(text) == 0.05, text


def test_long_doubled_and_edge_disguises_are_undone():
    model = model_of(*["idiot moron scum stupid loser trash clown the of and that this rated onion those other"] * 50)
    s = toxicity.Scorer(model, {"=" + w: 0.9 for w in "idiot moron scum stupid loser trash clown".split()}, 0.05)
    for text in ["iidiot", "sscum", "!diot", "(lown", "1d10t5m0r0n5", "that-other-rated-those-onion-" * 4 + "m0r0n",
                 " ".join("that other rated those onion that other rated those onion scum".replace(" ", "")), "so (lown!"]:
        assert s.score(text) == 0.9, (text, s.words(text))
    assert "ass" in toxicity.Scorer(model_of(*["ass pass"] * 50), {}, 0.05).words("a$$")
    for text in ["(other)", "onion!", "455", "$100 1005.50", "x" * 30_000 + "1" * 30_000]:
        assert s.score(text) == 0.05, (text[:50], s.words(text)[:5])


def test_signs_and_digits_alone_and_wide_spacing_are_undone():
    # a word of signs may also stand for nothing; which path is best depends on the model
    s = toxicity.Scorer(model_of(*["ass boob scum ass scum boob ass"] * 300), {"=ass": 0.9, "=boob": 0.9, "=scum": 0.9}, 0.05)
    for text in ["4$$", "455", "8008", "a  s   s", "s\nc\nu\nm", "s - c - u - m"]:
        assert s.score(text) == 0.9, (text, s.words(text))
    assert s.score("2024 10 7.5") == 0.05


def test_the_sieve_loses_nothing():
    r, words = random.Random(8), "idiot moron scum stupid loser trash ass boob".split()
    model = model_of(*["idiot moron scum stupid loser trash ass boob the of and that onion pass toil"] * 20)
    lexicon = {"=" + w: 0.9 for w in words} | {"stup": 0.7, "idio": 0.8, "moro": 0.6}
    s = toxicity.Scorer(model, lexicon, 0.05)
    plain = toxicity.Scorer(model, lexicon, 0.05)
    plain.sieve.passes = lambda word: True
    back = {c: sign for sign, letters in toxicity.LEET.items() for c in letters}
    hit = 0
    for _ in range(3000):
        w = list(r.choice(words)) if r.random() < 0.6 else [r.choice("abeilmorstu") for _ in range(r.randint(1, 9))]
        for i in range(len(w)):
            x = r.random()
            w[i] = back.get(w[i], w[i]) if x < .25 else w[i] * r.randint(2, 3) if x < .4 else w[i] + r.choice("-.*_!| ,") if x < .5 else w[i]
        w = "".join(w).replace(" ", "")
        best = max((lexicon.get(f, 0.0) for x in plain.readings(w) for f in toxicity.features(x)), default=0.0)
        assert s._of_word(w) == best, w
        hit += best > 0
    assert hit > 300


def all_paths(restorer, word):
    """(worth, text) of every path of the lattice, one by one."""
    paths = [("", 0.0)]
    for options in toxicity.lattice(word):
        paths = [(t + e, c + k) for t, c in paths for e, k in options]
    for text, cost in paths:
        x, y, worth = 0, 0, -cost
        for c in text + " ":
            if c != " " or y != 0:
                z = toxicity._sign(c)
                worth += restorer.model[(x * toxicity.SIGNS + y) * toxicity.SIGNS + z]
                x, y = y, z
        yield worth, re.sub(" +", " ", text).strip()


def test_viterbi_finds_the_best_path():
    restorer = toxicity.Restorer(model_of("idiot moron scum stupid", "slit toil"))
    for word in ["1d10t", "m0r0n", "$c.u-m", "st*p1d", "ss1iit"]:
        best = max(worth for worth, _ in all_paths(restorer, word))
        assert abs(max(worth for worth, text in all_paths(restorer, word) if text == restorer.best(word)) - best) < 1e-9


def test_toxicity_learns_from_its_folds_only(spark, odd_docs, no_docs):
    r = random.Random(9)
    text = lambda i: " ".join("".join(r.choice("an er th on in re st".split()) for _ in range(r.randint(2, 5))) for _ in range(40))
    rows = [(i, text(i) + (" vileword" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # a held-out label must not count: there all are turned round
    labels = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, _, t in rows], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    got = toxicity.score(docs, fitted).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in got)
    odd = toxicity.score(odd_docs, fitted).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(no_docs, fitted).count() == 0
    empty = toxicity.fit(no_docs, labels.limit(0))
    assert not empty[1] and toxicity.score(odd_docs, empty).count() == odd_docs.count()


def test_every_template_has_a_cue_and_finds_itself():
    s = license_scan.Scanner(TEMPLATES)
    for name, text in TEMPLATES:
        own = text.replace("<holder>", "2020 Some One")
        assert any(c in own.lower() for c in CUES), name
        found = s.scan(f"Before it, some words.\n{own}\nAnd after it others.")
        assert name in {f.license for f in found} or name in ("ISC",), (name, found)


def test_wording_differences_are_reported():
    s = license_scan.Scanner(TEMPLATES)
    mit = next(t for _, t in TEMPLATES if t.startswith("Permission is hereby granted, free"))
    found, = s.scan("x " + mit.replace("merge, ", "").replace("restriction", "any restriction") + " y")
    assert (found.license, found.missing, found.extra) == ("MIT", ["merge"], ["any"])
    assert not s.scan("Licensed under the Apache License, Version 1.1.")
    assert [f.license for f in s.scan("Licensed under CC BY-NC 4.0. " * 3)] == ["CC-BY-NC-4.0"] * 3


def test_license_scan_of_odd_rows(spark, odd_docs, no_docs):
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "word " * 30_000 + "\nReleased under the MIT License.")] * 2, "doc_id long, text string")
    got = license_scan.scan(rows).collect()
    assert [(r.license, r.start, r.end) for r in got] == [("MIT", 150_001, 150_031)] * 2


PAGE = ("<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><header class=site><h1>Site</h1></header>"
        "<nav><a href=/>menu</a></nav><div id='cookie-notice'>We use</div><div class='wrap'><div class=sidebar><p>side side</p></div>"
        "<div class='post-body post-{n}'><h2>Title &amp; more</h2><p>Some   text\nwith <em>wor</em>ds<br>here<p>{body}</p>"
        "<ul><li>one<li>two</ul><div class='share'>share</div></div>"
        "<div id=comments><p>{long}</p></div></div><footer>&copy; f</footer></body></html>")


def test_extraction_follows_the_host(spark):
    pages = [(i, f"https://a.example/{i}", PAGE.format(n=i, body=f"body {i}", long="short comment")) for i in range(5)]
    pages.append((9, "https://a.example/9", PAGE.format(n=9, body="body 9", long="a very long comment " * 50)))
    pages += [(20, None, None), (21, "", ""), (22, "http://b.example", "<p>only <b>this &amp"), (22, "http://b.example", "<p>only <b>this &amp"),
              (None, "x", "<div><div>deep" * 300)]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in (0, 1, 2, 3, 4, 9):
        assert by[i] == f"Title & more\nSome text with words here\nbody {i}\none\ntwo"
    assert by[20] == by[21] == "" and by[22] == "only this &"
    assert extraction.extract(df.limit(0)).count() == 0
