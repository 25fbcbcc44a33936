"""The index of character runs against a look at every text."""

import random

from pyspark.sql import functions as F

from vacatlas.operators import text_index as X


def test_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 20)
    r = random.Random(1)
    words = ["Perception", "engineer", "köln", "漢字", "c++", "%", "_", "a", "the"]
    texts = {f"j{i}": " ".join(r.choice(words) for _ in range(r.randint(0, 12))) for i in range(150)}
    texts |= {"far": "x" * 100_000 + " quantum annealing", "null": None, "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    index = X.TextIndex(str(tmp_path / "ix"))
    index.add(df, F.lower("t"), 0)
    terms = ["perception", "Quantum Anneal", "a", "c+", "%", "engineer the", "köln", "漢字 漢字", "nowhere", "perception köln c++", "", None, "xxx", "++ %"]
    got = {(x.term, x.id) for x in index.find(df, F.lower("t"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t.lower(), i) for t in terms if t for i, x in texts.items() if x and t.lower() in x.lower()}
    assert ("quantum anneal", "far") in got
    lists = spark.read.parquet(index.root + "/lists")
    assert lists.agg(F.max("n")).first()[0] <= 40  # a common run has a list per block
    # a changed row is added again, a removed one is not found any more
    changed = spark.createDataFrame([("j0", "now about welding")], "id string, t string")
    index.add(changed, F.lower("t"), 1)
    index.add(changed, F.lower("t"), 1)
    now = df.filter("id not in ('j0', 'far')").union(changed)
    asked = spark.createDataFrame([("welding",), ("quantum",), ("perception",)], "term string")
    got = {(x.term, x.id) for x in index.find(now, F.lower("t"), asked).collect()}
    assert got == {("welding", "j0")} | {("perception", i) for i, x in texts.items() if x and "Perception" in x and i != "j0"}


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "id string, t string")
    index = X.TextIndex(str(tmp_path / "ix"))
    index.add(df, F.lower("t"), 0)
    assert index.find(df, F.lower("t"), spark.createDataFrame([("abc",), ("a",)], "term string")).count() == 0


def test_a_row_meets_its_text_once_with_all_its_terms(spark, tmp_path, monkeypatch):
    """Pairs of term and row stay in the task of their block; a row per indexed row goes on to the texts."""
    monkeypatch.setattr(X, "BLOCK", 10)
    df = spark.createDataFrame([(f"j{i:02}", f"alpha beta gamma {i}") for i in range(60)], "id string, t string")
    index = X.TextIndex(str(tmp_path / "ix"))
    index.add(df, F.col("t"), 0)
    index.add(df.filter("id < 'j10'"), F.col("t"), 1)  # rows in two additions
    asked = spark.createDataFrame([("alpha",), ("beta gamma",), ("a",), ("ga",), ("nowhere",)], "term string")
    got = {r.id: sorted(r.terms) for r in index._terms(asked).collect()}
    assert got == {f"j{i:02}": ["a", "alpha", "beta gamma", "ga"] for i in range(60)}
    assert index._terms(asked).count() == 60
    assert sorted(map(tuple, index.find(df, F.col("t"), asked).collect())) == sorted((t, i) for i, own in got.items() for t in own)


def test_lists_are_those_of_every_run_in_blocks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "CHARACTERS", 200)
    texts = {f"j{i}": "aa\x00b 漢字😀😀😀 %d" % i * (1 + i % 7) for i in range(40)}
    index = X.TextIndex(str(tmp_path / "ix"))
    index.add(spark.createDataFrame(list(texts.items()), "id string, t string"), F.col("t"), 0)
    places = {(r.block, r.place): r.id for r in spark.read.parquet(index.root + "/places").collect()}
    assert len({b for b, _ in places}) > 5  # few rows, but long ones
    rows = spark.read.parquet(index.root + "/lists").collect()
    assert all(r.places == sorted(set(r.places)) and len(r.places) == r.n for r in rows)
    got = sorted((r.run, places[r.block, p]) for r in rows for p in r.places)
    assert got == sorted({(f"{t}\x00\x00"[i:i + 3], k) for k, t in texts.items() for i in range(len(t))})


def test_a_list_goes_to_its_block_once_however_many_terms_ask(spark, tmp_path, monkeypatch):
    """Lists are not copied for terms, terms only go where their rarest run is, and slices of a block give what a scan gives."""
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "漢字", "x"]
    texts = [(f"j{i:02}", " ".join(r.choice(words) for _ in range(r.randint(0, 8)))) for i in range(60)]
    texts += [texts[5], ("j07", "another text of the same id"), ("j61", None), (None, "alpha")]
    df = spark.createDataFrame(texts, "id string, t string")
    index = X.TextIndex(str(tmp_path / "ix"))
    index.add(df, F.col("t"), 0)
    terms = sorted({w[i:i + n] for w in ["alpha beta gamma delta", "漢字 x", "no such", "same id"] for n in (1, 2, 3, 5) for i in range(len(w) - n + 1)})
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    near = index._near(asked)[0].drop("addition").toArrow()
    runs = [x for x in near.column("run").to_pylist() if x]
    assert len(runs) == len(set(runs))
    assert "such" not in {t for own in near.column("terms").to_pylist() for t in own or ()}
    want = sorted((t, i) for i, x in texts for t in terms if i and x and t in x)
    assert sorted(map(tuple, index.find(df, F.col("t"), asked).collect())) == want
    monkeypatch.setattr(X, "ROWS", 8)
    monkeypatch.setattr(X, "TERMS", 3)
    own = df.filter("id is not null").select(F.col("id").alias("key"), "id", F.col("t").alias("text")).toArrow()
    assert sorted((t, x["key"]) for x in X._holding(own, near).to_pylist() for t in x["terms"]) == want
