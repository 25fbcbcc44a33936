"""The stages one after another on a small corpus with known answers."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("an er th on in re st en ou".split()) for _ in range(r.randint(1, 4)))
    text = lambda n=90: [word() for _ in range(n)]
    rows, labels = [], []
    for i in range(240):  # good, some toxic
        rows.append((i, " ".join(text() + ["vileword"] * (i % 4 == 0))))
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(300, 340):  # bad
        rows.append((i, " ".join(w + "###" for w in text())))
        labels.append((i, 0, 0))
    base = text(200)
    near = [*base[:100], "changed", *base[101:]]
    rows += [(400, " ".join(base)), (401, " ".join(base)), (402, " ".join(near)), (402, " ".join(near)),
             (403, " ".join(text(3000))), (404, None), (405, ""), (None, " ".join(text())), (406, "v1l3word " + " ".join(text()))]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*x, "en", "s", 1, "a", "b") for x in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, _row string, _node string"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_takes_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect())
        if name != "packing":
            assert docs.columns == columns
    assert left["quality_rules"] == sorted([-1, *range(240), 400, 401, 402, 402, 403, 406])
    assert left["toxicity"] == sorted([-1, *(i for i in range(240) if i % 4), 400, 401, 402, 402, 403])
    assert left["near_dedup"] == sorted([-1, *(i for i in range(240) if i % 4), 400, 403])
    assert set(left["packing"]) == set(left["near_dedup"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == {r.doc_id for r in docs.collect()}


def test_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
