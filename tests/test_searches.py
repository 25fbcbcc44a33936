"""Stored searches by their narrowest keys against one filter document at a time."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacatlas.operators import listing as L
from vacatlas.operators import searches as S

AS_OF = F.lit("2024-01-31").cast("date")
JOBS = ("id string, company_name string, company_id string, title string, source string, location_raw string, city string, country string, "
        "remote_policy string, seniority string, language_requirement string, role_category string, posted_at date, first_seen_at timestamp, "
        "is_open boolean, is_new boolean, hidden boolean, starred boolean, has_flags boolean, score int, salary_annual_eur_min double, "
        "status string, search_blob string")


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    some = lambda *v: r.choice([*v, None])
    blobs = ["ml engineer munich", "50%_off data", "x" * 5000 + " perception late", "", None]
    rows = [(f"j{i:03}", some("Acme GmbH", "Bosch"), some("c1", "c2"), "t", some("lever", "adzuna"), some("Munich", "Bern"), some("München", ""),
             some("DE", "CH"), some("remote", "onsite"), some("senior", "junior"), some("unclear", "english_only"), some("Research", "Platform"),
             some(dt.date(2024, 1, 30), dt.date(2023, 12, 1), dt.date(2024, 2, 9)), dt.datetime(2024, 1, 1), r.random() < .8, r.random() < .3, r.random() < .2,
             r.random() < .3, r.random() < .3, some(0, 55, 99, 100), some(50_000.0, 900_000.0), some("new", "applied"), some(*blobs)) for i in range(150)]
    companies = spark.createDataFrame([("c1", "dream"), ("c2", "high")], "id string, tier string")
    return spark.createDataFrame(rows, JOBS), companies


def documents(r, n):
    choices = {"q": ["engineer", " Perception ", "ml", "%_o", "nothing like it", "  "], "tier": ["dream", "HIGH", "normal"], "country": ["de", "ch", "zz"],
               "city": ["mün", "BERN"], "company": ["gmbh", "o"], "category": ["Research"], "language": ["unclear"], "source": ["lever"], "status": ["applied"],
               "domain": ["data", "late"], "remote": ["remote"], "seniority": ["senior"], "min_score": [0, 50, 100, 101], "max_age_days": [0, 5, 400, 9999],
               "salary_min": [0, 60_000, 2_000_000], "only_new": [True], "only_starred": [True], "only_clean": [True], "include_hidden": [True],
               "include_closed": [True]}
    return {f"s{i}": {k: r.choice(choices[k]) for k in r.sample(sorted(choices), r.randint(0, 4))} for i in range(n)}


def test_every_search_finds_what_its_document_finds(spark, tables):
    jobs, companies = tables
    docs = documents(random.Random(4), 60)
    got: dict = {n: set() for n in docs}
    for x in S.matches(jobs, companies, S.stored(spark, docs), AS_OF).select("search", "id").collect():
        got[x.search].add(x.id)
    jobs = jobs.cache()
    for name, doc in docs.items():
        want = {x.id for x in L.find(jobs, companies, L.JobQuery.from_dict(doc), AS_OF).select("id").collect()}
        assert got[name] == want, doc
    assert sum(map(len, got.values())) > 300


def test_the_plan_does_not_grow_with_the_searches(spark, tables):
    jobs, companies = tables
    size = lambda n: len(S.matches(jobs, companies, S.stored(spark, documents(random.Random(n), n)), AS_OF)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(5000) - size(5)) < 500


def test_ranks_counts_and_empty_tables(spark, tables):
    jobs, companies = tables
    docs = {"all": {}, "new": {"only_new": True}, "none": {"status": "nowhere"}}
    got = S.results(jobs, companies, S.stored(spark, docs), AS_OF, per_search=7).collect()
    old = L.saved_searches(jobs, companies, docs, AS_OF, per_search=7).collect()
    key = lambda x: (x.search, x.id, x["rank"], x.matches)
    assert sorted(map(key, got)) == sorted(map(key, old)) and len(got) == 14
    assert S.results(jobs.limit(0), companies, S.stored(spark, docs), AS_OF).count() == 0
    assert S.results(jobs, companies, S.stored(spark, {}), AS_OF).count() == 0
    with pytest.raises(ValueError):
        S.stored(spark, {"x": {"colour": "red"}})


def test_blocks_and_parts_give_what_the_pairs_give(spark, tables, monkeypatch):
    """Counts and first rows from bits, over several blocks of jobs and parts of searches, against the pairs themselves."""
    monkeypatch.setattr(S, "BLOCK", 40)
    monkeypatch.setattr(S, "PART", 25)
    jobs, companies = tables
    odd = jobs.filter("is_open and not hidden").limit(3).withColumn("id", F.concat(F.lit("odd"), "id")).select(jobs.columns).cache()
    jobs = jobs.union(odd).union(odd.withColumn("id", F.lit(None).cast("string")).select(jobs.columns)).cache()
    stored = S.stored(spark, documents(random.Random(9), 80))
    for order in L.ORDERS:
        got = S.results(jobs, companies, stored, AS_OF, per_search=4, order=order).collect()
        want: dict = {}
        for x in S.matches(jobs, companies, stored, AS_OF).orderBy(*L.ordering(order)).collect():
            want.setdefault(x.search, []).append(x.id)
        assert sorted((x.search, x.rank, x.id, x.matches) for x in got) == sorted(
            (n, i + 1, j, len(ids)) for n, ids in want.items() for i, j in enumerate(ids[:4])), order
    paid = odd.withColumn("salary_annual_eur_min", F.lit(float("nan"))).select(jobs.columns)  # no number is above any, as in one filter document
    dear = {"dear": {"salary_min": 2_000_000}}
    want = L.saved_searches(paid, companies, dear, AS_OF, per_search=9).count()
    assert want == S.results(paid, companies, S.stored(spark, dear), AS_OF).count() == 3
    plan = S.results(jobs, companies, stored, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # no rows of (search, job)


def test_a_search_is_sent_once_for_many_blocks(spark, tables, monkeypatch):
    """Blocks of a span come as one value each; counts and first rows over blocks and spans are those of the pairs, names twice count twice."""
    monkeypatch.setattr(S, "BLOCK", 20)
    monkeypatch.setattr(S, "SPAN", 3)
    jobs, companies = tables
    stored = S.stored(spark, documents(random.Random(12), 40))
    stored = stored.union(stored.limit(5)).cache()
    got = sorted((x.search, x["rank"], x.id, x.matches) for x in S.results(jobs, companies, stored, AS_OF, per_search=5).collect())
    names = [x.search for x in stored.select("search").collect()]
    want: dict = {}
    for x in S.matches(jobs, companies, stored.dropDuplicates(["search"]), AS_OF).orderBy(*L.ordering("newest")).collect():
        want.setdefault(x.search, []).extend([x.id] * names.count(x.search))
    assert got == sorted((n, i + 1, j, len(ids)) for n, ids in want.items() for i, j in enumerate(ids[:5]))
    # one task's work: two blocks, bits of one condition kept at a time
    monkeypatch.setattr(S, "KEPT", 1)
    table = lambda at, n: pa.table({"span": [0] * n, "block": [at] * n, "pos": list(range(at * 100, at * 100 + n)), "id": [f"{at}-{i}" for i in range(n)],
                                    "status": ["new" if i % 2 else None for i in range(n)], "score": list(range(n))})
    blocks = pa.concat_tables([S._block(table(1, 70)), S._block(table(0, 30))])
    assert blocks.num_rows == 2
    conditions = [[("status", "new")], [("min_score", "25"), ("status", "new")], [], [("status", "old")], [("status", "new"), ("min_score", "25")]]
    asked = pa.table({"search": list("abcde"), "conditions": pa.array([[{"field": f, "value": v} for f, v in x] for x in conditions],
                                                                      pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())])))})
    answers = {x["search"]: (x["n"], [(y["pos"], y["id"]) for y in x["top"]]) for x in S._answers(blocks, asked, 4).to_pylist()}
    assert answers == {"a": (50, [(i, f"0-{i}") for i in (1, 3, 5, 7)]), "b": (26, [(25, "0-25"), (27, "0-27"), (29, "0-29"), (125, "1-25")]),
                       "c": (100, [(i, f"0-{i}") for i in range(4)]), "e": (26, [(25, "0-25"), (27, "0-27"), (29, "0-29"), (125, "1-25")])}
