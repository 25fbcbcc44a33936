"""Resolution and snapshots batch by batch: the groups of one batch, and only touched buckets rewritten."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_tables import COLS, NOW, brute, sighting
from vacatlas.operators import dedup as D
from vacatlas.operators import upsert as U
from vacatlas.plans import incremental as I
from vacatlas.plans.buckets import Buckets


def stored(spark, store):
    out: dict = {}
    for r in store.read(spark).collect():
        out.setdefault(r.group_key, set()).add(r.seq)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches_in_any_order_give_the_groups_of_one(spark, tmp_path, seed):
    rnd = random.Random(seed)
    titles = ["data engineer", "data platform engineer", "data platform engineer berlin", "ml engineer", "senior ml engineer cloud"]
    rows = [sighting(i, rnd.choice(["workday", "lever", "arbeitnow", "adzuna"]), rnd.choice(["BMW Group", "Audi AG", "Bosch"]),
                     rnd.choice(titles), rnd.choice(["Munich", "Berlin"]),
                     rnd.choice(["", f"e{i % 23}", f"x{i}", f"REQ-{10000 + i % 9}"]), "t" * rnd.randint(0, 9)) for i in range(70)]
    parts = [rows[:40], rows[40:55], rows[55:]]
    if seed:
        rnd.shuffle(parts)  # late arrivals, too
    store = Buckets(str(tmp_path / "s"), 4, 2)
    for n, part in enumerate(parts):
        member, groups = I.take(store, spark.createDataFrame(part, COLS), n)
        assert {r.group_key for r in member.collect()} <= {r.group_key for r in groups.collect()}
    one = D.assign(spark.createDataFrame(rows, COLS)).collect()
    want: dict = {}
    for r in one:
        want.setdefault(r.group_key, set()).add(r.seq)
    assert stored(spark, store) == want
    assert sorted(map(sorted, want.values())) == brute(rows)


def test_a_replayed_batch_changes_nothing_more(spark, tmp_path):
    store = Buckets(str(tmp_path / "s"), 4, 2)
    one, two = ([sighting(i, ["workday", "lever"][i % 2], ext=f"id{i % 7}", text=f"t{i}") for i in r] for r in (range(20), range(20, 30)))
    I.take(store, spark.createDataFrame(one, COLS), 0)
    for _ in range(2):
        I.take(store, spark.createDataFrame(two, COLS), 1)
        rows = sorted((r.seq, r.last_seq, r.group_key, r.description) for r in store.read(spark).collect())
        assert len(rows) == len({r[0] for r in rows}) and (rows[0][1], rows[0][3]) == (28, "t28")
    assert store.newest(spark) == 1


def test_a_requisition_unites_old_groups_and_their_names(spark, tmp_path):
    store = Buckets(str(tmp_path / "s"), 4, 2)
    I.take(store, spark.createDataFrame([sighting(1, ext="REQ-12345", title="Data Engineer"), sighting(2, "lever", title="Cloud Architect")], COLS), 0)
    member, groups = I.take(store, spark.createDataFrame([sighting(3, "lever", title="Cloud Architect", ext="REQ-12345")], COLS), 1)
    # the slots of the united component are numbered anew: lever's two own ids are two vacancies
    every = [sighting(1, ext="REQ-12345", title="Data Engineer"), sighting(2, "lever", title="Cloud Architect"),
             sighting(3, "lever", title="Cloud Architect", ext="REQ-12345")]
    assert sorted(map(sorted, stored(spark, store).values())) == brute(every)
    assert {r.seq for r in member.collect()} == {1, 2, 3} and groups.count() >= 2


def test_what_a_complete_fetch_does_not_hold_is_gone(spark, tmp_path):
    store, at = Buckets(str(tmp_path / "s"), 4, 2), lambda payload, place: payload << 20 | place
    row = lambda seq, provider, title: (*sighting(seq, provider, title=title, ext=title, url=f"https://x/{title}"), "acme")
    cols = COLS + ", target string"
    I.take(store, spark.createDataFrame([row(at(1, 0), "workday", "A"), row(at(1, 1), "workday", "B"), row(at(2, 0), "lever", "B")], cols), 0)
    ends = spark.createDataFrame([("workday", "acme", 3)], "source string, target string, first_seq long")
    member, groups = I.take(store, spark.createDataFrame([row(at(3, 0), "workday", "C")], cols), 1, ends)
    assert sorted((r.title, r.provider) for r in member.collect()) == [("B", "lever"), ("C", "workday")]
    assert {g.group_key.split("|")[1] for g in groups.collect()} == {"a", "b", "c"}
    member, _ = I.take(store, spark.createDataFrame([row(at(4, 0), "workday", "A")], cols), 2)
    assert [(r.title, r.seq, r.last_seq) for r in member.collect()] == [("A", at(1, 0), at(4, 0))]    # back again, the same vacancy


JOB = "id string, source string, target string, title string, score int, posted_at date"


def job(i, employer, score=50):
    return (f"{employer}|t{i}|m", "x", "t", f"t{i}", score, dt.date(2024, 1, 1 + i % 28))


def test_a_run_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = Buckets(str(tmp_path / "j"))
    rows = [job(i, f"employer {i % 200}") for i in range(2000)]
    ids = lambda r: spark.createDataFrame([(x[0],) for x in r], "group_key string")
    I.merge_jobs(store, spark.createDataFrame(rows, JOB), ids(rows), 0, NOW)
    changed = [job(i, f"employer {i % 200}", 90) for i in range(2000) if i % 200 < 2]                # 1 % of the employers
    gone, fresh = changed[0], job(5000, "employer 1")
    given = [*changed[1:], fresh]
    for _ in range(2):                                                                             # once and replayed
        I.merge_jobs(store, spark.createDataFrame(given, JOB), ids([*changed, fresh]), 1, NOW)
    live = store.live(spark, 1)
    assert 0 < sum(r == 1 for r in live.values()) <= 0.05 * len(live)
    out = {r.id: r for r in I.jobs(store, spark).collect()}
    assert len(out) == 2001 and [i for i, r in out.items() if not r.is_open] == [gone[0]] and out[gone[0]].removed_at is not None
    assert [i for i, r in out.items() if r.is_new] == [fresh[0]]                                     # older flags do not stay
    assert {(r.score, r.times_seen) for i, r in out.items() if i in {x[0] for x in changed[1:]}} == {(90, 2)}
    whole = U.upsert(U.upsert(U.empty_snapshot(spark.createDataFrame(rows, JOB)), spark.createDataFrame(rows, JOB), NOW),
                     spark.createDataFrame([*[r for r in rows if int(r[3][1:]) % 200 >= 2], *given], JOB), NOW)
    same = ["id", "title", "score", "status", "is_open", "is_new"]
    assert sorted(I.jobs(store, spark).select(same).collect()) == sorted(whole.select(same).collect())


def test_old_runs_are_expired_and_a_broken_one_is_not_seen(spark, tmp_path):
    store = Buckets(str(tmp_path / "j"), 2, 1)
    own = lambda i, v: spark.createDataFrame([(i, v)], "id string, v int")
    place = store.of(F.col("id"), F.col("id"))
    homes = {i: own(i, 0).select(place).first()[0] for i in "abcdef"}
    a, b = "a", next(i for i in "bcdef" if homes[i] != homes["a"])
    for run in range(6):
        i = b if run == 0 else a
        store.write(own(i, run), run, place, {homes[i]})
    store.expire(spark, 2)
    assert {(r.id, r.v) for r in store.read(spark).collect()} == {(a, 5), (b, 0)}
    assert sorted(p.name for p in (tmp_path / "j" / "data").iterdir()) == ["run=0", "run=4", "run=5"]
    assert sorted(p.name for p in (tmp_path / "j" / "runs").iterdir()) == ["run=4", "run=5"]
    own(a, 9).withColumn("bucket", place).write.partitionBy("bucket").parquet(f"{store.root}/data/run=6")   # no marker
    assert store.newest(spark) == 5 and {r.v for r in store.read(spark).collect()} == {5, 0}
    store.write(own(a, 7), 6, place, {homes[a]})
    assert {r.v for r in store.read(spark).collect()} == {7, 0} and {r.v for r in store.read(spark, 6).collect()} == {5, 0}
    assert store.read(spark, buckets={homes[b]}).first().v == 0 and store.read(spark, buckets=set()).count() == 0
    assert Buckets(str(tmp_path / "none")).read(spark) is None


def test_late_details_reach_the_group_and_stay(spark, tmp_path):
    store, say = Buckets(str(tmp_path / "s"), 4, 2), lambda *r: spark.createDataFrame(list(r), "provider string, external_id string, text string")
    one = [sighting(1, ext="a", text="short"), sighting(2, "lever", title="Data Engineer", ext="b", text="a long listing")]
    I.take(store, spark.createDataFrame(one, COLS), 0, details=say(("lever", "b", "brief"), ("lever", "nobody", "x")))
    member, groups = I.take(store, spark.createDataFrame([], COLS), 1, details=say(("workday", "a", "a longer text"), ("workday", "a", "no"), ("lever", "b", None)))
    assert [(r.seq, r.description) for r in member.collect()] == [(1, "a longer text")] and groups.count() == 1
    member, _ = I.take(store, spark.createDataFrame([sighting(3, ext="a", text="tiny", url="https://x.example.com/1")], COLS), 2)
    assert [(r.seq, r.last_seq, r.description) for r in member.collect()] == [(1, 3, "a longer text")]


def test_texts_stay_out_of_the_joins(spark, tmp_path, monkeypatch):
    kept, cut = [], I.cut_lineage
    monkeypatch.setattr(I, "cut_lineage", lambda df: kept.append(df) or cut(df))
    store = Buckets(str(tmp_path / "store"))
    row = "seq long, provider string, company string, title string, location string, url string, external_id string, posted date, description string"
    make = lambda *rows: spark.createDataFrame([(i, "p", "Firma", f"Titel {i % 4}", "Berlin", "https://x.de/1", f"E{i % 4}", None, t) for i, t in rows], row)
    I.take(store, make((0, "old " * 50), (1, "one"), (2, None), (3, "one"), (4, "new " * 50)), 0)
    current, _ = I.take(store, make((5, "later"), (7, None)), 1)
    assert all(dict(df.dtypes).get("description", "binary") == "binary" for df in kept) and any("description" in df.columns for df in kept)
    want = [(0, "new " * 50), (1, "later"), (2, None), (3, None)]
    assert sorted(((r.seq, r.description) for r in store.read(spark).collect())) == want
    assert sorted((r.seq, r.description) for r in current.collect()) == [(1, "later"), (3, None)]
