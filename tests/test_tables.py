"""Entity resolution, snapshots, health, sources, streams and plans, against brute force on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vacatlas.operators import analytics as A, dedup as D, health, listing as L, upsert as U
from vacatlas.plans import scale
from vacatlas.sources import landing, providers as R

NOW = F.lit("2024-01-31 12:00:00").cast("timestamp")
AS_OF = F.lit("2024-01-31").cast("date")
COLS = "seq long, provider string, company string, title string, url string, location string, external_id string, posted date, description string, tier string"


def sighting(seq, provider="workday", company="BMW Group", title="ML Engineer", location="Munich", ext=None, text="", posted=None, url=None):
    return (seq, provider, company, title, url or f"https://x.example.com/{seq}", location, f"e{seq}" if ext is None else ext, posted, text, "normal")


def groups(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    out: dict = {}
    for r in D.assign(df).collect():
        out.setdefault(r.group_key, set()).add(r.seq)
    return sorted(map(sorted, out.values()))


def brute(rows):
    """The set rule over everything at once, as plain text-book code."""
    import re
    noise, kept = re.compile(r"\b(group|gmbh|ag)\b"), {}
    for seq, provider, company, title, _, location, ext, *_ in sorted(rows):
        c, t = noise.sub("", company.lower()).strip(), title.lower()
        req = ext if ext.startswith("REQ-") else ""
        kept.setdefault((c, provider, ext, t, location.lower(), req), seq)
    rows = [(seq, *k) for k, seq in kept.items()]

    def join(items, together):
        root = {i: i for i in items}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        for a in items:
            for b in items:
                if together(a, b):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
        return {i: top(i) for i in items}

    def alike(a, b):
        x, y = set(a[4].split()), set(b[4].split())
        same = a[1] == b[1] and a[5] == b[5] and len(x & y) >= 0.72 * len(x | y)
        return same or a[1] == b[1] and a[6] != "" and a[6] == b[6]
    component, slot = join(rows, alike), {}
    for r in rows:
        own = sorted({x[3]: x[0] for x in sorted(rows, reverse=True) if x[3] and component[x] == component[r] and x[2] == r[2]}.items(), key=lambda x: x[1])
        slot[r] = component[r], [i for i, _ in own].index(r[3]) + 1 if r[3] else 1
    united = join(rows, lambda a, b: slot[a] == slot[b] or a[1] == b[1] and a[6] != "" and a[6] == b[6])
    out = {}
    for r in rows:
        out.setdefault(united[r], []).append(r[0])
    return sorted(map(sorted, out.values()))


def test_merges_and_guards(spark):
    assert groups(spark, [sighting(1), sighting(2, "arbeitnow")]) == [[1, 2]]                      # same key, two sources
    assert groups(spark, [sighting(1, ext="a"), sighting(2, ext="b"), sighting(3, ext="c")]) == [[1], [2], [3]]
    assert groups(spark, [sighting(1, ext="REQ-12345"), sighting(2, "lever", title="Other", ext="REQ-12345")]) == [[1, 2]]
    assert groups(spark, [sighting(1), sighting(2, "lever", company="Audi")]) == [[1], [2]]
    assert groups(spark, [sighting(1, ext="a"), sighting(2, ext="a")]) == [[1]]                    # a repeat is not counted
    assert groups(spark, [sighting(1, title="Data Platform Engineer"), sighting(2, "lever", title="Data Platform Engineer Berlin")]) == [[1, 2]]


@pytest.mark.parametrize("seed", range(4))
def test_same_result_as_the_rule_in_plain_code(spark, seed):
    rnd = random.Random(seed)
    titles = ["data engineer", "data platform engineer", "data platform engineer berlin", "ml engineer", "senior ml engineer cloud"]
    rows = [sighting(i, rnd.choice(["workday", "lever", "arbeitnow", "adzuna"]), rnd.choice(["BMW Group", "Audi AG"]),
                     rnd.choice(titles), rnd.choice(["Munich", "Berlin"]),
                     rnd.choice(["", f"e{i % 23}", f"x{i}", f"REQ-{10000 + i % 9}"]), "t" * rnd.randint(0, 9)) for i in range(60)]
    assert groups(spark, rows) == brute(rows)


def test_a_hot_key(spark):
    rows = [sighting(i, ["workday", "lever", "arbeitnow"][i % 3], ext=f"id{i}") for i in range(300)]
    assert groups(spark, rows) == brute(rows)


def test_one_rule_for_a_mixed_component(spark):
    rows = [sighting(i, ["workday", "lever"][i % 2], title=["data platform engineer", "data platform engineer berlin"][i % 2], ext=f"id{i}")
            for i in range(40)]
    out = groups(spark, rows)
    assert sorted(s for g in out for s in g) == list(range(40)) and len(out) == 20 and out == brute(rows)


def test_an_employer_with_a_third_of_all_rows_and_long_titles(spark):
    rnd, words = random.Random(11), [f"w{i}" for i in range(60)]
    bases = [rnd.sample(words, 15) for _ in range(12)]
    rows = []
    for i in range(90):
        title = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 3)):
            title[rnd.randrange(15)] = rnd.choice(words)
        company = "BMW Group" if i % 3 == 0 else f"Employer {i % 20}"
        rows.append(sighting(i, rnd.choice(["workday", "lever", "arbeitnow"]), company, " ".join(dict.fromkeys(title)), "Munich", rnd.choice(["", f"e{i % 31}"])))
    assert groups(spark, rows) == brute(rows)


def test_long_keys_keep_their_city(spark):
    title = " ".join(f"word{i}" for i in range(40))
    assert groups(spark, [sighting(1, title=title), sighting(2, "lever", title=title, location="Berlin")]) == [[1], [2]]


def test_group_facts(spark):
    rows = [sighting(1, "arbeitnow", text="a longer text", posted=dt.date(2024, 1, 20)), sighting(2, "workday", text="short", posted=dt.date(2024, 1, 14))]
    v = D.dedupe(spark.createDataFrame(rows, COLS)).first()
    assert (v.provider, v.description, v.posted, v.providers, v.duplicates) == (
        "workday", "a longer text", dt.date(2024, 1, 14), ["arbeitnow", "workday"], 1)


def test_similar_titles_are_never_missed(spark):
    rnd, words = random.Random(5), [f"w{i}" for i in range(30)]
    titles = set()
    for _ in range(150):
        a = rnd.sample(words, rnd.randint(1, 20))
        titles |= {" ".join(a), " ".join(a[rnd.randint(0, 2):] + rnd.sample(words, rnd.randint(0, 2)))}
    titles = sorted(t for t in titles if t)
    df = spark.createDataFrame([("c", "m", t, t) for t in titles], "company_norm string, city_norm string, title_norm string, key string")
    got = {(r.a, r.b) for r in D.by_title(df).collect()}
    share = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    assert got == {(a, b) for a in titles for b in titles if a > b and share(a, b) >= D.V.TITLE_SIMILARITY}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in scale.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and {got[i] for i in (200, 201, 202)} == {200}


def test_running_equals_one_window(spark):
    rows = [(i % 3, i, (i * 7) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t long, v long")
    out = scale.running(df, ["k"], F.floor(F.col("t") / 10), [F.col("t")], totals={"s": F.col("v")},
                        latest={"m": F.when(F.col("v") == 3, F.col("t"))}, before=True).collect()
    for r in out:
        earlier = [x for x in rows if x[0] == r.k and x[1] < r.t]
        assert r.s == sum(x[2] for x in earlier)
        assert r.m == max((x[1] for x in earlier if x[2] == 3), default=None)


def test_ranges_follow_the_rows(spark):
    df = spark.createDataFrame([(i << 20,) for i in range(1000)], "t long")
    n = [r["count"] for r in df.groupBy(scale.ranges(df, F.col("t"), rows=100).alias("b")).count().collect()]
    assert len(n) == 10 and max(n) < 150 and df.select(scale.ranges(df, F.col("t"))).distinct().count() == 1


JOB = "id string, source string, title string, score int, posted_at date, salary_basis string, salary_annual_eur_min double"


def test_upsert_is_idempotent_and_keeps_human_columns(spark):
    run = spark.createDataFrame([("a", "x", "t", 80, None, "unknown", None), ("b", "y", "t", 50, None, "unknown", None)], JOB)
    first = U.upsert(U.empty_snapshot(run), run, NOW)
    edits = spark.createDataFrame([("a", "status", "applied", dt.datetime(2024, 1, 30)), ("a", "notes", "call", dt.datetime(2024, 1, 30)),
                                   ("a", "starred", "true", dt.datetime(2024, 1, 30))], "id string, field string, value string, at timestamp")
    edited, events = U.apply_edits(first, edits)
    assert [(e.from_status, e.to_status) for e in events.collect()] == [("new", "applied")]
    again = spark.createDataFrame([("a", "x", "t2", 88, None, "unknown", None)], JOB)
    up = spark.createDataFrame([("x",)], "source string")
    out = {r.id: r for r in U.upsert(edited, again, NOW, up).collect()}
    assert (out["a"].score, out["a"].status, out["a"].notes, out["a"].starred, out["a"].times_seen) == (88, "applied", "call", True, 2)
    assert out["a"].applied_at == dt.date(2024, 1, 30) and out["a"].follow_up_at == dt.date(2024, 2, 6)
    assert out["b"].is_open and not out["a"].is_new            # a silent source closes nothing
    closed = {r.id: r for r in U.upsert(edited, again, NOW).collect()}
    assert not closed["b"].is_open and closed["b"].removed_at is not None
    reopened = {r.id: r for r in U.upsert(U.upsert(edited, again, NOW), run, NOW).collect()}
    assert reopened["b"].is_open and reopened["b"].removed_at is None


def test_edits_keep_the_whole_history_and_can_clear(spark):
    run = spark.createDataFrame([("a", "x", "t", 80, None, "unknown", None)], JOB)
    at = lambda d: dt.datetime(2024, 1, d)
    edits = spark.createDataFrame([("a", "status", "applied", at(3)), ("a", "status", "interview", at(9)), ("a", "notes", "call", at(3)),
                                   ("a", "notes", None, at(4)), ("a", "starred", "no boolean", at(4)), ("z", "status", "applied", at(3))],
                                  "id string, field string, value string, at timestamp")
    edited, events = U.apply_edits(U.upsert(U.empty_snapshot(run), run, NOW), edits)
    assert sorted((e.from_status, e.to_status, e.at) for e in events.collect()) == [("applied", "interview", at(9)), ("new", "applied", at(3))]
    r = edited.first()
    assert (r.status, r.notes, r.starred, r.applied_at, r.follow_up_at) == ("interview", "", False, dt.date(2024, 1, 3), dt.date(2024, 1, 10))


def test_a_long_feed_of_times_without_zone_gives_the_events_of_a_short_one(spark):
    """Several ranges of rows, in a zone whose clocks change inside the feed."""
    names = ["new", "applied", "interview", "offer"]
    snapshot = spark.createDataFrame([("a", "new"), ("b", "offer")], "id string, status string")
    start, rnd = dt.datetime(2024, 3, 31, 1, 0, 0, 5), random.Random(8)
    feed = [(rnd.choice("ab"), "status", rnd.choice(names), start + dt.timedelta(minutes=7 * i)) for i in range(40)]
    edits = spark.createDataFrame(feed, "id string, field string, value string, at timestamp_ntz")
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = key(U.status_events(snapshot, edits, rows_per_range=3))
        assert got == key(U.status_events(snapshot, edits))
        us = [r[0] for r in edits.orderBy("at").select(scale.micros(edits, "at")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert us == [(start - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) + 7 * 60_000_000 * i for i in range(40)]
    last, want = {"a": "new", "b": "offer"}, []
    for i, _, value, at in feed:
        if last[i] != value:
            want.append((i, last[i], value, at))
        last[i] = value
    assert got == sorted(want)


def test_board_keeps_what_is_overdue(spark):
    rows = [(f"n{i}", "applied", False, 50, dt.date(2024, 1, 30), None) for i in range(20)] + [("old", "applied", False, 10, dt.date(2020, 1, 1), dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id string, status string, hidden boolean, score int, posted_at date, follow_up_at date")
    got = L.board(df, AS_OF, per_stage=5).orderBy("position").collect()
    assert len(got) == 5 and (got[0].id, got[0].due) == ("old", True)


def test_health_continues_like_one_fold(spark):
    rnd = random.Random(3)
    rows = [(i, "lever", f"t{rnd.randint(0, 2)}", rnd.choice(["healthy", "failed", "failed", "rate_limited", "skipped"]),
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 5)) for i in range(80)]
    schema = "seq long, provider string, target string, state string, at timestamp"
    whole = health.fold(spark.createDataFrame(rows, schema))
    cols = ["target", "state", "consecutive_failures", "total_runs", "total_failures", "at", "backoff_until"]
    parts = health.fold_onto(health.fold_onto(None, spark.createDataFrame(rows[:30], schema)), spark.createDataFrame(rows[30:], schema))
    assert sorted(whole.select(cols).collect()) == sorted(parts.select(cols).collect())
    streaks = {}
    for seq, _, target, state, _ in rows:
        if state != "skipped":
            streaks[target] = 0 if state == "healthy" else streaks.get(target, 0) + 1
    assert {r.target: r.consecutive_failures for r in whole.collect()} == streaks


def test_streaks_over_ranges_with_a_source_that_has_all_rows_of_a_day(spark):
    rnd = random.Random(9)
    rows = [(i, "lever", "busy" if i < 300 else f"t{i % 3}", rnd.choice(["healthy", "failed", "failed", "rate_limited", "skipped"]),
             dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 200) if i < 300 else i * 4000)) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, provider string, target string, state string, at timestamp")
    want, streak, runs, failures = {}, {}, {}, {}
    for seq, _, target, state, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if state != "skipped":
            streak[target] = 0 if state == "healthy" else streak.get(target, 0) + 1
            runs[target], failures[target] = runs.get(target, 0) + 1, failures.get(target, 0) + (state != "healthy")
            want[seq] = (streak[target], runs[target], failures[target])
    for size in (1_000_000, 30):
        got = {r.seq: (r.consecutive_failures, r.runs, r.failures) for r in health.failure_streaks(df, size).collect()}
        assert got == want
    events = df.select(F.col("target").alias("job_id"), F.col("seq").alias("event_id"), "at", F.col("state").alias("to_status"))
    key = lambda r: (r.job_id, r.event_id, r.from_status, r.micros_in_stage)
    assert sorted(map(key, A.status_timeline(events, 30).collect()), key=repr) == sorted(map(key, A.status_timeline(events).collect()), key=repr)


def raw(spark, provider, payload, target="acme"):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(provider, target, "Acme", "dream", 1, text)], "provider string, target string, company string, tier string, seq long, payload string")


def test_sources_read_their_payloads(spark):
    g = R.normalize(raw(spark, "greenhouse", {"jobs": [{"id": 7, "title": "A", "absolute_url": "https://a", "location": {"name": "Bern"},
                    "first_published": "2024-01-05T00:00", "updated_at": "2024-01-30"}, {"title": "B"}]}), "greenhouse", AS_OF).collect()
    assert (g[0].external_id, g[0].posted, g[0].location, g[0].tier) == ("7", dt.date(2024, 1, 5), "Bern", "dream") and g[1].url == ""
    xml = "<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x/job/9</link><pubDate>Mon, 05 Feb 2024 10:00:00 +0000</pubDate></item><item><title>No link</title></item></rss>"
    s = R.normalize(raw(spark, "successfactors", xml), "successfactors", AS_OF).collect()
    assert (s[0].title, s[0].external_id, s[0].posted) == ("A & B", "9", dt.date(2024, 2, 5))
    w = R.normalize(raw(spark, "workday", {"jobPostings": [
        {"title": "T", "externalPath": "/job/Ulm-Nord/T_R1", "postedOn": "Posted 5 Days Ago", "bulletFields": ["R-1"]},
        {"title": "T", "externalPath": "/x", "bulletFields": ["R-2", "Various"]}]}), "workday", AS_OF).collect()
    assert [(r.external_id, r.location) for r in w] == [("R-1", "Ulm Nord"), ("R-2", "")] and w[0].posted == dt.date(2024, 1, 26)
    j = R.normalize(raw(spark, "jobsch", {"documents": [{"job_id": "1", "title": "T", "place": " Bern ", "regions": [{"name": None}],
                    "language_skills": [{"language": "de", "level": 3}], "_links": {"detail_de": {"href": "/de/1"}}}]}), "jobsch", AS_OF).first()
    assert (j.url, j.location, j.company, j.tier, j.structured.language_skills[0].level) == ("https://www.jobs.ch/de/1", "Bern", "Unknown", "normal", 3)
    a = R.normalize(raw(spark, "adzuna", {"results": [{"id": "1", "salary_min": 50000.4, "salary_is_predicted": "0"}, {"id": "2", "salary_min": 1, "salary_is_predicted": "1"}]}), "adzuna", AS_OF).collect()
    assert [r.salary_hint for r in a] == ["50000-50000 EUR per year", ""]
    assert R.quarantine(raw(spark, "lever", "not json")).count() == 1 and R.normalize(raw(spark, "lever", "not json"), "lever", AS_OF).count() == 0
    with pytest.raises(ValueError):
        R.normalize(raw(spark, "greenhouse", "{}"), "nobody", AS_OF)


def test_filter_documents():
    with pytest.raises(ValueError):
        L.JobQuery.from_dict({"colour": "red"})
    with pytest.raises(ValueError):
        L.ordering("random")


def test_stream_merges_batches_and_closes_per_target(spark, tmp_path):
    from vacatlas.streaming import ingest
    land, root = tmp_path / "land", str(tmp_path / "jobs")
    land.mkdir()

    def drop(n, target, titles, name=None):
        jobs = [{"id": t, "title": t, "absolute_url": f"https://x/{t}", "location": {"name": "Munich"}, "first_published": "2024-01-30"} for t in titles]
        row = {"provider": "greenhouse", "target": target, "company": target.title(), "tier": "high", "fetched_at": f"2024-01-31T0{n}:00:00", "seq": n, "payload": json.dumps({"jobs": jobs})}
        (land / f"{name or n}.json").write_text(json.dumps(row) + "\n")

    registry = spark.createDataFrame([(t, t.title(), None) for t in ("acme", "beta", "core")], "id string, name string, aliases array<string>")
    ends = []

    def finished(s):
        return s.createDataFrame([("greenhouse", *e) for e in ends], "source string, target string, state string, first_seq long, last_seq long")

    def go(files=10):
        stream = ingest.sightings(landing.read_stream(spark, str(land), files_per_batch=files), AS_OF)
        ingest.merge_batches(stream, registry, root, str(tmp_path / "ck"), AS_OF, NOW, outcomes=finished).awaitTermination()
        return {r.title: r for r in ingest.latest_snapshot(spark, root, 99).collect()}

    ends += [("acme", "healthy", 1, 1), ("beta", "healthy", 2, 2), ("core", "healthy", 3, 3)]
    drop(1, "acme", ["Machine Learning Engineer", "Data Scientist"])
    drop(2, "beta", ["Data Engineer"])
    drop(3, "core", ["Research Scientist", "Perception Engineer", "Robotics Engineer"])
    assert all(r.is_open for r in go().values())
    # acme changed, beta's payload is the same as before, core's next fetch has two payloads in two batches
    ends[:] = [("acme", "healthy", 4, 4), ("beta", "healthy", 5, 5), ("core", "healthy", 6, 7)]
    drop(4, "acme", ["Machine Learning Engineer"])
    drop(5, "beta", ["Data Engineer"])
    drop(6, "core", ["Research Scientist"])
    out = go()
    assert out["Machine Learning Engineer"].times_seen == 2 and out["Machine Learning Engineer"].is_open
    assert not out["Data Scientist"].is_open and out["Data Scientist"].company_id == "acme"
    assert out["Data Engineer"].is_open and out["Data Engineer"].times_seen == 2
    assert out["Robotics Engineer"].is_open and out["Perception Engineer"].is_open       # core is not read to its end
    drop(7, "core", ["Perception Engineer"])
    drop(7, "core", ["Perception Engineer"], name="again")                              # delivered twice
    out = go()
    assert out["Research Scientist"].is_open and out["Perception Engineer"].is_open and not out["Robotics Engineer"].is_open
    assert out["Perception Engineer"].times_seen == 2 and out["Data Engineer"].is_open


def test_only_complete_fetches_close(spark):
    jobs = spark.createDataFrame([("a", "s", "x", True, 4), ("b", "s", "x", True, 9), ("c", "s", "y", True, 4), ("d", "t", "x", True, 4), ("e", "s", "x", False, 1)],
                                 "id string, source string, target string, is_open boolean, seen_seq long").withColumn("removed_at", F.lit(None).cast("timestamp"))
    ends = spark.createDataFrame([("s", "x", 3), ("s", "x", 7), ("u", "x", 9)], "source string, target string, first_seq long")
    out = {r.id: (r.is_open, r.removed_at is not None) for r in U.close_missing(jobs, ends, NOW).collect()}
    assert out == {"a": (False, True), "b": (True, False), "c": (True, False), "d": (True, False), "e": (False, False)}


def test_plans_push_filters_and_never_sort_everything(spark, tmp_path):
    path = str(tmp_path / "jobs")
    spark.createDataFrame([("a", True, False, 5, dt.date(2024, 1, 1))], "id string, is_open boolean, hidden boolean, score int, posted_at date").write.parquet(path)
    jobs = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "9999")
    plan = L.page(L.find(jobs, jobs, L.JobQuery(min_score=3, max_age_days=9), AS_OF), "score", 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(score,3)" in plan and "GreaterThanOrEqual(posted_at" in plan
