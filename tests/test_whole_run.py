"""One run with all its tables, twice."""

import datetime as dt

from pyspark.sql import functions as F

from vacatlas.plans import discovery
from vacatlas.plans.discovery import Tables

AS_OF = F.lit("2024-01-31").cast("date")
AT = lambda h: F.lit(f"2024-01-31 {h:02}:00:00").cast("timestamp")
COLS = "seq long, provider string, target string, company string, title string, url string, location string, external_id string, posted date, description string, tier string"
OUT = "provider string, target string, state string, postings long, error string, seq long, at timestamp"
REGISTRY = "id string, name string, aliases array<string>, tier string, adapter string, adapter_arg string, source_status string, careers_url string"


def posting(seq, provider, company, title, ext, text="Machine learning with PyTorch. English is our working language.", posted=dt.date(2024, 1, 30), url=None):
    return (seq, provider, provider[0], company, title, url or f"https://x.example.com/{ext}", "Munich", ext, posted, text, "normal")


def test_a_run_writes_all_its_tables(spark):
    registry = spark.createDataFrame([("acme", "Acme", ["Acme Labs"], "dream", "greenhouse", "g", "idle", "https://a")], REGISTRY)
    one = [posting(1, "greenhouse", "Acme Labs", "Machine Learning Engineer", "a"), posting(2, "arbeitnow", "Acme Labs", "Machine Learning Engineer", "b", text="short"),
           posting(3, "arbeitnow", "Newcomer AG", "Data Scientist", "c"), posting(4, "greenhouse", "Acme", "Data Engineer", "d"),
           posting(5, "greenhouse", "Acme", "Data Engineer", "d"), posting(6, "greenhouse", "Acme", "Research Scientist", "e", posted=dt.date(2023, 6, 1)),
           posting(7, "arbeitnow", "Acme", "Machine Learning Engineer", "f", url="http://plain.example.com")]
    at = dt.datetime(2024, 1, 31, 9)
    outcomes = lambda *r: spark.createDataFrame([(*x, i, at) for i, x in enumerate(r)], OUT)
    details = spark.createDataFrame([("arbeitnow", "c", "A much longer text about machine learning, deep learning, PyTorch, Docker and Kubernetes. " * 3)],
                                    "provider string, external_id string, text string")
    first = discovery.whole_run(Tables(companies=registry), spark.createDataFrame(one, COLS), outcomes(
        ("greenhouse", "g", "healthy", 4, ""), ("arbeitnow", "a", "healthy", 3, "")), 1, AS_OF, AT(9), details)
    jobs = {r.title: r for r in first.jobs.collect()}
    assert set(jobs) == {"Machine Learning Engineer", "Data Scientist", "Data Engineer"} and all(r.is_new for r in jobs.values())
    assert jobs["Machine Learning Engineer"].company_id == "acme" and "Kubernetes" in jobs["Data Scientist"].description
    assert sorted((r.provider, r.external_id, r.is_primary) for r in first.sources.collect()) == [
        ("arbeitnow", "b", False), ("arbeitnow", "c", True), ("greenhouse", "a", True), ("greenhouse", "d", True)]
    employers = {r.id: r for r in first.companies.collect()}
    assert (employers["acme"].source_status, employers["acme"].open_roles) == ("live", 2) and employers["newcomer-ag"].discovered_from == "arbeitnow"
    run = first.runs.first()
    assert (run.run_id, run.jobs_new, run.jobs_closed, run.errors_count) == (1, 3, 0, 0)
    assert any(r.kind == "dream_company" for r in first.signals.collect())

    later = [posting(8, "greenhouse", "Acme Labs", "Machine Learning Engineer", "a")]
    second = discovery.whole_run(first, spark.createDataFrame(later, COLS), outcomes(
        ("greenhouse", "g", "healthy", 1, ""), ("arbeitnow", "a", "failed", 0, "timed out")), 2, AS_OF, AT(10))
    jobs = {r.title: r for r in second.jobs.collect()}
    assert {t: r.is_open for t, r in jobs.items()} == {"Machine Learning Engineer": True, "Data Engineer": False, "Data Scientist": True}
    assert jobs["Machine Learning Engineer"].times_seen == 2 and not any(r.is_new for r in jobs.values())
    assert [(r.run_id, r.jobs_closed, r.errors_count, r.status) for r in second.runs.orderBy("run_id").collect()] == [(1, 0, 0, "ok"), (2, 1, 1, "partial")]
    assert {(r.provider, r.consecutive_failures) for r in second.health.collect()} == {("greenhouse", 0), ("arbeitnow", 1)}
    told = [r.dedupe_key for r in second.signals.collect()]
    assert len(told) == len(set(told)) and second.sources.count() == 4 and second.archived.count() == 0
