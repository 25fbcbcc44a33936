"""The read side: one filter document, five orders, pages, saved searches, detail rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import labels
from ..profile import DEFAULT, Profile
from .text_index import TextIndex

ORDERS = ("newest", "score", "company", "discovered", "salary")


@dataclass(frozen=True)
class JobQuery:
    """A filter document.  Unset fields do not filter; unknown keys are refused."""

    q: str | None = None
    tier: str | None = None
    country: str | None = None
    city: str | None = None
    company: str | None = None
    category: str | None = None
    language: str | None = None
    source: str | None = None
    status: str | None = None
    domain: str | None = None
    remote: str | None = None
    seniority: str | None = None
    min_score: int | None = None
    max_age_days: int | None = None
    salary_min: int | None = None
    only_new: bool = False
    only_starred: bool = False
    only_clean: bool = False
    include_hidden: bool = False
    include_closed: bool = False

    @classmethod
    def from_dict(cls, doc: dict) -> "JobQuery":
        unknown = set(doc) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filter keys: {sorted(unknown)}")
        return cls(**doc)

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None and v is not False}


def _holds(column: str, text: str) -> Column:
    """Case-insensitive 'contains'; % and _ are ordinary characters."""
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower()))


def conditions(query: JobQuery, as_of: Column, profile: Profile = DEFAULT) -> list[Column]:
    """Every set filter as a column; equality and range tests reach the Parquet scan."""
    q, c = query, F.col
    out = []
    if not q.include_closed:
        out.append(c("is_open"))
    if not q.include_hidden:
        out.append(~c("hidden"))
    if q.only_new:
        out.append(c("is_new"))
    if q.only_starred:
        out.append(c("starred"))
    if q.only_clean:
        out.append(~c("has_flags"))
    for value, column in ((q.status, "status"), (q.language, "language_requirement"),
                          (q.source, "source"), (q.seniority, "seniority"),
                          (q.remote, "remote_policy"), (q.category, "role_category")):
        if value:
            out.append(c(column) == value)
    if q.company:
        out.append(_holds("company_name", q.company))
    if q.city:
        out.append(_holds("city", q.city) | _holds("location_raw", q.city))
    if q.domain:
        out.append(_holds("search_blob", q.domain))
    if q.min_score is not None:
        out.append(c("score") >= q.min_score)
    if q.salary_min is not None:
        out.append(c("salary_annual_eur_min") >= float(q.salary_min))
    if q.max_age_days is not None:
        out.append(c("posted_at") >= F.date_sub(as_of, q.max_age_days))
    if q.country:
        terms = profile.country_terms.get(q.country.lower(), [])
        if terms:
            named = [F.contains(c("search_blob"), F.lit(t)) for t in terms]
            out.append(reduce(lambda a, b: a | b, named, c("country") == q.country.upper()))
    if q.q and q.q.strip():
        out.append(F.contains(c("search_blob"), F.lit(q.q.lower().strip())))
    return out


def find(jobs: DataFrame, companies: DataFrame, query: JobQuery, as_of: Column,
         profile: Profile = DEFAULT, index: TextIndex | None = None) -> DataFrame:
    """All jobs that a filter document selects.

    With an ``index`` over ``search_blob`` only the jobs that may hold the text terms are read on.
    """
    terms = [t.lower() for t in ((query.q or "").strip(), query.domain or "") if t]
    if index is not None and terms:
        asked = jobs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        both = index.candidates(asked).groupBy("id").agg(F.countDistinct("term").alias("_terms")).filter(F.col("_terms") == len(set(terms)))
        jobs = jobs.join(both.select("id"), "id", "left_semi")
    tests = conditions(query, as_of, profile)
    out = jobs.filter(reduce(lambda a, b: a & b, tests)) if tests else jobs
    if query.tier:
        ids = companies.filter(F.col("tier") == query.tier.lower()).select(F.col("id").alias("company_id"))
        out = out.join(ids, ["company_id"], "left_semi")
    return out


def ordering(order: str = "newest") -> list[Column]:
    """Sort columns with missing values last; ``id`` makes every order total."""
    score, posted = F.desc("score"), F.desc_nulls_last("posted_at")
    try:
        lead = {"newest": [posted, score], "score": [score, posted],
                "company": [F.asc("company_name"), score],
                "discovered": [F.desc("first_seen_at"), score],
                "salary": [F.desc_nulls_last("salary_annual_eur_min"), score]}[order]
    except KeyError:
        raise ValueError(f"unknown order {order!r}, use one of {ORDERS}") from None
    return [*lead, F.asc("id")]


def page(found: DataFrame, order: str = "newest", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; the plan keeps limit+offset rows per task, never a full sort."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset not negative")
    out = found.orderBy(*ordering(order))
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def with_tier(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Tier of the employer, 'normal' when it is not registered."""
    tiers = companies.select(F.col("id").alias("company_id"), F.col("tier").alias("company_tier"))
    return jobs.join(tiers, ["company_id"], "left").withColumn(
        "company_tier", F.coalesce("company_tier", F.lit("normal")))


def summary_rows(jobs: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Light projection for lists, with labels next to codes."""
    c = F.col
    return with_tier(jobs, companies).select(
        "id", "company_name", "company_id", "title", "url", "city", "country", "source",
        c("company_tier").alias("tier"), "posted_at",
        F.datediff(as_of, c("posted_at")).alias("age_days"), "is_new", "is_open", "score",
        labels.match_band(c("score")).alias("band"),
        labels.language_label(c("language_requirement")).alias("language"),
        labels.seniority_label(c("seniority")).alias("seniority"),
        labels.remote_label(c("remote_policy")).alias("remote"),
        labels.status_label(c("status")).alias("status"), "starred", "hidden")


def detail_rows(jobs: DataFrame, sources: DataFrame, history: DataFrame,
                wanted: DataFrame) -> DataFrame:
    """Full rows of the wanted jobs with their sources and status history nested.

    The children are cut down to the wanted ids before they are collected, so
    the nested lists only ever hold what a page asked for.
    """
    base = jobs.join(wanted, "id", "left_semi")
    mine = wanted.select(F.col("id").alias("job_id"))
    src = sources.join(mine, "job_id", "left_semi").groupBy("job_id").agg(F.array_sort(F.collect_list(
        F.struct("provider", "external_id", "url"))).alias("sources"))
    hist = history.join(mine, "job_id", "left_semi").groupBy("job_id").agg(F.sort_array(F.collect_list(
        F.struct("at", "from_status", "to_status")), asc=False).alias("history"))
    return (base.join(src, base.id == src.job_id, "left").drop("job_id")
            .join(hist, base.id == hist.job_id, "left").drop("job_id"))


def saved_searches(jobs: DataFrame, companies: DataFrame, searches: dict[str, dict], as_of: Column,
                   per_search: int = 100, profile: Profile = DEFAULT) -> DataFrame:
    """All saved documents over all jobs in one scan: ``search, id, rank, matches``.

    A job carries the list of searches it satisfies; the best rows per search
    are then kept with a ranked filter that Spark also applies before the
    shuffle, so a search that matches a third of all jobs stays cheap.
    """
    # the tier of a registered employer; the others have none, as in find()
    jobs = jobs.join(companies.select(F.col("id").alias("company_id"), F.col("tier").alias("company_tier")), "company_id", "left")
    tests = []
    for name, doc in searches.items():
        query = JobQuery.from_dict(doc)
        cond = conditions(query, as_of, profile)
        if query.tier:
            cond.append(F.col("company_tier") == query.tier.lower())
        tests.append(F.when(reduce(lambda a, b: a & b, cond, F.lit(True)), F.lit(name)))
    hits = jobs.withColumn("search", F.explode(F.array_compact(F.array(*tests))))
    best = W.partitionBy("search").orderBy(*ordering("newest"))
    top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_search)
    counts = hits.groupBy("search").agg(F.count(F.lit(1)).alias("matches"))
    return top.select("search", "id", "rank").join(counts, "search")


def overview(jobs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """The morning lists: 8 strongest new rows, then up to 14 worth applying that are not among them."""
    open_jobs = jobs.filter(F.col("is_open") & ~F.col("hidden"))
    first = page(open_jobs.filter(F.col("score") >= profile.high_match_score), limit=8)
    second = page(open_jobs.filter(F.col("score") >= profile.recommend_min_score), limit=14)
    first_ids = first.select("id")
    return first.select("id", "score", F.lit("priority").alias("list")).union(
        second.join(first_ids, "id", "left_anti").select("id", "score", F.lit("worth").alias("list")))


def board(jobs: DataFrame, as_of: Column, per_stage: int) -> DataFrame:
    """Pipeline columns: the first ``per_stage`` of each, due follow-ups first, then the score."""
    due = F.coalesce(F.col("follow_up_at") <= as_of, F.lit(False))
    show = W.partitionBy("status").orderBy(F.desc("due"), F.desc("score"), F.asc("id"))
    return (jobs.filter(F.col("status").isin(V.PIPELINE_STAGES) & ~F.col("hidden"))
            .withColumn("due", due).withColumn("position", F.row_number().over(show))
            .filter(F.col("position") <= per_stage)
            .select("status", "id", "due", "score", "position"))


def company_roles(jobs: DataFrame, company_id: str, limit: int = 100, closed: bool = False) -> DataFrame:
    out = jobs.filter(F.col("company_id") == company_id)
    out = out if closed else out.filter("is_open")
    return out.orderBy(*ordering("score")).limit(limit)


def recent(df: DataFrame, at: str, limit: int, key: str = "id") -> DataFrame:
    """Newest rows of an event table."""
    return df.orderBy(F.desc(at), F.asc(key)).limit(limit)
