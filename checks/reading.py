"""Checked queries: filters (F01-F09, F18-F21), orders (T), aggregates (A), joins (J), rankings (W)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacatlas import fixed_values as V
from vacatlas.functions import labels
from vacatlas.operators import analytics as A
from vacatlas.operators import companies as C
from vacatlas.operators import drafts, health, listing as L, searches, text_index
from vacatlas.operators import enrich as E
from vacatlas.plans.scale import shared_dir
from vacatlas.profile import DEFAULT as P

from .base import AS_OF_SQL, O, VIEWS, as_of, now, query, sql, table, view
from .facts import q, sql_lookup, sql_match_key, sql_plain, sql_slug

VIEWS["job_view"] = """
SELECT 'job-' || CAST(seq AS VARCHAR(20)) AS id, seq, company AS company_name,
  CASE WHEN seq % 23 = 0 THEN NULL ELSE 'c' || CAST(seq % 97 AS VARCHAR(20)) END AS company_id,
  title, url, provider AS source, location AS location_raw,
  CASE seq % 9 WHEN 0 THEN 'Munich' WHEN 1 THEN 'München' WHEN 2 THEN 'Zürich' WHEN 3 THEN 'Bangalore'
    WHEN 4 THEN 'Lisbon' WHEN 8 THEN 'Berlin (Remote)' ELSE '' END AS city,
  CASE seq % 9 WHEN 0 THEN 'DE' WHEN 1 THEN 'DE' WHEN 2 THEN 'CH' WHEN 4 THEN 'EU' WHEN 8 THEN 'DE' ELSE '' END AS country,
  CASE seq % 9 WHEN 8 THEN 'remote' ELSE CASE seq % 10 WHEN 4 THEN 'hybrid' WHEN 8 THEN 'onsite' ELSE 'unknown' END END AS remote_policy,
  CASE seq % 12 WHEN 2 THEN 'senior' WHEN 3 THEN 'junior' WHEN 8 THEN 'executive' WHEN 9 THEN 'graduate' WHEN 10 THEN 'lead' ELSE 'unknown' END AS seniority,
  CASE seq % 10 WHEN 0 THEN 'english_only' WHEN 1 THEN 'german_c1_plus' WHEN 3 THEN 'german_b2' WHEN 6 THEN 'german_optional' ELSE 'unclear' END AS language_requirement,
  CASE seq % 12 WHEN 0 THEN 'Machine Learning' WHEN 1 THEN 'Machine Learning' WHEN 2 THEN 'Data Science' WHEN 3 THEN 'Data Engineering' WHEN 10 THEN 'Research' ELSE '' END AS role_category,
  posted AS posted_at, CAST(DATE '2024-01-31' - CAST(seq % 40 AS INT) AS TIMESTAMP) AS first_seen_at,
  seq % 9 <> 5 AS is_open, seq % 5 = 0 AS is_new, seq % 17 = 0 AS hidden, seq % 13 = 0 AS starred,
  seq % 10 = 5 AS has_flags, CAST((seq * 37) % 101 AS INT) AS score,
  CASE WHEN seq % 10 IN (2, 3, 7) THEN 'explicit' ELSE 'unknown' END AS salary_basis,
  CASE seq % 10 WHEN 2 THEN CAST(40000 + seq % 13 * 5000 AS DOUBLE) WHEN 3 THEN CAST(72000 AS DOUBLE) WHEN 7 THEN CAST(127200 AS DOUBLE) ELSE NULL END AS salary_annual_eur_min,
  CASE seq % 14 WHEN 1 THEN 'reviewing' WHEN 2 THEN 'interested' WHEN 3 THEN 'to_apply' WHEN 4 THEN 'applied' WHEN 5 THEN 'interview'
    WHEN 6 THEN 'technical_interview' WHEN 7 THEN 'hr_interview' WHEN 8 THEN 'offer' WHEN 9 THEN 'rejected' ELSE 'new' END AS status,
  CASE WHEN seq % 14 BETWEEN 4 AND 9 THEN DATE '2024-01-31' - CAST(seq % 20 AS INT) ELSE NULL END AS applied_at,
  CASE WHEN seq % 14 BETWEEN 4 AND 6 THEN DATE '2024-01-31' + CAST(seq % 9 - 4 AS INT) ELSE NULL END AS follow_up_at,
  CASE WHEN seq % 19 = 0 THEN 'call them' ELSE '' END AS notes,
  CASE WHEN seq % 9 = 5 THEN CAST(DATE '2024-01-31' - CAST(seq % 60 AS INT) AS TIMESTAMP) ELSE NULL END AS removed_at,
  lower(company || ' ' || title || ' ' || location) AS search_blob, description
FROM posting_view
"""
VIEWS["company_view"] = """
SELECT 'c' || CAST(s.s_suppkey AS VARCHAR(20)) AS id, s.s_suppkey AS num, s.s_name AS name,
  CASE s.s_suppkey % 4 WHEN 0 THEN 'dream' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'ignored' END AS tier,
  CASE s.s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'greenhouse' ELSE 'workday' END AS adapter,
  CASE s.s_suppkey % 3 WHEN 0 THEN NULL ELSE 'board-' || CAST(s.s_suppkey - s.s_suppkey % 50 % 2 AS VARCHAR(20)) END AS adapter_arg,
  lower(r.r_name) AS industry, lower(n.n_name) AS country,
  CASE WHEN s.s_suppkey % 10 = 3 THEN 'c' || CAST(s.s_suppkey - 3 AS VARCHAR(20))
       WHEN s.s_suppkey % 10 = 4 THEN 'c' || CAST(s.s_suppkey - 1 AS VARCHAR(20))
       WHEN s.s_suppkey % 31 = 0 THEN 'missing' ELSE NULL END AS parent_id,
  s.s_suppkey % 25 <> 24 AS enabled,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'manual' ELSE CASE s.s_suppkey % 5 WHEN 0 THEN 'idle' WHEN 1 THEN 'broken' ELSE 'live' END END AS source_status,
  CASE WHEN s.s_suppkey % 6 = 5 THEN 'arbeitnow' ELSE '' END AS discovered_from,
  CASE WHEN s.s_suppkey % 6 = 0 THEN '' ELSE 'https://careers.example.com/' || CAST(s.s_suppkey AS VARCHAR(20)) END AS careers_url
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
"""
VIEWS["outcome_view"] = """
SELECT event_id AS seq, ts AS at, CAST(ts AS DATE) AS day, CASE user_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'lever' ELSE 'adzuna' END AS provider,
  'board-' || CAST(user_id AS VARCHAR(20)) AS target, CAST(ts AS DATE) AS run_day,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'rate_limited'
       WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'skipped' ELSE 'healthy' END AS state,
  CASE WHEN event_type = 'error' THEN 'timed out' ELSE '' END AS error,
  CAST(CASE WHEN event_type IN ('view', 'click') THEN event_id % 40 ELSE 0 END AS BIGINT) AS postings
FROM events
"""
VIEWS["status_view"] = """
SELECT event_id, 'job-' || CAST(user_id AS VARCHAR(20)) AS job_id, ts AS at,
  CASE event_type WHEN 'view' THEN 'reviewing' WHEN 'click' THEN 'interested' WHEN 'signup' THEN 'applied'
    WHEN 'purchase' THEN 'interview' ELSE 'rejected' END AS to_status FROM events
"""
O["o_vis"] = "SELECT * FROM job_view WHERE is_open AND NOT hidden"
O["o_fig"] = f"""
SELECT c.*, coalesce(f.worth, 0)::BIGINT AS worth_applying, coalesce(f.best, 0) AS best_score FROM company_view c LEFT JOIN (
  SELECT company_id, count(*) FILTER (WHERE score >= {P.recommend_min_score}) AS worth, max(score) AS best
  FROM o_vis WHERE company_id IS NOT NULL GROUP BY company_id) f ON f.company_id = c.id"""


def jobs(spark, sf):
    return view(spark, sf, "job_view")


def comps(spark, sf):
    return view(spark, sf, "company_view")


def figured(spark, sf):
    f = A.employer_figures(jobs(spark, sf)).withColumnRenamed("company_id", "id")
    return comps(spark, sf).join(f, "id", "left").withColumns({
        "worth_applying": F.coalesce("worth_applying", F.lit(0)), "best_score": F.coalesce("best_score", F.lit(0))})


# -- filters ----------------------------------------------------------------
_FILTERS = {
    "f01_visible": ({}, ""),
    "f01_with_closed": ({"include_closed": True}, None),
    "f02_new": ({"only_new": True}, "is_new"), "f02_starred": ({"only_starred": True}, "starred"),
    "f02_clean": ({"only_clean": True}, "NOT has_flags"),
    "f03_tier": ({"tier": "dream"}, "company_id IN (SELECT id FROM company_view WHERE tier = 'dream')"),
    "f04_equals": ({"language": "unclear", "seniority": "senior"},
                   "language_requirement = 'unclear' AND seniority = 'senior'"),
    "f05_contains": ({"company": "gmbh", "city": "MÜN"},
                     "contains(lower(company_name), 'gmbh') AND (contains(lower(city), 'mün') OR contains(lower(location_raw), 'mün'))"),
    "f06_text": ({"q": " Perception ", "domain": "engineer"},
                 "contains(search_blob, 'perception') AND contains(search_blob, 'engineer')"),
    "f07_ranges": ({"min_score": 40, "salary_min": 50000, "max_age_days": 20},
                   f"score >= 40 AND salary_annual_eur_min >= 50000 AND posted_at >= {AS_OF_SQL} - 20"),
    "f08_country": ({"country": "de"}, "(country = 'DE' OR " + " OR ".join(
        f"contains(search_blob, {q(t)})" for t in P.country_terms["de"]) + ")"),
    "f09_document": ({"q": "engineer", "remote": "hybrid", "source": "adzuna", "min_score": 10},
                     "contains(search_blob, 'engineer') AND remote_policy = 'hybrid' AND source = 'adzuna' AND score >= 10"),
}


def _filter(name, doc, cond):
    text = ("SELECT id FROM job_view WHERE NOT hidden" if cond is None
            else "SELECT id FROM o_vis" + (f" WHERE {cond}" if cond else ""))

    @query(name, sql(text))
    def run(spark, sf):
        return L.find(jobs(spark, sf), comps(spark, sf), L.JobQuery.from_dict(doc), as_of()).select("id")


for _n, (_d, _c) in _FILTERS.items():
    _filter(_n, _d, _c)


@query("f18_companies", sql(
    "SELECT id FROM company_view WHERE enabled AND adapter IS NOT NULL AND tier = 'high' AND source_status = 'live'"))
def f18(spark, sf):
    return C.select(comps(spark, sf), tier="high", automated=True, source_status="live").select("id")


@query("f19_explorer_views", sql(
    "SELECT 'hiring' AS v, id FROM o_fig WHERE worth_applying > 0 UNION ALL SELECT 'dream', id FROM o_fig WHERE tier = 'dream' "
    "UNION ALL SELECT 'manual', id FROM o_fig WHERE adapter IS NULL UNION ALL SELECT 'text', id FROM o_fig "
    "WHERE contains(lower(name), 'asia') OR contains(industry, 'asia') OR contains(adapter, 'asia')"))
def f19(spark, sf):
    c = figured(spark, sf)
    parts = [C.explore(c, v).select(F.lit(v).alias("v"), "id") for v in ("hiring", "dream", "manual")]
    return parts[0].union(parts[1]).union(parts[2]).union(
        C.explore(c, text="asia").select(F.lit("text").alias("v"), "id"))


@query("f20_unread", sql("SELECT event_id FROM events WHERE event_type <> 'view'"))
def f20(spark, sf):
    from vacatlas.operators.signals import unread
    e = table(spark, sf, "events").withColumn("read_at", F.when(F.col("event_type") == "view", F.col("ts")))
    return unread(e).select("event_id")


@query("f21_summary_rows", sql(f"""
SELECT j.id, coalesce(c.tier, 'normal') AS tier, date_diff('day', posted_at, {AS_OF_SQL})::INT AS age_days, score,
  {sql_lookup('language_requirement', V.LANGUAGE_LABELS, q('Not stated'))} AS language,
  {sql_lookup('status', V.STATUS_LABELS, q('Not stated'))} AS status FROM o_vis j LEFT JOIN company_view c ON c.id = j.company_id"""))
def f21(spark, sf):
    rows = L.summary_rows(A.visible(jobs(spark, sf)), comps(spark, sf), as_of())
    return rows.select("id", "tier", "age_days", "score", "language", "status")


@query("j09_job_detail", sql("""
SELECT j.id, coalesce(s.n, 0)::INT AS n_sources, coalesce(h.n, 0)::INT AS n_events, h.latest
FROM (SELECT * FROM o_vis WHERE starred) j
LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT id FROM job_view UNION ALL SELECT id FROM job_view WHERE seq % 3 = 0) GROUP BY id) s ON s.id = j.id
LEFT JOIN (SELECT job_id, count(*) AS n, arg_max(to_status, ("at", event_id)) AS latest FROM status_view GROUP BY job_id) h ON h.job_id = j.id"""))
def j09(spark, sf):
    j = jobs(spark, sf)
    base = j.select(F.col("id").alias("job_id"), F.col("source").alias("provider"), "url",
                    F.col("id").alias("external_id"), "seq")
    src = base.union(base.filter("seq % 3 = 0").withColumn("provider", F.lit("board")))
    hist = view(spark, sf, "status_view").withColumn("from_status", F.lit(None).cast("string"))
    out = L.detail_rows(j, src, hist, A.visible(j).filter("starred").select("id"))
    return out.select("id", F.greatest(F.size("sources"), F.lit(0)).alias("n_sources"),
                      F.coalesce(F.size("history"), F.lit(0)).alias("n_events"),
                      F.get("history", 0)["to_status"].alias("latest")).withColumn(
        "n_events", F.greatest("n_events", F.lit(0)))


# -- orders -----------------------------------------------------------------
_SQL_ORDER = {"newest": "posted_at DESC NULLS LAST, score DESC, id", "score": "score DESC, posted_at DESC NULLS LAST, id",
              "company": "company_name, score DESC, id", "discovered": "first_seen_at DESC, score DESC, id",
              "salary": "salary_annual_eur_min DESC NULLS LAST, score DESC, id"}


def _order(name, order):
    @query(f"t01_{name}", sql(f"SELECT id FROM o_vis ORDER BY {order} LIMIT 50"))
    def run(spark, sf):
        return L.page(A.visible(jobs(spark, sf)), name, 50).select("id")


for _n, _o in _SQL_ORDER.items():
    _order(_n, _o)


@query("t02_page", sql(f"SELECT id FROM o_vis ORDER BY {_SQL_ORDER['score']} LIMIT 40 OFFSET 80"))
def t02(spark, sf):
    return L.page(A.visible(jobs(spark, sf)), "score", 40, 80).select("id")


@query("t03_by_score", sql("SELECT id, score FROM o_vis"))
def t03(spark, sf):
    return A.visible(jobs(spark, sf)).orderBy(F.desc("score"), "id").select("id", "score")


@query("t04_overview", sql(f"""
WITH a AS (SELECT id, score FROM o_vis WHERE score >= 80 ORDER BY {_SQL_ORDER['newest']} LIMIT 8),
 b AS (SELECT id, score FROM o_vis WHERE score >= 60 ORDER BY {_SQL_ORDER['newest']} LIMIT 14)
SELECT id, score, 'priority' AS list FROM a UNION ALL SELECT id, score, 'worth' FROM b WHERE id NOT IN (SELECT id FROM a)""".replace("\nWITH a", "\nSELECT * FROM (WITH a") + ")"))
def t04(spark, sf):
    return L.overview(jobs(spark, sf))


@query("t05_board", sql(f"""
SELECT status, id, due, score, row_number() OVER (PARTITION BY status ORDER BY due DESC, score DESC, id)::INT AS position FROM (
  SELECT *, coalesce(follow_up_at <= {AS_OF_SQL}, false) AS due
  FROM job_view WHERE NOT hidden AND status IN ({', '.join(map(q, V.PIPELINE_STAGES))})) QUALIFY position <= 200"""))
def t05(spark, sf):
    return L.board(jobs(spark, sf), as_of(), per_stage=200)


_TIER = sql_lookup("tier", C.TIER_ORDER, "9")


@query("t06_explorer_order", sql(
    f"SELECT id, row_number() OVER (ORDER BY (worth_applying > 0) DESC, {_TIER}, worth_applying DESC, best_score DESC, name, id)::INT AS position FROM o_fig ORDER BY position LIMIT 60"))
def t06(spark, sf):
    top = figured(spark, sf).orderBy(*C.explorer_order()).limit(60)
    from pyspark.sql import Window as W
    return top.withColumn("position", F.row_number().over(W.orderBy(*C.explorer_order()))).select("id", "position")


@query("t07_dream_radar", sql(
    "SELECT id FROM o_fig WHERE tier = 'dream' ORDER BY worth_applying DESC, best_score DESC, name, id LIMIT 10"))
def t07(spark, sf):
    return C.explore(figured(spark, sf), "dream").orderBy(*C.radar_order()).limit(10).select("id")


@query("t08_company_roles", sql(
    f"SELECT id FROM job_view WHERE company_id = 'c5' AND is_open ORDER BY {_SQL_ORDER['score']} LIMIT 20"))
def t08(spark, sf):
    return L.company_roles(jobs(spark, sf), "c5", 20).select("id")


@query("t09_recent", sql('SELECT seq FROM outcome_view ORDER BY "at" DESC, seq LIMIT 30'))
def t09(spark, sf):
    return L.recent(view(spark, sf, "outcome_view"), "at", 30, "seq").select("seq")


@query("t10_watchlist", sql("SELECT id, tier, name FROM company_view WHERE enabled AND adapter IS NULL"))
def t10(spark, sf):
    return C.watchlist(comps(spark, sf))


# -- aggregates -------------------------------------------------------------
_places = P.location_tiers[max(P.location_tiers)][:12]


@query("a01_headline", sql(f"""
SELECT count(*) FILTER (WHERE v) AS total_open, count(*) FILTER (WHERE v AND first_seen_at::DATE = {AS_OF_SQL}) AS found_today,
  count(*) FILTER (WHERE v AND is_new) AS new_since_last_run, count(*) FILTER (WHERE v AND score >= 80) AS high_match,
  count(*) FILTER (WHERE v AND score >= 60) AS worth_applying, count(*) FILTER (WHERE v AND score >= 60 AND is_new) AS worth_applying_new,
  round(avg(score) FILTER (WHERE v), 1) AS average_score,
  count(*) FILTER (WHERE v AND is_new AND ({' OR '.join(f"contains(lower(city), {q(p)})" for p in _places)})) AS new_in_priority_city,
  count(*) FILTER (WHERE v AND score >= 60 AND company_id IN (SELECT id FROM company_view WHERE tier = 'dream')) AS dream_company_open
FROM (SELECT *, is_open AND NOT hidden AS v FROM job_view)"""))
def a01(spark, sf):
    return A.headline(jobs(spark, sf), comps(spark, sf), as_of()).drop(
        "applications_pending", "applications_submitted")


@query("a02_applications", sql(f"""
SELECT count(*) FILTER (WHERE status IN ({', '.join(map(q, V.PENDING_STATUSES))})) AS applications_pending,
  count(*) FILTER (WHERE status <> 'new' AND applied_at IS NOT NULL) AS applications_submitted FROM job_view"""))
def a02(spark, sf):
    return A.headline(jobs(spark, sf), comps(spark, sf), as_of()).select(
        "applications_pending", "applications_submitted")


@query("a03_hiring_companies", sql("SELECT count(DISTINCT company_name) AS companies_with_roles FROM o_vis"))
def a03(spark, sf):
    return A.hiring_companies(jobs(spark, sf))


for _c, _lim, _lab, _map in (("country", 12, None, None), ("role_category", 12, None, None), ("company_name", 10, None, None),
                             ("language_requirement", 12, labels.language_label, V.LANGUAGE_LABELS),
                             ("seniority", 12, labels.seniority_label, V.SENIORITY_LABELS), ("source", 12, None, None)):
    def _a04(c=_c, lim=_lim, lab=_lab, m=_map):
        label = sql_lookup(c, m, q("Not stated")) if m else c

        @query(f"a04_by_{c}", sql(
            f"SELECT {c} AS key, {label} AS label, count(*) AS n FROM o_vis WHERE {c} <> '' GROUP BY {c} ORDER BY n DESC, key LIMIT {lim}"))
        def run(spark, sf):
            return A.top_counts(jobs(spark, sf), c, lim, lab)
    _a04()


def _days_sql(source, column, days):
    return (f"SELECT d::DATE AS day, date_diff('day', d::DATE, {AS_OF_SQL})::INT AS age_days, coalesce(n, 0) AS n FROM "
            f"generate_series({AS_OF_SQL} - {days}, {AS_OF_SQL}, INTERVAL 1 DAY) g(d) LEFT JOIN "
            f"(SELECT {column}::DATE AS k, count(*) AS n FROM {source} GROUP BY 1) ON k = d::DATE")


@query("a05_posted_per_day", sql(_days_sql("o_vis", "posted_at", 14)))
def a05(spark, sf):
    return A.posted_per_day(jobs(spark, sf), as_of(), 14)


@query("a06_discovered_per_day", sql(_days_sql("job_view", "first_seen_at", 30)))
def a06(spark, sf):
    return A.per_day(jobs(spark, sf), "first_seen_at", as_of(), 30)


def _band_sql(case, names, source="o_vis"):
    rows = " UNION ALL ".join(f"SELECT {i} AS position, {q(b)} AS band" for i, b in enumerate(names))
    return (f"SELECT position, o.band, coalesce(n, 0) AS n FROM ({rows}) o LEFT JOIN "
            f"(SELECT {case} AS band, count(*) AS n FROM {source} GROUP BY 1) c ON c.band = o.band")


_SCORE = "CASE WHEN score >= 80 THEN '80-100' WHEN score >= 60 THEN '60-79' WHEN score >= 40 THEN '40-59' ELSE 'under 40' END"


@query("a07_score_bands", sql(_band_sql(_SCORE, [b for _, b in V.CHART_BANDS])))
def a07(spark, sf):
    return A.score_distribution(jobs(spark, sf))


@query("a08_freshness_bands", sql(_band_sql(
    f"CASE WHEN posted_at >= {AS_OF_SQL} - 1 THEN 'today' WHEN posted_at >= {AS_OF_SQL} - 3 THEN '1-3 days' "
    f"WHEN posted_at >= {AS_OF_SQL} - 7 THEN '4-7 days' ELSE 'over a week' END", [b for _, b in V.FRESH_BANDS])))
def a08(spark, sf):
    return A.freshness_distribution(jobs(spark, sf), as_of())


@query("a09_salary_bands", sql(_band_sql(
    "CASE WHEN salary_annual_eur_min >= 100000 THEN 'over 100k' WHEN salary_annual_eur_min >= 80000 THEN '80–100k' "
    "WHEN salary_annual_eur_min >= 65000 THEN '65–80k' WHEN salary_annual_eur_min >= 50000 THEN '50–65k' ELSE 'under 50k' END",
    [b for _, b in V.SALARY_BANDS], "(SELECT * FROM o_vis WHERE salary_basis = 'explicit' AND salary_annual_eur_min IS NOT NULL)")))
def a09(spark, sf):
    return A.salary_distribution(jobs(spark, sf))


@query("a09_salary_coverage", sql("""
SELECT count(*) FILTER (WHERE salary_basis = 'explicit' AND salary_annual_eur_min IS NOT NULL) AS with_salary,
  round(count(*) FILTER (WHERE salary_basis = 'explicit' AND salary_annual_eur_min IS NOT NULL) / count(*), 3) AS coverage FROM o_vis"""))
def a09b(spark, sf):
    return A.salary_coverage(jobs(spark, sf))


@query("a10_funnel", sql(_band_sql("status", [s for s, _ in V.FUNNEL], "job_view").replace("o.band", "o.band AS status", 1)))
def a10(spark, sf):
    return A.funnel(jobs(spark, sf))


@query("a11_coverage_totals", sql("""
SELECT count(*) AS tracked, count(adapter) AS automated, count(*) - count(adapter) AS manual,
  count(*) FILTER (WHERE discovered_from <> '') AS discovered_by_boards FROM company_view WHERE enabled"""))
def a11(spark, sf):
    return A.coverage_totals(comps(spark, sf))


@query("a11_coverage_status", sql("SELECT source_status, count(*) AS n FROM company_view WHERE enabled GROUP BY 1"))
def a11b(spark, sf):
    return A.coverage_by_status(comps(spark, sf))


_ROLES = "(SELECT c.*, coalesce(n, 0) AS roles FROM company_view c LEFT JOIN (SELECT company_id, count(*) AS n FROM o_vis GROUP BY 1) j ON j.company_id = c.id WHERE enabled)"


@query("a12_coverage_buckets", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, coalesce(nullif({k}, ''), 'unknown') AS key, count(*) AS companies, count(adapter) AS automated, "
    f"count(*) - count(adapter) AS manual, sum(roles)::BIGINT AS open_roles FROM {_ROLES} GROUP BY {k}"
    for k in ("industry", "country", "adapter"))))
def a12(spark, sf):
    return A.coverage_buckets(comps(spark, sf), jobs(spark, sf))


@query("a13_employer_figures", sql(
    "SELECT company_id, count(*) FILTER (WHERE score >= 60) AS worth_applying, max(score) AS best_score FROM o_vis WHERE company_id IS NOT NULL GROUP BY 1"))
def a13(spark, sf):
    return A.employer_figures(jobs(spark, sf))


@query("a14_employer_counts", sql("""
SELECT c.id, coalesce(o, 0) AS open_roles, coalesce(w, 0) AS new_roles_7d FROM company_view c LEFT JOIN (
  SELECT company_id, count(*) AS o, count(*) FILTER (WHERE first_seen_at >= TIMESTAMP '2024-01-24 12:00:00') AS w
  FROM job_view WHERE is_open GROUP BY 1) j ON j.company_id = c.id"""))
def a14(spark, sf):
    return A.employer_counts(comps(spark, sf), jobs(spark, sf), now())


@query("a15_run_counters", sql("""
SELECT run_day::VARCHAR AS run_id, count(*) AS providers_checked, count(*) FILTER (WHERE state = 'healthy') AS providers_ok,
  sum(postings)::BIGINT AS postings_seen, count(*) FILTER (WHERE error <> '') AS errors_count,
  CASE WHEN count(*) FILTER (WHERE error <> '') > 0 THEN 'partial' ELSE 'ok' END AS status FROM outcome_view GROUP BY 1"""))
def a15(spark, sf):
    return A.run_counters(view(spark, sf, "outcome_view").withColumn("run_id", F.col("run_day").cast("string")))


@query("a16_success_rates", sql("""
SELECT provider, target, count(*) AS runs, count(*) FILTER (WHERE state <> 'healthy') AS failures,
  round(1 - count(*) FILTER (WHERE state <> 'healthy') / count(*), 3) AS success_rate FROM outcome_view WHERE state <> 'skipped' GROUP BY 1, 2"""))
def a16(spark, sf):
    return A.success_rates(view(spark, sf, "outcome_view"))


@query("a17_unread_count", sql("SELECT count(*) AS unread FROM events WHERE event_type <> 'view'"))
def a17(spark, sf):
    return f20(spark, sf).agg(F.count(F.lit(1)).alias("unread"))


@query("a18_tab_counts", sql("""
SELECT count(*) AS all, count(*) FILTER (WHERE tier = 'dream') AS dream, count(*) FILTER (WHERE worth_applying > 0) AS hiring,
  count(adapter) AS automated, count(*) - count(adapter) AS manual, count(DISTINCT nullif(industry, '')) AS industries FROM o_fig""".replace(" AS all", ' AS "all"')))
def a18(spark, sf):
    return C.tab_counts(figured(spark, sf))


_PROBE = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 200 END AS http_status,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'board not found' WHEN event_type = 'error' THEN 'timed out' ELSE '' END AS error,
 CASE WHEN event_type = 'view' THEN 3 ELSE 0 END AS postings, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS stale_dropped FROM events"""
VIEWS["probe_view"] = _PROBE


@query("a19_probe_summary", sql("""
SELECT status, count(*) AS n, status IN ('live', 'empty') AS usable FROM (SELECT CASE WHEN http_status IN (401, 403, 429) THEN 'blocked'
  WHEN http_status IN (404, 410) OR contains(error, 'not found') THEN 'not-found' WHEN error <> '' OR http_status >= 400 THEN 'error'
  WHEN postings > 0 OR stale_dropped > 0 THEN 'live' ELSE 'empty' END AS status FROM probe_view) GROUP BY 1"""))
def a19(spark, sf):
    return A.probe_summary(view(spark, sf, "probe_view"))


@query("a20_total", sql("SELECT count(*) AS total FROM o_vis WHERE score >= 60"))
def a20(spark, sf):
    return L.total(L.find(jobs(spark, sf), comps(spark, sf), L.JobQuery(min_score=60), as_of()))


# -- joins ------------------------------------------------------------------
@query("j01_tier_lookup", sql(
    "SELECT j.id, coalesce(c.tier, 'normal') AS company_tier FROM job_view j LEFT JOIN company_view c ON c.id = j.company_id"))
def j01(spark, sf):
    return L.with_tier(jobs(spark, sf), comps(spark, sf)).select("id", "company_tier")


def aliased(spark, sf):
    return comps(spark, sf).withColumn("aliases", F.when(F.col("num") % 2 == 0, F.array(
        F.concat(F.lit("Alias "), "name"), F.concat("name", F.lit(" Holding")))))


O["o_names"] = f"""
SELECT match_key, arg_min(id, (kind, id)) AS company_id FROM (
  SELECT id, 0 AS kind, {sql_match_key('name')} AS match_key FROM company_view
  UNION ALL SELECT id, 1, {sql_match_key("('Alias ' || name)")} FROM company_view WHERE num % 2 = 0
  UNION ALL SELECT id, 1, {sql_match_key("(name || ' Holding')")} FROM company_view WHERE num % 2 = 0)
WHERE match_key <> '' GROUP BY match_key"""


@query("j02_name_resolution", sql(
    f"SELECT p.seq, n.company_id FROM posting_view p LEFT JOIN o_names n ON n.match_key = {sql_match_key('p.company')}"))
def j02(spark, sf):
    return C.resolve_names(view(spark, sf, "posting_view"), aliased(spark, sf)).select("seq", "company_id")


@query("j03_new_employers", sql(f"""
SELECT {sql_slug(sql_plain('company'))} AS id, company AS name FROM (SELECT company, match_key, row_number() OVER (PARTITION BY match_key ORDER BY seq) AS rn
  FROM (SELECT seq, company || CASE WHEN seq % 4 = 3 THEN ' Spinoff' ELSE '' END AS company,
    {sql_match_key("(company || CASE WHEN seq % 4 = 3 THEN ' Spinoff' ELSE '' END)")} AS match_key FROM posting_view)) WHERE rn = 1
  AND match_key NOT IN (SELECT match_key FROM o_names)"""))
def j03(spark, sf):
    p = view(spark, sf, "posting_view").withColumn("company", F.concat(
        "company", F.when(F.col("seq") % 4 == 3, " Spinoff").otherwise(F.lit(""))))
    return C.discover(p, aliased(spark, sf)).select("id", "name")


@query("j04_source_status", sql("""
SELECT c.id, CASE WHEN c.adapter IS NULL OR o.state IS NULL OR o.state = 'skipped' THEN c.source_status
  WHEN o.state = 'healthy' AND o.postings > 0 THEN 'live' WHEN o.state = 'healthy' THEN 'idle'
  WHEN o.state = 'rate_limited' THEN 'rate_limited' ELSE 'broken' END AS source_status
FROM company_view c LEFT JOIN (SELECT provider, target, arg_max(state, seq) AS state, arg_max(postings, seq) AS postings
  FROM outcome_view GROUP BY 1, 2) o ON o.provider = c.adapter AND o.target = c.adapter_arg"""))
def j04(spark, sf):
    return health.source_status(comps(spark, sf), view(spark, sf, "outcome_view")).select("id", "source_status")


@query("j05_parent_name", sql("""
SELECT c.id, coalesce(p.name, '') AS parent_name FROM company_view c
LEFT JOIN company_view p ON p.id = c.parent_id AND p.parent_id IS NULL"""))
def j05(spark, sf):
    return C.with_parent_name(comps(spark, sf)).select("id", "parent_name")


_tt = E.transfer_table(P)


@query("j07_transfer_join", sql(f"""
SELECT seq, x AS requirement, {sql_lookup('x', {k: v[0] for k, v in _tt.items()}, 'NULL')} AS via
FROM (SELECT seq, unnest(covered) AS x FROM o_skills)"""))
def j07(spark, sf):
    return E.skills(view(spark, sf, "posting_view")).select("seq", F.explode("transfers").alias("t")).select(
        "seq", "t.requirement", "t.via")


def paragraphs(spark, sf):
    tags = F.expr("""CASE item_id % 5 WHEN 0 THEN array('pytorch', 'vision') WHEN 1 THEN array('docker', 'mlops')
        WHEN 2 THEN array('rag', 'llm') WHEN 3 THEN array('robotics', 'automotive') ELSE array('sql', 'python') END""")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("pid"), tags.alias("tags"), "text",
        F.col("item_id").cast("int").alias("ord"))


O["o_chosen"] = """
SELECT seq, pid, text, rn FROM (SELECT seq, pid, text, row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN ex > 0 THEN ex ELSE lo END DESC, ord)::INT AS rn FROM (
SELECT s.seq, p.pid, p.ord, p.text, len(list_intersect(p.tags, s.w))::DOUBLE AS ex,
  0.5 * list_sum(list_transform(p.tags, lambda t: len(list_filter(s.w, lambda w: contains(w, t) OR contains(t, w))))) AS lo
FROM (SELECT seq, list_distinct(list_concat(list_concat(skills, domains), CASE WHEN role_category <> '' THEN [lower(role_category)] ELSE [] END)) AS w FROM o_skills) s,
 (SELECT 'p' || item_id::VARCHAR AS pid, item_id AS ord, text, CASE item_id % 5 WHEN 0 THEN ['pytorch', 'vision'] WHEN 1 THEN ['docker', 'mlops']
   WHEN 2 THEN ['rag', 'llm'] WHEN 3 THEN ['robotics', 'automotive'] ELSE ['sql', 'python'] END AS tags FROM benchmark) p)) WHERE rn <= 3
"""


@query("j08_letter_paragraphs", sql("SELECT seq, pid, rn AS position FROM o_chosen"))
def j08(spark, sf):
    picked = drafts.pick(E.skills(view(spark, sf, "posting_view")), paragraphs(spark, sf), key="seq")
    return picked.select("seq", F.posexplode("chosen").alias("p", "pid")).select("seq", "pid", (F.col("p") + 1).alias("position"))


@query("j10_phrase_rules", sql(" UNION ALL ".join(
    f"SELECT seq, {q(r['code'])} AS code FROM posting_view WHERE "
    + " OR ".join(f"contains(lower(title || chr(10) || description), {q(p)})" for p in r["phrases"]) for r in P.flags)))
def j10(spark, sf):
    return E.flags(view(spark, sf, "posting_view")).select("seq", F.explode("flags.code").alias("code"))


@query("j12_missing_parents", sql(
    "SELECT id, parent_id FROM company_view WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM company_view)"))
def j12(spark, sf):
    return C.missing_parents(comps(spark, sf))


@query("s17_registry_reconcile", sql("""
SELECT coalesce(c.id, o.id) AS id, CASE WHEN c.id IS NOT NULL THEN c.tier ELSE o.tier END AS tier,
  CASE WHEN c.id IS NULL THEN o.source_status WHEN c.adapter IS NULL THEN 'manual'
    WHEN coalesce(o.source_status, 'manual') = 'manual' THEN 'idle' ELSE o.source_status END AS source_status,
  CASE WHEN c.id IS NOT NULL THEN c.alias ELSE '' END AS aliases, CASE WHEN c.id IS NOT NULL THEN c.parent_id ELSE o.parent_id END AS parent_id,
  CASE WHEN c.id IS NOT NULL THEN c.careers_url ELSE o.careers_url END AS careers_url, CASE WHEN c.id IS NOT NULL THEN c.enabled ELSE o.enabled END AS enabled
FROM (SELECT replace(lower(name), '#', '-') AS id, 'high' AS tier, CASE WHEN num % 5 = 0 THEN NULL ELSE 'lever' END AS adapter, name || ' Labs' AS alias,
  CASE WHEN num % 6 = 0 THEN replace(lower(name), '#', '-') || '-holding' END AS parent_id, careers_url, num % 9 <> 0 AS enabled FROM company_view WHERE num % 3 <> 1) c
FULL JOIN (SELECT replace(lower(name), '#', '-') AS id, tier, source_status, parent_id, careers_url, enabled FROM company_view WHERE num % 4 <> 1) o ON o.id = c.id"""))
def s17(spark, sf):
    c = comps(spark, sf)
    cfg = c.filter("num % 3 <> 1").drop("parent_id").withColumns({
        "tier": F.lit("HIGH"), "adapter": F.when(F.col("num") % 5 != 0, "lever"), "aliases": F.array(F.concat("name", F.lit(" Labs"))),
        "parent": F.when(F.col("num") % 6 == 0, F.concat("name", F.lit(" Holding"))), "enabled": F.col("num") % 9 != 0})
    obs = c.filter("num % 4 <> 1").withColumns({"id": E.T.slugify(F.col("name")), "notes": F.lit("")})
    return C.reconcile(cfg, obs).select("id", "tier", "source_status", F.coalesce(F.array_join("aliases", "|"), F.lit("")).alias("aliases"),
                                        "parent_id", "careers_url", "enabled")


# -- rankings ---------------------------------------------------------------
@query("w03_last_run", sql("""
SELECT arg_max(run_id, (started_at, run_id)) FILTER (WHERE status <> 'running') AS last_finished,
  arg_max(run_id, (started_at, run_id)) FILTER (WHERE status = 'running') AS in_progress
FROM (SELECT event_id AS run_id, ts AS started_at, CASE event_type WHEN 'view' THEN 'running' ELSE 'ok' END AS status FROM events)"""))
def w03(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"),
                                             F.when(F.col("event_type") == "view", "running").otherwise("ok").alias("status"))
    return A.last_run(runs)


@query("w05_status_timeline", sql("""
SELECT event_id, job_id, lag(to_status) OVER w AS from_status, to_status,
  epoch_us("at") - epoch_us(lag("at") OVER w) AS micros_in_stage FROM status_view WINDOW w AS (PARTITION BY job_id ORDER BY "at", event_id)"""))
def w05(spark, sf):
    return A.status_timeline(_ltz(view(spark, sf, "status_view"))).drop("at")


def _ltz(df):
    """Event times as UTC instants, whatever timestamp type the file carries."""
    return df.withColumn("at", F.col("at").cast("timestamp"))


@query("w06_request_rate", sql("""
SELECT event_id, count(*) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS requests
FROM (SELECT event_id, user_id % 10 AS host, epoch_us(ts) AS us FROM events)"""))
def w06(spark, sf):
    req = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).alias("host"), F.col("ts").alias("at"))
    return health.request_rates(_ltz(req), 3600).select("event_id", "requests")


@query("w07_failure_streaks", sql("""
SELECT seq, failures - coalesce(max(CASE WHEN state = 'healthy' THEN failures END) OVER w, 0) AS consecutive_failures FROM (
  SELECT *, sum(CASE WHEN state <> 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY provider, target ORDER BY "at", seq)::BIGINT AS failures
  FROM outcome_view WHERE state <> 'skipped') WINDOW w AS (PARTITION BY provider, target ORDER BY "at", seq)"""))
def w07(spark, sf):
    return health.failure_streaks(_ltz(view(spark, sf, "outcome_view"))).select("seq", "consecutive_failures")


@query("i06_health_fold", sql(f"""
SELECT provider, target, CASE WHEN state = 'healthy' THEN 'healthy' WHEN state = 'rate_limited' THEN 'rate_limited'
  WHEN streak >= {P.failures_before_backoff} THEN 'failed' ELSE 'degraded' END AS state, streak AS consecutive_failures, total_runs, total_failures FROM (
SELECT provider, target, arg_max(state, ("at", seq)) AS state, arg_max(streak, ("at", seq)) AS streak, count(*) AS total_runs,
  count(*) FILTER (WHERE state <> 'healthy') AS total_failures FROM (
  SELECT *, failures - coalesce(max(CASE WHEN state = 'healthy' THEN failures END) OVER w, 0) AS streak FROM (
    SELECT *, sum(CASE WHEN state <> 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY provider, target ORDER BY "at", seq)::BIGINT AS failures
    FROM outcome_view WHERE state <> 'skipped') WINDOW w AS (PARTITION BY provider, target ORDER BY "at", seq)) GROUP BY 1, 2)"""))
def i06(spark, sf):
    return health.fold(_ltz(view(spark, sf, "outcome_view"))).select(
        "provider", "target", "state", "consecutive_failures", "total_runs", "total_failures")


_SEARCHES = {
    "clean ml": {"category": "Machine Learning", "only_clean": True}, "munich": {"city": "munich", "min_score": 30},
    "dream": {"tier": "dream", "min_score": 60}, "english": {"language": "english_only"},
    "paid": {"salary_min": 60000}, "fresh": {"max_age_days": 3, "include_hidden": True},
}


@query("i12_saved_searches", sql(f"""
SELECT search, id, rank, matches FROM (SELECT search, id, row_number() OVER (PARTITION BY search ORDER BY {_SQL_ORDER['newest']})::INT AS rank,
  count(*) OVER (PARTITION BY search) AS matches FROM (
  SELECT 'clean ml' AS search, * FROM o_vis WHERE role_category = 'Machine Learning' AND NOT has_flags
  UNION ALL SELECT 'munich', * FROM o_vis WHERE score >= 30 AND (contains(lower(city), 'munich') OR contains(lower(location_raw), 'munich'))
  UNION ALL SELECT 'dream', * FROM o_vis WHERE score >= 60 AND company_id IN (SELECT id FROM company_view WHERE tier = 'dream')
  UNION ALL SELECT 'english', * FROM o_vis WHERE language_requirement = 'english_only'
  UNION ALL SELECT 'paid', * FROM o_vis WHERE salary_annual_eur_min >= 60000
  UNION ALL SELECT 'fresh', * FROM job_view WHERE is_open AND posted_at >= {AS_OF_SQL} - 3)) WHERE rank <= 20"""))
def i12(spark, sf):
    return L.saved_searches(jobs(spark, sf), comps(spark, sf), _SEARCHES, as_of(), 20)


VIEWS["search_view"] = """
SELECT 'search-' || CAST(c_custkey AS VARCHAR(20)) AS search,
  CASE c_custkey % 11 WHEN 0 THEN ' Engineer' WHEN 1 THEN 'perception' WHEN 2 THEN 'ai' WHEN 3 THEN 'supplier#00000000' || CAST(c_custkey % 10 AS VARCHAR(2)) ELSE NULL END AS q,
  CASE WHEN c_custkey % 13 = 4 THEN 'Data' ELSE NULL END AS domain, CASE WHEN c_custkey % 17 = 3 THEN 'GmbH' ELSE NULL END AS company,
  CASE c_custkey % 19 WHEN 1 THEN 'MÜN' WHEN 2 THEN 'berlin' ELSE NULL END AS city, CASE c_custkey % 23 WHEN 1 THEN 'de' WHEN 2 THEN 'xx' ELSE NULL END AS country,
  CASE c_custkey % 7 WHEN 0 THEN 'dream' WHEN 1 THEN 'HIGH' ELSE NULL END AS tier, CASE WHEN c_custkey % 29 = 0 THEN 'applied' ELSE NULL END AS status,
  CASE c_custkey % 6 WHEN 0 THEN 'unclear' WHEN 1 THEN 'english_only' ELSE NULL END AS language, CASE WHEN c_custkey % 9 = 4 THEN 'adzuna' ELSE NULL END AS source,
  CASE WHEN c_custkey % 10 = 4 THEN 'senior' ELSE NULL END AS seniority, CASE WHEN c_custkey % 14 = 6 THEN 'remote' ELSE NULL END AS remote,
  CASE WHEN c_custkey % 15 = 8 THEN 'Machine Learning' ELSE NULL END AS category, CASE WHEN c_custkey % 4 = 2 THEN CAST(c_custkey % 120 AS INT) ELSE NULL END AS min_score,
  CASE WHEN c_custkey % 5 = 3 THEN CAST(c_custkey % 50 AS INT) ELSE NULL END AS max_age_days, CASE WHEN c_custkey % 8 = 5 THEN CAST(30000 + c_custkey % 9 * 10000 AS INT) ELSE NULL END AS salary_min,
  c_custkey % 31 = 1 AS only_new, c_custkey % 37 = 1 AS only_starred, c_custkey % 3 = 0 AS only_clean, c_custkey % 41 < 3 AS include_hidden, c_custkey % 43 < 5 AS include_closed
FROM customer
"""


@query("i12_reverse_search", sql(f"""
SELECT search, id, rank, matches FROM (SELECT s.search, j.id, row_number() OVER (PARTITION BY s.search ORDER BY {_SQL_ORDER['newest']})::INT AS rank,
  count(*) OVER (PARTITION BY s.search) AS matches
  FROM search_view s JOIN job_view j ON (s.include_closed OR j.is_open) AND (s.include_hidden OR NOT j.hidden) AND (NOT s.only_new OR j.is_new)
    AND (NOT s.only_starred OR j.starred) AND (NOT s.only_clean OR NOT j.has_flags) AND (s.status IS NULL OR s.status = j.status)
    AND (s.language IS NULL OR s.language = j.language_requirement) AND (s.source IS NULL OR s.source = j.source)
    AND (s.seniority IS NULL OR s.seniority = j.seniority) AND (s.remote IS NULL OR s.remote = j.remote_policy)
    AND (s.category IS NULL OR s.category = j.role_category) AND (s.q IS NULL OR contains(j.search_blob, trim(lower(s.q))))
    AND (s.domain IS NULL OR contains(lower(j.search_blob), lower(s.domain))) AND (s.company IS NULL OR contains(lower(j.company_name), lower(s.company)))
    AND (s.city IS NULL OR contains(lower(j.city), lower(s.city)) OR contains(lower(j.location_raw), lower(s.city)))
    AND (s.min_score IS NULL OR j.score >= s.min_score) AND (s.salary_min IS NULL OR j.salary_annual_eur_min >= s.salary_min)
    AND (s.max_age_days IS NULL OR j.posted_at >= {AS_OF_SQL} - s.max_age_days)
    AND (s.country IS DISTINCT FROM 'de' OR j.country = 'DE' OR {' OR '.join(f"contains(j.search_blob, {q(t)})" for t in P.country_terms['de'])})
  LEFT JOIN (SELECT id AS cid, tier AS ctier FROM company_view) v ON v.cid = j.company_id
  WHERE s.tier IS NULL OR v.ctier = lower(s.tier)) WHERE rank <= 20"""))
def i12_reverse(spark, sf):
    """As many stored searches as there are customers, looked up through their narrowest keys."""
    return searches.results(jobs(spark, sf), comps(spark, sf), view(spark, sf, "search_view"), as_of(), 20)


# whole postings: short fields and the text behind them
_WHOLE = "lower(company_name || chr(10) || title || chr(10) || location_raw || chr(10) || description)"
VIEWS["term_view"] = """
SELECT DISTINCT lower(substr(p_name, 1, CAST(2 + p_partkey % 6 AS INT))) AS term FROM part
UNION SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN lower(substr(text, 1 + CAST(floor(length(text) / 2) AS INT), 5)) ELSE 'kubernetes' END FROM documents
"""


@query("f06_text_index", sql(f"SELECT t.term, j.id FROM term_view t JOIN job_view j ON contains({_WHOLE}, t.term) WHERE t.term <> ''"))
def f06_index(spark, sf):
    """Many terms, wherever they stand in whole postings."""
    index = text_index.TextIndex(f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}")
    text = text_index.searchable("company_name", "title", "location_raw", "description")
    index.add(jobs(spark, sf), text, 0)
    return index.find(jobs(spark, sf), text, view(spark, sf, "term_view"))


@query("f09_indexed_document", sql(f"""
SELECT id FROM o_vis WHERE contains({_WHOLE}, 'machine learning') AND contains({_WHOLE}, 'munich') AND score >= 10"""))
def f09_indexed(spark, sf):
    index = text_index.TextIndex(f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}")
    j = jobs(spark, sf).withColumn("search_blob", text_index.searchable("company_name", "title", "location_raw", "description"))
    index.add(j, F.col("search_blob"), 0)
    doc = L.JobQuery.from_dict({"q": "machine learning", "domain": "Munich", "min_score": 10})
    return L.find(j, comps(spark, sf), doc, as_of(), index=index).select("id")
