"""Counters, distributions and time series over the jobs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import labels
from ..plans.scale import ranges, running
from ..profile import DEFAULT, Profile


def visible(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("is_open") & ~F.col("hidden"))


def headline(jobs: DataFrame, companies: DataFrame, as_of: Column,
             profile: Profile = DEFAULT) -> DataFrame:
    """All headline counters in one pass; the base filter is one definition for every number."""
    top = profile.location_tiers[max(profile.location_tiers)] if profile.location_tiers else []
    dream = companies.filter(F.col("tier") == "dream").select(
        F.col("id").alias("company_id"), F.lit(True).alias("_dream"))
    df = jobs.join(dream, ["company_id"], "left")
    base = F.col("is_open") & ~F.col("hidden")
    worth = base & (F.col("score") >= profile.recommend_min_score)
    in_city = F.lit(False)
    for place in top:
        in_city = in_city | F.contains(F.lower("city"), F.lit(place))

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    return df.agg(
        n(base).alias("total_open"),
        n(base & (F.to_date("first_seen_at") == as_of)).alias("found_today"),
        n(base & F.col("is_new")).alias("new_since_last_run"),
        n(base & (F.col("score") >= profile.high_match_score)).alias("high_match"),
        n(worth).alias("worth_applying"), n(worth & F.col("is_new")).alias("worth_applying_new"),
        F.round(F.coalesce(F.avg(F.when(base, F.col("score"))), F.lit(0.0)), 1).alias("average_score"),
        n(base & F.col("is_new") & in_city).alias("new_in_priority_city"),
        n(worth & F.col("_dream").isNotNull()).alias("dream_company_open"),
        n(F.col("status").isin(V.PENDING_STATUSES)).alias("applications_pending"),
        n((F.col("status") != "new") & F.col("applied_at").isNotNull()).alias("applications_submitted"))


def hiring_companies(jobs: DataFrame) -> DataFrame:
    return visible(jobs).agg(F.count_distinct("company_name").alias("companies_with_roles"))


def top_counts(jobs: DataFrame, column: str, limit: int = 12, labeller=None) -> DataFrame:
    """Most frequent non-empty values; ties by key."""
    key = F.col(column)
    out = (visible(jobs).filter(key.isNotNull() & (key != "")).groupBy(key.alias("key"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("key")).limit(limit))
    return out.select("key", (labeller(F.col("key")) if labeller else F.col("key")).alias("label"), "n")


def _spine(spark, as_of: Column, days: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(as_of, days), as_of)).alias("day"))


def per_day(jobs: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows per day of a date or timestamp column over a window, zero-filled."""
    counts = jobs.filter(F.col(column) >= F.date_sub(as_of, days)).groupBy(
        F.to_date(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _spine(jobs.sparkSession, as_of, days).join(counts, "day", "left").select(
        "day", F.datediff(as_of, "day").alias("age_days"), F.coalesce("n", F.lit(0)).alias("n"))


def posted_per_day(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    return per_day(visible(jobs), "posted_at", as_of, days)


def banded(df: DataFrame, band: Column, names: list[str]) -> DataFrame:
    """Rows per band in fixed order, zeros included."""
    counts = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    rows = ", ".join(f"({i}, '{b}')" for i, b in enumerate(names))
    order = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(position, band)")
    return order.join(counts, "band", "left").select("position", "band", F.coalesce("n", F.lit(0)).alias("n"))


def score_distribution(jobs: DataFrame) -> DataFrame:
    return banded(visible(jobs), labels.chart_band(F.col("score")), [b for _, b in V.CHART_BANDS])


def freshness_distribution(jobs: DataFrame, as_of: Column) -> DataFrame:
    return banded(visible(jobs), labels.fresh_band(F.col("posted_at"), as_of),
                  [b for _, b in V.FRESH_BANDS])


def _priced() -> Column:
    return (F.col("salary_basis") == "explicit") & F.col("salary_annual_eur_min").isNotNull()


def salary_distribution(jobs: DataFrame) -> DataFrame:
    return banded(visible(jobs).filter(_priced()), labels.salary_band(F.col("salary_annual_eur_min")),
                  [b for _, b in V.SALARY_BANDS])


def salary_coverage(jobs: DataFrame) -> DataFrame:
    return visible(jobs).agg(
        F.count_if(_priced()).alias("with_salary"),
        F.coalesce(F.round(F.count_if(_priced()) / F.nullif(F.count(F.lit(1)), F.lit(0)), 3),
                   F.lit(0.0)).alias("coverage"))


def funnel(jobs: DataFrame) -> DataFrame:
    return banded(jobs, F.col("status"), [s for s, _ in V.FUNNEL]).withColumnRenamed("band", "status")


# -- employers --------------------------------------------------------------
def coverage_totals(companies: DataFrame) -> DataFrame:
    auto = F.col("adapter").isNotNull()
    return companies.filter("enabled").agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if(auto).alias("automated"),
        F.count_if(~auto).alias("manual"),
        F.count_if(F.coalesce("discovered_from", F.lit("")) != "").alias("discovered_by_boards"))


def coverage_by_status(companies: DataFrame) -> DataFrame:
    return companies.filter("enabled").groupBy("source_status").agg(F.count(F.lit(1)).alias("n"))


def coverage_buckets(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Companies, automation and open roles by industry, country and adapter, in one pass."""
    roles = visible(jobs).filter("company_id IS NOT NULL").groupBy(F.col("company_id").alias("id")).agg(
        F.count(F.lit(1)).alias("roles"))
    df = companies.filter("enabled").join(roles, "id", "left").select(
        "industry", "country", F.col("adapter").alias("source"), F.coalesce("roles", F.lit(0)).alias("roles"))
    df = df.withColumn("auto", F.col("source").isNotNull())
    sets = [[F.col("industry")], [F.col("country")], [F.col("source")]]
    out = df.groupingSets(sets, "industry", "country", "source").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("companies"),
        F.count_if("auto").alias("automated"), F.count_if(~F.col("auto")).alias("manual"),
        F.sum("roles").alias("open_roles"))
    kind = F.when(F.col("g") == 3, "industry").when(F.col("g") == 5, "country").otherwise("adapter")
    key = F.when(F.col("g") == 3, F.col("industry")).when(F.col("g") == 5, F.col("country")) \
        .otherwise(F.col("source"))
    return out.select(kind.alias("kind"), F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown")).alias("key"),
                      "companies", "automated", "manual", "open_roles")


def employer_figures(jobs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Jobs worth applying to and best score per employer."""
    return visible(jobs).filter("company_id IS NOT NULL").groupBy("company_id").agg(
        F.count_if(F.col("score") >= profile.recommend_min_score).alias("worth_applying"),
        F.max("score").alias("best_score"))


def employer_counts(companies: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Open roles and roles first seen in the last seven days, 0 where there are none."""
    counts = jobs.filter("is_open AND company_id IS NOT NULL").groupBy(F.col("company_id").alias("id")).agg(
        F.count(F.lit(1)).alias("open_roles"),
        F.count_if(F.col("first_seen_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("new_roles_7d"))
    return companies.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("open_roles", F.lit(0)).alias("open_roles"),
        F.coalesce("new_roles_7d", F.lit(0)).alias("new_roles_7d"))


# -- runs and sources -------------------------------------------------------
def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters of each run from its per-source outcomes."""
    return outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("providers_checked"),
        F.count_if(F.col("state") == "healthy").alias("providers_ok"),
        F.sum("postings").alias("postings_seen"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors_count")).withColumn(
        "status", F.when(F.col("errors_count") > 0, "partial").otherwise("ok"))


def success_rates(outcomes: DataFrame) -> DataFrame:
    """Share of successful runs per source, 3 decimals."""
    return outcomes.filter("state <> 'skipped'").groupBy("provider", "target").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("state") != "healthy").alias("failures")
    ).withColumn("success_rate", F.round(1 - F.col("failures") / F.col("runs"), 3))


def last_run(runs: DataFrame) -> DataFrame:
    """Newest finished run and newest run in progress, by aggregates."""
    at = F.struct("started_at", "run_id")
    return runs.agg(F.max(F.when(F.col("status") != "running", at)).alias("done"),
                    F.max(F.when(F.col("status") == "running", at)).alias("now")).select(
        F.col("done.run_id").alias("last_finished"), F.col("now.run_id").alias("in_progress"))


def probe_summary(probes: DataFrame) -> DataFrame:
    """Class of each probe of a source, counted; usable means it answered."""
    code, error = F.col("http_status"), F.lower(F.coalesce("error", F.lit("")))
    kind = (F.when(code.isin(401, 403, 429), "blocked").when(code.isin(404, 410), "not-found")
            .when(F.contains(error, F.lit("not found")) | F.contains(error, F.lit("404")), "not-found")
            .when((error != "") | (code >= 400), "error")
            .when((F.col("postings") > 0) | (F.col("stale_dropped") > 0), "live").otherwise("empty"))
    return probes.groupBy(kind.alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "usable", F.col("status").isin("live", "empty"))


def status_timeline(events: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """Previous status and hours in it at every change of a job, safe for very long histories and very busy days."""
    out = running(events, ["job_id"], ranges(events, F.unix_micros("at"), rows_per_range), [F.col("at"), F.col("event_id")],
                  latest={"_prev": F.struct("at", "event_id", "to_status")}, before=True)
    return out.select("job_id", "event_id", "at", F.col("_prev.to_status").alias("from_status"), "to_status",
                      (F.unix_micros("at") - F.unix_micros("_prev.at")).alias("micros_in_stage"))
