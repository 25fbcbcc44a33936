"""The whole run: sightings in, ranked and explained vacancies out, merged into the snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, companies, dedup, enrich, gates, health, score, signals, upsert
from ..profile import DEFAULT, Profile
from ..sources import landing
from .scale import cut_lineage


def scored_vacancies(sightings: DataFrame, registry: DataFrame, as_of: Column,
                     profile: Profile = DEFAULT) -> DataFrame:
    """Resolve, gate, enrich and score; rows below the store line are dropped.

    Gates run before enrichment: they decide most rows by title, place and
    age, so the costly text facts are only taken from the survivors, which are
    written once in between.
    """
    return scored(dedup.dedupe(sightings), registry, as_of, profile)


def scored(vacancies: DataFrame, registry: DataFrame, as_of: Column, profile: Profile = DEFAULT) -> DataFrame:
    """Vacancies that pass the gates and the store line, with their facts and scores."""
    kept = cut_lineage(gates.kept(gates.gate(vacancies, as_of, profile)))
    out = score.score(cut_lineage(enrich.enrich(kept, profile)), profile)
    return companies.resolve_names(out, registry).filter(F.col("score") >= profile.min_score)


def worth_applying(sightings: DataFrame, registry: DataFrame, as_of: Column,
                   profile: Profile = DEFAULT) -> DataFrame:
    """The answer a reader wants: what to apply to, best first, and why."""
    # written once: a global sort samples its input first and would run the plan twice
    out = cut_lineage(scored_vacancies(sightings, registry, as_of, profile))
    return (out.filter(F.col("score") >= profile.recommend_min_score)
            .select("group_key", "company", "title", "city", "country", "score", "posted",
                    F.size("providers").alias("sources"), "duplicates", "match_reasons", "match_gaps", "url")
            .orderBy(F.desc("score"), F.desc_nulls_last("posted"), "group_key"))


def run(snapshot: DataFrame, sightings: DataFrame, registry: DataFrame, as_of: Column, now: Column,
        healthy_sources: DataFrame | None = None, profile: Profile = DEFAULT) -> DataFrame:
    """One discovery run as a new snapshot.  The scored rows are written once and read back."""
    rows = cut_lineage(upsert.job_rows(scored_vacancies(sightings, registry, as_of, profile)))
    return upsert.upsert(snapshot, rows, now, healthy_sources)


@dataclass(frozen=True)
class Tables:
    """Everything that a run reads and writes; ``None`` before the first run."""

    jobs: DataFrame | None = None          # the snapshot
    sources: DataFrame | None = None       # provenance by job, source and external id
    companies: DataFrame | None = None     # the registry, employers found by boards included
    health: DataFrame | None = None        # record of every source
    runs: DataFrame | None = None          # one row per run
    signals: DataFrame | None = None       # every signal sent
    archived: DataFrame | None = None      # long closed jobs nobody touched


SOURCES = "job_id string, provider string, external_id string, url string, posted_at date, first_seen_at timestamp, last_seen_at timestamp, is_primary boolean"


def whole_run(before: Tables, sightings: DataFrame, outcomes: DataFrame, run_id: int, as_of: Column, now: Column,
              details: DataFrame | None = None, profile: Profile = DEFAULT) -> Tables:
    """One run with all its tables, each written once.

    ``outcomes(provider, target, state, postings, error, seq, at)`` has one row per fetch; jobs close only
    where one was healthy.  ``details(provider, external_id, text)`` are full texts; the longer text of a posting
    counts, before gates and scores.  ``before.companies`` is the registry as it was configured.
    """
    spark, c = sightings.sparkSession, F.col
    seen = landing.safe_links(landing.fresh(landing.once_per_fetch(sightings), as_of, profile.max_age_days, profile.keep_undated))
    if details is not None:
        size = lambda n: F.length(F.coalesce(c(n), F.lit("")))
        full = details.groupBy("provider", "external_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("_full"))
        seen = seen.join(full, ["provider", "external_id"], "left").withColumn(
            "description", F.when(size("_full") > size("description"), c("_full")).otherwise(c("description"))).drop("_full")
    seen = cut_lineage(seen)
    member = cut_lineage(dedup.members(seen, dedup.assign(seen)))
    found = cut_lineage(dedup.vacancies(member))
    registry = before.companies.unionByName(companies.discover(found, before.companies), allowMissingColumns=True)
    registry = cut_lineage(registry)
    rows = cut_lineage(upsert.job_rows(scored(found, registry, as_of, profile)))
    old = before.jobs if before.jobs is not None else upsert.empty_snapshot(rows)
    answered = outcomes.filter("state = 'healthy'").select(c("provider").alias("source"), "target")
    after = cut_lineage(upsert.upsert(old, rows, now, answered))
    stored = found.join(rows.select(c("id").alias("group_key")), "group_key", "left_semi")
    origin = upsert.latest_sources(member.join(stored.select("group_key"), "group_key", "left_semi"), stored)
    known = before.sources if before.sources is not None else spark.createDataFrame([], SOURCES)
    fact = cut_lineage(upsert.run_fact(old, after, outcomes.withColumn("run_id", F.lit(run_id)), now))
    told = signals.run_signals(after, registry, fact, now, profile).unionByName(signals.follow_ups(after, as_of))
    sent = before.signals if before.signals is not None else told.limit(0)
    told = sent.select(*signals.COLUMNS).unionByName(signals.only_unsent(told, sent))
    status = companies_after(registry, outcomes, after, now)
    kept, gone = upsert.archive(after, now, profile)
    together = lambda a, b: b if a is None else a.unionByName(b, allowMissingColumns=True)
    return Tables(
        jobs=cut_lineage(kept), sources=cut_lineage(upsert.sources_upsert(known, origin, now)), companies=cut_lineage(status),
        health=cut_lineage(health.fold_onto(before.health, outcomes, profile)), runs=cut_lineage(together(before.runs, fact)),
        signals=cut_lineage(told.select(*signals.COLUMNS)), archived=cut_lineage(together(before.archived, gone)))


def companies_after(registry: DataFrame, outcomes: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """The registry with the status of its sources and the number of open and recent roles."""
    status = health.source_status(registry, outcomes).select("id", F.col("source_status").alias("_status"))
    own = registry.join(status, "id", "left").withColumn("source_status", F.coalesce("_status", "source_status")).drop("_status")
    return own.drop("open_roles", "new_roles_7d").join(analytics.employer_counts(own.select("id"), jobs, now), "id")
