"""Merging a run into the jobs snapshot without touching what people wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scale import first_per, micros, ranges, running
from ..profile import DEFAULT, Profile
from ..sources.providers import PLACE_BITS
from ..schemas import BOOKKEEPING, HUMAN_COLUMNS, HUMAN_DEFAULTS


def job_rows(scored: DataFrame, key: str = "group_key") -> DataFrame:
    """Run-owned columns of the jobs table from scored vacancies, whole."""
    c = F.col

    def text(name: str) -> Column:
        return F.coalesce(c(name), F.lit("")).alias(name)

    return scored.select(
        c(key).alias("id"), text("company").alias("company_name"),
        (c("company_id") if "company_id" in scored.columns else F.lit(None).cast("string")).alias("company_id"),
        text("title"),
        T.normalize_title(c("title")).alias("title_normalized"), "url",
        text("location").alias("location_raw"), text("city"), "country",
        "remote_policy", "employment_type", text("description"),
        T.summarise(c("description")).alias("summary"),
        c("posted").alias("posted_at"), c("provider").alias("source"),
        *([F.coalesce("target", F.lit("")).alias("target")] if "target" in scored.columns else []),
        *([F.shiftright("seq", PLACE_BITS).alias("seen_seq")] if "seq" in scored.columns else []), "seniority",
        "experience_min_years", "experience_max_years", "language_requirement", "language_evidence",
        "salary_basis", "salary_min", "salary_max", "salary_currency", "salary_period",
        "salary_annual_eur_min", "salary_annual_eur_max", "salary_evidence",
        "skills", "domains",
        "role_category", "score", *[f"score_{n}" for n in (
            "technical", "experience", "language", "location", "education", "freshness", "domain")],
        "match_reasons", "match_gaps", "flags", (F.size("flags") > 0).alias("has_flags"),
        T.search_blob(c("company"), c("title"), c("location"), c("city"), c("country"),
                      c("role_category"), c("skills"), c("domains")).alias("search_blob"))


def upsert(snapshot: DataFrame, run: DataFrame, now: Column,
           healthy_sources: DataFrame | None = None) -> DataFrame:
    """New snapshot: one full outer join on ``id``; each column has one owner.

    Run columns come from the run where it saw the job, human columns always
    from the snapshot, bookkeeping from both.  Unseen open jobs are closed;
    with ``healthy_sources(source[, target])`` only those whose source (and
    target) answered, so a failed source closes nothing.  Ids are unique on
    both sides, so the join has no hot key.
    """
    run_columns = [c for c in run.columns if c != "id"]
    human = [c for c in HUMAN_COLUMNS if c in snapshot.columns]
    new = run.select("id", *[F.col(c).alias(f"_n_{c}") for c in run_columns], F.lit(True).alias("_seen"))
    old = snapshot.withColumn("_known", F.lit(True))
    df = old.join(new, "id", "full_outer")
    if healthy_sources is not None:
        on = [c for c in ("source", "target") if c in healthy_sources.columns]
        df = df.join(healthy_sources.select(*on, F.lit(True).alias("_up")).distinct(), on, "left")
        may_close = F.coalesce("_up", F.lit(False))
    else:
        may_close = F.lit(True)
    seen, known = F.coalesce("_seen", F.lit(False)), F.coalesce("_known", F.lit(False))
    closing = ~seen & F.col("is_open") & may_close
    owned = [F.when(seen, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in snapshot.columns
             else F.col(f"_n_{c}").alias(c) for c in run_columns]
    kept = [F.coalesce(F.col(c), F.lit(HUMAN_DEFAULTS[c])).alias(c) if c in HUMAN_DEFAULTS else F.col(c)
            for c in human]
    return df.select(
        "id", *owned, *kept,
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (F.coalesce("times_seen", F.lit(0)) + F.when(seen, 1).otherwise(0)).alias("times_seen"),
        F.when(seen, True).when(closing, False).otherwise(F.col("is_open")).alias("is_open"),
        (seen & ~known).alias("is_new"),
        F.when(closing, now).when(seen, F.lit(None)).otherwise(F.col("removed_at")).alias("removed_at"))


def close_missing(snapshot: DataFrame, complete: DataFrame, now: Column) -> DataFrame:
    """Close open jobs that a complete fetch of their source did not hold.

    ``complete(source, target, first_seq)`` has one row per source that was read to its end, with
    the number of the fetch's first payload; a job last seen in an earlier payload is gone.  Sources
    without a row close nothing, however many of their payloads have arrived.
    """
    ends = complete.groupBy("source", "target").agg(F.max("first_seq").alias("_first"))
    df = snapshot.join(ends, ["source", "target"], "left")
    gone = F.coalesce(F.col("is_open") & (F.col("seen_seq") < F.col("_first")), F.lit(False))
    return df.withColumns({"is_open": F.col("is_open") & ~gone,
                           "removed_at": F.when(gone, now).otherwise(F.col("removed_at"))}).select(snapshot.columns)


def empty_snapshot(run: DataFrame) -> DataFrame:
    """A snapshot with no rows and every column a first run needs."""
    cols = {n: F.lit(None).cast(t) for n, t in {**HUMAN_COLUMNS, **BOOKKEEPING}.items()}
    return run.filter(F.lit(False)).withColumns(cols)


def sources_upsert(old: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Provenance rows by (job, provider, external id): first sight kept, the rest refreshed."""
    key = ["job_id", "provider", "external_id"]
    new = seen.select(*key, F.col("url").alias("_url"), F.col("posted_at").alias("_posted"),
                      F.col("is_primary").alias("_primary"), F.lit(True).alias("_seen"))
    df = old.join(new, key, "full_outer")
    here = F.col("_seen").isNotNull()
    return df.select(
        *key, F.when(here, F.col("_url")).otherwise(F.col("url")).alias("url"),
        F.when(here, F.col("_posted")).otherwise(F.col("posted_at")).alias("posted_at"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(here, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(here, F.col("_primary")).otherwise(F.col("is_primary")).alias("is_primary"))


def run_fact(before: DataFrame, after: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """One row of counters for a run."""
    from .analytics import run_counters
    changes = diff(before, after).groupBy().agg(
        F.count_if(F.col("change") == "new").alias("jobs_new"),
        F.count_if(F.col("change").isin("updated", "same", "reopened")).alias("jobs_updated"),
        F.count_if(F.col("change") == "closed").alias("jobs_closed"))
    return run_counters(outcomes).crossJoin(changes).withColumn("finished_at", now)  # two one-row tables


def archive(snapshot: DataFrame, now: Column, profile: Profile = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): long closed jobs nobody touched leave the snapshot."""
    cutoff = now - F.expr(f"INTERVAL {int(profile.archive_after_days)} DAYS")
    gone = F.coalesce(~F.col("is_open") & (F.col("removed_at") < cutoff) & (F.col("status") == "new")
                      & ~F.col("starred") & (F.coalesce("notes", F.lit("")) == ""), F.lit(False))
    return snapshot.filter(~gone), snapshot.filter(gone)


def status_events(snapshot: DataFrame, edits: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """Every change of status in a feed: job_id, from_status, to_status, at.

    The status before an edit is the latest earlier one of the feed, else the snapshot's.  It is a
    running value over ranges of rows, so a job with a large share of the feed is no single task.
    """
    feed = edits.filter((F.col("field") == "status") & F.col("value").isNotNull()).select("id", "at", "value").distinct()
    feed = feed.join(snapshot.select("id", F.col("status").alias("_status")), "id")
    step = running(feed, ["id"], ranges(feed, micros(feed, "at"), rows_per_range), [F.col("at"), F.col("value")],
                   latest={"_before": F.struct("at", "value")}, before=True)
    return step.select(F.col("id").alias("job_id"), F.coalesce("_before.value", "_status").alias("from_status"),
                       F.col("value").alias("to_status"), "at").filter("from_status <> to_status")


def apply_edits(snapshot: DataFrame, edits: DataFrame, profile: Profile = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Apply a feed of edits ``(id, field, value, at)``; returns (snapshot, status events).

    The latest edit per job and field wins; a null value clears the field (to its default), a value
    that is none of the field's type changes nothing.  The first move to 'applied' sets the date it
    happened and a follow-up, unless they are set.
    """
    events = status_events(snapshot, edits)
    own = {f: F.col("field") == f for f in HUMAN_COLUMNS}
    latest = edits.groupBy("id").agg(*[
        F.max_by(F.when(own[f], F.struct("value")), F.when(own[f], F.struct("at", "value"))).alias(f"_e_{f}") for f in HUMAN_COLUMNS])
    moved = events.filter("to_status = 'applied'").groupBy(F.col("job_id").alias("id")).agg(F.to_date(F.min("at")).alias("_applied"))
    df = snapshot.join(latest, "id", "left").join(moved, "id", "left")
    value = {}
    for f, t in HUMAN_COLUMNS.items():
        if f in snapshot.columns:
            given, default = F.col(f"_e_{f}.value"), F.lit(HUMAN_DEFAULTS.get(f)).cast(t)
            value[f] = (F.when(F.col(f"_e_{f}").isNull(), F.col(f)).when(given.isNull(), default)
                        .otherwise(F.coalesce(given.try_cast(t), F.col(f))))
    first = F.col("_applied").isNotNull() & value["applied_at"].isNull() & F.col("_e_applied_at").isNull()
    days = profile.follow_up_after_days
    follow = F.when(first & F.col("_e_follow_up_at").isNull() & F.lit(days > 0), F.date_add("_applied", days))
    value["applied_at"] = F.when(first, F.col("_applied")).otherwise(value["applied_at"])
    value["follow_up_at"] = F.coalesce(value["follow_up_at"], follow)
    return df.select(*[value[c].alias(c) if c in value else F.col(c) for c in snapshot.columns]), events


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a run changed, per job: new, closed, reopened, updated or same, and the score change."""
    a = before.select("id", F.col("is_open").alias("_o"), F.col("score").alias("_s"))
    b = after.select("id", F.col("is_open").alias("_no"), F.col("score").alias("_ns"))
    df = a.join(b, "id", "full_outer")
    change = (F.when(F.col("_o").isNull(), "new").when(F.col("_no").isNull(), "archived")
              .when(F.col("_o") & ~F.col("_no"), "closed").when(~F.col("_o") & F.col("_no"), "reopened")
              .when(F.col("_s") != F.col("_ns"), "updated").otherwise("same"))
    return df.select("id", change.alias("change"), (F.col("_ns") - F.col("_s")).alias("score_change"))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Write a whole snapshot, rows in board order inside each file.

    Date and score filters then skip row groups by their minimum and maximum.
    """
    (snapshot.sortWithinPartitions(F.desc_nulls_last("posted_at"), F.desc("score"))
     .write.mode("overwrite").parquet(path))


def latest_sources(member: DataFrame, primary: DataFrame) -> DataFrame:
    """Provenance rows of this run from group members and each group's primary arrival number."""
    one = first_per(member.select(F.col("group_key").alias("job_id"), "provider", "external_id", "url",
                                  F.col("posted").alias("posted_at"), "seq"),
                    ["job_id", "provider", "external_id"], [F.col("seq")])
    p = primary.select(F.col("group_key").alias("job_id"), F.col("seq").alias("_p"))
    return one.join(p, "job_id", "left").withColumn("is_primary", F.col("seq") == F.col("_p")).drop("_p", "seq")
