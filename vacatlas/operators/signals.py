"""What a run changed, as rows worth telling; each signal is emitted once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profile import DEFAULT, Profile

COLUMNS = ["kind", "title", "body", "severity", "dedupe_key", "job_id", "company_id"]


def _row(df: DataFrame, kind: str, title: Column, body: Column, severity: str, key: Column,
         job: Column | None = None, company: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), title.alias("title"), body.alias("body"),
                     F.lit(severity).alias("severity"), key.alias("dedupe_key"),
                     (none if job is None else job).alias("job_id"),
                     (none if company is None else company).alias("company_id"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def run_signals(jobs: DataFrame, companies: DataFrame, run: DataFrame, now: Column,
                profile: Profile = DEFAULT) -> DataFrame:
    """Signals of one run.  ``jobs`` is the snapshot after it, ``run`` its one-row fact table."""
    c = F.col
    new = jobs.filter("is_new")
    errors = _row(run.filter("errors_count > 0"), "run_failed",
                  _text(c("errors_count"), " sources did not answer"),
                  _text(c("providers_ok"), " of ", c("providers_checked"), " sources answered"),
                  "warning", _text("run:", c("run_id"), ":errors"))
    empty = _row(run.filter("jobs_new = 0"), "scan_summary", F.lit("No new roles in this run"),
                 _text(c("postings_seen"), " postings checked"), "muted", _text("run:", c("run_id"), ":empty"))
    place = F.coalesce(F.nullif(c("city"), F.lit("")), F.nullif(c("location_raw"), F.lit("")),
                       F.lit("place not stated"))
    strong = _row(new.filter(c("score") >= profile.high_match_score), "high_match",
                  _text("Strong match: ", c("title")),
                  _text(c("company_name"), " · ", place, " · ", c("score"), "%"), "success",
                  _text("high:", c("id")), c("id"), c("company_id"))
    wanted = companies.filter(c("tier").isin("dream", "high")).select(
        c("id").alias("company_id"), c("name").alias("employer"))
    # the three best titles per employer as three "next best" aggregates would need
    # sorting; a bounded top-3 window is pruned before the shuffle instead
    from pyspark.sql import Window as W
    mine = new.select("id", "company_id", "title", "score").join(wanted, ["company_id"], "inner")
    best = W.partitionBy("company_id").orderBy(F.desc("score"), F.asc("id"))
    top = mine.withColumn("rn", F.row_number().over(best)).filter("rn <= 3").groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("top"))
    counts = mine.groupBy("company_id", "employer").agg(F.count(F.lit(1)).alias("n"))
    hired = counts.join(top, "company_id").join(run.select("run_id"), how="cross")  # run is one row
    hiring = _row(hired, "dream_company",
                  _text(c("employer"), " posted ", c("n"), F.when(c("n") == 1, " new role").otherwise(" new roles")),
                  _text(F.array_join(F.transform("top", lambda t: t["title"]), ", "),
                        F.when(c("n") > 3, _text(" and ", c("n") - 3, " more")).otherwise(F.lit(""))),
                  "success", _text("dream:", c("run_id"), ":", c("company_id")), None, c("company_id"))
    gone = jobs.filter(~c("is_open") & c("starred") & (c("removed_at") >= now - F.expr("INTERVAL 2 HOURS")))
    closed = _row(gone, "job_closed", _text("A saved role closed: ", c("title")),
                  _text(c("company_name"), " no longer advertises it"), "warning",
                  _text("closed:", c("id")), c("id"))
    return reduce(DataFrame.unionByName, [errors, empty, strong, hiring, closed])


def follow_ups(jobs: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    return _row(jobs.filter(c("follow_up_at") <= as_of), "follow_up_due",
                _text("Follow up on ", c("company_name")), _text(c("title"), " · due ", c("follow_up_at")),
                "info", _text("followup:", c("id"), ":", c("follow_up_at")), c("id"))


def only_unsent(signals: DataFrame, sent: DataFrame) -> DataFrame:
    """Signals whose key was not emitted before; one row per key."""
    return signals.dropDuplicates(["dedupe_key"]).join(
        sent.select("dedupe_key").distinct(), "dedupe_key", "left_anti").select(*COLUMNS)


def prune(notifications: DataFrame, now: Column, keep_days: int = 30) -> DataFrame:
    """Without the read rows older than the window."""
    old = (F.col("created_at") < now - F.expr(f"INTERVAL {int(keep_days)} DAYS")) & F.col("read_at").isNotNull()
    return notifications.filter(~F.coalesce(old, F.lit(False)))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.filter("read_at IS NULL")
