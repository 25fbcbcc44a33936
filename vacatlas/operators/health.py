"""Rolling health of sources, folded from a log of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scale import ranges
from ..profile import DEFAULT, Profile

KEY = ["provider", "target"]


def failure_streaks(outcomes: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """Failures since the last success, at every outcome of a source.

    Failures so far minus failures so far at the last success, both counted inside ranges of rows and
    carried over them by a small summary: one sort, and a source with a third of the log, or one whose
    log falls on a single day, is still spread over many tasks.
    """
    df = outcomes.filter("state <> 'skipped'")
    failed, success = F.when(F.col("state") != "healthy", 1).otherwise(0), F.col("state") == "healthy"
    part = df.withColumn("_range", ranges(df, F.unix_micros("at"), rows_per_range))
    inside = W.partitionBy(*KEY, "_range").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = part.withColumns({"_f": F.sum(failed).over(inside), "_r": F.count(F.lit(1)).over(inside)})
    local = local.withColumn("_s", F.max(F.when(success, F.col("_f"))).over(inside))
    earlier = W.partitionBy(*KEY).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    summary = local.groupBy(*KEY, "_range").agg(F.max("_f").alias("_all"), F.max("_r").alias("_runs"), F.max("_s").alias("_last"))
    carried = summary.withColumns({
        "_f0": F.coalesce(F.sum("_all").over(earlier), F.lit(0)), "_r0": F.coalesce(F.sum("_runs").over(earlier), F.lit(0))})
    carried = carried.withColumn("_s0", F.max(F.col("_f0") + F.col("_last")).over(earlier)).select(*KEY, "_range", "_f0", "_r0", "_s0")
    out = local.join(carried, [*KEY, "_range"])
    at_success = F.coalesce(F.col("_f0") + F.col("_s"), F.col("_s0"), F.lit(0))
    return out.withColumns({"failures": F.col("_f0") + F.col("_f"), "runs": F.col("_r0") + F.col("_r")}).withColumn(
        "consecutive_failures", F.col("failures") - at_success).drop("_range", "_f", "_r", "_s", "_f0", "_r0", "_s0")


def _state(profile: Profile) -> Column:
    return (F.when(F.col("state") == "healthy", "healthy").when(F.col("state") == "rate_limited", "rate_limited")
            .when(F.col("consecutive_failures") >= profile.failures_before_backoff, "failed")
            .otherwise("degraded"))


def _counted(outcomes: DataFrame) -> DataFrame:
    """Per source: last outcome, streak at it, totals and last success of a log."""
    last = failure_streaks(outcomes).groupBy(*KEY).agg(
        F.max_by(F.struct("state", "at", "consecutive_failures"), F.struct("at", "seq")).alias("l"),
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("state") != "healthy").alias("total_failures"),
        F.max(F.when(F.col("state") == "healthy", F.col("at"))).alias("last_ok_at"))
    return last.select(*KEY, "l.*", "total_runs", "total_failures", "last_ok_at")


def _judged(df: DataFrame, profile: Profile) -> DataFrame:
    df = df.withColumn("state", _state(profile))
    minutes = (F.when(F.col("state") == "rate_limited", profile.rate_limited_minutes)
               .when(F.col("state") == "failed", profile.backoff_minutes))
    return df.withColumn("backoff_until", F.timestamp_add("MINUTE", minutes, F.col("at")))


def fold(outcomes: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Current record of every source: state, streak, totals and end of its back-off."""
    return _judged(_counted(outcomes), profile)


def fold_onto(record: DataFrame | None, outcomes: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Continue a record with later outcomes; equals folding the whole log at once."""
    new = _counted(outcomes)
    if record is None:
        return _judged(new, profile)
    kept = ["state", "at", "consecutive_failures", "total_runs", "total_failures", "last_ok_at", "backoff_until"]
    df = record.select(*KEY, *[F.col(c).alias(f"_{c}") for c in kept]).join(new, KEY, "full_outer")
    # without a success in the new part the old streak goes on
    streak = F.col("consecutive_failures") + F.when(
        F.col("last_ok_at").isNull(), F.coalesce("_consecutive_failures", F.lit(0))).otherwise(0)
    df = df.withColumn("fresh", F.col("at").isNotNull()).withColumns({
        "consecutive_failures": F.coalesce(streak, "_consecutive_failures"),
        "total_runs": F.coalesce("total_runs", F.lit(0)) + F.coalesce("_total_runs", F.lit(0)),
        "total_failures": F.coalesce("total_failures", F.lit(0)) + F.coalesce("_total_failures", F.lit(0)),
        "last_ok_at": F.coalesce("last_ok_at", "_last_ok_at"), "at": F.coalesce("at", "_at")})
    df = _judged(df, profile)
    return df.select(*KEY, *[(F.when(F.col("fresh"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
                              if c in ("state", "backoff_until") else F.col(c)) for c in kept])


def backed_off(health: DataFrame, now: Column) -> DataFrame:
    return health.filter(F.col("backoff_until") > now)


def source_status(companies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status of each automated employer from this run, by (adapter, argument), else by name."""
    o = outcomes.groupBy(*KEY).agg(F.max_by(F.struct("state", "postings"), "seq").alias("o"))
    by_arg = o.select(F.col("provider").alias("adapter"), F.col("target").alias("adapter_arg"), F.col("o").alias("o1"))
    by_name = o.select(F.col("provider").alias("adapter"), F.col("target").alias("name"), F.col("o").alias("o2"))
    df = companies.join(by_arg, ["adapter", "adapter_arg"], "left").join(by_name, ["adapter", "name"], "left")
    out = F.coalesce("o1", "o2")
    status = (F.when(F.col("adapter").isNull() | out.isNull() | (out["state"] == "skipped"), F.col("source_status"))
              .when((out["state"] == "healthy") & (out["postings"] > 0), "live")
              .when(out["state"] == "healthy", "idle")
              .when(out["state"] == "rate_limited", "rate_limited").otherwise("broken"))
    return df.select("id", "name", "adapter", "adapter_arg", status.alias("source_status"))


def request_rates(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the same host in the window ending at each request.

    Each request is also placed in the following time bucket, so a window
    never needs more than its own bucket and a busy host is spread over time.
    """
    df = requests.withColumn("_us", F.unix_micros("at"))
    own = F.floor(F.col("_us") / (seconds * 1_000_000))
    df = df.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    window = W.partitionBy("host", "_bucket").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    df = df.withColumn("requests", F.count(F.lit(1)).over(window))
    return df.filter("_bucket = _own").drop("_us", "_own", "_bucket")
