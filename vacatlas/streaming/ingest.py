"""Streams: payload files to sightings, micro-batches to snapshots, outcomes to source health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, health
from ..operators.upsert import job_rows
from ..plans import incremental
from ..plans.buckets import Buckets
from ..plans.discovery import scored
from ..plans.scale import cut_lineage
from ..profile import DEFAULT, Profile
from ..sources.providers import PLACE_BITS, detail_text, normalize_all


def sightings(raw: DataFrame, as_of: Column, lateness: str = "2 days") -> DataFrame:
    """Sightings of a payload stream; a payload that is delivered again passes once.

    Payloads are told apart by source, target, number and content: a later fetch with the same
    content is a new sighting, because its postings are still there.  One small key per payload is
    held as state, and only for the watermark's span; payloads later than that stay in the landing
    zone for a batch replay.
    """
    once = (raw.withWatermark("fetched_at", lateness)
            .withColumn("content", F.xxhash64("payload"))
            .dropDuplicatesWithinWatermark(["provider", "target", "seq", "content"]))
    return normalize_all(once, as_of)


def latest_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The jobs as of the newest finished run, or of the newest one before a given run."""
    return incremental.jobs(Buckets(f"{root}/jobs"), spark, before)


def merge_batches(stream: DataFrame, registry: DataFrame, root: str, checkpoint: str, as_of: Column,
                  now: Column, profile: Profile = DEFAULT,
                  outcomes: Callable[[SparkSession], DataFrame] | None = None,
                  details: Callable[[SparkSession], DataFrame] | None = None, keep: int = 3, **trigger):
    """Start the stream that turns each micro-batch into one discovery run.

    A batch is resolved against all sightings seen before, so its split into batches does not show in
    the groups; only groups that it touches are scored, and only their buckets are written.  Runs older
    than the last ``keep`` are expired.  A batch that is replayed reads the same predecessor and
    writes the same run again.

    A batch alone closes nothing.  ``outcomes(spark)`` gives the finished fetches, ``(source, target,
    state, first_seq, last_seq)`` with the numbers of their first and last payload; when a batch
    brings the last payload of a healthy one, the sightings of that source and target which its payloads
    did not hold are gone, and jobs without any other sighting are closed.  A fetch may be split over
    any number of batches.  ``details(spark)`` gives detail payloads ``(provider, external_id, payload)`` that may
    belong to postings of any batch; those that say more than what is known are applied.
    """
    seen, kept = Buckets(f"{root}/sightings"), Buckets(f"{root}/jobs")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch)
        ended = None
        if outcomes is not None:
            read = batch.groupBy(F.col("provider").alias("source"), "target").agg(
                F.max(F.shiftright("seq", PLACE_BITS)).alias("_read"))
            ended = outcomes(spark).filter("state = 'healthy'").join(read, ["source", "target"]).filter("_read >= last_seq")
        told = detail_text(details(spark)) if details is not None else None
        member, groups = incremental.take(seen, batch, batch_id, ended, told)
        rows = cut_lineage(job_rows(scored(dedup.vacancies(member), registry, as_of, profile)))
        incremental.merge_jobs(kept, rows, groups, batch_id, now)
        for store in (seen, kept):
            store.expire(spark, keep)

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def follow_health(outcomes: DataFrame, root: str, checkpoint: str, profile: Profile = DEFAULT, **trigger):
    """Start the stream that keeps the health record of every source.

    The record is a small table with one row per source, written per batch
    like the snapshots are, in one bucket.  A batch is folded with bucketed running values
    before it meets the record, so a source that dominates the log is spread.
    """
    store = Buckets(root, 1, 1)

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = store.read(batch.sparkSession, batch_id)
        after = health.fold_onto(None if before is None else before.drop("_fresh"), batch, profile)
        store.write(after, batch_id, F.lit(0), {0})
        store.expire(batch.sparkSession)

    return (outcomes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def request_windows(requests: DataFrame, limit: int, span: str = "60 seconds", slide: str = "10 seconds",
                    lateness: str = "5 minutes") -> DataFrame:
    """Hosts asked more than ``limit`` times in a sliding window, as a stream of breaches."""
    return (requests.withWatermark("at", lateness).groupBy("host", F.window("at", span, slide))
            .agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > limit)
            .select("host", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests"))
