"""Entity resolution batch by batch: any split of the sightings into batches gives the groups of one batch.

Every sighting once seen stays in a bucketed table with the group it belongs to.  A batch only reads
the employers that it names, because all three signals hold inside one employer.  Of those

* only titles at the places of new keys are compared, and only with new keys;
* components found before enter as single nodes, so the graph holds new links alone;
* only components that gain a sighting are numbered and named anew.

A sighting that its source no longer lists is marked as gone.  It still ties its group together, so
a group does not fall apart when one of its sources drops it, but it adds nothing to the group's facts.

Detail texts are kept beside the text of the listing, so they may come with a posting, later, or before
the listing is read again.  The longer of the two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import upsert as U
from ..sources.providers import PLACE_BITS
from .buckets import Buckets, distinct_buckets
from .scale import components, cut_lineage

NARROW = ["seq", "provider", "external_id", "company_norm", "title_norm", "city_norm", "req", "key"]
GROUP = ["component", "vacancy", "group_key"]


def extend(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """All rows of the components that ``fresh`` joins, with ``component``, ``vacancy`` and ``group_key``.

    ``known`` holds resolved rows (NARROW and ``component``) of at least the employers of ``fresh``;
    ``fresh`` rows are new or replace the row of the same identity, which ``known`` must not hold any more.
    """
    known, fresh = cut_lineage(known.select(*NARROW, "component")), cut_lineage(fresh.select(*NARROW))
    rows = known.select(*NARROW).union(fresh)
    old = known.select("key", "component").distinct()
    new = fresh.select(*D.PLACE, "title_norm", "key").distinct().join(old, "key", "left_anti").select(*D.PLACE, "title_norm", "key")
    near = known.join(new.select(*D.PLACE).distinct(), D.PLACE, "left_semi").select(*D.PLACE, "title_norm", "key").distinct()
    rare = D.rare_words(near.union(new))
    by_title = D.alike(rare, rare.join(new.select("key"), "key", "left_semi"))
    named = fresh.filter("req <> ''").select("company_norm", "req").distinct()
    by_requisition = D.by_requisition(rows.join(named, ["company_norm", "req"], "left_semi"))
    label = cut_lineage(old.union(new.select("key", F.col("key").alias("component"))))
    side = lambda n: label.select(F.col("key").alias(n), F.col("component").alias(f"_{n}"))
    links = by_title.union(by_requisition).join(side("a"), "a").join(side("b"), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"))
    merged = components(links).withColumnRenamed("component", "_to")
    label = label.join(merged, label["component"] == merged["node"], "left").select(
        "key", F.coalesce("_to", "component").alias("component"))
    touched = label.join(fresh.select("key").distinct(), "key", "left_semi").select("component").distinct()
    return D.named(D.set_groups(rows.join(label, "key").join(touched, "component", "left_semi")))


def _table(batch: DataFrame) -> DataFrame:
    """One row per posting of a source: the latest content, first and last arrival, and what resolution needs; its text as a digest."""
    narrow = D.normalized(batch)
    last = narrow.groupBy(*D.IDENTITY).agg(F.min("seq").alias("_first"), F.max("seq").alias("last_seq"))
    of_last = narrow.select("seq", *[c for c in NARROW if c not in ("seq", "provider", "external_id")]).join(
        last.select("_first", "last_seq"), F.col("seq") == F.col("last_seq")).drop("seq")
    content = batch.withColumns({"external_id": F.coalesce("external_id", F.lit("")), "description": _digest("description")})
    return content.join(of_last, content["seq"] == of_last["last_seq"]).withColumn("seq", F.col("_first")).drop("_first")


def _longer(a: str, b: str) -> Column:
    """The longer text, the first of equally long ones."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return F.when(size(b) > size(a), F.col(b)).otherwise(F.col(a))


def _digest(text: str) -> Column:
    """What stands for a text while rows are resolved; null for none."""
    return F.unhex(F.sha2(F.col(text), 256))


def take(store: Buckets, batch: DataFrame, run: int, ended: DataFrame | None = None,
         details: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolve a batch against the stored sightings and store the outcome as run ``run``.

    ``ended(source, target, first_seq)`` are the fetches that this batch completed: their sightings last
    listed before are gone.  ``details(provider, external_id, text)`` are full texts that arrived since the
    last run, for postings of this or of any earlier batch.  Returns the sightings still listed of every group that the run touched, and
    the names of all touched groups, those that have no sighting any more or a new name included.
    """
    spark = batch.sparkSession
    owner, at = F.col("company_norm"), store.of(F.col("company_norm"), F.col("key"))
    told_by = batch.select(T.normalize_company(F.col("company")).alias("company_norm"), "description",
                           T.canonical_key(F.col("company"), F.col("title"), F.col("location")).alias("key"))

    def whole(rows: DataFrame) -> DataFrame:
        """The texts that digests stand for, with the bucket of their rows."""
        return rows.filter("description is not null").select(at.alias("bucket"), _digest("description").alias("digest"), F.col("description").alias("whole"))

    new = _table(batch).withColumns({"gone": F.lit(False), "detail": F.lit(None).cast("string")})
    if details is not None:
        longest = F.max_by("text", F.struct(F.length("text"), "text"))
        told = cut_lineage(details.filter(F.coalesce("text", F.lit("")) != "").groupBy("provider", "external_id").agg(longest.alias("_told")))
        new = new.join(told, ["provider", "external_id"], "left").withColumn("detail", F.col("_told")).drop("_told")
    new = cut_lineage(new)
    everything = store.read(spark, run)
    reach = new.select(F.explode(store.of_owner(owner)))
    if everything is None:
        found = D.named(D.set_groups(D.with_component(new.select(*NARROW))))
        after = cut_lineage(new.join(found.select(*D.IDENTITY, *GROUP), D.IDENTITY))
        touched = distinct_buckets(after.select(at))
        store.write(after, run, at, touched, texts=whole(told_by), text="description")
        return _current(store.read(spark, run + 1, touched), after), after.select("group_key").distinct()

    if ended is not None:
        ends = ended.groupBy(F.col("source").alias("provider"), "target").agg(F.max("first_seq").alias("_starts"))
        late = F.shiftright("last_seq", PLACE_BITS) < F.col("_starts")
        old = everything.filter("not gone").join(ends, ["provider", "target"]).filter(late)
        reach = reach.union(old.select(F.explode(store.of_owner(owner))))
    if details is not None:
        late_text = everything.join(told, ["provider", "external_id"]).filter(F.length("_told") > F.coalesce(F.length("detail"), F.lit(0)))
        reach = reach.union(late_text.select(F.explode(store.of_owner(owner))))
    reach = distinct_buckets(reach)
    stored_texts = store.read(spark, run, reach).drop("_fresh")
    known = stored_texts.withColumn("description", _digest("description"))
    employers = new.select("company_norm").distinct()

    here = known.select(*D.IDENTITY, F.col("seq").alias("_seq"))
    first = new.join(here, D.IDENTITY, "left").filter(F.col("_seq").isNull() | (F.col("seq") < F.col("_seq"))).select(*NARROW)
    first = cut_lineage(first)
    same = known.join(employers, "company_norm", "left_semi").join(first, D.IDENTITY, "left_anti")
    found = cut_lineage(extend(same, first).select(*D.IDENTITY, *[F.col(c).alias(f"_{c}") for c in GROUP]))

    # what the batch holds replaces the stored content; who came first and the group do not depend on it
    stored = [c for c in known.columns if c not in (*D.IDENTITY, *GROUP, "seq", "last_seq", "gone", "detail")]
    mine = new.select(*D.IDENTITY, F.col("seq").alias("_n_seq"), F.col("last_seq").alias("_n_last"),
                      *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_n_{c}") for c in stored])
    both = known.join(mine, D.IDENTITY, "full_outer").join(found, D.IDENTITY, "left")
    newer = F.coalesce(F.col("_n_last") >= F.col("last_seq"), F.col("_n_last").isNotNull())
    after = both.select(
        *D.IDENTITY, F.least("seq", "_n_seq").alias("seq"), F.greatest("last_seq", "_n_last").alias("last_seq"),
        *[F.when(newer, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in stored],
        *[F.coalesce(f"_{c}", c).alias(c) for c in GROUP], F.coalesce(F.col("gone") & ~newer, F.lit(False)).alias("gone"),
        F.col("group_key").alias("_was"), F.col("_n_last").isNotNull().alias("_listed"), F.col("gone").alias("_gone"),
        F.col("component").alias("_in"), F.col("detail"))
    after = after.withColumn("_had", F.coalesce(F.length("detail"), F.lit(0)))
    if details is not None:
        after = after.join(told, ["provider", "external_id"], "left").withColumn("detail", _longer("detail", "_told")).drop("_told")
    if ended is not None:
        after = after.join(ends, ["provider", "target"], "left").withColumn("gone", F.col("gone") | F.coalesce(late, F.lit(False))).drop("_starts")
    after = cut_lineage(after)
    renamed = ~F.col("_was").eqNullSafe(F.col("group_key"))
    changed = after.filter(renamed | F.col("_listed") | ~F.col("_gone").eqNullSafe(F.col("gone"))
                           | ~F.col("_in").eqNullSafe(F.col("component")) | (F.coalesce(F.length("detail"), F.lit(0)) > F.col("_had")))
    rows = after.drop("_was", "_listed", "_gone", "_in", "_had")
    touched = distinct_buckets(changed.select(at))
    # a bucket is rewritten whole; `rows` holds every bucket of every employer concerned
    own = at.isin(*sorted(touched)) if touched else F.lit(False)
    texts = whole(stored_texts.select(*told_by.columns).union(told_by)).filter(F.col("bucket").isin(*sorted(touched)) if touched else F.lit(False))
    store.write(rows.filter(own), run, at, touched, texts=texts, text="description")
    groups = changed.select(F.explode(F.array("_was", "group_key")).alias("group_key")).filter("group_key is not null").distinct()
    return _current(store.read(spark, run + 1, reach | touched), rows).join(groups, "group_key", "left_semi"), groups


def _current(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Sightings that are still listed, with the longer of their texts, as stored; ``rows`` tell the columns."""
    rows = rows.filter("false").withColumn("description", F.lit(None).cast("string")) if stored is None else stored.select(*rows.columns)
    return rows.filter("not gone").withColumn("description", _longer("description", "detail")).drop("detail")


def job_bucket(store: Buckets) -> Column:
    """Jobs lie with their employer, which their id begins with."""
    return store.of(F.substring_index("id", "|", 1), F.col("id"))


def merge_jobs(store: Buckets, rows: DataFrame, groups: DataFrame, run: int, now: Column) -> None:
    """Merge the job rows of a run into the stored snapshot, reading and writing the touched buckets only.

    ``groups(group_key)`` are all groups that the run looked at: a stored job among them that has no row
    any more is closed.  What people wrote stays.
    """
    spark = rows.sparkSession
    ids = groups.select(F.col("group_key").alias("id"))
    place = job_bucket(store)
    touched = distinct_buckets(ids.select(place))
    before = store.read(spark, run, touched)
    before = U.empty_snapshot(rows) if before is None else before.drop("_fresh")
    nobody = spark.createDataFrame([], "source string")
    after = U.upsert(before, rows, now, nobody)
    ended = ids.join(rows.select("id"), "id", "left_anti").withColumn("_ended", F.lit(True))
    after = after.join(ended, "id", "left")
    closing = F.coalesce(F.col("_ended") & F.col("is_open"), F.lit(False))
    after = after.withColumns({"is_open": F.col("is_open") & ~closing,
                               "removed_at": F.when(closing, now).otherwise(F.col("removed_at"))}).drop("_ended")
    store.write(after, run, place, touched, [F.desc_nulls_last("posted_at"), F.desc("score")])


def jobs(store: Buckets, spark, before: int | None = None) -> DataFrame | None:
    """The stored snapshot.  A job is new as long as no later run has finished."""
    rows = store.read(spark, before)
    return None if rows is None else rows.withColumn("is_new", F.col("is_new") & F.col("_fresh")).drop("_fresh")
