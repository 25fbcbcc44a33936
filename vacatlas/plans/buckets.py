"""Tables in hash buckets that a run rewrites only where it changed something.

``root/data/run=N/bucket=B`` holds the rows that run N wrote; ``root/runs/run=N`` is its marker, written
last, and names the run whose files are live for every bucket.  So

* a run that fails before its marker has changed nothing, and one that is replayed writes the same again;
* readers see one finished run, whole, whatever is being written;
* the newest run is found by listing one folder of names.

Files that no marker of the last ``keep`` runs names can be expired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE = 25_000  # rows with texts that a task takes of a bucket, or so


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system, none if it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n[len(prefix):]) for n in _names(spark, path) if n.startswith(prefix))


def _with_texts(rows: DataFrame, texts: DataFrame, text: str, slices: int) -> DataFrame:
    """``rows`` with the whole texts that the digests in their column ``text`` stand for, dealt by bucket and slice."""
    # a row without a text meets nobody
    alone = F.coalesce(text, F.col("seq").cast("string").cast("binary"))
    both = rows.withColumns({"_digest": alone, "_row": F.lit(True)}).unionByName(
        texts.select("bucket", F.col("digest").alias("_digest"), F.col("whole").alias("_whole"), F.lit(False).alias("_row")), allowMissingColumns=True)
    slice_ = F.pmod(F.xxhash64("_digest"), F.lit(slices))
    dealt = both.withColumn("_slice", slice_).repartition("bucket", "_slice")
    whole = F.first("_whole", ignorenulls=True).over(W.partitionBy("bucket", "_slice", "_digest"))
    return dealt.withColumn("_whole", whole).filter("_row").withColumn(text, F.col("_whole")).drop("_whole", "_digest", "_row", "_slice")


@dataclass(frozen=True)
class Buckets:
    """A table under ``root``: rows of one owner lie in one of ``owners`` buckets, dealt over ``parts`` by their key.

    An owner with a large share of the table is spread over ``parts`` buckets, one with few rows
    touches few.  Neither number may change once the table exists.
    """

    root: str
    owners: int = 64
    parts: int = 8

    def of(self, owner: Column, key: Column) -> Column:
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        return deal(owner, self.owners) * self.parts + deal(key, self.parts)

    def of_owner(self, owner: Column) -> Column:
        """All buckets that rows of an owner can lie in."""
        first = F.pmod(F.xxhash64(owner), F.lit(self.owners)).cast("int") * self.parts
        return F.sequence(first, first + self.parts - 1)

    def newest(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The newest finished run, or the newest one before a run that may be a replay."""
        for run in reversed(_numbers(spark, f"{self.root}/runs", "run=")):
            if (before is None or run < before) and "_SUCCESS" in _names(spark, f"{self.root}/runs/run={run}"):
                return run
        return None

    def live(self, spark: SparkSession, run: int | None) -> dict[int, int]:
        """The run whose files hold each bucket: at most owners * parts rows."""
        if run is None:
            return {}
        return {r["bucket"]: r["live"] for r in spark.read.parquet(f"{self.root}/runs/run={run}").collect()}

    def read(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows as of the newest run (before a run), of some buckets only if given.

        Adds ``_fresh``: whether the row's files were written by that run.  None where nothing was written;
        without a bucket that has rows, an empty table.
        """
        run = self.newest(spark, before)
        live = self.live(spark, run)
        if not live:
            return None
        wanted = {b: r for b, r in live.items() if buckets is None or b in buckets}
        some = wanted or dict([next(iter(live.items()))])
        rows = (spark.read.option("basePath", f"{self.root}/data")
                .parquet(*[f"{self.root}/data/run={r}/bucket={b}" for b, r in sorted(some.items())]))
        rows = rows.withColumn("_fresh", F.col("run") == run).drop("run", "bucket")
        return rows if wanted else rows.filter(F.lit(False))

    def write(self, rows: DataFrame, run: int, bucket: Column, touched: set[int], order: list[Column] | None = None,
              texts: DataFrame | None = None, text: str = "") -> None:
        """Replace the touched buckets by ``rows`` and finish the run; buckets not touched keep their files.

        ``rows`` must hold all rows of the touched buckets.  Large buckets are split over tasks and files.
        With ``texts`` the column ``text`` of ``rows`` holds digests, and ``texts(bucket, digest, whole)`` has what they
        stand for in every bucket that needs it, maybe more than once: both meet in the bucket's own shuffle.
        """
        spark = rows.sparkSession
        path = f"{self.root}/data/run={run}"
        before = self.live(spark, self.newest(spark, run))
        if touched:
            own = rows.withColumn("bucket", bucket)
            own = own.hint("rebalance", "bucket") if texts is None else _with_texts(own, texts, text, 1 + rows.count() // (SLICE * len(touched)))
            own = own.sortWithinPartitions("bucket", *(order or []))
            own.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(path)
        written = set(_numbers(spark, path, "bucket=")) if touched else set()
        live = {**{b: r for b, r in before.items() if b not in touched}, **{b: run for b in written}}
        marker = spark.createDataFrame(sorted(live.items()), "bucket int, live long").coalesce(1)
        marker.write.mode("overwrite").parquet(f"{self.root}/runs/run={run}")

    def expire(self, spark: SparkSession, keep: int = 3) -> None:
        """Delete the files and markers that none of the last ``keep`` finished runs needs."""
        runs = [r for r in _numbers(spark, f"{self.root}/runs", "run=") if "_SUCCESS" in _names(spark, f"{self.root}/runs/run={r}")]
        kept = runs[-keep:]
        if not kept:
            return
        needed = {(r, b) for run in kept for b, r in self.live(spark, run).items()}
        for run in [r for r in _numbers(spark, f"{self.root}/data", "run=") if r < kept[0]]:
            path = f"{self.root}/data/run={run}"
            here = _numbers(spark, path, "bucket=")
            if not any((run, b) in needed for b in here):
                _drop(spark, path)
            else:
                for b in here:
                    if (run, b) not in needed:
                        _drop(spark, f"{path}/bucket={b}")
        for run in runs[:-keep]:
            _drop(spark, f"{self.root}/runs/run={run}")


def distinct_buckets(*rows: DataFrame) -> set[int]:
    """The buckets named by tables of one bucket column: as many values as there are buckets, at most."""
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    return {r[0] for r in every.distinct().collect()}
