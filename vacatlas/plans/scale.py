"""Helpers that keep a job whole and balanced when one key holds much of the data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.  A session on one machine may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vacatlas-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the written table.

    A lost executor then re-reads files instead of replaying a loop from its
    start, and the optimizer knows the true size of what follows.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, however often they are used further up.

    The optimizer merges neighbouring projections and moves filters below them, and copies the columns'
    expressions to every use.  It does not look into a generator, so one that makes a single row holds the
    values.  For columns that cost much, such as patterns over a whole text.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(row)))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every group as an aggregate: combined before the shuffle, no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in rest])


def ranges(df: DataFrame, order: Column, rows: int = 1_000_000) -> Column:
    """Ordered buckets of about ``rows`` rows each: the split follows the rows, not the values.

    The driver holds the bounds, one number per bucket.
    """
    n = -(-df.count() // rows)
    if n < 2:
        return F.lit(0)
    bounds = df.agg(F.percentile_approx(order.cast("double"), [i / n for i in range(1, n)], 10_000)).first()[0]
    return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < order))


def micros(df: DataFrame, name: str) -> Column:
    """A number that grows with a time column of either timestamp type, whatever the session's time zone."""
    at = F.col(name)
    if df.schema[name].dataType != T.TimestampNTZType():
        return F.unix_micros(at)
    # read as UTC from its parts: a cast goes through the session's zone, which is not monotone where clocks change
    seconds = F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
            totals: dict[str, Column] | None = None, latest: dict[str, Column] | None = None,
            before: bool = False) -> DataFrame:
    """Running values within a group, split into ordered buckets so no task sees a whole group.

    ``totals`` are running sums, ``latest`` running maxima (of anything that
    orders with the group's order).  Each bucket is processed on its own; its
    totals and maxima form a small summary whose running values are added.
    With ``before`` the current row is left out.  ``bucket`` must grow with
    ``order``.
    """
    totals, latest = totals or {}, latest or {}
    part = df.withColumn("_bucket", bucket)
    end = -1 if before else W.currentRow
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    summary = part.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in latest.items()])
    carried = summary.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in totals],
        *[F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in latest])
    local = part.withColumns({
        **{n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()},
        **{n: F.max(c).over(inside) for n, c in latest.items()}})
    joined = local.join(carried, [*keys, "_bucket"], "left")
    return joined.withColumns({
        **{n: F.col(n) + F.col(f"_c_{n}") for n in totals},
        **{n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in latest},
    }).drop("_bucket", *[f"_c_{n}" for n in [*totals, *latest]])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, smallest node as label.

    Alternates "large star" and "small star" steps (Kiveris et al., 2014),
    which converge in a logarithmic number of rounds and never hold more edges
    than they started with.  Both steps are aggregates and joins on the node.
    A node with very many neighbours is only ever aggregated to its minimum;
    the join back is plain, so Spark can split a skewed side.  Lineage is cut each round.
    """
    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    for _ in range(rounds if seen[0] else 0):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        e = cut_lineage(small)
        before, seen = seen, mark(e)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not converge")
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return labels.union(roots)
