"""Landing zone of raw payloads, and the steps every source shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import within_age
from ..operators.quality import url_class
from ..plans.scale import first_per
from ..schemas import RAW_PAYLOAD


def read(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw payload files as a batch; the schema is fixed, so nothing is inferred."""
    return spark.read.schema(RAW_PAYLOAD).format(fmt).load(path).withColumn("file", F.input_file_name())


def read_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW_PAYLOAD).format(fmt).option(
        "maxFilesPerTrigger", files_per_batch).load(path)


def once_per_fetch(sightings: DataFrame, key: str = "external_id") -> DataFrame:
    """The same id from several queries of one fetch is kept once; the first wins.

    An aggregate, so it combines before the shuffle.  Rows without an id have
    nothing to compare and all stay.
    """
    named = sightings.filter(F.coalesce(key, F.lit("")) != "")
    rest = sightings.filter(F.coalesce(key, F.lit("")) == "")
    return first_per(named, ["provider", "target", key], [F.col("seq")]).select(sightings.columns).union(rest)


def fresh(sightings: DataFrame, as_of: Column, max_age_days: int, keep_undated: bool = True) -> DataFrame:
    return sightings.filter(within_age(F.col("posted"), as_of, max_age_days, keep_undated))


def safe_links(sightings: DataFrame) -> DataFrame:
    return sightings.filter(url_class(F.col("url")) == "ok")


DATE_FILTER = {"successfactors": "feed-is-newest-first", "personio": "none", "adzuna": "server"}


def capabilities(sightings: DataFrame, as_of: Column, max_age_days: int) -> DataFrame:
    """Facts of a fetch per source: kind of date filter, postings, stale rows dropped."""
    from ..functions.terms import lookup
    stale = ~within_age(F.col("posted"), as_of, max_age_days)
    return sightings.groupBy("provider", "target").agg(
        F.count_if(~stale).alias("postings"), F.count_if(stale).alias("stale_dropped")).withColumn(
        "date_filter", lookup(F.col("provider"), DATE_FILTER, "client"))


def enrich_candidates(vacancies: DataFrame, max_enrich: int, short: int = 400) -> DataFrame:
    """Vacancies with little text whose full text is worth fetching, strongest tier first."""
    rank = F.when(F.col("tier") == "dream", 0).when(F.col("tier") == "high", 1).otherwise(2)
    return vacancies.filter(F.length(F.coalesce("description", F.lit(""))) < short).orderBy(
        rank, F.col("seq")).limit(max_enrich)
