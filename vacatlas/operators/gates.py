"""The few rejections.  Rejected rows stay in the result with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import WORD, any_of
from ..profile import DEFAULT, Profile
from . import enrich as E


def usable(df: DataFrame) -> DataFrame:
    """Sightings with a title and a link."""
    return df.filter((F.coalesce(F.col("title"), F.lit("")) != "")
                     & (F.coalesce(F.col("url"), F.lit("")) != ""))


def not_full_time(title: Column, profile: Profile = DEFAULT) -> Column:
    """Whole terms, or beginnings of words for terms written with a trailing ``*``."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    whole = [t for t in profile.not_fulltime if not t.endswith("*")]
    starts = [t[:-1] for t in profile.not_fulltime if t.endswith("*")]
    out = F.rlike(lowered, F.lit(any_of(whole))) if whole else F.lit(False)
    if starts:
        prefix = "|".join(E.T.re.escape(t) for t in starts)
        out = out | F.rlike(lowered, F.lit(f"(?<![{WORD}])(?:{prefix})"))
    return out


def gate(df: DataFrame, as_of: Column, profile: Profile = DEFAULT) -> DataFrame:
    """Adds ``age_days``, the relevance verdict and ``reject_reason`` ('' means keep)."""
    df = E.excluded_region(E.relevance(df, profile), profile)
    df = df.withColumn("age_days", F.datediff(as_of, F.col("posted")))
    age = F.col("age_days")
    tests = [
        F.when(not_full_time(F.col("title"), profile), F.lit("not a full-time position")),
        F.when(F.col("relevance") == 0, F.col("relevance_reason")),
        F.when(F.col("excluded_region") != "", F.concat(
            F.lit("outside the target region ("), F.col("excluded_region"), F.lit(")"))),
        F.when(age > profile.max_age_days, F.lit(f"older than {profile.max_age_days} days")),
    ]
    if not profile.keep_undated:
        tests.insert(3, F.when(age.isNull(), F.lit("no posting date")))
    return df.withColumn("reject_reason", F.coalesce(*tests, F.lit("")))


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason") == "")
