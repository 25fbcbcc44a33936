"""Seven sub-scores, one total, and the sentences that explain it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.labels import language_label
from ..functions.terms import lookup
from ..profile import DEFAULT, Profile
from .enrich import looks_like_place

SUB_SCORES = ["technical", "experience", "language", "location", "education", "freshness", "domain"]


def technical() -> Column:
    depth = F.least(F.size("skills") + F.col("transfer_credit"), F.lit(7.0)) / 7
    breadth = F.least(F.size("skill_groups"), F.lit(4)) / 4
    return F.least(F.rint(depth * 72 + breadth * 28), F.lit(100.0)).cast("int")


def experience(profile: Profile) -> Column:
    n = F.col("experience_min_years")
    gap = n - F.lit(float(profile.years_experience))
    early = F.col("seniority").isin("graduate", "junior")
    return (F.when(n.isNull() & early, 95).when(n.isNull(), 75)
            .when(gap <= 1, 100).when(gap <= 1.5, 82).when(gap <= 2.5, 68).when(gap <= 4, 48)
            .otherwise(F.greatest(F.lit(0.0), F.rint(52 - (gap - 4) * 13)).cast("int")))


def _german_ad() -> Column:
    return (F.col("language_requirement") == "unclear") & (F.col("posting_language") == "de")


def language() -> Column:
    base = lookup(F.col("language_requirement"), V.LANGUAGE_SCORE, 60)
    return F.when(_german_ad(), F.greatest(F.lit(0), base - 15)).otherwise(base)


def location(profile: Profile) -> Column:
    top = max(profile.location_tiers, default=1) or 1
    points, remote = F.col("tier_points"), F.col("remote_policy")
    base = (F.when(points > 0, F.rint(points / top * 100).cast("int"))
            .when(remote == "remote", 60).otherwise(0))
    return F.when(remote.isin("remote", "hybrid") & (base < 100),
                  F.least(F.lit(100), base + 8)).otherwise(base)


def education(profile: Profile) -> Column:
    mine = V.DEGREE_RANK.get(profile.education_level, 2)
    return (F.when(F.col("degree_rank") == 0, 85)
            .when(F.col("degree_rank") <= mine, 100).otherwise(40))


def freshness(profile: Profile) -> Column:
    age = F.col("age_days")
    out = F.when(age.isNull(), 50)
    for days, points in profile.freshness_curve:
        out = out.when(age <= int(days), int(points))
    return out.otherwise(5)


def domain(profile: Profile) -> Column:
    liked = F.array(*map(F.lit, profile.preferred_industries)) if profile.preferred_industries \
        else F.array().cast("array<string>")
    overlap = F.size(F.filter("domains", lambda d: F.exists(liked, lambda p: F.contains(p, d))))
    return F.when(F.size("domains") == 0, 50).otherwise(
        F.least(F.lit(100), 45 + F.size("domains") * 18 + overlap * 10))


def place_penalty(profile: Profile) -> Column:
    named = (F.col("tier_points") == 0) & looks_like_place(F.col("location"))
    return (F.when(named & (F.col("remote_policy") == "remote"),
                   profile.location_penalty.get("unmatched_remote", 0))
            .when(named, profile.location_penalty.get("unmatched", 0)).otherwise(0))


def add_parts(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """The seven sub-scores and the penalties, each its own column."""
    parts = {"technical": technical(), "experience": experience(profile), "language": language(),
             "location": location(profile), "education": education(profile),
             "freshness": freshness(profile), "domain": domain(profile)}
    return df.withColumns({**{f"score_{n}": parts[n].cast("int") for n in SUB_SCORES}, **{
        "penalty_seniority": lookup(F.col("seniority"), profile.seniority_penalty, 0),
        "penalty_place": place_penalty(profile),
        "penalty_language": lookup(F.col("language_requirement"), profile.language_penalty, 0),
        "penalty_flags": F.aggregate("flags", F.lit(0), lambda a, f: a + f["penalty"]),
        "bonus_tier": lookup(F.col("tier"), profile.tier_bonus, 0),
    }})


def add_total(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Weighted sum plus bonuses minus penalties, clamped to 0..100, halves to even.

    The terms are added in one fixed order, so the floating sum is reproducible.
    """
    base = reduce(lambda a, b: a + b, [F.col(f"score_{n}") * F.lit(float(w))
                                       for n, w in profile.weights.items()])
    stated = (F.col("salary_basis") == "explicit") & (F.col("salary_annual_eur_min") > 0)
    total = (base + F.col("bonus_tier") - F.col("penalty_seniority") - F.col("penalty_place")
             - F.col("penalty_language") - F.col("penalty_flags")
             + F.when(stated, 3).otherwise(0)
             - F.when(F.col("relevance") == 1, 8).when(F.col("relevance") == 2, 3).otherwise(0))
    return df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(total)))
                         .cast("int"))


def add_sentences(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Reasons and gaps, in the order the score is built, the first eight of each."""
    n, score = F.col("experience_min_years"), F.col("score_experience")
    years = F.concat(F.lit("Asks for "), n.cast("string"), F.lit("+ years"))
    early = n.isNull() & F.col("seniority").isin("graduate", "junior")
    label = language_label(F.col("language_requirement"))
    top = F.filter("skill_groups", lambda g: g["group"] == F.col("strongest_group"))
    fresh = F.col("score_freshness")
    remote = F.col("remote_policy") == "remote"
    level = F.when(F.col("title_signal") != "", F.col("title_signal")).otherwise(F.col("seniority"))

    def say(cond: Column, *parts) -> Column:
        return F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    reasons = F.concat(
        F.array(
            say(F.size("skill_groups") > 0, "Your ", F.replace(F.col("strongest_group"), F.lit("_"), F.lit(" ")),
                " skills match: ", F.array_join(F.slice(F.try_element_at(top, F.lit(1))["terms"], 1, 3), ", ")),
            say(F.size("skill_groups") >= 3, "Covers ", F.size("skill_groups").cast("string"),
                " of your skill areas")),
        F.transform(F.slice("transfers", 1, 3), lambda t: F.concat(
            F.lit("Asks for "), t["requirement"], F.lit("; your "), t["via"],
            F.lit(" carries over: "), t["why"])),
        F.array(
            say(early, "Advertised at entry level"),
            say(score == 100, years, ", which you meet"),
            say(n.isNotNull() & (score == 82), years, ", within reach"),
            say(F.col("score_language") >= 88, "Language: ", label),
            say(F.col("tier_points") > 0, "Place: ", F.col("tier_label")),
            say((F.col("tier_points") == 0) & remote, "Remote, so the place matters less"),
            say((F.col("degree_rank") > 0) & (F.col("score_education") == 100),
                "Your degree meets the requirement"),
            say((F.col("age_days") <= 1) & (fresh >= 90), "Posted today"),
            say((F.col("age_days") > 1) & (fresh >= 90), "Posted ", F.col("age_days").cast("string"),
                " days ago"),
            say(F.size("domains") > 0, "Industry: ", F.array_join(F.slice("domains", 1, 3), ", ")),
            say(F.col("tier") == "dream", F.col("company"), " is on your shortlist"),
            say(F.col("salary_annual_eur_min") >= profile.target_salary_eur,
                "The stated salary meets your target"),
            say(F.col("relevance") == 2, "In your field: ", F.col("relevance_reason"))))
    gaps = F.concat(
        F.array(
            say(n.isNotNull() & (score < 82), years),
            say(_german_ad(), "Advertised in German; no language requirement stated"),
            say(F.col("score_language") <= 45, "Language: ", label),
            say((F.col("tier_points") == 0) & ~remote, "Place not preferred or not stated"),
            say(F.col("score_education") == 40, "Asks for a doctorate"),
            say(F.col("penalty_seniority") > 0, "Advertised at ", level, " level"),
            say(F.col("penalty_place") > 0, "Located in ", F.substring(F.trim("location"), 1, 60),
                ", outside the places you work"),
            say(F.col("penalty_language") > 0, "Requires ", label)),
        F.transform("flags", lambda f: f["why"]),
        F.transform(F.slice("unmet", 1, 4), lambda m: F.concat(
            F.lit("Asks for "), m, F.lit(", which you do not list"))),
        F.array(say(F.col("relevance") == 1, "In the field by its text, not its title: ",
                    F.col("relevance_reason"))))
    return df.withColumns({"match_reasons": F.slice(F.array_compact(reasons), 1, 8),
                           "match_gaps": F.slice(F.array_compact(gaps), 1, 8)})


def score(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Score enriched, gated postings."""
    return add_sentences(add_total(add_parts(df, profile), profile), profile)


def rescore(df: DataFrame, old: Profile, new: Profile, key: str = "id") -> DataFrame:
    """What-if: the same enriched rows under two profiles, without a join or a second scan."""
    first = add_total(add_parts(df, old), old).withColumnRenamed("score", "score_before")
    parts = [f"score_{n}" for n in SUB_SCORES] + [
        "penalty_seniority", "penalty_place", "penalty_language", "penalty_flags", "bonus_tier"]
    second = add_total(add_parts(first.drop(*parts), new), new)
    return second.select(key, "score_before", F.col("score").alias("score_after"),
                         (F.col("score") - F.col("score_before")).alias("delta"))
