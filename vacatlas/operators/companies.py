"""The employer registry: names, aliases, parents, reconciliation, explorer order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.terms import lookup
from ..plans.scale import first_per

TIER_ORDER = {"dream": 0, "high": 1, "normal": 2, "ignored": 3}


def name_index(companies: DataFrame) -> DataFrame:
    """``match_key, company_id`` from names and aliases; a name beats an alias, then the smaller id."""
    names = F.array(F.struct(F.lit(0).alias("kind"), F.col("name").alias("n")))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")),
                          lambda a: F.struct(F.lit(1).alias("kind"), a.alias("n")))
    rows = companies.select(F.col("id").alias("company_id"), F.explode(F.concat(names, aliases)).alias("e"))
    keyed = rows.select("company_id", "e.kind", T.match_key(F.col("e.n")).alias("match_key"))
    return first_per(keyed.filter("match_key <> ''"), ["match_key"],
                     [F.col("kind"), F.col("company_id")]).select("match_key", "company_id")


def resolve_names(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds ``company_id`` by employer name or alias, NULL when unknown."""
    keyed = postings.withColumn("match_key", T.match_key(F.col("company")))
    return keyed.join(name_index(companies), ["match_key"], "left").drop("match_key")


def discover(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Employers that are neither a known name or alias nor an existing id, one row each."""
    keyed = postings.filter(F.trim("company") != "").select(
        "seq", "company", "provider", T.match_key(F.col("company")).alias("match_key"))
    first = first_per(keyed, ["match_key"], [F.col("seq")]).withColumn("id", T.slugify(F.col("company")))
    fresh = first.join(name_index(companies), "match_key", "left_anti")
    fresh = fresh.join(companies.select("id"), "id", "left_anti")
    fresh = first_per(fresh, ["id"], [F.col("seq")])
    return fresh.select("id", F.substring(F.trim("company"), 1, 200).alias("name"),
                        F.lit("normal").alias("tier"), F.lit("manual").alias("source_status"),
                        F.substring("provider", 1, 40).alias("discovered_from"))


def with_parent_name(companies: DataFrame) -> DataFrame:
    """Name of the parent group; only parents that are themselves roots resolve."""
    roots = companies.filter("parent_id IS NULL").select(
        F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return companies.join(roots, "parent_id", "left").withColumn(
        "parent_name", F.coalesce("parent_name", F.lit("")))


def missing_parents(companies: DataFrame) -> DataFrame:
    return companies.filter("parent_id IS NOT NULL").join(
        companies.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def reconcile(config: DataFrame, observed: DataFrame) -> DataFrame:
    """Configuration says what an employer *is*; what was observed and noted stays.

    Employers only found by boards are kept untouched.  A source is idle until
    a run has fetched from it, and manual while it has no adapter.  Of a configuration the columns
    ``aliases``, ``parent`` (a name) or ``parent_id``, ``careers_url`` and ``enabled`` may be missing: then no
    aliases, no parent, no link, enabled.
    """
    def of(df: DataFrame, name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    parent = F.nullif(T.slugify(F.nullif(F.trim(of(config, "parent", "string")), F.lit(""))), F.lit("unknown"))
    cfg = config.select(T.slugify(F.col("name")).alias("id"), "name", F.lower("tier").alias("tier"),
                        "adapter", "adapter_arg", "industry", "country", F.lit(True).alias("configured"),
                        F.coalesce(of(config, "aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"),
                        F.coalesce(of(config, "parent_id", "string"), parent).alias("parent_id"),
                        F.coalesce(of(config, "careers_url", "string"), F.lit("")).alias("careers_url"),
                        F.coalesce(of(config, "enabled", "boolean"), F.lit(True)).alias("enabled"))
    obs = observed.select("id", *[F.col(c).alias(f"_{c}") for c in (
        "name", "tier", "adapter", "adapter_arg", "industry", "country", "source_status", "notes",
        "discovered_from")], *[of(observed, c, k).alias(f"_{c}") for c, k in (
            ("aliases", "array<string>"), ("parent_id", "string"), ("careers_url", "string"), ("enabled", "boolean"))])
    df = cfg.join(obs, "id", "full_outer")
    stated = F.col("configured").isNotNull()

    def pick(name: str) -> Column:
        return F.when(stated, F.col(name)).otherwise(F.col(f"_{name}")).alias(name)

    before = F.coalesce("_source_status", F.lit("manual"))
    status = (F.when(~stated, F.col("_source_status")).when(F.col("adapter").isNull(), "manual")
              .when(before == "manual", "idle").otherwise(before))
    return df.select("id", *[pick(c) for c in ("name", "tier", "adapter", "adapter_arg", "industry", "country",
                                               "aliases", "parent_id", "careers_url", "enabled")],
                     status.alias("source_status"), F.coalesce("_notes", F.lit("")).alias("notes"),
                     F.coalesce("_discovered_from", F.lit("")).alias("discovered_from"))


def select(companies: DataFrame, tier: str | None = None, automated: bool | None = None,
           industry: str | None = None, country: str | None = None,
           source_status: str | None = None) -> DataFrame:
    out = companies.filter("enabled")
    for value, column in ((tier, "tier"), (industry, "industry"), (country, "country"),
                          (source_status, "source_status")):
        if value:
            out = out.filter(F.col(column) == value.lower())
    if automated is not None:
        out = out.filter(F.col("adapter").isNotNull() if automated else F.col("adapter").isNull())
    return out


def explore(companies: DataFrame, view: str = "all", text: str = "") -> DataFrame:
    """Explorer views over companies that carry their figures."""
    tests = {"all": F.lit(True), "dream": F.col("tier") == "dream",
             "hiring": F.col("worth_applying") > 0, "automated": F.col("adapter").isNotNull(),
             "manual": F.col("adapter").isNull()}
    out = companies.filter(tests[view])
    if text:
        hit = F.lit(False)
        for c in ("name", "industry", "adapter"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
        out = out.filter(hit)
    return out


def explorer_order() -> list[Column]:
    return [F.desc(F.col("worth_applying") > 0), lookup(F.col("tier"), TIER_ORDER, 9).asc(),
            F.desc("worth_applying"), F.desc("best_score"), F.asc("name"), F.asc("id")]


def radar_order() -> list[Column]:
    return [F.desc("worth_applying"), F.desc("best_score"), F.asc("name"), F.asc("id")]


def tab_counts(companies: DataFrame) -> DataFrame:
    auto = F.col("adapter").isNotNull()
    return companies.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("tier") == "dream").alias("dream"),
        F.count_if(F.col("worth_applying") > 0).alias("hiring"), F.count_if(auto).alias("automated"),
        F.count_if(~auto).alias("manual"),
        F.count_distinct(F.nullif(F.col("industry"), F.lit(""))).alias("industries"))


def watchlist(companies: DataFrame) -> DataFrame:
    """Employers without an adapter, by tier name and name."""
    return companies.filter("enabled AND adapter IS NULL").select("id", "tier", "name").orderBy("tier", "name", "id")
