"""Entity resolution: sightings of one vacancy become one group.

Two sightings belong together over (1) the employer's requisition id, (2) the canonical key, (3) a
similar title at the same employer and city.  Two different ids from one source are two vacancies,
unless (1) says otherwise.  The groups are defined as sets, alike at every size:

* keys that share a requisition or have similar titles, directly or over others, form a component;
* in a component, the n-th own id of a source (by first arrival) lands in group n, as does whatever
  carries no id in group 1;
* groups that share a requisition are one.

Processing one arrival after the other gives the same groups where a source repeats no id under two
keys; where it does, arrival order would let the first key win, and this rule numbers the ids of the
whole component instead.  No row is dropped, sampled or treated by another rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..functions.terms import lookup
from ..plans.scale import components, cut_lineage, first_per, ranges, running
from .gates import usable


def normalized(sightings: DataFrame) -> DataFrame:
    """The narrow table the resolution works on; texts stay behind."""
    c = F.col
    df = usable(sightings).select(
        "seq", "provider", F.coalesce("external_id", F.lit("")).alias("external_id"), "posted",
        T.normalize_company(c("company")).alias("company_norm"),
        T.normalize_title(c("title")).alias("title_norm"),
        T.normalize_city(c("location")).alias("city_norm"),
        T.requisition_id(c("external_id"), c("url")).alias("req"),
        lookup(c("provider"), V.PROVIDER_RANK, V.DEFAULT_PROVIDER_RANK).alias("rank"),
        F.length(F.coalesce("description", F.lit(""))).alias("n_chars"))
    return df.withColumn("key", F.concat_ws("|", "company_norm", "title_norm", "city_norm"))


#: What makes two sightings the same posting of the same source.
IDENTITY = ["company_norm", "provider", "external_id", "key", "req"]
PLACE = ["company_norm", "city_norm"]


def drop_repeats(df: DataFrame) -> DataFrame:
    """A source repeating the same posting adds nothing: the earliest stays."""
    return first_per(df, IDENTITY, [F.col("seq")])


# -- similar titles ---------------------------------------------------------
def by_requisition(df: DataFrame) -> DataFrame:
    """Edges from every key of a requisition to the smallest one: linear, never all pairs."""
    member = df.filter("req <> ''").select("company_norm", "req", "key").distinct()
    low = member.groupBy("company_norm", "req").agg(F.min("key").alias("b"), F.max("key").alias("top")).filter("b <> top")
    return member.join(low, ["company_norm", "req"]).filter("key <> b").select(F.col("key").alias("a"), "b")


def by_title(df: DataFrame) -> DataFrame:
    """Pairs of keys of one employer and city whose titles are similar.

    Two sets of tokens of that similarity share one of their rarest tokens: of x tokens the first
    x - ceil(t x) + 1 in the order of rarity.  So only titles that share a rare token are compared,
    and a common word brings nobody together.
    """
    rare = rare_words(df.select(*PLACE, "title_norm", "key").distinct())
    return alike(rare, rare).filter("a > b").distinct()


def rare_words(titles: DataFrame) -> DataFrame:
    """The leading tokens of every title, in the order of their rarity at its employer and place."""
    place = PLACE
    titles = titles.withColumn("tokens", T.title_tokens(F.col("title_norm")))
    words = titles.select(*place, "key", "tokens", F.explode("tokens").alias("token"))
    rarity = words.groupBy(*place, "token").agg(F.count(F.lit(1)).alias("n"))
    ordered = words.join(rarity.filter("n > 1"), [*place, "token"]).groupBy(*place, "key").agg(
        F.first("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("by_rarity"))
    x = F.size("tokens")
    lead = x - F.ceil(V.TITLE_SIMILARITY * x - 1e-9).cast("int") + 1
    # tokens that no other title has come first in the order and meet nobody
    alone = x - F.size("by_rarity")
    return cut_lineage(ordered.select(*place, "key", "tokens", F.explode(F.slice(
        "by_rarity", F.lit(1), F.greatest(lead - alone, F.lit(0)))).alias("r")).select(*place, "key", "tokens", "r.token"))


def alike(rare: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar titles, a of the first table and b of the second."""
    other = others.select(*PLACE, "token", F.col("key").alias("b"), F.col("tokens").alias("other"))
    return rare.join(other, [*PLACE, "token"]).filter(
        (F.col("key") != F.col("b")) & (T.title_similarity(F.col("tokens"), F.col("other")) >= V.TITLE_SIMILARITY)).select(
        F.col("key").alias("a"), "b")


def edges(df: DataFrame) -> DataFrame:
    """Pairs of keys that share a requisition or have similar titles."""
    return by_requisition(df).union(by_title(df))


def with_component(df: DataFrame) -> DataFrame:
    df = cut_lineage(df)  # read by several branches below
    comp = components(edges(df)).select(F.col("node").alias("key"), "component")
    return df.join(comp, ["key"], "left").withColumn(
        "component", F.coalesce("component", "key"))


# -- groups -----------------------------------------------------------------
def slots(df: DataFrame, group: str) -> DataFrame:
    """Number of the group that each row lands in: the rank of its own id within its source."""
    df = df.withColumn("unit", F.when(F.col("req") != "", F.col("req")).otherwise(F.col("external_id")))
    named = F.col("unit") != ""
    units = cut_lineage(df.filter(named).groupBy(group, "provider", "unit").agg(F.min("seq").alias("first_seq")))
    ranked = running(units, [group, "provider"], ranges(units, F.col("first_seq")),
                     [F.col("first_seq")], totals={"slot": F.lit(1)}).select(group, "provider", "unit", "slot")
    # rows without an id of their own never meet the join
    own = df.filter(named).join(ranked, [group, "provider", "unit"]).withColumn("slot", F.col("slot").cast("long"))
    return own.unionByName(df.filter(~named).withColumn("slot", F.lit(1).cast("long"))).drop("unit")


def set_groups(df: DataFrame, group: str = "component") -> DataFrame:
    """Whole-table rule: component and slot, then groups sharing a requisition united.

    Adds ``vacancy``, the smallest arrival number of the group.
    """
    df = cut_lineage(slots(df, group))
    first = df.groupBy(group, "slot").agg(F.min("seq").alias("vacancy"))
    df = df.join(first, [group, "slot"])
    pairs = df.filter("req <> ''").groupBy("company_norm", "req").agg(
        F.min("vacancy").alias("low"), F.max("vacancy").alias("top")).filter("low <> top")
    member = df.filter("req <> ''").select("company_norm", "req", "vacancy").distinct()
    same = member.join(pairs.drop("top"), ["company_norm", "req"]).select(
        F.col("vacancy").alias("a"), F.col("low").alias("b"))
    united = components(same).select(F.col("node").alias("vacancy"), F.col("component").alias("_to"))
    return df.join(united, ["vacancy"], "left").withColumn(
        "vacancy", F.coalesce("_to", "vacancy")).drop("_to")


def assign(sightings: DataFrame) -> DataFrame:
    """``seq, group_key`` for every kept sighting.

    A group is named by the key of its first sighting; further groups of the same key add that
    sighting's source and id.
    """
    return named(set_groups(with_component(drop_repeats(normalized(sightings))))).select("seq", "group_key")


def named(df: DataFrame) -> DataFrame:
    """Rows of whole components with the name of their group."""
    df = cut_lineage(df)
    named = df.filter("seq = vacancy").select("vacancy", F.col("key").alias("c_key"), F.concat(
        F.lit("#"), "provider", F.lit("/"), "external_id").alias("c_rest"))
    first = named.groupBy("c_key").agg(F.min("vacancy").alias("c_first"))
    named = named.join(first, "c_key").select("vacancy", F.concat("c_key", F.when(
        F.col("vacancy") == F.col("c_first"), "").otherwise(F.col("c_rest"))).alias("group_key"))
    return df.join(named, "vacancy")


# -- group facts ------------------------------------------------------------
def primary_order() -> list[Column]:
    """Employer-direct sources first, then the longer text, then the earlier arrival."""
    return [lookup(F.col("provider"), V.PROVIDER_RANK, V.DEFAULT_PROVIDER_RANK),
            -F.length(F.coalesce("description", F.lit(""))), F.col("seq")]


def members(sightings: DataFrame, assigned: DataFrame) -> DataFrame:
    """Sightings with their group."""
    return sightings.join(assigned, "seq")


def vacancies(member: DataFrame, group: str = "group_key") -> DataFrame:
    """One row per group: primary sighting, longest text, earliest date, sources, duplicates.

    All of it is one aggregate that combines before the shuffle, so a group
    of any size costs no more than its share of the scan.
    """
    own = [c for c in ("seq", "provider", "target", "company", "title", "url", "location", "external_id",
                       "tier", "tags", "structured") if c in member.columns]
    text = F.coalesce("description", F.lit(""))
    agg = member.groupBy(group).agg(
        F.min_by(F.struct(*own), F.struct(*primary_order())).alias("p"),
        F.max_by(text, F.struct(F.length(text), -F.col("seq"))).alias("description"),
        F.min("posted").alias("posted"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
        (F.count(F.lit(1)) - 1).alias("duplicates"))
    return agg.select(group, *[F.col(f"p.{c}") for c in own], "description", "posted",
                      "providers", "duplicates")


def dedupe(sightings: DataFrame) -> DataFrame:
    return vacancies(members(sightings, assign(sightings)))
