"""Checked queries: entity resolution (D), joins used by it (J06), unions (U01)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacatlas.operators import dedup as D
from vacatlas.plans import incremental
from vacatlas.plans.buckets import Buckets
from vacatlas.plans.scale import shared_dir

from .base import O, VIEWS, query, sql, view
from .facts import sql_city, sql_company, sql_title

# every third posting is syndicated by a board, every seventh renamed under the
# same requisition, every tenth fetched twice
VIEWS["sighting_view"] = """
SELECT seq * 4 AS seq, provider, company, title, location, url, external_id, posted, tier, description
FROM posting_view
UNION ALL
SELECT seq * 4 + 1, CASE WHEN provider = 'arbeitnow' THEN 'adzuna' ELSE 'arbeitnow' END, company,
  CASE WHEN seq % 6 = 0 THEN title || ' (all genders)' ELSE title || ' Team' END, location,
  'https://board.example.com/' || CAST(seq AS VARCHAR(20)), 'B' || CAST(seq AS VARCHAR(20)), posted + 2, tier,
  'Via a board. ' || description FROM posting_view WHERE seq % 3 = 0
UNION ALL
SELECT seq * 4 + 2, 'lever', company, 'Renamed position', location,
  'https://lever.example.com/' || CAST(seq AS VARCHAR(20)), external_id, posted - 1, tier,
  'Renamed.' FROM posting_view WHERE seq % 7 = 0
UNION ALL
SELECT seq * 4 + 3, provider, company, title, location, url, external_id, posted, tier, description
FROM posting_view WHERE seq % 10 = 0
"""

O["o_norm"] = f"""
SELECT *, company_norm || '|' || title_norm || '|' || city_norm AS key,
  coalesce(nullif(req, ''), external_id) AS unit FROM (
SELECT min(seq) AS seq, provider, external_id, company_norm, title_norm, city_norm, req FROM (
  SELECT seq, provider, external_id, {sql_company('company')} AS company_norm, {sql_title('title')} AS title_norm,
    {sql_city('location')} AS city_norm,
    CASE WHEN external_id LIKE 'REQ-%' THEN external_id ELSE '' END AS req FROM sighting_view)
GROUP BY ALL)
"""
O["o_titles"] = """
SELECT DISTINCT company_norm, city_norm, key, list_distinct(string_split(title_norm, ' ')) AS tk FROM o_norm
"""
O["o_edges"] = """
SELECT DISTINCT a.key AS a, b.key AS b FROM o_titles a JOIN o_titles b
  ON a.company_norm = b.company_norm AND a.city_norm = b.city_norm AND a.key <> b.key
WHERE len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) >= 0.72
UNION SELECT DISTINCT a.key, b.key FROM o_norm a JOIN o_norm b
  ON a.company_norm = b.company_norm AND a.req = b.req AND a.req <> '' AND a.key <> b.key
"""
O["o_reach"] = """
SELECT DISTINCT key AS a, key AS b FROM o_norm
UNION SELECT r.a, e.b FROM o_reach r JOIN o_edges e ON e.a = r.b
"""
O["o_comp"] = "SELECT a AS key, min(b) AS component FROM o_reach GROUP BY a"


O["o_slot"] = """
SELECT n.*, c.component, coalesce(r.slot, 1) AS slot FROM o_norm n JOIN o_comp c ON c.key = n.key
LEFT JOIN (SELECT component, provider, unit, row_number() OVER (PARTITION BY component, provider ORDER BY s) AS slot
  FROM (SELECT component, provider, unit, min(seq) AS s FROM o_norm n JOIN o_comp c ON c.key = n.key
    WHERE unit <> '' GROUP BY ALL)) r
  ON r.component = c.component AND r.provider = n.provider AND r.unit = n.unit
"""
O["o_first"] = "SELECT *, min(seq) OVER (PARTITION BY component, slot) AS vac FROM o_slot"
O["o_same"] = """
SELECT DISTINCT a.vac AS a, b.vac AS b FROM o_first a JOIN o_first b ON a.company_norm = b.company_norm AND a.req = b.req
WHERE a.req <> ''
"""
O["o_united"] = "SELECT vac AS a, vac AS b FROM o_first UNION SELECT u.a, s.b FROM o_united u JOIN o_same s ON s.a = u.b"
O["o_vacancy"] = """
SELECT f.*, u.vacancy FROM o_first f JOIN (SELECT a, min(b) AS vacancy FROM o_united GROUP BY a) u ON u.a = f.vac
"""
O["o_group"] = """
SELECT v.*, n.group_key FROM o_vacancy v JOIN (SELECT vacancy, CASE WHEN vacancy = min(vacancy) OVER (PARTITION BY key)
  THEN key ELSE key || '#' || provider || '/' || external_id END AS group_key FROM o_vacancy WHERE seq = vacancy) n
  ON n.vacancy = v.vacancy
"""


def sightings(spark, sf):
    return view(spark, sf, "sighting_view")


@query("u01_union_sources", sql("SELECT provider, count(*) AS n FROM sighting_view GROUP BY provider"))
def u01(spark, sf):
    return sightings(spark, sf).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("u03_token_sets", sql("""
SELECT key, len(list_intersect(tk, ['machine', 'learning', 'engineer']))::INT AS shared,
  len(list_distinct(list_concat(tk, ['machine', 'learning', 'engineer'])))::INT AS joined FROM o_titles"""))
def u03(spark, sf):
    tk = D.T.title_tokens(F.col("title_norm"))
    other = F.array(*map(F.lit, ["machine", "learning", "engineer"]))
    return D.normalized(sightings(spark, sf)).select("key", "title_norm").distinct().select(
        "key", F.size(F.array_intersect(tk, other)).alias("shared"),
        F.size(F.array_union(tk, other)).alias("joined"))


@query("d01_resolve", sql("SELECT seq, group_key FROM o_group"))
def d01(spark, sf):
    return D.assign(sightings(spark, sf))


def by_batches(spark, sf):
    """The table of sightings after three batches that mix early and late arrivals."""
    s, store = sightings(spark, sf), Buckets(f"{shared_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}")
    for n in range(3):
        incremental.take(store, s.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == n), n)
    return store.read(spark)


@query("d01_by_batches", sql("SELECT seq, group_key FROM o_group"))
def d01_by_batches(spark, sf):
    return by_batches(spark, sf).select("seq", "group_key")


@query("j06_by_batches", sql("""
SELECT g.group_key, count(*) AS sightings, array_to_string(list_sort(list(DISTINCT g.provider)), ',') AS providers, min(g.vacancy) AS vacancy
FROM o_group g GROUP BY g.group_key"""))
def j06_by_batches(spark, sf):
    return by_batches(spark, sf).groupBy("group_key").agg(
        F.count(F.lit(1)).alias("sightings"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"),
        F.min("vacancy").alias("vacancy"))


@query("d02_merge_guard", sql("""
SELECT group_key, provider, count(DISTINCT external_id) AS ids, count(DISTINCT nullif(req, '')) AS requisitions
FROM o_group WHERE external_id <> '' GROUP BY ALL HAVING count(DISTINCT external_id) > 1"""))
def d02(spark, sf):
    """Sources with several ids in one group, and how many requisitions tie them together."""
    s = sightings(spark, sf)
    m = D.assign(s).join(D.normalized(s).select("seq", "provider", "external_id", "req"), "seq")
    return m.filter("external_id <> ''").groupBy("group_key", "provider").agg(
        F.countDistinct("external_id").alias("ids"),
        F.countDistinct(F.nullif("req", F.lit(""))).alias("requisitions")).filter("ids > 1")


@query("d03_drop_repeats", sql("SELECT seq FROM o_norm"))
def d03(spark, sf):
    return D.drop_repeats(D.normalized(sightings(spark, sf))).select("seq")


_KEYED = """(SELECT s.*, n.key FROM sighting_view s JOIN (SELECT seq AS q, company_norm || '|' || title_norm
  || '|' || city_norm AS key FROM (SELECT seq, """ + sql_company("company") + " AS company_norm, " \
    + sql_title("title") + " AS title_norm, " + sql_city("location") + """ AS city_norm FROM sighting_view)) n
  ON n.q = s.seq)"""


def keyed(spark, sf):
    s = sightings(spark, sf)
    return s.withColumn("key", D.T.canonical_key(F.col("company"), F.col("title"), F.col("location")))


@query("d04_primary", sql(f"""
SELECT key, seq AS primary_seq, provider FROM (SELECT key, seq, provider, row_number() OVER (
  PARTITION BY key ORDER BY CASE provider WHEN 'arbeitnow' THEN 2 WHEN 'jobsch' THEN 2 WHEN 'adzuna' THEN 3
  ELSE 0 END, length(description) DESC, seq) AS rn FROM {_KEYED}) WHERE rn = 1"""))
def d04(spark, sf):
    return D.vacancies(keyed(spark, sf), "key").select("key", F.col("seq").alias("primary_seq"), "provider")


@query("d05_best_description", sql(f"SELECT key, max(length(description))::INT AS n FROM {_KEYED} GROUP BY key"))
def d05(spark, sf):
    return D.vacancies(keyed(spark, sf), "key").select("key", F.length("description").alias("n"))


@query("d06_earliest_posted", sql(f"SELECT key, min(posted) AS posted FROM {_KEYED} GROUP BY key"))
def d06(spark, sf):
    return D.vacancies(keyed(spark, sf), "key").select("key", "posted")


@query("d07_providers", sql(f"""
SELECT key, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, count(*) - 1 AS duplicates
FROM {_KEYED} GROUP BY key"""))
def d07(spark, sf):
    return D.vacancies(keyed(spark, sf), "key").select(
        "key", F.array_join("providers", ",").alias("providers"), "duplicates")


@query("d08_components", sql("SELECT n.seq, c.component FROM o_norm n JOIN o_comp c ON c.key = n.key"))
def d08(spark, sf):
    return D.with_component(D.drop_repeats(D.normalized(sightings(spark, sf)))).select("seq", "component")


@query("d08_slots", sql("SELECT seq, component, slot FROM o_slot"))
def d08_slots(spark, sf):
    df = D.with_component(D.drop_repeats(D.normalized(sightings(spark, sf))))
    return D.slots(df, "component").select("seq", "component", "slot")


@query("d08_set_groups", sql("SELECT seq, vacancy FROM o_vacancy"))
def d08_set(spark, sf):
    df = D.with_component(D.drop_repeats(D.normalized(sightings(spark, sf))))
    return D.set_groups(df).select("seq", "vacancy")


@query("j06_dedupe", sql("""
SELECT g.group_key, arg_min(s.seq, (CASE WHEN s.provider IN ('arbeitnow', 'jobsch') THEN 2 WHEN s.provider = 'adzuna' THEN 3 ELSE 0 END,
    -length(s.description), s.seq)) AS seq,
  array_to_string(list_sort(list(DISTINCT s.provider)), ',') AS providers, count(*) - 1 AS duplicates, min(s.posted) AS posted
FROM o_group g JOIN sighting_view s ON s.seq = g.seq GROUP BY g.group_key"""))
def j06(spark, sf):
    return D.dedupe(sightings(spark, sf)).select(
        "group_key", "seq", F.array_join("providers", ",").alias("providers"), "duplicates", "posted")
