"""One normaliser per source: raw payload rows in, sightings out.

A source is a pair of a payload reader (rows of one posting each) and a
mapping to sighting columns.  JSON is read with an explicit schema in
permissive mode; a payload that cannot be read yields no posting here and is
kept by :func:`quarantine`.  Feeds are cut with patterns, because feeds in the
wild are often not well-formed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import from_any, from_relative
from ..functions.text import clean_html
from ..schemas import SIGHTING, STRUCTURED

# --- fixed values: fields of each source's payload that are used ------------
_NAME = "STRUCT<name: STRING>"
PAYLOADS = {
    "smartrecruiters": "STRUCT<content: ARRAY<STRUCT<id: STRING, name: STRING, releasedDate: STRING, "
                       "createdOn: STRING, location: STRUCT<city: STRING, region: STRING, country: STRING>>>>",
    "greenhouse": f"STRUCT<jobs: ARRAY<STRUCT<id: STRING, title: STRING, absolute_url: STRING, location: {_NAME}, "
                  "first_published: STRING, updated_at: STRING>>>",
    "lever": "ARRAY<STRUCT<id: STRING, text: STRING, hostedUrl: STRING, createdAt: STRING, "
             "descriptionPlain: STRING, categories: STRUCT<location: STRING>>>",
    "ashby": "STRUCT<jobs: ARRAY<STRUCT<id: STRING, title: STRING, jobUrl: STRING, applyUrl: STRING, "
             "location: STRING, isRemote: BOOLEAN, publishedAt: STRING, updatedAt: STRING, "
             "descriptionHtml: STRING, descriptionPlain: STRING, compensation: STRING>>>",
    "workable": "STRUCT<jobs: ARRAY<STRUCT<shortcode: STRING, title: STRING, url: STRING, application_url: STRING, "
                "city: STRING, country: STRING, published_on: STRING, created_at: STRING, description: STRING>>>",
    "arbeitnow": "STRUCT<data: ARRAY<STRUCT<slug: STRING, title: STRING, company_name: STRING, url: STRING, "
                 "location: STRING, created_at: STRING, description: STRING, tags: ARRAY<STRING>, "
                 "job_types: ARRAY<STRING>>>>",
    "jobsch": "STRUCT<documents: ARRAY<STRUCT<job_id: STRING, title: STRING, company_name: STRING, place: STRING, "
              f"regions: ARRAY<{_NAME}>, publication_date: STRING, preview: STRING, "
              "language_skills: ARRAY<STRUCT<language: STRING, level: INT>>, "
              "_links: STRUCT<detail_en: STRUCT<href: STRING>, detail_de: STRUCT<href: STRING>, "
              "detail_fr: STRUCT<href: STRING>>>>>",
    "adzuna": "STRUCT<results: ARRAY<STRUCT<id: STRING, title: STRING, redirect_url: STRING, created: STRING, "
              "description: STRING, company: STRUCT<display_name: STRING>, location: STRUCT<display_name: STRING>, "
              "salary_min: DOUBLE, salary_max: DOUBLE, salary_is_predicted: STRING>>>",
    "workday": "STRUCT<jobPostings: ARRAY<STRUCT<title: STRING, externalPath: STRING, postedOn: STRING, "
               "locationsText: STRING, bulletFields: ARRAY<STRING>>>>",
}
LIST_FIELD = {"smartrecruiters": "content", "greenhouse": "jobs", "ashby": "jobs", "workable": "jobs",
              "arbeitnow": "data", "jobsch": "documents", "adzuna": "results", "workday": "jobPostings"}
BOARDS = {"arbeitnow", "jobsch", "adzuna"}
NO_PLACE = ["location negotiable", "multiple locations", "various"]


def _or(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _joined(*cols: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in cols])


def _tag(block: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(
        block, rf"(?s)<{name}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1), r"^\s+|\s+$", "")


def _blocks(name: str) -> Callable[[Column], Column]:
    """The texts between an opening and a closing tag, as an array."""
    return lambda payload: F.regexp_extract_all(payload, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def _json(provider: str) -> Callable[[Column], Column]:
    """The list of postings in a JSON payload, as an array of structs."""
    field = LIST_FIELD.get(provider)

    def items(payload: Column) -> Column:
        parsed = F.from_json(payload, PAYLOADS[provider])
        return parsed[field] if field else parsed
    return items


def _host_path(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *parts)


def smartrecruiters(p: Column, as_of: Column) -> dict[str, Column]:
    return {"title": p["name"], "external_id": p["id"],
            "url": _host_path("https://jobs.smartrecruiters.com/", F.col("target"), F.lit("/"), p["id"]),
            "location": _joined(p["location"]["city"], p["location"]["region"], p["location"]["country"]),
            "posted": from_any(_or(p["releasedDate"], p["createdOn"]))}


def successfactors(p: Column, as_of: Column) -> dict[str, Column]:
    return {"title": clean_html(_tag(p, "title")), "url": _tag(p, "link"), "location": _tag(p, "location"),
            "external_id": F.substring_index(_tag(p, "link"), "/", -1), "posted": from_any(_tag(p, "pubDate")),
            "description": clean_html(_tag(p, "description"))}


def greenhouse(p: Column, as_of: Column) -> dict[str, Column]:
    # the first publication, never the last edit first
    return {"title": p["title"], "url": p["absolute_url"], "location": p["location"]["name"],
            "external_id": p["id"], "posted": from_any(_or(p["first_published"], p["updated_at"]))}


def lever(p: Column, as_of: Column) -> dict[str, Column]:
    return {"title": p["text"], "url": p["hostedUrl"], "location": p["categories"]["location"],
            "external_id": p["id"], "posted": from_any(p["createdAt"]), "description": p["descriptionPlain"]}


def ashby(p: Column, as_of: Column) -> dict[str, Column]:
    remote = F.when(p["isRemote"], " remote").otherwise(F.lit(""))
    return {"title": p["title"], "url": _or(p["jobUrl"], p["applyUrl"]), "external_id": p["id"],
            "location": F.concat(F.coalesce(p["location"], F.lit("")), remote),
            "posted": from_any(_or(p["publishedAt"], p["updatedAt"])),
            "description": clean_html(_or(p["descriptionHtml"], p["descriptionPlain"])),
            "salary_hint": p["compensation"]}


def personio(p: Column, as_of: Column) -> dict[str, Column]:
    values = F.regexp_extract_all(p, F.lit(r"(?s)<value>(.*?)</value>"), F.lit(1))
    return {"title": clean_html(_tag(p, "name")), "external_id": _tag(p, "id"), "location": _tag(p, "office"),
            "url": _host_path("https://", F.col("target"), F.lit(".jobs.personio.de/job/"), _tag(p, "id")),
            "description": F.array_join(F.transform(values, clean_html), " ")}


def workable(p: Column, as_of: Column) -> dict[str, Column]:
    return {"title": p["title"], "url": _or(p["url"], p["application_url"]), "external_id": p["shortcode"],
            "location": _joined(p["city"], p["country"]), "description": clean_html(p["description"]),
            "posted": from_any(_or(p["published_on"], p["created_at"]))}


def arbeitnow(p: Column, as_of: Column) -> dict[str, Column]:
    def words(a: Column) -> Column:
        return F.coalesce(F.array_join(a, " "), F.lit(""))
    return {"title": p["title"], "company": _or(p["company_name"], F.lit("Unknown")), "url": p["url"],
            "location": p["location"], "external_id": p["slug"], "posted": from_any(p["created_at"]),
            "description": clean_html(p["description"]),
            "tags": F.concat(words(p["tags"]), F.lit(" "), words(p["job_types"]))}


def jobsch(p: Column, as_of: Column) -> dict[str, Column]:
    href = _or(*[p["_links"][f"detail_{lang}"]["href"] for lang in ("en", "de", "fr")])
    url = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit("https://www.jobs.ch"), href)).otherwise(
        F.coalesce(href, _host_path("https://www.jobs.ch/en/vacancies/detail/", p["job_id"], F.lit("/"))))
    regions = F.array_join(F.filter(F.transform(p["regions"], lambda r: r["name"]),
                                    lambda n: n.isNotNull() & (n != "")), ", ")
    return {"title": p["title"], "company": _or(p["company_name"], F.lit("Unknown")), "url": url,
            "location": _or(_joined(F.trim(p["place"]), regions), F.lit("Switzerland")),
            "external_id": p["job_id"], "posted": from_any(p["publication_date"]),
            "description": clean_html(p["preview"]),
            "structured": F.struct(p["language_skills"].alias("language_skills"))}


def adzuna(p: Column, as_of: Column) -> dict[str, Column]:
    stated = (p["salary_min"] > 0) & ~p["salary_is_predicted"].eqNullSafe(F.lit("1"))
    high = F.when(p["salary_max"] > 0, p["salary_max"]).otherwise(p["salary_min"])
    hint = F.concat(F.bround(p["salary_min"]).cast("long").cast("string"), F.lit("-"),
                    F.bround(high).cast("long").cast("string"), F.lit(" EUR per year"))
    return {"title": p["title"], "company": _or(p["company"]["display_name"], F.lit("Unknown")),
            "url": p["redirect_url"], "external_id": p["id"], "posted": from_any(p["created"]),
            "location": _or(p["location"]["display_name"], F.upper("target")),
            "description": clean_html(p["description"]), "salary_hint": F.when(stated, hint)}


def workday(p: Column, as_of: Column) -> dict[str, Column]:
    path = F.coalesce(p["externalPath"], F.lit(""))
    bullets = F.transform(F.filter(p["bulletFields"], lambda b: b.isNotNull() & (b != "")), lambda b: F.trim(b))
    slug = F.when(F.startswith(path, F.lit("/job/")) & (F.size(F.split(path, "/")) > 2),
                  F.trim(F.replace(F.get(F.split(path, "/"), 2), F.lit("-"), F.lit(" "))))
    place = F.coalesce(_or(F.get(bullets, 1), p["locationsText"], slug), F.lit(""))
    return {"title": p["title"], "url": F.concat(F.col("target"), path),
            "location": F.when(F.lower(place).isin(NO_PLACE), F.lit("")).otherwise(place),
            "external_id": _or(F.get(bullets, 0), path), "posted": from_relative(p["postedOn"], as_of)}


@dataclass(frozen=True)
class Source:
    items: Callable[[Column], Column]
    fields: Callable[[Column, Column], dict[str, Column]]


REGISTRY: dict[str, Source] = {
    **{f.__name__: Source(_json(f.__name__), f) for f in (
        smartrecruiters, greenhouse, lever, ashby, workable, arbeitnow, jobsch, adzuna, workday)},
    "successfactors": Source(_blocks("item"), successfactors),
    "personio": Source(_blocks("position"), personio),
}


PLACE_BITS = 20  # a payload holds fewer than 2**20 postings
EMPTY_TEXT = {"description", "tags", "salary_hint", "location", "title", "url", "external_id"}


def _sighting(provider: str, p: Column, as_of: Column) -> Column:
    """One posting of a payload as a sighting struct; missing text is '', missing facts NULL."""
    fields = REGISTRY[provider].fields(p, as_of)
    if provider in BOARDS:  # a board names the employer itself and never carries a tier
        fields["tier"] = F.lit("normal")
    out = []
    for f in SIGHTING.fields:
        col = fields.get(f.name)
        if col is None:
            col = F.lit("") if f.name in EMPTY_TEXT else F.lit(None)
            if f.name in ("target", "company", "tier", "provider", "seq"):
                col = F.col(f.name)
        elif f.name in EMPTY_TEXT:
            col = F.coalesce(col, F.lit(""))
        out.append(col.cast(STRUCTURED if f.name == "structured" else f.dataType).alias(f.name))
    return F.struct(*out)


def normalize_all(raw: DataFrame, as_of: Column, providers=None) -> DataFrame:
    """Sightings of all sources in one pass over the payloads (batch or stream).

    Each row takes the branch of its own source, so the landing table is read
    once and not once per source.  Arrival order is the payload's ``seq``, then
    the place in the payload; both make up the sighting's unique ``seq``.
    """
    branches = None
    for name in providers or REGISTRY:
        if name not in REGISTRY:
            raise ValueError(f"unknown source {name!r}")
        here, rows = F.col("provider") == name, _rows(name, as_of)
        branches = F.when(here, rows) if branches is None else branches.when(here, rows)
    # outer plus a test of the place: a plain explode also filters on its array,
    # which would take every payload apart twice
    rows = raw.select(F.posexplode_outer(branches).alias("pos", "s")).filter("pos IS NOT NULL").select("s.*", "pos")
    place = F.when(F.col("pos") < 1 << PLACE_BITS, F.col("pos")).otherwise(
        F.raise_error(F.lit("a payload holds too many postings for the numbering")).cast("int"))
    return rows.withColumn("seq", F.shiftleft("seq", PLACE_BITS) + place).drop("pos")


def _rows(name: str, as_of: Column) -> Column:
    return F.transform(REGISTRY[name].items(F.col("payload")), lambda p: _sighting(name, p, as_of))


def normalize(raw: DataFrame, provider: str, as_of: Column) -> DataFrame:
    """Sightings of one source."""
    return normalize_all(raw.filter(F.col("provider") == provider), as_of, [provider])


def quarantine(raw: DataFrame) -> DataFrame:
    """Payloads of a JSON source that do not parse, kept for a later look."""
    bad = F.lit(False)
    for name, schema in PAYLOADS.items():
        bad = bad | ((F.col("provider") == name) & F.from_json(F.col("payload"), schema).isNull())
    return raw.filter(bad | ~F.col("provider").isin(list(REGISTRY)))


def detail_text(details: DataFrame) -> DataFrame:
    """``provider, external_id, text`` from detail payloads."""
    body = F.col("payload")
    sections = F.from_json(body, "STRUCT<jobAd: STRUCT<sections: MAP<STRING, STRUCT<text: STRING>>>>")
    parts = F.filter(F.transform(F.map_values(sections["jobAd"]["sections"]),
                                 lambda s: clean_html(s["text"])), lambda t: t != "")
    text = (F.when(F.col("provider") == "smartrecruiters", F.array_join(parts, "\n\n"))
            .when(F.col("provider") == "greenhouse", clean_html(F.get_json_object(body, "$.content")))
            .when(F.col("provider") == "workday",
                  clean_html(F.get_json_object(body, "$.jobPostingInfo.jobDescription"))))
    return details.select("provider", "external_id", F.coalesce(text, F.lit("")).alias("text"))
