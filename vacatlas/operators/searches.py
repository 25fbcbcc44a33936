"""Stored searches as a table: any number of them looked up by the jobs that satisfy them.

A search is a row with the fields of ``listing.JobQuery``; null and false fields do not filter.  Each has
several *ways in*, every one a condition that all its jobs meet: an equal value, a run of three characters
that its text term holds, a band of scores, ages or pay, or being visible at all.  Jobs are listed under
the keys that some search asks for, the counts tell which way in of a search is the narrowest, and only
jobs under that key are tested against the search's remaining conditions.

``matches`` gives the pairs; ``results`` needs only counts and first rows, so it never makes them.

The plan is the same for five searches and for five thousand.  Pairs follow the narrowest keys, so they
stay near the matches; a key with a large share of the jobs is a join key that Spark may split.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import constant_map
from ..plans.scale import cut_lineage
from ..profile import DEFAULT, Profile
from .listing import JobQuery, ordering
from .text_index import runs

EQUAL = {"tier": "company_tier", "status": "status", "language": "language_requirement", "source": "source",
         "seniority": "seniority", "remote": "remote_policy", "category": "role_category"}
SCHEMA = T.StructType([
    T.StructField("search", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in ("q", "domain", "company", "city", "country", *EQUAL)],
    *[T.StructField(n, T.IntegerType()) for n in ("min_score", "max_age_days", "salary_min")],
    *[T.StructField(n, T.BooleanType()) for n in ("only_new", "only_starred", "only_clean", "include_hidden", "include_closed")]])
#: Width and number of the bands of scores, ages in days, and pay.
SCORES, AGES, PAYS = (10, 10), (7, 60), (10_000, 50)
#: Jobs of a block, one bit each, blocks of a span, and searches of a part that one task answers for a span.
BLOCK, SPAN, PART = 1 << 16, 64, 300_000
#: Different conditions whose bits a task keeps at a time.
KEPT = 1 << 14
_KEY = "struct<field:string,value:string>"


def stored(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    """Search rows from filter documents; unknown keys are refused."""
    rows = [{**JobQuery.from_dict(d).as_dict(), "search": n} for n, d in documents.items()]
    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA)


def _key(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))


def _band(value: Column, band: tuple[int, int]) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(value / band[0]), F.lit(band[1])))


def _prepared(searches: DataFrame, profile: Profile) -> DataFrame:
    """Terms in lower case, blanks trimmed; empty ones do not filter."""
    strip = lambda c: F.nullif(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), F.lit(""))
    full = searches.select("search", *[F.col(f.name).cast(f.dataType) if f.name in searches.columns
                                       else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA[1:]])
    terms = constant_map({k.lower(): v for k, v in profile.country_terms.items()}) if profile.country_terms else None
    known = F.try_element_at(terms, F.lower("country")) if terms is not None else F.lit(None).cast("array<string>")
    return full.withColumns({
        "q": strip(F.col("q")), **{n: F.nullif(F.lower(n), F.lit("")) for n in ("domain", "company", "city")},
        **{n: F.nullif(F.col(n), F.lit("")) for n in EQUAL if n != "tier"}, "tier": F.nullif(F.lower("tier"), F.lit("")),
        "_places": F.when(F.size(known) > 0, known), "country": F.upper("country"),
        **{f.name: F.coalesce(f.name, F.lit(False)) for f in SCHEMA if f.dataType == T.BooleanType()}})


def _ways(s: DataFrame) -> DataFrame:
    """(search, way, field, value): a search's jobs are all listed under the keys of each of its ways."""
    c = F.col
    none = F.array().cast(f"array<{_KEY}>")

    def way(name: str, *keys: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("way"), F.array(*keys).alias("keys")))

    def band(name: str, first: Column, last: Column) -> Column:
        return F.struct(F.lit(name).alias("way"), F.transform(F.sequence(first, last), lambda b: _key(name, b)).alias("keys"))

    simple = [way(n, _key(col, c(n)), when=c(n).isNotNull()) for n, col in EQUAL.items()]
    simple += [way(n, _key(n, F.lit(True)), when=c(n)) for n in ("only_new", "only_starred", "only_clean")]
    low = lambda v: F.lit(v).cast("bigint")
    simple += [F.when(c("min_score").isNotNull(), band("score", _band(c("min_score"), SCORES), low(SCORES[1]))),
               F.when(c("max_age_days").isNotNull(), band("age", low(0), _band(c("max_age_days"), AGES))),
               F.when(c("salary_min").isNotNull(), band("pay", _band(c("salary_min"), PAYS), low(PAYS[1])))]
    scope = F.filter(F.array(*[F.when(ok, _key("scope", F.lit(v))) for v, ok in (
        ("open shown", F.lit(True)), ("closed shown", c("include_closed")), ("open hidden", c("include_hidden")),
        ("closed hidden", c("include_closed") & c("include_hidden")))]), lambda k: k.isNotNull())
    simple.append(F.struct(F.lit("scope").alias("way"), scope.alias("keys")))
    # every run of three characters of a term is a way by itself
    found = [F.transform(F.coalesce(runs(c(n)), F.array().cast("array<string>")), lambda r: F.struct(
        F.concat(F.lit(n + " "), r).alias("way"), F.array(_key(f, r)).alias("keys")))
        for n, f in (("q", "text"), ("domain", "text"), ("company", "employer"), ("city", "place"))]
    ways = F.concat(F.array_compact(F.array(*simple)), *found)
    return (s.select("search", F.inline(ways)).select("search", "way", F.inline(F.coalesce("keys", none))).distinct())


def _listed(jobs: DataFrame, as_of: Column) -> DataFrame:
    """(id, field, value): every key that a job is listed under."""
    c = F.col
    scope = F.concat(F.when(c("is_open"), "open").otherwise("closed"), F.when(c("hidden"), " hidden").otherwise(" shown"))
    keys = [F.when(c(col).isNotNull(), _key(col, c(col))) for col in EQUAL.values()]
    keys += [F.when(ok, _key(n, F.lit(True))) for n, ok in (("only_new", c("is_new")), ("only_starred", c("starred")), ("only_clean", ~c("has_flags")))]
    keys += [F.when(v.isNotNull(), _key(n, _band(v, b))) for n, v, b in (
        ("score", c("score"), SCORES), ("age", F.datediff(as_of, c("posted_at")), AGES), ("pay", c("salary_annual_eur_min"), PAYS))]
    keys.append(_key("scope", scope))
    text = lambda *names: F.lower(F.concat_ws("\n", *[F.coalesce(c(n), F.lit("")) for n in names]))
    found = [F.transform(F.coalesce(runs(t), F.array().cast("array<string>")), lambda r: _key(f, r)) for f, t in (
        ("text", text("search_blob")), ("employer", text("company_name")), ("place", text("city", "location_raw")))]
    return jobs.select("id", F.inline(F.concat(F.array_compact(F.array(*keys)), *found)))


def _holding(as_of: Column) -> Column:
    """Whether a job meets every condition of a search; columns of the search are under ``s``."""
    c, s = F.col, lambda n: F.col(f"s.{n}")
    unset = lambda n, cond: s(n).isNull() | cond
    lower = lambda n: F.lower(F.coalesce(c(n), F.lit("")))
    tests = [s("include_closed") | c("is_open"), s("include_hidden") | ~c("hidden"), ~s("only_new") | c("is_new"),
             ~s("only_starred") | c("starred"), ~s("only_clean") | ~c("has_flags"),
             *[unset(n, c(col) == s(n)) for n, col in EQUAL.items()],
             unset("company", F.contains(lower("company_name"), s("company"))),
             unset("city", F.contains(lower("city"), s("city")) | F.contains(lower("location_raw"), s("city"))),
             unset("domain", F.contains(lower("search_blob"), s("domain"))), unset("q", F.contains(c("search_blob"), s("q"))),
             unset("min_score", c("score") >= s("min_score")),
             unset("salary_min", c("salary_annual_eur_min") >= s("salary_min").cast("double")),
             unset("max_age_days", c("posted_at") >= F.date_sub(as_of, s("max_age_days"))),
             unset("_places", (c("country") == s("country")) | F.exists(s("_places"), lambda t: F.contains(c("search_blob"), t)))]
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), tests, F.lit(True))


def matches(jobs: DataFrame, companies: DataFrame, searches: DataFrame, as_of: Column, profile: Profile = DEFAULT) -> DataFrame:
    """(search, id and the columns of the orders) for every job that satisfies a search.  Ids and names are unique."""
    # the tier of a registered employer; the others have none, as in listing.find
    jobs = jobs.join(companies.select(F.col("id").alias("company_id"), F.col("tier").alias("company_tier")), "company_id", "left")
    s = cut_lineage(_prepared(searches, profile))
    ways = cut_lineage(_ways(s))
    asked = ways.select("field", "value").distinct()
    listed = cut_lineage(_listed(jobs, as_of).join(asked, ["field", "value"]))
    often = listed.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    cost = ways.join(often, ["field", "value"], "left").groupBy("search", "way").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    best = cost.groupBy("search").agg(F.min(F.struct("cost", "way")).alias("b")).select("search", F.col("b.way").alias("way"))
    chosen = ways.join(best, ["search", "way"]).select("search", "field", "value")
    pairs = chosen.join(listed, ["field", "value"]).select("search", "id").distinct()
    full = s.select("search", F.struct(*[c for c in s.columns if c != "search"]).alias("s"))
    own = jobs.select("id", *[c for c in (
        "is_open", "hidden", "is_new", "starred", "has_flags", *EQUAL.values(), "company_name", "city", "location_raw", "search_blob",
        "score", "salary_annual_eur_min", "posted_at", "country", "first_seen_at")])
    return pairs.join(own, "id").join(full, "search").filter(_holding(as_of)).drop("s")


def _conditions(s: DataFrame, as_of: Column) -> DataFrame:
    """(search, conditions): what a search asks of a job, as (field, value) pairs in text form."""
    c = F.col

    def asked(field: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), value.cast("string").alias("value")))

    some = [asked(n, F.lit(""), ~c(by)) for n, by in (("is_open", "include_closed"), ("shown", "include_hidden"))]
    some += [asked(n, F.lit(""), c(by)) for n, by in (("is_new", "only_new"), ("starred", "only_starred"), ("clean", "only_clean"))]
    some += [asked(n, c(n), c(n).isNotNull()) for n in (*EQUAL, "q", "domain", "company", "city", "min_score", "salary_min")]
    since = F.unix_date(F.date_sub(as_of, c("max_age_days")))
    some += [asked("since", since, since.isNotNull()),
             asked("places", F.to_json(F.struct("country", "_places")), c("_places").isNotNull())]
    return s.filter(c("search").isNotNull()).select("search", F.array_compact(F.array(*some)).alias("conditions"))


_TOP = pa.struct([("pos", pa.int64()), ("id", pa.string())])
_ANSWER = pa.schema([("search", pa.string()), ("n", pa.int64()), ("top", pa.list_(_TOP))])


def _block(jobs: pa.Table) -> pa.Table:
    """(span, block, jobs): the jobs of a block in their order as one value, column by column and compressed."""
    span, block = (jobs.column(n)[0].as_py() for n in ("span", "block"))
    jobs = jobs.sort_by("pos").combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, jobs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(jobs)
    return pa.table({"span": pa.array([span], pa.int64()), "block": pa.array([block], pa.int64()), "jobs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _holds(jobs: pa.Table, field: str, value: str) -> pa.ChunkedArray:
    """Which of the jobs meet one condition."""
    if field in EQUAL:
        return pc.equal(jobs.column(EQUAL[field]), value)
    if field == "q":
        return pc.match_substring(jobs.column("search_blob"), value)
    if field in ("domain", "company"):
        return pc.match_substring(jobs.column("blob" if field == "domain" else "company"), value)
    if field == "city":
        return pc.or_(pc.match_substring(jobs.column("city"), value), pc.match_substring(jobs.column("place"), value))
    if field == "min_score":
        return pc.greater_equal(jobs.column("score"), int(value))
    if field == "since":
        return pc.greater_equal(jobs.column("posted"), int(value))
    if field == "salary_min":  # a pay that is no number is above every other, as in Spark
        pay = jobs.column("pay")
        return pc.or_(pc.greater_equal(pay, float(value)), pc.is_nan(pay))
    if field == "places":
        place = json.loads(value)
        found = [pc.match_substring(jobs.column("search_blob"), t) for t in place["_places"]]
        return reduce(pc.or_kleene, found, pc.equal(jobs.column("country"), place.get("country")))
    return jobs.column(field)


def _asked(conditions: pa.ListArray) -> tuple[list[tuple[str, str]], list[tuple[int, ...]]]:
    """The different (field, value) conditions, and those of every search by their numbers."""
    flat = conditions.flatten()
    field, value = (flat.field(n).dictionary_encode() for n in ("field", "value"))
    code = field.indices.to_numpy().astype(np.int64) * max(1, len(value.dictionary)) + value.indices.to_numpy()
    own, number = np.unique(code, return_inverse=True)
    fields, values = field.dictionary.to_pylist(), value.dictionary.to_pylist()
    known = [(fields[x // len(values)], values[x % len(values)]) for x in own.tolist()]
    ends = np.cumsum(pc.list_value_length(conditions).to_numpy())
    return known, [tuple(sorted(set(number[a:b].tolist()))) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]


def _answers(blocks: pa.Table, asked: pa.Table, first: int) -> pa.Table:
    """(search, n, top): how many jobs of the blocks each search finds, and the first of them as (pos, id).

    Every different condition is tested on all the jobs of a block and kept as one bit per job; a search is the
    intersection of its conditions' bits, and searches with the same conditions are answered together.
    """
    if not blocks.num_rows or not asked.num_rows:
        return pa.table([pa.array([], t) for t in _ANSWER.types], schema=_ANSWER)
    conditions, of = _asked(asked.column("conditions").combine_chunks())
    groups = {own: k for k, own in enumerate(dict.fromkeys(of))}
    counts, held = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
    top: list[list] = [[], [], []]

    def bits(mask: np.ndarray) -> np.ndarray:
        packed = np.packbits(mask, bitorder="little")
        return np.append(packed, np.zeros(-len(packed) % 8, np.uint8)).view("<u8")

    for raw in blocks.sort_by("block").column("jobs"):
        jobs = pa.ipc.open_stream(raw.as_buffer()).read_all()
        every, known, whose, places = bits(np.ones(jobs.num_rows, bool)), {}, [], []
        for own, k in groups.items():
            left = every
            for x in own:
                if x not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[x] = bits(pc.fill_null(_holds(jobs, *conditions[x]), False).to_numpy().astype(bool))
                left = left & known[x]
            count = int(np.bitwise_count(left).sum())
            counts[k] += count
            more = first - int(held[k])
            if count and more > 0:
                at = np.flatnonzero(left)[:more]  # a word that is not 0 holds one job at least
                inside = np.flatnonzero(np.unpackbits(left[at].view(np.uint8), bitorder="little"))[:more]
                places.append(at[inside >> 6] * 64 + (inside & 63))
                whose.append(np.full(len(inside), k))
                held[k] += len(inside)
        if places:
            at = np.concatenate(places)
            for x, own in zip(top, (np.concatenate(whose), jobs.column("pos").to_numpy()[at], jobs.column("id").take(pa.array(at))), strict=True):
                x.append(own)
    # the first rows of a group stand together, in the order of the blocks
    whose, pos = (np.concatenate([np.zeros(0, np.int64), *x]) for x in top[:2])
    order = np.argsort(whose, kind="stable")
    ids = pa.chunked_array([y for x in top[2] for y in x.chunks], pa.string()).take(pa.array(order)).combine_chunks()
    rows = pa.StructArray.from_arrays([pa.array(pos[order]), ids], fields=list(_TOP))
    tops = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), rows)
    number = np.array([groups[x] for x in of])
    names, some = asked.column("search").combine_chunks(), np.flatnonzero(counts[number])
    return pa.table([names.take(pa.array(some)), pa.array(counts[number[some]]), tops.take(pa.array(number[some]))], schema=_ANSWER)


def results(jobs: DataFrame, companies: DataFrame, searches: DataFrame, as_of: Column, per_search: int = 100,
            order: str = "newest", profile: Profile = DEFAULT) -> DataFrame:
    """``search, id, rank, matches``: the first rows of every search and how many jobs it has in all.

    Jobs are dealt into blocks in the order asked for, each one value of compressed columns, and blocks into spans;
    every part of the searches meets every span in a task of its own, where a job is a bit.  A span answers a search
    with a count and its first rows, so no pair of search and job is ever a row, however many jobs a search finds; a
    search is sent once for SPAN blocks, a block once for PART searches.
    """
    c = F.col
    jobs = jobs.filter("id IS NOT NULL").join(companies.select(c("id").alias("company_id"), c("tier").alias("company_tier")), "company_id", "left")
    lower = lambda n: F.lower(F.coalesce(c(n), F.lit("")))
    sure = lambda x: F.coalesce(x, F.lit(False))
    blocks, parts = -(-jobs.count() // BLOCK) or 1, -(-searches.count() // PART) or 1
    ordered = jobs.repartitionByRange(blocks, *ordering(order)).sortWithinPartitions(*ordering(order)).select(
        F.monotonically_increasing_id().alias("pos"), "id", *EQUAL.values(), "country", "search_blob",
        lower("search_blob").alias("blob"), lower("company_name").alias("company"), lower("city").alias("city"), lower("location_raw").alias("place"),
        c("score").cast("long").alias("score"), c("salary_annual_eur_min").cast("double").alias("pay"),
        F.unix_date("posted_at").cast("long").alias("posted"), sure(c("is_open")).alias("is_open"), sure(~c("hidden")).alias("shown"),
        sure(c("is_new")).alias("is_new"), sure(c("starred")).alias("starred"), sure(~c("has_flags")).alias("clean"))
    ordered = cut_lineage(ordered)  # as written: positions stay as they are
    # the upper bits of a position are the number of the range that the job is in, of BLOCK jobs on average
    ordered = ordered.withColumns({"block": F.floor(c("pos") / BLOCK), "span": F.floor(F.shiftright("pos", 33) / SPAN)})
    asked = cut_lineage(_conditions(_prepared(searches, profile), as_of).withColumn("part", F.pmod(F.xxhash64("search"), F.lit(parts))))
    packed = cut_lineage(ordered.groupBy("block").applyInArrow(_block, "span long, block long, jobs binary"))
    # names of their own: the other side of the cogroup has the span's column, too
    every = asked.crossJoin(packed.select("span").distinct()).select("search", "conditions", c("span").alias("_span"), c("part").alias("_part"))
    whole = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = (whole.groupBy("span", "part").cogroup(every.groupBy("_span", "_part"))
             .applyInArrow(lambda j, s: _answers(j, s, per_search), "search string, n long, top array<struct<pos: long, id: string>>"))
    top = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, per_search)
    best = found.groupBy("search").agg(F.sum("n").alias("matches"), top.alias("top")).select("search", "matches", F.posexplode("top").alias("rank", "job"))
    return best.select("search", c("job.id").alias("id"), (c("rank") + 1).alias("rank"), "matches")
