"""Letters as rows: the best paragraphs for each job, and the text around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.terms import lookup
from ..profile import DEFAULT, Profile


def _substrings(c: Column) -> Column:
    """Every part of a short term."""
    n = F.length(c)
    return F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(c, i, k)))))


def tag_scores(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """(term, tag, exact): pairs of a wanted term and a tag that are equal or of which one contains the other.

    Found by equi-joins on the parts of the terms and of the tags, never by comparing all with all.
    """
    term = wanted.select("term").filter("term <> ''").distinct()
    tag = tags.select("tag").filter("tag <> ''").distinct()
    inside = term.select("term", _substrings(F.col("term")).alias("tag")).distinct().join(tag, "tag")
    around = tag.select("tag", _substrings(F.col("tag")).alias("term")).distinct().join(term, "term")
    both = inside.select("term", "tag").union(around.select("term", "tag")).distinct()
    return both.select("term", "tag", (F.col("term") == F.col("tag")).alias("exact"))


def wanted_terms(skills: Column, domains: Column, category: Column) -> Column:
    named = F.when(F.coalesce(category, F.lit("")) != "", F.array(F.lower(category))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(skills, domains, named), F.lower))


def pick(jobs: DataFrame, paragraphs: DataFrame, how_many: int = 3, key: str = "id") -> DataFrame:
    """Adds ``chosen``: the ids of the best paragraphs ``(pid, tags, text, ord)``, always as many as asked for.

    A paragraph scores by the tags that are wanted terms, else half a point per tag and term of which
    one contains the other; ties go by ``ord``.  Paragraphs with the same tags score alike, so only
    the first ``how_many`` of them can be chosen, and jobs meet tag lists, not paragraphs.
    """
    book = paragraphs.select("pid", "ord", F.transform("tags", F.lower).alias("tags"))
    same = W.partitionBy("tags").orderBy("ord", "pid")
    first = book.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= how_many).drop("_n")
    lists = first.select("tags").distinct().withColumn("list", F.xxhash64("tags"))
    tags = lists.select("list", F.explode("tags").alias("tag"))
    wanted = jobs.select(F.col(key).alias("_key"), F.explode(wanted_terms(
        F.col("skills"), F.col("domains"), F.col("role_category"))).alias("term"))
    hits = (wanted.join(tag_scores(wanted, tags), "term").join(tags, "tag").groupBy("_key", "list").agg(
        F.countDistinct(F.when(F.col("exact"), F.col("tag"))).alias("equal"), (0.5 * F.count(F.lit(1))).alias("loose")))
    scored = hits.select("_key", "list", F.when(F.col("equal") > 0, F.col("equal").cast("double")).otherwise(F.col("loose")).alias("score"))
    best = W.partitionBy("_key").orderBy(F.desc("score"), "ord", "pid")
    named = (scored.join(first.withColumn("list", F.xxhash64("tags")), "list").withColumn("_n", F.row_number().over(best))
             .filter(F.col("_n") <= how_many).groupBy("_key")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "pid"))), lambda x: x["pid"]).alias("_named")))
    rest = F.array(*[F.lit(r["pid"]) for r in paragraphs.orderBy("ord", "pid").limit(how_many).collect()]).cast("array<string>")
    named_or_none = F.coalesce("_named", F.array().cast("array<string>"))
    out = jobs.join(named, jobs[key] == named["_key"], "left").withColumn(
        "chosen", F.slice(F.concat(named_or_none, F.array_except(rest, named_or_none)), 1, how_many))
    return out.drop("_key", "_named")


def skills_line(skills: Column) -> Column:
    pretty = F.transform(F.slice(skills, 1, 7), lambda s: F.coalesce(
        lookup(s, V.SPELLING), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))))
    n = F.size(pretty)
    listed = F.when(n > 1, F.concat(F.array_join(F.slice(pretty, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "),
                                    F.lit(" and "), F.element_at(pretty, -1))).otherwise(F.array_join(pretty, ""))
    return F.when(n > 0, F.concat(F.lit("You ask for "), listed, F.lit("; I use these at work."))).otherwise(
        F.lit("My daily tools are Python, SQL and Spark."))


def letters(jobs: DataFrame, paragraphs: DataFrame, frame: str, as_of: Column, profile: Profile = DEFAULT) -> DataFrame:
    """Draft letter, job description and checklist for every new job above the draft line."""
    df = pick(jobs.filter(F.col("is_new") & (F.col("score") >= profile.draft_min_score)), paragraphs)
    body = (df.select("id", F.posexplode("chosen").alias("_at", "pid")).join(paragraphs.select("pid", "text"), "pid")
            .groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]),
                                            "\n\n").alias("_bullets")))
    df = df.join(body, "id", "left")
    bullets = F.coalesce("_bullets", F.lit(""))
    place = F.coalesce(F.col("location_raw"), F.lit(""))
    values = {
        "{{DATE}}": F.date_format(as_of, "dd MMMM yyyy"), "{{ROLE}}": F.col("title"),
        "{{COMPANY}}": F.col("company_name"),
        "{{LOCATION_LINE}}": F.when(place != "", F.concat(F.lit(" — "), place)).otherwise(F.lit("")),
        "{{GRADUATION}}": F.lit(profile.available_from), "{{NAME}}": F.lit(profile.name),
        "{{EMAIL}}": F.lit(profile.email), "{{BULLETS}}": bullets, "{{SKILLS_LINE}}": skills_line(F.col("skills")),
    }
    letter = F.lit(frame)
    for mark, value in values.items():
        letter = F.replace(letter, F.lit(mark), value)
    posting = F.concat_ws("\n", "title", "company_name", place,
                          F.concat(F.lit("Posted: "), F.coalesce(F.col("posted_at").cast("string"), F.lit("unknown"))),
                          F.concat(F.lit("Source: "), "source"), F.lit(""), "url", F.lit(""),
                          F.coalesce(F.nullif("description", F.lit("")), F.lit("(not captured)")))
    return df.select(F.col("id").alias("job_id"), as_of.alias("drafted_on"), letter.alias("letter"),
                     posting.alias("job_description"), F.col("chosen").alias("paragraphs"))
