"""Text to facts: one function per fact, each adding columns to a postings DataFrame.

Postings carry ``title, description, location, company, tier, posted`` and
optionally ``tags`` and ``structured``.  Every expression is a built-in one;
costly patterns sit behind a cheap ``contains`` test of the same text.
"""

from __future__ import annotations

import unicodedata
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import money, term_table, text as T
from ..functions.terms import TermIndex, any_of, canonical, first_hit, lookup, ordered
from ..plans.scale import once
from ..profile import DEFAULT, Profile
from ..schemas import STRUCTURED

UNICODE = "(?iU)"  # original spelling
LOWER = "(?U)"     # text that is lower case already


def with_optional(df: DataFrame) -> DataFrame:
    """Add the optional posting columns where a source does not have them."""
    extra = {}
    if "tags" not in df.columns:
        extra["tags"] = F.lit("")
    if "structured" not in df.columns:
        extra["structured"] = F.lit(None).cast(STRUCTURED)
    return df.withColumns(extra) if extra else df


LOWERED = {"_low_title": "title", "_low_text": "description"}


def lowered(step):
    """Give a step the lower-cased title and text; computed once when steps are chained."""
    @wraps(step)
    def run(df: DataFrame, *args) -> DataFrame:
        if "_low_text" in df.columns:
            return step(df, *args)
        return step(add_lowered(df), *args).drop(*LOWERED)
    return run


def add_lowered(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lower(F.coalesce(F.col(c), F.lit(""))) for k, c in LOWERED.items()})


def _low() -> Column:
    """Lower-cased title and text as one string."""
    return F.concat_ws("\n", "_low_title", "_low_text")


def _text(*names: str) -> Column:
    return F.concat_ws("\n", *[F.coalesce(F.col(n), F.lit("")) for n in names])


def _has_any(lowered: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lowered, F.lit(w))
    return out


def _first_rule(text: Column, rules, flags: str = LOWER) -> Column:
    """Name of the first rule whose pattern matches, NULL if none."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(flags + p)), F.lit(name))
                        for name, p in rules])


def _extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, group), F.lit(""))


# -- E01 --------------------------------------------------------------------
def _marker_pattern(markers) -> str:
    """One pattern for all markers.

    A closing blank is looked at but not consumed, so it can open the next word;
    a word repeated at once counts like two occurrences that share a blank do.
    """
    whole = "|".join(m.strip() for m in markers if m.endswith(" "))
    starts = "|".join(m.strip() for m in markers if not m.endswith(" "))
    return f" ({whole})(?= )(?: \\1(?= ))?| (?:{starts})"


@lowered
def posting_language(df: DataFrame) -> DataFrame:
    """'de', 'en' or 'unknown' by short-word counts; too short a text is unknown."""
    padded = F.when(F.length("_low_text") >= 120, F.concat(
        F.lit(" "), F.col("_low_text"), F.lit(" ")))
    df = once(df, {
        "_de": F.regexp_count(padded, F.lit(_marker_pattern(V.GERMAN_MARKERS))),
        "_en": F.regexp_count(padded, F.lit(_marker_pattern(V.ENGLISH_MARKERS)))})
    de, en = F.col("_de"), F.col("_en")
    return df.withColumn("posting_language", F.when((de == 0) & (en == 0), "unknown")
                         .when(de >= en * 1.5, "de").when(en >= de * 1.5, "en")
                         .otherwise("unknown")).drop("_de", "_en")


# -- E02, E03 ---------------------------------------------------------------
def _language_phrase(text: Column, level: Column) -> Column:
    out = None
    for name, patterns in V.LANGUAGE_RULES:
        phrase = F.coalesce(*[_extract(text, p) for p in patterns])
        out = F.when(level == name, phrase) if out is None else out.when(level == name, phrase)
    return out


def structured_language(structured: Column) -> Column:
    """Level from a source's own language list; deliberately no higher than B2."""
    skills = F.filter(structured["language_skills"],
                      lambda s: F.substring(F.lower(s["language"]), 1, 2) != "")

    def best(code: str) -> Column:
        mine = F.filter(skills, lambda s: F.substring(F.lower(s["language"]), 1, 2) == code)
        return F.when(F.size(mine) > 0, F.array_max(F.transform(
            mine, lambda s: F.greatest(F.coalesce(s["level"], F.lit(0)), F.lit(0)))))

    return (F.when(best("de") >= 3, "german_b2").when(best("de") == 2, "german_b1")
            .when(best("de").isNotNull(), "german_a1_a2")
            .when(best("en").isNotNull(), "english_preferred"))


@lowered
def language_requirement(df: DataFrame) -> DataFrame:
    """Strictest statement in the text; the structured list only where the text is silent."""
    df = with_optional(df)
    text = _text("title", "description")
    rules = [(name, "(?:" + "|".join(ps) + ")") for name, ps in V.LANGUAGE_RULES]
    german = [r for r in rules if r[0].startswith("german")]
    english = [r for r in rules if r[0].startswith("english")]
    level = F.coalesce(
        F.when(_has_any(_low(), ["german", "deutsch"]), _first_rule(_low(), german)),
        F.when(_has_any(_low(), ["englis"]), _first_rule(_low(), english)))
    df = once(df, {"_said": level, "_listed": structured_language(F.col("structured"))})
    df = once(df, {"language_phrase": _language_phrase(text, F.col("_said"))})
    listed = F.concat(F.lit("Listed by the source: "), F.array_join(F.array_sort(F.transform(
        F.col("structured.language_skills"),
        lambda s: F.concat(F.upper(F.substring(s["language"], 1, 2)), F.lit(" "), s["level"]))), ", "))
    evidence = (F.when(F.col("_said").isNotNull(),
                       T.find_evidence(text, F.col("language_phrase")))
                .when(F.col("_listed").isNotNull(), listed)
                .otherwise(F.lit("No language requirement stated")))
    return df.withColumns({
        "language_requirement": F.coalesce("_said", "_listed", F.lit("unclear")),
        "language_evidence": F.substring(evidence, 1, 400),
    }).drop("_said", "_listed")


# -- E04, E05 ---------------------------------------------------------------
def _ints(text: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                       lambda s: s.try_cast("int"))


@lowered
def years_required(df: DataFrame) -> DataFrame:
    """Smallest number of years asked for; the upper end only when it belongs to it."""
    text = F.col("_low_text")
    ranges = F.filter(
        F.zip_with(_ints(text, V.YEARS_RANGE, 1), _ints(text, V.YEARS_RANGE, 2),
                   lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))),
        lambda r: (r["lo"] <= r["hi"]) & (r["hi"] <= V.MAX_YEARS))
    singles = F.filter(F.concat(
        F.zip_with(_ints(text, V.YEARS_MINIMUM, 1), _ints(text, V.YEARS_MINIMUM, 2), lambda a, b: F.coalesce(a, b)),
        _ints(text, V.YEARS_PLAIN, 1)), lambda n: n <= V.MAX_YEARS)
    guard = _has_any(text, ["year", "yr", "jahr"]) & F.rlike(text, F.lit(
        r"\d\s*\+?\s*(?:years?|yrs?|jahre?n?)"))
    df = once(df, {"_ranges": F.when(guard, ranges), "_least": F.when(guard, F.array_min(singles))})
    lowest = F.array_min(F.transform("_ranges", lambda r: r["lo"]))
    df = df.withColumn("_first", F.get(F.filter("_ranges", lambda r: r["lo"] == lowest), 0))
    return df.withColumns({
        "experience_min_years": F.least(F.col("_first.lo"), F.col("_least")),
        "experience_max_years": F.col("_first.hi"),
    }).drop("_ranges", "_least", "_first")


@lowered
def seniority(df: DataFrame) -> DataFrame:
    """The title decides when it says something, otherwise the years do."""
    df = years_required(df)
    title, n = F.coalesce(F.col("title"), F.lit("")), F.col("experience_min_years")
    from_years = (F.when(n <= 1, "graduate").when(n <= 3, "junior")
                  .when(n <= 6, "mid").when(n.isNotNull(), "senior"))
    signal = F.coalesce(*[_extract(title, p) for _, p in V.SENIORITY_RULES])
    return df.withColumns({
        "seniority": F.coalesce(_first_rule(F.col("_low_title"), V.SENIORITY_RULES), from_years, F.lit("unknown")),
        "title_signal": F.trim(F.coalesce(signal, F.lit(""))),
    })


# -- E06 --------------------------------------------------------------------
_SEP, _SUB = "\x01", "\x02"


def _pieces(text: Column) -> Column:
    """The text cut at its pay phrases by one scan: gap, phrase, gap, phrase, ..., gap."""
    plain = F.translate(text, _SEP + _SUB, "  ")
    return F.split(F.regexp_replace(plain, LOWER + V.PAY_CONTEXT, _SEP + "$0" + _SEP), _SEP, -1)


def _window(k: Column) -> Column:
    """The neighbourhood of the phrase at place ``k`` of the pieces.

    Gaps are held by their beginnings and ends, so a window costs the same wherever it stands; a pay
    phrase has four letters or more, which bounds the pieces that a window can reach.
    """
    back, on = 2 * -(-V.PAY_WINDOW_BEFORE // 4) + 1, 2 * -(-V.PAY_WINDOW_AFTER // 4) + 1
    before = F.array_join(F.slice("_ends", F.greatest(F.lit(1), k - back + 1), F.least(k, F.lit(back))), "")
    after = F.array_join(F.slice("_starts", k + 2, F.lit(on)), "")
    return F.concat(F.right(before, F.lit(V.PAY_WINDOW_BEFORE)), F.get("_pieces", k), F.substring(after, 1, V.PAY_WINDOW_AFTER))


def _matches(window: Column, pattern: str, groups: int) -> Column:
    """Every match with all its groups, the whole match first, by one scan."""
    shown = _SEP + _SUB.join(f"${i}" for i in range(groups)) + _SEP
    parts = F.split(F.regexp_replace(window, UNICODE + pattern, shown), _SEP, -1)
    return F.transform(F.filter(parts, lambda p, i: i % 2 == 1), lambda p: F.split(p, _SUB, -1))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _offer(window: Column) -> Column:
    """The first plausible figure in one window: ranges first, then single amounts, as printed."""
    def currency(*tokens: Column) -> Column:
        return F.coalesce(*[lookup(F.lower(F.trim(t)), V.CURRENCY_TOKENS) for t in tokens])

    def priced(phrase: Column, unit: Column, lo: Column, hi: Column) -> Column:
        period = F.coalesce(_first_rule(window, V.PERIOD_RULES, UNICODE), F.lit("year"))
        read = F.struct(phrase.alias("phrase"), unit.alias("currency"), period.alias("period"), lo.alias("lo"), hi.alias("hi"))
        return _with(read, lambda o: F.struct(
            *[o[n].alias(n) for n in ("phrase", "currency", "period", "lo", "hi")],
            money.annual_eur(o["lo"], o["period"], o["currency"]).alias("eur_lo"),
            money.annual_eur(o["hi"], o["period"], o["currency"]).alias("eur_hi")))

    def first(offers: Column) -> Column:
        least, most = V.PAY_PLAUSIBLE
        return F.get(F.filter(offers, lambda o: o["currency"].isNotNull()
                              & o["eur_lo"].between(least, most) & o["eur_hi"].between(least, most)
                              & (o["eur_lo"] <= o["eur_hi"])), 0)

    ranges = F.transform(_matches(window, V.PAY_RANGE, 6), lambda m: priced(
        m[0], currency(m[1], m[3], m[5]), money.parse_amount(m[2]), money.parse_amount(m[4])))
    single = F.transform(_matches(window, V.PAY_SINGLE, 5), lambda m: _with(
        money.parse_amount(F.concat(m[2], m[3])), lambda n: priced(m[0], currency(m[1], m[4]), n, n)))
    return F.coalesce(first(ranges), first(single))


# every pay phrase contains one of these, so texts without them are never searched
PAY_WORDS = ["salar", "compensation", "remuneration", "pay", "package", "gehalt", "vergütung",
             "vergutung", "lohn", "brutto", "gross", "annual"]


@lowered
def salary(df: DataFrame) -> DataFrame:
    """Pay that the posting prints, with its yearly euro figure; nothing is ever estimated."""
    text = _text("title", "description")
    df = once(df, {"_pieces": F.when(_has_any(_low(), PAY_WORDS) & F.rlike(_low(), F.lit(r"\d")), _pieces(_low()))})
    even = lambda cut: lambda p, i: F.when(i % 2 == 0, cut(p)).otherwise(p)
    df = once(df, {
        "_starts": F.transform("_pieces", even(lambda p: F.substring(p, 1, V.PAY_WINDOW_AFTER))),
        "_ends": F.transform("_pieces", even(lambda p: F.right(p, F.lit(V.PAY_WINDOW_BEFORE))))})
    nothing = F.lit(None).cast("struct<phrase:string,currency:string,period:string,lo:double,hi:double,eur_lo:double,eur_hi:double>")
    # windows are looked at in text order, and no more once a figure is found
    df = once(df, {"_pay": F.when(F.size("_pieces") > 2, F.aggregate(
        F.sequence(F.lit(1), F.size("_pieces") - 2, F.lit(2)), nothing, lambda found, k: F.coalesce(
            found, _with(_window(k), lambda w: F.when(F.rlike(w, F.lit(r"\d")), _offer(w))))))})
    p = F.col("_pay")
    return df.withColumns({
        "salary_basis": F.when(p.isNotNull(), "explicit").otherwise("unknown"),
        "salary_min": p["lo"], "salary_max": p["hi"],
        "salary_currency": F.coalesce(p["currency"], F.lit("")),
        "salary_period": F.when(p.isNotNull(), p["period"]).otherwise(F.lit("")),
        "salary_annual_eur_min": p["eur_lo"], "salary_annual_eur_max": p["eur_hi"],
        "salary_evidence": F.substring(F.when(p.isNotNull(), T.find_evidence(text, p["phrase"]))
                                       .otherwise(F.lit("No salary stated")), 1, 400),
    }).drop("_pay", "_pieces", "_starts", "_ends")


# -- E07 --------------------------------------------------------------------
@lowered
def relevance(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """How surely a posting is in the field: 0 no, 1 possible, 2 likely, 3 certain."""
    df = with_optional(df)
    title = F.col("_low_title")
    body = F.concat_ws("\n", F.lower(F.coalesce(F.col("tags"), F.lit(""))), "_low_text")

    def title_hit(terms) -> Column:
        return F.nullif(F.regexp_extract(title, any_of(terms), 0), F.lit(""))

    def distinct_hits(terms) -> Column:
        return F.array_distinct(F.regexp_extract_all(body, F.lit(any_of(terms)), F.lit(0)))

    df = once(df, {
        "_out": title_hit(V.OUT_OF_FIELD_TITLE),
        "_certain": title_hit(V.CERTAIN_TITLE + list(profile.role_include)),
        "_adjacent": title_hit(V.ADJACENT_TITLE), "_generic": title_hit(V.GENERIC_TITLE)})
    # the body is only read where the title leaves the question open
    undecided = F.col("_out").isNull() & F.col("_certain").isNull()
    df = once(df, {
        "_strong": F.when(undecided, distinct_hits(V.STRONG_BODY)),
        "_support": F.when(undecided, F.size(distinct_hits(V.SUPPORTING_BODY)))})
    strong = F.least(F.size("_strong"), F.lit(V.TERM_COUNT_CAP))
    support = F.least(F.col("_support"), F.lit(V.TERM_COUNT_CAP))
    named = F.get("_strong", 0)
    cases = [  # condition, level, confidence, reason
        (F.col("_out").isNotNull(), 0, 0.0, F.lit("the title names another profession")),
        (F.col("_certain").isNotNull(), 3, 1.0, F.lit("the title names the field")),
        (F.col("_adjacent").isNotNull() & (strong >= 1), 2, 0.9,
         F.concat(F.lit("a neighbouring title, and the text names "), named)),
        (F.col("_adjacent").isNotNull() & (support >= 3), 1, 0.7,
         F.lit("a neighbouring title with technical detail")),
        (F.col("_adjacent").isNotNull(), 0, 0.0,
         F.concat(F.lit("only the title hints at the field: "), F.col("_adjacent"))),
        (F.col("_generic").isNotNull() & (strong >= 3), 2, 0.85,
         F.concat(F.lit("a general title, but the text is about "), named)),
        (F.col("_generic").isNotNull() & (strong >= 2) & (support >= 2), 1, 0.65,
         F.concat(F.lit("a general title with technical content: "), named)),
        (F.col("_generic").isNotNull(), 0, 0.0, F.lit("a general role without content of the field")),
        (strong >= 4, 1, 0.6, F.concat(F.lit("an unknown title, but the text is full of "), named)),
    ]
    out = F.struct(F.lit(0).alias("level"), F.lit(0.0).alias("confidence"),
                   F.lit("not in the field").alias("reason"))
    for cond, level, confidence, reason in reversed(cases):
        out = F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(confidence).alias("confidence"),
                                    reason.alias("reason"))).otherwise(out)
    df = once(df, {"_verdict": out})
    return df.withColumns({
        "relevance": F.col("_verdict.level"), "relevance_confidence": F.col("_verdict.confidence"),
        "relevance_reason": F.col("_verdict.reason"),
    }).drop("_out", "_certain", "_adjacent", "_generic", "_strong", "_support", "_verdict")


# -- E08, E09, E17 ----------------------------------------------------------
def _plain(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", term.lower())
                   if not unicodedata.combining(c))


def place_hits(location: Column, profile: Profile) -> Column:
    """Every configured place named in a location, by one pass over it."""
    groups = [*profile.location_tiers.values(), *profile.country_terms.values(),
              profile.location_exclude]
    index = TermIndex([_plain(t) for g in groups for t in g], word="a-z", flexible=False)
    return index.hits(T.strip_accents(F.lower(F.coalesce(location, F.lit("")))))


def _tier_terms(profile: Profile) -> list[tuple[str, int]]:
    tiers = sorted(profile.location_tiers.items(), key=lambda kv: -kv[0])
    return list({_plain(t): (_plain(t), points)
                 for points, ts in reversed(tiers) for t in reversed(ts)}.values())[::-1]


def location(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """City, country, and points of the best configured place."""
    raw = F.coalesce(F.col("location"), F.lit(""))
    tiers = _tier_terms(profile)
    codes: dict[str, str] = {}
    for code, terms in profile.country_terms.items():
        for t in terms:
            codes.setdefault(_plain(t), code.upper())
    df = once(df, {"_places": place_hits(F.col("location"), profile)})
    best = first_hit(F.col("_places"), [t for t, _ in tiers])
    city = F.trim(F.split(F.split(raw, ",").getItem(0), ";").getItem(0))
    is_code = F.lower(city).isin([c.lower() for c in profile.country_terms])
    return df.withColumns({
        "tier_points": lookup(best, dict(tiers), 0),
        "tier_label": lookup(best, {t: t.title() for t, _ in tiers}, ""),
        "country": lookup(first_hit(F.col("_places"), list(codes)), codes, ""),
        "city": F.when(is_code | (F.length(city) > 60), F.lit("")).otherwise(city),
    }).drop("_places")


def excluded_region(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Name of the excluded region, '' when a wanted place is named too or nothing is."""
    df = once(df, {"_places": place_hits(F.col("location"), profile)})
    hit = first_hit(F.col("_places"), [_plain(t) for t in profile.location_exclude])
    wanted = F.size(ordered(F.col("_places"), [t for t, _ in _tier_terms(profile)])) > 0
    return df.withColumn("excluded_region", F.when(wanted, F.lit("")).otherwise(
        F.coalesce(hit, F.lit("")))).drop("_places")


@lowered
def remote_policy(df: DataFrame) -> DataFrame:
    """Four ordered rules over title, then place, then text."""
    words = ["remote", "hybrid", "office", "mobiles", "on-site", "on site", "vor ort",
             "präsenz", "prasenz", "anywhere", "model", "vor ort", "vor", "on site"]
    fields = [F.col("_low_title"), F.lower(F.coalesce(F.col("location"), F.lit(""))), F.col("_low_text")]
    found = F.coalesce(*[F.when(_has_any(f, words), F.coalesce(*[
        F.when(F.rlike(f, F.lit(LOWER + p)), F.struct(
            F.lit(name).alias("policy"), F.regexp_extract(f, LOWER + p, 0).alias("phrase")))
        for name, p in V.REMOTE_RULES])) for f in fields])
    df = once(df, {"_remote": found})
    return df.withColumns({
        "remote_policy": F.coalesce("_remote.policy", F.lit("unknown")),
        "remote_phrase": F.trim(F.coalesce("_remote.phrase", F.lit("")))}).drop("_remote")


def looks_like_place(raw: Column) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    return ((text != "") & ~F.rlike(text, F.lit("(?iu)" + V.PLACEHOLDER_LOCATION))
            & F.rlike(text, F.lit(r"\p{L}{3,}")))


# -- E10, E11, E12, E13 -----------------------------------------------------
def _vocabulary(profile: Profile) -> list[str]:
    return [*profile.skill_terms(), *profile.domains,
            *[t for ts in profile.role_categories.values() for t in ts],
            *V.COMMON_REQUIREMENTS, *[m for f in profile.families for m in f["members"]]]


def category_order(profile: Profile) -> list[str]:
    """Categories by their longest term, longest first, stable."""
    return sorted(profile.role_categories,
                  key=lambda n: -max(map(len, profile.role_categories[n]), default=0))


def _category(hits: Column, profile: Profile) -> Column:
    return F.coalesce(*[F.when(F.size(ordered(hits, profile.role_categories[n])) > 0, F.lit(n))
                        for n in category_order(profile)])


def transfer_table(profile: Profile) -> dict[str, tuple[str, float, str]]:
    """requirement -> (held skill, credit, why).  The profile is constant, so this is too."""
    held = {t.lower() for t in profile.skill_terms()}
    squeezed = {canonical(t).replace(" ", "") for t in held}
    out: dict[str, tuple[str, float, str]] = {}
    for f in profile.families:
        for need in f["members"]:
            mine = sorted((m for m in f["members"] if m != need
                           and (m in held or canonical(m).replace(" ", "") in squeezed)),
                          key=lambda m: (-len(m), m))
            if mine and need not in out:
                out[need] = (mine[0], float(f["transfer"]), f["why"])
    return out


@lowered
def skills(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Skills by group, domains, category, unclaimed requirements and their transfers."""
    df = with_optional(df)
    index = TermIndex(_vocabulary(profile))
    titles = TermIndex([t for ts in profile.role_categories.values() for t in ts])
    df = once(df, {"_named": index.hits(_low())})
    df = once(df, {"_hits": F.when(F.coalesce(F.col("tags"), F.lit("")) == "", F.col("_named"))
                       .otherwise(index.hits(F.concat_ws("\n", "_low_title", F.lower("tags"), "_low_text")))})
    hits = F.col("_hits")
    df = once(df, {
        "skills": ordered(hits, profile.skill_terms()),
        "skill_groups": F.filter(F.array(*[
            F.struct(F.lit(g).alias("group"), ordered(hits, ts).alias("terms"))
            for g, ts in profile.skills.items()]), lambda g: F.size(g["terms"]) > 0),
        "domains": ordered(hits, profile.domains),
        "role_category": F.coalesce(
            _category(titles.hits(F.col("_low_title")), profile),
            _category(hits, profile), F.lit("")),
    })
    watch = sorted({t.lower() for t in V.COMMON_REQUIREMENTS}
                   | {m.lower() for f in profile.families for m in f["members"]})
    df = once(df, {"missing": F.array_sort(F.array_except(ordered(F.col("_named"), watch), F.col("skills")))})
    table = transfer_table(profile)
    via = {k: v[0] for k, v in table.items()}
    credit = {k: v[1] for k, v in table.items()}
    why = {k: v[2] for k, v in table.items()}
    covered = F.filter("missing", lambda m: lookup(m, via).isNotNull())
    return df.withColumns({
        "strongest_group": F.coalesce(F.array_max(F.transform(
            "skill_groups", lambda g, i: F.struct(F.size(g["terms"]).alias("n"), (-i).alias("o"),
                                                  g["group"].alias("g"), g["terms"].alias("t")))
        )["g"], F.lit("")),
        "transfers": F.transform(covered, lambda m: F.struct(
            m.alias("requirement"), lookup(m, via).alias("via"),
            lookup(m, credit).alias("credit"), lookup(m, why).alias("why"))),
        "unmet": F.filter("missing", lambda m: lookup(m, via).isNull()),
    }).withColumn("transfer_credit", F.aggregate(
        "transfers", F.lit(0.0), lambda a, t: a + t["credit"])).drop("_named", "_hits")


def skill_vocabulary(spark, profile: Profile = DEFAULT) -> DataFrame:
    """The profile's vocabulary as a table, one row per term and role, for ``skills_by_table``.

    ``role`` is skill, domain or need; ``place`` the order of declaration, ``area`` a skill's group.  A need
    carries the skill that covers it, the credit and the reason, where the reader holds one.
    """
    rows = [("skill", t, i, g, None, None, None) for i, (g, t) in enumerate((g, t) for g, ts in profile.skills.items() for t in ts)]
    rows += [("domain", t, i, None, None, None, None) for i, t in enumerate(profile.domains)]
    covered = transfer_table(profile)
    watch = {t.lower() for t in V.COMMON_REQUIREMENTS} | {m.lower() for f in profile.families for m in f["members"]}
    rows += [("need", t, i, None, *covered.get(t, (None, None, None))) for i, t in enumerate(sorted(watch))]
    return spark.createDataFrame(rows, "role string, term string, place int, area string, via string, credit double, why string")


@lowered
def skills_by_table(df: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """What ``skills`` adds but the category, with a vocabulary table of any size; ``key`` tells postings apart.

    The vocabulary has the columns of ``skill_vocabulary``.  Hits are narrow rows that combine before their
    shuffle; a posting's lists hold no more than the terms it names.
    """
    df = with_optional(df)
    table = term_table.vocabulary(vocabulary)
    # needs only count where title or text name them, skills and domains in the tags, too
    named = df.select(key, _low().alias("_t")).withColumn("_tagged", F.lit(False))
    tagged = df.filter(F.coalesce("tags", F.lit("")) != "").select(
        key, F.concat_ws("\n", "_low_title", F.lower("tags"), "_low_text").alias("_t")).withColumn("_tagged", F.lit(True))
    hits = (term_table.find(named, key, F.col("_t"), table)
            .unionByName(term_table.find(tagged, key, F.col("_t"), table.filter("role <> 'need'"))).distinct())
    c = F.col

    def listed(role: str, *columns: str) -> Column:
        return F.array_sort(F.collect_set(F.when(c("role") == role, F.struct("place", *columns))))

    per = hits.groupBy(key).agg(listed("skill", "term", "area").alias("_s"), listed("domain", "term").alias("_d"),
                                listed("need", "term", "via", "credit", "why").alias("_n"))
    df = df.join(per, key, "left")
    held = F.array_distinct(F.transform("_s", lambda s: s["term"]))
    df = once(df, {"skills": F.coalesce(held, F.array().cast("array<string>")),
                   "domains": F.coalesce(F.array_distinct(F.transform("_d", lambda d: d["term"])), F.array().cast("array<string>")),
                   "_open": F.array_sort(F.filter("_n", lambda n: ~F.array_contains(F.coalesce(held, F.array().cast("array<string>")), n["term"])))})
    areas = F.array_distinct(F.transform("_s", lambda s: s["area"]))
    groups = F.transform(areas, lambda a: F.struct(a.alias("group"), F.array_distinct(F.transform(
        F.filter("_s", lambda s: s["area"] == a), lambda s: s["term"])).alias("terms")))
    none = "array<struct<requirement:string,via:string,credit:double,why:string>>"
    return df.withColumns({
        "skill_groups": F.coalesce(groups, F.array().cast("array<struct<group:string,terms:array<string>>>")),
        "missing": F.coalesce(F.transform("_open", lambda n: n["term"]), F.array().cast("array<string>")),
        "transfers": F.coalesce(F.transform(F.filter("_open", lambda n: n["via"].isNotNull()), lambda n: F.struct(
            n["term"].alias("requirement"), n["via"].alias("via"), n["credit"].alias("credit"), n["why"].alias("why"))), F.array().cast(none)),
        "unmet": F.coalesce(F.transform(F.filter("_open", lambda n: n["via"].isNull()), lambda n: n["term"]), F.array().cast("array<string>")),
    }).withColumn("transfer_credit", F.aggregate("transfers", F.lit(0.0), lambda a, t: a + t["credit"])).drop("_s", "_d", "_n", "_open")


# -- E14, E15, E16 ----------------------------------------------------------
@lowered
def employment(df: DataFrame) -> DataFrame:
    return df.withColumn("employment_type", F.when(
        F.rlike(_low(), F.lit(LOWER + V.FULL_TIME_HINT)), "full_time").otherwise("unknown"))


@lowered
def degree(df: DataFrame) -> DataFrame:
    """Highest degree named: 3 doctorate, 2 master, 1 bachelor, 0 none."""
    return df.withColumn("degree_rank", F.coalesce(*[
        F.when(F.rlike(_low(), F.lit(LOWER + p)), F.lit(rank)) for rank, p in V.DEGREE_RULES],
        F.lit(0)))


@lowered
def flags(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Warning rules: the first phrase of each rule that the text contains."""
    text = _low()
    if not profile.flags:
        empty = F.array().cast("array<struct<code:string,why:string,evidence:string,penalty:int>>")
        return df.withColumn("flags", empty)
    rules = [F.struct(
        F.lit(r["code"]).alias("code"), F.lit(r.get("explain", r["code"])).alias("why"),
        F.coalesce(*[F.when(F.contains(text, F.lit(p.lower())), F.lit(p.lower()))
                     for p in r["phrases"]]).alias("evidence"),
        F.lit(int(r.get("penalty", 0))).alias("penalty")) for r in profile.flags]
    return df.withColumn("flags", F.filter(F.array(*rules), lambda f: f["evidence"].isNotNull()))


def enrich(df: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """All facts, for postings that passed the gates."""
    df = add_lowered(with_optional(df))
    for step in (posting_language, language_requirement, seniority, remote_policy, employment,
                 degree, salary):
        df = step(df)
    for step in (location, skills, flags):
        df = step(df, profile)
    return df.drop(*LOWERED)
