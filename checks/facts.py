"""Checked queries: normalisation (N), facts (E), gates (F10-F17), scores (M)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vacatlas import fixed_values as V
from vacatlas.functions import dates, labels, money, text as T
from vacatlas.functions.terms import canonical
from vacatlas.operators import enrich as E
from vacatlas.operators import gates, score as M
from vacatlas.plans.scale import cut_lineage
from vacatlas.profile import DEFAULT as P

from .base import AS_OF_SQL, O, as_of, query, sql, table, view


# -- DuckDB building blocks -------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(s: str) -> str:
    """A pattern literal with case folding, safe to embed."""
    return q("(?i)" + s)


def term_rx(term: str) -> str:
    words = [re.escape(w) for w in canonical(term).split(" ")]
    return r"(^|[^\p{L}\p{N}])" + r"[\s\-_/]+".join(words) + r"($|[^\p{L}\p{N}])"


def sql_case(text: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {rx(p)}) THEN {q(n)}" for n, p in rules) \
        + f" ELSE {other} END"


def sql_terms(text: str, terms) -> str:
    terms = list(dict.fromkeys(t.lower() for t in terms))
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches({text}, {q(term_rx(t))}) THEN {q(t)} END" for t in terms
    ) + "], lambda x: x IS NOT NULL)"


def sql_plain(c: str) -> str:
    return f"strip_accents(lower(coalesce({c}, '')))"


def sql_slug(plain: str, n: int = 80) -> str:
    s = f"substr(regexp_replace(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {n})"
    return f"coalesce(nullif({s}, ''), 'unknown')"


def sql_title(c: str) -> str:
    return ("trim(regexp_replace(regexp_replace(" + sql_plain(c) + f", {rx(V.TITLE_NOISE)}, ' ', 'g'), "
            "'[^a-z0-9]+', ' ', 'g'))")


def sql_company(c: str) -> str:
    suffix = r"\b(?:" + "|".join(V.COMPANY_SUFFIXES) + r")\b\.?"
    return sql_slug(f"strip_accents(regexp_replace(lower(coalesce({c}, '')), {q(suffix)}, ' ', 'g'))")


def sql_city(c: str) -> str:
    first = f"regexp_replace(string_split_regex(coalesce({c}, ''), '[,;/|]')[1], '\\(.*?\\)', ' ', 'g')"
    return f"substr({sql_slug(sql_plain(first))}, 1, 40)"


def sql_key(company="company", title="title", location="location") -> str:
    return (f"substr({sql_company(company)} || '|' || {sql_title(title)} || '|' || "
            f"{sql_city(location)}, 1, 120)")


def sql_match_key(c: str) -> str:
    t = f"trim(lower(coalesce({c}, '')))"
    for s in V.MATCH_KEY_SUFFIXES:
        t = f"trim(regexp_replace({t}, {q(re.escape(s) + '$')}, ''))"
    return f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def sql_lookup(c: str, mapping: dict, default: str) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else repr(v)
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) \
        + f" ELSE {default} END"


def sql_amount(tok: str) -> str:
    raw = f"regexp_replace(regexp_replace(trim({tok}), '[kK]+$', ''), '[ \\x{{A0}}\\x{{202F}}'']', '', 'g')"
    last = f"string_split({raw}, ',')[-1]"
    return (f"(CASE WHEN regexp_matches(trim({tok}), '[kK]$') THEN 1000.0 ELSE 1.0 END::DOUBLE * try_cast(CASE "
            f"WHEN contains({raw}, '.') AND contains({raw}, ',') AND "
            f"strpos(reverse({raw}), ',') < strpos(reverse({raw}), '.') "
            f"THEN replace(replace({raw}, '.', ''), ',', '.') "
            f"WHEN contains({raw}, '.') AND contains({raw}, ',') THEN replace({raw}, ',', '') "
            f"WHEN contains({raw}, ',') AND length({last}) = 3 THEN replace({raw}, ',', '') "
            f"WHEN contains({raw}, ',') THEN replace({raw}, ',', '.') "
            f"WHEN contains({raw}, '.') AND length(string_split({raw}, '.')[-1]) = 3 THEN replace({raw}, '.', '') "
            f"ELSE {raw} END AS DOUBLE))")


TEXT = "(title || chr(10) || description)"
# skills are looked for with the (absent) tags between title and text
LOWER = "lower(title || chr(10) || description)"


def _count(padded: str, markers) -> str:
    return " + ".join(f"(length({padded}) - length(replace({padded}, {q(m)}, ''))) // {len(m)}"
                      for m in markers)


O["o_lang"] = f"""
SELECT *, CASE WHEN length(description) < 120 OR (de = 0 AND en = 0) THEN 'unknown'
  WHEN de >= en * 1.5 THEN 'de' WHEN en >= de * 1.5 THEN 'en' ELSE 'unknown' END AS posting_language
FROM (SELECT *, {_count("(' ' || lower(description) || ' ')", V.GERMAN_MARKERS)} AS de,
  {_count("(' ' || lower(description) || ' ')", V.ENGLISH_MARKERS)} AS en FROM posting_view)
"""

O["o_req"] = "SELECT *, " + sql_case(
    TEXT, [(n, "(?:" + "|".join(ps) + ")") for n, ps in V.LANGUAGE_RULES], "'unclear'") \
    + " AS language_requirement FROM o_lang"

O["o_years"] = f"""
SELECT *, least(lo, single) AS experience_min_years, hi AS experience_max_years FROM (
  SELECT *, r[1].lo AS lo, r[1].hi AS hi FROM (
    SELECT *, list_filter(rs, lambda x: x.lo = list_min(list_transform(rs, lambda y: y.lo))) AS r,
      list_min(list_filter(singles, lambda n: n <= 40)) AS single FROM (
      SELECT *, list_filter(list_transform(list_zip(
          regexp_extract_all(description, {rx(V.YEARS_RANGE)}, 1),
          regexp_extract_all(description, {rx(V.YEARS_RANGE)}, 2)),
          lambda z: {{'lo': z[1]::INT, 'hi': z[2]::INT}}), lambda x: x.lo <= x.hi AND x.hi <= 40) AS rs,
        list_transform(list_concat(list_concat(
          regexp_extract_all(description, {rx(V.YEARS_MINIMUM)}, 1),
          regexp_extract_all(description, {rx(V.YEARS_MINIMUM)}, 2)),
          regexp_extract_all(description, {rx(V.YEARS_PLAIN)}, 1)), lambda s: try_cast(s AS INT)) AS singles
      FROM o_req)))
"""
_N = "experience_min_years"
O["o_senior"] = "SELECT *, " + sql_case("title", V.SENIORITY_RULES, (
    f"CASE WHEN {_N} <= 1 THEN 'graduate' WHEN {_N} <= 3 THEN 'junior' WHEN {_N} <= 6 THEN 'mid' "
    f"WHEN {_N} IS NOT NULL THEN 'senior' ELSE 'unknown' END")) + " AS seniority FROM o_years"

O["o_remote"] = "SELECT *, coalesce(" + ", ".join(
    sql_case(f, V.REMOTE_RULES, "NULL") for f in ("title", "location", "description")
) + ", 'unknown') AS remote_policy FROM o_senior"


def _strong(terms) -> str:
    keys = sorted({canonical(t) for t in terms}, key=len, reverse=True)
    alt = "|".join(r"[\s\-_/]+".join(re.escape(w) for w in k.split(" ")) for k in keys)
    body = "regexp_replace(lower(chr(10) || description), '([^\\p{L}\\p{N}])', '\\1\\1', 'g')"
    return (f"least(12, len(list_distinct(regexp_extract_all({body}, "
            + q(r"(?:^|[^\p{L}\p{N}])(" + alt + r")(?:$|[^\p{L}\p{N}])") + ", 1))))")


def _title_any(terms) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(title), {q(term_rx(t))})" for t in terms) + ")"


O["o_rel"] = f"""
SELECT *, CASE WHEN outside THEN 0 WHEN certain THEN 3
  WHEN adjacent AND strong >= 1 THEN 2 WHEN adjacent AND support >= 3 THEN 1 WHEN adjacent THEN 0
  WHEN generic AND strong >= 3 THEN 2 WHEN generic AND strong >= 2 AND support >= 2 THEN 1
  WHEN generic THEN 0 WHEN strong >= 4 THEN 1 ELSE 0 END AS relevance FROM (
SELECT *, {_title_any(V.OUT_OF_FIELD_TITLE)} AS outside,
  {_title_any(V.CERTAIN_TITLE + P.role_include)} AS certain,
  {_title_any(V.ADJACENT_TITLE)} AS adjacent, {_title_any(V.GENERIC_TITLE)} AS generic,
  {_strong(V.STRONG_BODY)} AS strong, {_strong(V.SUPPORTING_BODY)} AS support FROM o_remote)
"""


def _place(terms, value) -> str:
    return " ".join(f"WHEN regexp_matches({sql_plain('location')}, "
                    f"{q('(^|[^a-z])' + E._plain(t) + '($|[^a-z])')}) THEN {value(t)}" for t in terms)


_tiers = sorted(P.location_tiers.items(), key=lambda kv: -kv[0])
_city = "trim(string_split(string_split(location, ',')[1], ';')[1])"
O["o_place"] = "SELECT *, CASE " + " ".join(
    _place(ts, lambda t, pts=pts: pts) for pts, ts in _tiers) + " ELSE 0 END AS tier_points, CASE " \
    + " ".join(_place(ts, lambda t: q(E._plain(t).title())) for _, ts in _tiers) \
    + " ELSE '' END AS tier_label, CASE " + " ".join(
        _place(ts, lambda t, c=c: q(c.upper())) for c, ts in P.country_terms.items()) \
    + f" ELSE '' END AS country, CASE WHEN lower({_city}) IN (" \
    + ", ".join(map(q, P.country_terms)) + f") OR length({_city}) > 60 THEN '' ELSE {_city} END AS city, " \
    + "CASE " + _place(P.location_exclude, lambda t: q(E._plain(t))) + " ELSE '' END AS excluded_hit FROM o_rel"
O["o_where"] = ("SELECT *, CASE WHEN tier_points > 0 THEN '' ELSE excluded_hit END AS excluded_region, "
                f"date_diff('day', posted, {AS_OF_SQL})::INT AS age_days FROM o_place")

_whole = [t for t in P.not_fulltime if not t.endswith("*")]
_starts = [t[:-1] for t in P.not_fulltime if t.endswith("*")]
O["o_gate"] = f"""
SELECT *, CASE WHEN {_title_any(_whole)}
    OR regexp_matches(lower(title), {q(r'(^|[^\p{L}\p{N}])(' + '|'.join(_starts) + ')')}) THEN 'full_time'
  WHEN relevance = 0 THEN 'relevance' WHEN excluded_region <> '' THEN 'region'
  WHEN age_days > {P.max_age_days} THEN 'age' ELSE '' END AS gate FROM o_where
"""

# pay: one row per printed offer, the first plausible one wins
_period = sql_case("win", V.PERIOD_RULES, "'year'")
_cur = {k: v for k, v in V.CURRENCY_TOKENS.items()}


def _currency(*groups: str) -> str:
    return "coalesce(" + ", ".join(sql_lookup(f"lower(trim({g}))", _cur, "NULL") for g in groups) + ")"


def _groups(pattern: str, n: int) -> str:
    return "list_zip(" + ", ".join(f"regexp_extract_all(win, {rx(pattern)}, {i})" for i in range(n)) + ")"


O["o_windows"] = f"""
SELECT seq, i, substr(txt, a + 1, b - a) AS win FROM (
  SELECT seq, i, txt, greatest(0, st - {V.PAY_WINDOW_BEFORE}) AS a,
    st + length(marks[i]) + {V.PAY_WINDOW_AFTER} AS b FROM (
    SELECT seq, txt, marks, i,
      list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT
      + coalesce(list_sum(list_transform(marks[1:i-1], lambda m: length(m))), 0)::BIGINT AS st
    FROM (SELECT *, unnest(range(1, len(marks) + 1)) AS i FROM (
      SELECT seq, {TEXT} AS txt, string_split_regex({TEXT}, {rx(V.PAY_CONTEXT)}) AS gaps,
        regexp_extract_all({TEXT}, {rx(V.PAY_CONTEXT)}) AS marks FROM posting_view))))
"""
O["o_offers"] = f"""
SELECT seq, i, 0 AS kind, j, {_currency('g[2]', 'g[4]', 'g[6]')} AS currency, {_period} AS period,
  {sql_amount('g[3]')} AS lo, {sql_amount('g[5]')} AS hi
FROM (SELECT *, generate_subscripts(gs, 1) AS j, unnest(gs) AS g FROM (
  SELECT *, {_groups(V.PAY_RANGE, 6)} AS gs FROM o_windows))
UNION ALL
SELECT seq, i, 1, j, {_currency('g[2]', 'g[5]')}, {_period}, {sql_amount('concat(g[3], g[4])')},
  {sql_amount('concat(g[3], g[4])')}
FROM (SELECT *, generate_subscripts(gs, 1) AS j, unnest(gs) AS g FROM (
  SELECT *, {_groups(V.PAY_SINGLE, 5)} AS gs FROM o_windows))
"""
_rate = f"({sql_lookup('period', V.PERIOD_FACTOR, '1.0')})::DOUBLE * ({sql_lookup('currency', V.FX_TO_EUR, 'NULL')})::DOUBLE"
O["o_pay"] = f"""
SELECT * FROM (SELECT seq, currency, period, lo, hi, eur_lo, eur_hi,
    row_number() OVER (PARTITION BY seq ORDER BY i, kind, j) AS rn
  FROM (SELECT *,
      round_even(lo * ({sql_lookup('period', V.PERIOD_FACTOR, '1.0')})::DOUBLE * ({sql_lookup('currency', V.FX_TO_EUR, 'NULL')})::DOUBLE, 2) AS eur_lo,
      round_even(hi * ({sql_lookup('period', V.PERIOD_FACTOR, '1.0')})::DOUBLE * ({sql_lookup('currency', V.FX_TO_EUR, 'NULL')})::DOUBLE, 2) AS eur_hi FROM o_offers)
  WHERE currency IS NOT NULL AND eur_lo BETWEEN 12000 AND 500000 AND eur_hi BETWEEN 12000 AND 500000
    AND eur_lo <= eur_hi) WHERE rn = 1
"""

_watch = sorted({t.lower() for t in V.COMMON_REQUIREMENTS}
                | {m.lower() for f in P.families for m in f["members"]})
_table = E.transfer_table(P)


def _category(text: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"regexp_matches({text}, {q(term_rx(t))})" for t in P.role_categories[n])
        + f" THEN {q(n)}" for n in E.category_order(P)) + " END"


_SKILL_COLS = f"""
  {sql_terms(LOWER, P.skill_terms())} AS skills,
  [{', '.join(f"len({sql_terms(LOWER, ts)})" for ts in P.skills.values())}] AS group_sizes,
  {sql_terms(LOWER, P.domains)} AS domains,
  coalesce({_category('lower(title)')}, {_category(LOWER)}, '') AS role_category,
  {sql_terms(LOWER, _watch)} AS watched"""
_credit = sql_lookup("x", {k: v[1] for k, v in _table.items()}, "NULL")
_via = sql_lookup("x", {k: v[0] for k, v in _table.items()}, "NULL")
_SKILL_MORE = f"""
  list_filter(watched, lambda x: NOT list_contains(skills, x)) AS missing,
  len(list_filter(group_sizes, lambda n: n > 0)) AS n_groups"""
_SKILL_LAST = f"""
  list_filter(missing, lambda x: ({_via}) IS NULL) AS unmet,
  list_filter(missing, lambda x: ({_via}) IS NOT NULL) AS covered,
  coalesce(list_sum(list_transform(list_filter(missing, lambda x: ({_via}) IS NOT NULL),
    lambda x: ({_credit})::DOUBLE)), 0.0) AS transfer_credit"""
O["o_skills"] = (f"SELECT *, {_SKILL_LAST} FROM (SELECT *, {_SKILL_MORE} FROM "
                 f"(SELECT *, {_SKILL_COLS} FROM posting_view))")

_flag_cases = [(r["code"], r["penalty"], "CASE " + " ".join(
    f"WHEN contains({LOWER}, {q(p)}) THEN {q(p)}" for p in r["phrases"]) + " END") for r in P.flags]

_liked = "[" + ", ".join(map(q, P.preferred_industries)) + "]"
_ord = [n for n in P.weights]
O["o_all"] = f"""
SELECT g.*, s.skills, s.domains, s.role_category, s.missing, s.unmet, s.covered, s.n_groups,
  s.transfer_credit, pay.currency, pay.period, pay.eur_lo, pay.eur_hi,
  CASE WHEN pay.seq IS NULL THEN 'unknown' ELSE 'explicit' END AS salary_basis,
  {sql_case(TEXT.replace('title', 'g.title').replace('description', 'g.description'), [(str(r), p) for r, p in V.DEGREE_RULES], "'0'")}::INT AS degree_rank,
  {' + '.join(f"CASE WHEN ({c.replace('title', 'g.title').replace('description', 'g.description')}) IS NULL THEN 0 ELSE {n} END" for _, n, c in _flag_cases)} AS penalty_flags
FROM o_gate g JOIN o_skills s ON s.seq = g.seq LEFT JOIN o_pay pay ON pay.seq = g.seq
WHERE g.gate = ''
"""
_placeholder = rx(V.PLACEHOLDER_LOCATION)
O["o_parts"] = f"""
SELECT *,
  least(100, round_even(least(len(skills) + transfer_credit, 7.0) / 7 * 72 + least(n_groups, 4) / 4 * 28, 0))::INT AS score_technical,
  (CASE WHEN {_N} IS NULL THEN CASE WHEN seniority IN ('graduate', 'junior') THEN 95 ELSE 75 END
    WHEN {_N} - 1.5 <= 1 THEN 100 WHEN {_N} - 1.5 <= 1.5 THEN 82 WHEN {_N} - 1.5 <= 2.5 THEN 68
    WHEN {_N} - 1.5 <= 4 THEN 48 ELSE greatest(0, round_even(52 - ({_N} - 1.5 - 4) * 13, 0)) END)::INT AS score_experience,
  (CASE WHEN language_requirement = 'unclear' AND posting_language = 'de' THEN 45
    ELSE {sql_lookup('language_requirement', V.LANGUAGE_SCORE, '60')} END)::INT AS score_language,
  (CASE WHEN remote_policy IN ('remote', 'hybrid') AND base_loc < 100 THEN least(100, base_loc + 8)
    ELSE base_loc END)::INT AS score_location,
  (CASE WHEN degree_rank = 0 THEN 85 WHEN degree_rank <= 2 THEN 100 ELSE 40 END)::INT AS score_education,
  (CASE WHEN age_days IS NULL THEN 50 {' '.join(f'WHEN age_days <= {d} THEN {s}' for d, s in P.freshness_curve)} ELSE 5 END)::INT AS score_freshness,
  (CASE WHEN len(domains) = 0 THEN 50 ELSE least(100, 45 + 18 * len(domains) + 10 * len(list_filter(domains,
    lambda d: len(list_filter({_liked}, lambda p: contains(p, d))) > 0))) END)::INT AS score_domain,
  (CASE WHEN tier_points = 0 AND trim(location) <> '' AND NOT regexp_matches(trim(location), {_placeholder})
     AND regexp_matches(location, '\\p{{L}}{{3,}}')
    THEN CASE WHEN remote_policy = 'remote' THEN 10 ELSE 26 END ELSE 0 END)::INT AS penalty_place,
  ({sql_lookup('seniority', P.seniority_penalty, '0')})::INT AS penalty_seniority,
  ({sql_lookup('language_requirement', P.language_penalty, '0')})::INT AS penalty_language,
  ({sql_lookup('tier', P.tier_bonus, '0')})::INT AS bonus_tier
FROM (SELECT *, CASE WHEN tier_points > 0 THEN round_even(tier_points / 24 * 100, 0)
  WHEN remote_policy = 'remote' THEN 60 ELSE 0 END AS base_loc FROM o_all)
"""
O["o_scored"] = f"""
SELECT *, greatest(0, least(100, round_even({' + '.join(f'score_{n} * {w}::DOUBLE' for n, w in P.weights.items())}
  + bonus_tier - penalty_seniority - penalty_place - penalty_language - penalty_flags
  + CASE WHEN salary_basis = 'explicit' AND eur_lo > 0 THEN 3 ELSE 0 END
  - CASE relevance WHEN 1 THEN 8 WHEN 2 THEN 3 ELSE 0 END, 0)))::INT AS score FROM o_parts
"""


# -- Spark side -------------------------------------------------------------
def postings(spark, sf):
    return view(spark, sf, "posting_view")


def scored(spark, sf, profile=P):
    """Gates first, so the costly facts are only taken from the survivors."""
    kept = gates.kept(gates.gate(gates.usable(postings(spark, sf)), as_of(), profile))
    return M.score(cut_lineage(E.enrich(cut_lineage(kept), profile)), profile)


@query("n01_strip_accents", sql(
    "SELECT seq, strip_accents(company || location) AS plain FROM posting_view"))
def n01(spark, sf):
    return postings(spark, sf).select(
        "seq", T.strip_accents(F.concat("company", "location")).alias("plain"))


@query("n02_normalize_title", sql(f"SELECT seq, {sql_title('title')} AS norm FROM posting_view"))
def n02(spark, sf):
    return postings(spark, sf).select("seq", T.normalize_title(F.col("title")).alias("norm"))


@query("n03_slugify", sql(
    f"SELECT seq, {sql_slug(sql_plain('title'))} AS slug FROM posting_view"))
def n03(spark, sf):
    return postings(spark, sf).select("seq", T.slugify(F.col("title")).alias("slug"))


@query("n04_normalize_company", sql(f"SELECT seq, {sql_company('company')} AS norm FROM posting_view"))
def n04(spark, sf):
    return postings(spark, sf).select("seq", T.normalize_company(F.col("company")).alias("norm"))


@query("n05_normalize_city", sql(f"SELECT seq, {sql_city('location')} AS norm FROM posting_view"))
def n05(spark, sf):
    return postings(spark, sf).select("seq", T.normalize_city(F.col("location")).alias("norm"))


@query("n06_canonical_key", sql(f"SELECT seq, {sql_key()} AS k FROM posting_view"))
def n06(spark, sf):
    return postings(spark, sf).select(
        "seq", T.canonical_key(F.col("company"), F.col("title"), F.col("location")).alias("k"))


@query("n07_requisition_id", sql(r"""
SELECT seq, upper(replace(coalesce(
  nullif(regexp_extract(external_id, '(?i)(?:^|[^A-Za-z0-9])(REQ[-_]?\d{4,})(?:[^0-9]|$)', 1), ''),
  nullif(regexp_extract(url, '/(\d{7,})(?:[/?#]|$)', 1), ''), ''), '_', '-')) AS req FROM posting_view"""))
def n07(spark, sf):
    return postings(spark, sf).select(
        "seq", T.requisition_id(F.col("external_id"), F.col("url")).alias("req"))


@query("n08_title_similarity", sql(f"""
SELECT seq, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS sim
FROM (SELECT seq, list_distinct(string_split({sql_title('title')}, ' ')) AS a,
  ['machine', 'learning', 'engineer'] AS b FROM posting_view)"""))
def n08(spark, sf):
    other = F.array(*map(F.lit, ["machine", "learning", "engineer"]))
    return postings(spark, sf).select("seq", T.title_similarity(
        T.title_tokens(T.normalize_title(F.col("title"))), other).alias("sim"))


@query("n09_match_key", sql(f"SELECT seq, {sql_match_key('company')} AS k FROM posting_view"))
def n09(spark, sf):
    return postings(spark, sf).select("seq", T.match_key(F.col("company")).alias("k"))


_RELATIVE = """CASE seq % 6 WHEN 0 THEN 'Posted Today' WHEN 1 THEN 'Posted Yesterday'
 WHEN 2 THEN 'Posted ' || CAST(seq % 40 AS VARCHAR(9)) || ' Days Ago' WHEN 3 THEN '2 months ago'
 WHEN 4 THEN 'Posted ' || CAST(seq % 7 AS VARCHAR(9)) || '+ weeks ago' ELSE 'soon' END"""


@query("n10_relative_date", sql(f"""
SELECT seq, CASE WHEN contains(t, 'today') THEN {AS_OF_SQL}
  WHEN contains(t, 'yesterday') THEN {AS_OF_SQL} - 1
  WHEN regexp_matches(t, '\\d+\\+?\\s*day') THEN {AS_OF_SQL} - regexp_extract(t, '(\\d+)\\+?\\s*day', 1)::INT
  WHEN regexp_matches(t, '\\d+\\+?\\s*month') THEN {AS_OF_SQL} - 30 * regexp_extract(t, '(\\d+)\\+?\\s*month', 1)::INT
  WHEN regexp_matches(t, '\\d+\\+?\\s*week') THEN {AS_OF_SQL} - 7 * regexp_extract(t, '(\\d+)\\+?\\s*week', 1)::INT
  END AS d FROM (SELECT seq, lower({_RELATIVE}) AS t FROM posting_view)"""))
def n10(spark, sf):
    return postings(spark, sf).selectExpr("seq", f"{_RELATIVE} AS t").select(
        "seq", dates.from_relative(F.col("t"), as_of()).alias("d"))


_DATED = """CASE o_orderkey % 6 WHEN 0 THEN CAST(epoch_s AS VARCHAR(20))
 WHEN 1 THEN CAST(epoch_s * 1000 AS VARCHAR(20)) WHEN 2 THEN ymd || 'T10:00:00Z'
 WHEN 3 THEN dd || '.' || mm || '.' || yy WHEN 4 THEN mm || '/' || dd || '/' || yy
 ELSE yy || '/' || mm || '/' || dd END"""


@query("n11_any_date", """
SELECT o_orderkey, o_orderdate::DATE AS d FROM orders""")
def n11(spark, sf):
    d = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.unix_date(d).cast("long") * 86400 + 3600).alias("epoch_s"),
        F.date_format(d, "yyyy-MM-dd").alias("ymd"), F.date_format(d, "dd").alias("dd"),
        F.date_format(d, "MM").alias("mm"), F.date_format(d, "yyyy").alias("yy"))
    return o.selectExpr("o_orderkey", f"{_DATED} AS t").select(
        "o_orderkey", dates.from_any(F.col("t")).alias("d"))


@query("n12_days_old", sql(
    f"SELECT seq, date_diff('day', posted, {AS_OF_SQL})::INT AS age FROM posting_view"))
def n12(spark, sf):
    return postings(spark, sf).select("seq", dates.days_old(F.col("posted"), as_of()).alias("age"))


_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
        ("&nbsp;", " "), ("&copy;", "©"), ("&eacute;", "é"), ("&amp;", "&")]


@query("n13_clean_html")
def n13(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


@query("n14_summarise")
def n14(spark, sf):
    return postings(spark, sf).select(
        "seq", F.substring(T.summarise(F.col("description")), 1, 1200).alias("summary"))


@query("n15_find_evidence", sql("""
SELECT seq, CASE WHEN p = 0 THEN '' ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END)
  || trim(regexp_replace(substr(description, s, e - s + 1), '[\\s\\x{A0}\\x{2007}\\x{202F}]+', ' ', 'g'))
  || (CASE WHEN e < length(description) THEN '…' ELSE '' END) END AS evidence FROM (
SELECT seq, description, strpos(lower(description), 'experience') AS p,
  greatest(1, strpos(lower(description), 'experience') - 70) AS s,
  least(length(description), strpos(lower(description), 'experience') - 1 + 10 + 70) AS e FROM posting_view)"""))
def n15(spark, sf):
    return postings(spark, sf).select(
        "seq", T.find_evidence(F.col("description"), F.lit("experience")).alias("evidence"))


@query("n16_term_pattern", sql(
    f"SELECT seq, array_to_string({sql_terms(LOWER, ['scikit-learn', 'c++', 'neural networks', 'r'])}, '|') "
    "AS found FROM posting_view"))
def n16(spark, sf):
    index = E.TermIndex(["scikit-learn", "c++", "neural networks", "r"])
    return postings(spark, sf).select("seq", F.array_join(E.ordered(
        index.hits(F.lower(F.concat_ws("\n", "title", "description"))), index.terms), "|").alias("found"))


_TOKENS = """CASE seq % 7 WHEN 0 THEN CAST(seq AS VARCHAR(9)) || 'k' WHEN 1 THEN '90.000'
 WHEN 2 THEN '1.' || CAST(100 + seq % 900 AS VARCHAR(9)) || ',56' WHEN 3 THEN '1,234.56' WHEN 4 THEN '120''000'
 WHEN 5 THEN CAST(seq AS VARCHAR(9)) || ',5' ELSE '90,000' END"""


@query("n17_parse_amount", sql(
    f"SELECT seq, {sql_amount('t')} AS amount FROM (SELECT seq, {_TOKENS} AS t FROM posting_view)"))
def n17(spark, sf):
    return postings(spark, sf).selectExpr("seq", f"{_TOKENS} AS t".replace("''", "\\'")).select(
        "seq", money.parse_amount(F.col("t")).alias("amount"))


_MONEY = """CASE seq % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'CHF' WHEN 2 THEN 'USD' ELSE 'SEK' END AS currency,
 CASE seq % 5 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'week' WHEN 3 THEN 'day' ELSE 'hour' END AS period,
 CAST(10 + seq % 9000 AS DOUBLE) AS lo"""


@query("n18_annual_eur", sql(
    f"SELECT seq, round_even(lo * ({sql_lookup('period', V.PERIOD_FACTOR, '1.0')})::DOUBLE "
    f"* ({sql_lookup('currency', V.FX_TO_EUR, 'NULL')})::DOUBLE, 2) AS eur "
    f"FROM (SELECT seq, {_MONEY} FROM posting_view)"))
def n18(spark, sf):
    return postings(spark, sf).selectExpr("seq", _MONEY.split(",\n")[0], *_MONEY.split(",\n")[1:]).select(
        "seq", money.annual_eur(F.col("lo"), F.col("period"), F.col("currency")).alias("eur"))


@query("n19_format_salary", sql("""
SELECT seq, CASE WHEN currency <> 'EUR' OR period <> 'year' THEN '≈ ' ELSE '' END || '€'
  || format('{:,}', round_even(lo, 0)::BIGINT) || CASE WHEN hi - lo < 1 THEN ''
  ELSE '–' || format('{:,}', round_even(hi, 0)::BIGINT) END AS display FROM (
SELECT seq, CASE seq % 3 WHEN 0 THEN 'EUR' ELSE 'CHF' END AS currency, 'year' AS period,
  CAST(20000 + seq * 13 AS DOUBLE) AS lo,
  CAST(20000 + seq * 13 AS DOUBLE) + CASE seq % 2 WHEN 0 THEN 0.5 ELSE 10000.0 END AS hi FROM posting_view)"""))
def n19(spark, sf):
    p = postings(spark, sf).selectExpr(
        "seq", "CASE seq % 3 WHEN 0 THEN 'EUR' ELSE 'CHF' END AS currency",
        "CAST(20000 + seq * 13 AS DOUBLE) AS lo",
        "CAST(20000 + seq * 13 AS DOUBLE) + CASE seq % 2 WHEN 0 THEN CAST(0.5 AS DOUBLE) "
        "ELSE CAST(10000 AS DOUBLE) END AS hi")
    return p.select("seq", money.format_salary(
        F.lit("explicit"), F.col("lo"), F.col("hi"), F.col("currency"), F.lit("year")).alias("display"))


@query("n20_labels", sql(
    f"SELECT seq, {sql_lookup('language_requirement', V.LANGUAGE_LABELS, q('Not stated'))} AS language, "
    f"{sql_lookup('seniority', V.SENIORITY_LABELS, q('Not stated'))} AS seniority, "
    f"{sql_lookup('remote_policy', V.REMOTE_LABELS, q('Not stated'))} AS remote FROM o_remote"))
def n20(spark, sf):
    df = E.remote_policy(E.seniority(E.language_requirement(postings(spark, sf))))
    return df.select("seq", labels.language_label(F.col("language_requirement")).alias("language"),
                     labels.seniority_label(F.col("seniority")).alias("seniority"),
                     labels.remote_label(F.col("remote_policy")).alias("remote"))


@query("n21_score_bands", sql("""
SELECT seq, CASE WHEN s >= 80 THEN '80-100' WHEN s >= 60 THEN '60-79' WHEN s >= 40 THEN '40-59'
  ELSE 'under 40' END AS chart, CASE WHEN s >= 90 THEN 'exceptional' WHEN s >= 80 THEN 'strong'
  WHEN s >= 70 THEN 'good' WHEN s >= 60 THEN 'worth_applying' WHEN s >= 50 THEN 'stretch' ELSE 'low' END AS band
FROM (SELECT seq, seq % 101 AS s FROM posting_view)"""))
def n21(spark, sf):
    s = F.col("seq") % 101
    return postings(spark, sf).select("seq", labels.chart_band(s).alias("chart"),
                                      labels.match_band(s).alias("band"))


@query("n22_search_blob", sql("""
SELECT s.seq, substr(lower(concat_ws(' ', s.company, s.title, s.location, g.city, g.country, s.role_category,
  CASE WHEN len(s.skills) > 0 THEN array_to_string(s.skills, ' ') END,
  CASE WHEN len(s.domains) > 0 THEN array_to_string(s.domains, ' ') END)), 1, 2000) AS blob
FROM o_skills s JOIN o_place g ON g.seq = s.seq"""))
def n22(spark, sf):
    df = E.location(E.skills(postings(spark, sf)))
    c = F.col
    return df.select("seq", T.search_blob(c("company"), c("title"), c("location"), c("city"), c("country"),
                                          c("role_category"), c("skills"), c("domains")).alias("blob"))


@query("e01_posting_language", sql("SELECT seq, posting_language FROM o_lang"))
def e01(spark, sf):
    return E.posting_language(postings(spark, sf)).select("seq", "posting_language")


@query("e02_language_level", sql("SELECT seq, language_requirement FROM o_req"))
def e02(spark, sf):
    return E.language_requirement(postings(spark, sf)).select("seq", "language_requirement")


@query("e02_language_evidence")
def e02b(spark, sf):
    return E.language_requirement(postings(spark, sf)).select(
        "seq", "language_requirement", "language_phrase", "language_evidence")


@query("e03_structured_language", sql("""
SELECT seq, CASE WHEN language_requirement <> 'unclear' THEN language_requirement
  WHEN seq % 4 = 0 AND seq % 5 >= 3 THEN 'german_b2' WHEN seq % 4 = 0 AND seq % 5 = 2 THEN 'german_b1'
  WHEN seq % 4 = 0 THEN 'german_a1_a2' WHEN seq % 4 = 1 THEN 'english_preferred' ELSE 'unclear' END
  AS language_requirement FROM o_req"""))
def e03(spark, sf):
    code = F.when(F.col("seq") % 4 == 0, "de").when(F.col("seq") % 4 == 1, "en").otherwise("fr")
    listed = F.struct(F.array(
        F.struct(code.alias("language"), (F.col("seq") % 5).cast("int").alias("level")),
        F.struct(F.lit("it").alias("language"), F.lit(4).alias("level"))).alias("language_skills"))
    return E.language_requirement(postings(spark, sf).withColumn("structured", listed)).select(
        "seq", "language_requirement")


@query("e04_seniority", sql("SELECT seq, seniority FROM o_senior"))
def e04(spark, sf):
    return E.seniority(postings(spark, sf)).select("seq", "seniority")


@query("e05_years", sql("SELECT seq, experience_min_years, experience_max_years FROM o_years"))
def e05(spark, sf):
    return E.years_required(postings(spark, sf)).select(
        "seq", "experience_min_years", "experience_max_years")


@query("e06_salary", sql("""
SELECT p.seq, coalesce(currency, '') AS salary_currency, coalesce(period, '') AS salary_period,
  lo AS salary_min, hi AS salary_max, eur_lo AS salary_annual_eur_min, eur_hi AS salary_annual_eur_max
FROM posting_view p LEFT JOIN o_pay ON o_pay.seq = p.seq"""))
def e06(spark, sf):
    return E.salary(postings(spark, sf)).select(
        "seq", "salary_currency", "salary_period", "salary_min", "salary_max",
        "salary_annual_eur_min", "salary_annual_eur_max")


@query("e07_relevance", sql("SELECT seq, relevance FROM o_rel"))
def e07(spark, sf):
    return E.relevance(postings(spark, sf)).select("seq", "relevance")


@query("e08_location", sql("SELECT seq, tier_points, tier_label, country, city FROM o_place"))
def e08(spark, sf):
    return E.location(postings(spark, sf)).select("seq", "tier_points", "tier_label", "country", "city")


@query("e09_remote_policy", sql("SELECT seq, remote_policy FROM o_remote"))
def e09(spark, sf):
    return E.remote_policy(postings(spark, sf)).select("seq", "remote_policy")


@query("e10_skills", sql("""
SELECT seq, array_to_string(skills, '|') AS skills, array_to_string(domains, '|') AS domains,
  n_groups::INT AS n_groups FROM o_skills"""))
def e10(spark, sf):
    return E.skills(postings(spark, sf)).select(
        "seq", F.array_join("skills", "|").alias("skills"), F.array_join("domains", "|").alias("domains"),
        F.size("skill_groups").alias("n_groups"))


@query("e11_role_category", sql("SELECT seq, role_category FROM o_skills"))
def e11(spark, sf):
    return E.skills(postings(spark, sf)).select("seq", "role_category")


@query("e12_missing", sql("SELECT seq, array_to_string(missing, '|') AS missing FROM o_skills"))
def e12(spark, sf):
    return E.skills(postings(spark, sf)).select("seq", F.array_join("missing", "|").alias("missing"))


@query("e13_transfers", sql("""
SELECT seq, array_to_string(covered, '|') AS covered, array_to_string(unmet, '|') AS unmet,
  round(transfer_credit, 6) AS credit FROM o_skills"""))
def e13(spark, sf):
    return E.skills(postings(spark, sf)).select(
        "seq", F.array_join(F.transform("transfers", lambda t: t["requirement"]), "|").alias("covered"),
        F.array_join("unmet", "|").alias("unmet"), F.round("transfer_credit", 6).alias("credit"))


def by_table(spark, sf):
    return E.skills_by_table(postings(spark, sf), E.skill_vocabulary(spark), "seq")


@query("e10_skills_by_table", sql("""
SELECT seq, array_to_string(skills, '|') AS skills, array_to_string(domains, '|') AS domains,
  n_groups::INT AS n_groups, array_to_string(missing, '|') AS missing FROM o_skills"""))
def e10_by_table(spark, sf):
    return by_table(spark, sf).select(
        "seq", F.array_join("skills", "|").alias("skills"), F.array_join("domains", "|").alias("domains"),
        F.size("skill_groups").alias("n_groups"), F.array_join("missing", "|").alias("missing"))


@query("j07_transfers_by_table", sql("""
SELECT seq, array_to_string(covered, '|') AS covered, array_to_string(unmet, '|') AS unmet,
  round(transfer_credit, 6) AS credit FROM o_skills"""))
def j07_by_table(spark, sf):
    return by_table(spark, sf).select(
        "seq", F.array_join(F.transform("transfers", lambda t: t["requirement"]), "|").alias("covered"),
        F.array_join("unmet", "|").alias("unmet"), F.round("transfer_credit", 6).alias("credit"))


@query("e14_employment", sql(f"""
SELECT seq, CASE WHEN regexp_matches({TEXT}, {rx(V.FULL_TIME_HINT)}) THEN 'full_time' ELSE 'unknown' END
  AS employment_type FROM posting_view"""))
def e14(spark, sf):
    return E.employment(postings(spark, sf)).select("seq", "employment_type")


@query("e15_degree", sql("SELECT seq, " + sql_case(
    TEXT, [(str(r), p) for r, p in V.DEGREE_RULES], "'0'") + "::INT AS degree_rank FROM posting_view"))
def e15(spark, sf):
    return E.degree(postings(spark, sf)).select("seq", "degree_rank")


@query("e16_flags", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT seq, {q(code)} AS code, {case} AS evidence FROM posting_view" for code, _, case in _flag_cases)
    + ") WHERE evidence IS NOT NULL"))
def e16(spark, sf):
    return E.flags(postings(spark, sf)).select("seq", F.explode("flags").alias("f")).select(
        "seq", "f.code", "f.evidence")


@query("e17_place_like", sql(f"""
SELECT seq, trim(location) <> '' AND NOT regexp_matches(trim(location), {_placeholder})
  AND regexp_matches(location, '\\p{{L}}{{3,}}') AS is_place FROM posting_view"""))
def e17(spark, sf):
    return postings(spark, sf).select("seq", E.looks_like_place(F.col("location")).alias("is_place"))


# -- gates ------------------------------------------------------------------
@query("f10_usable", sql("SELECT seq FROM posting_view WHERE title <> '' AND url <> ''"))
def f10(spark, sf):
    return gates.usable(postings(spark, sf)).select("seq")


@query("f11_freshness", sql(
    f"SELECT seq FROM posting_view WHERE posted IS NULL OR posted >= {AS_OF_SQL} - 14"))
def f11(spark, sf):
    return postings(spark, sf).filter(dates.within_age(F.col("posted"), as_of(), 14)).select("seq")


def _gated(spark, sf):
    return gates.gate(gates.usable(postings(spark, sf)), as_of())


@query("f12_not_full_time", sql("SELECT seq FROM o_gate WHERE gate = 'full_time'"))
def f12(spark, sf):
    return postings(spark, sf).filter(gates.not_full_time(F.col("title"))).select("seq")


@query("f13_relevance_gate", sql("SELECT seq FROM o_rel WHERE relevance = 0"))
def f13(spark, sf):
    return E.relevance(postings(spark, sf)).filter("relevance = 0").select("seq")


@query("f14_excluded_region", sql("SELECT seq, excluded_region FROM o_where"))
def f14(spark, sf):
    return E.excluded_region(postings(spark, sf)).select("seq", "excluded_region")


@query("f15_age_gate", sql(f"SELECT seq, age_days FROM o_where WHERE age_days > {P.max_age_days}"))
def f15(spark, sf):
    return postings(spark, sf).withColumn("age_days", dates.days_old(F.col("posted"), as_of())).filter(
        F.col("age_days") > P.max_age_days).select("seq", "age_days")


@query("f16_gate_chain", sql("SELECT seq, gate FROM o_gate"))
def f16(spark, sf):
    r = F.col("reject_reason")
    gate = (F.when(r == "", "").when(r == "not a full-time position", "full_time")
            .when(r.startswith("outside the target"), "region").when(r.startswith("older than"), "age")
            .otherwise("relevance"))
    return _gated(spark, sf).select("seq", gate.alias("gate"))


@query("f17_store_threshold", sql(f"SELECT seq, score FROM o_scored WHERE score >= {P.min_score}"))
def f17(spark, sf):
    return scored(spark, sf).filter(F.col("score") >= P.min_score).select("seq", "score")


# -- scores -----------------------------------------------------------------
def _part(name, column, spark_column):
    @query(name, sql(f"SELECT seq, {column} FROM o_parts"))
    def part(spark, sf):
        return scored(spark, sf).select("seq", spark_column)


_part("m01_technical", "score_technical", "score_technical")
_part("m02_experience", "score_experience", "score_experience")
_part("m03_language", "score_language", "score_language")
_part("m04_location", "score_location", "score_location")
_part("m05_place_penalty", "penalty_place", "penalty_place")
_part("m06_education", "score_education", "score_education")
_part("m07_freshness", "score_freshness", "score_freshness")
_part("m08_domain", "score_domain", "score_domain")


@query("m09_total", sql("""
SELECT seq, score, score_technical, score_experience, score_language, score_location, score_education,
  score_freshness, score_domain, penalty_flags, penalty_seniority, penalty_language, penalty_place
FROM o_scored"""))
def m09(spark, sf):
    return scored(spark, sf).select(
        "seq", "score", *[f"score_{n}" for n in M.SUB_SCORES],
        "penalty_flags", "penalty_seniority", "penalty_language", "penalty_place")


@query("m10_reasons_gaps")
def m10(spark, sf):
    return scored(spark, sf).select("seq", "score", "match_reasons", "match_gaps")


@query("m11_rescore", sql("""
SELECT seq, score AS score_before, a AS score_after, a - score AS delta FROM (
SELECT *, greatest(0, least(100, round_even(
  score_technical * 0.26::DOUBLE + score_location * 0.20::DOUBLE + score_freshness * 0.16::DOUBLE
  + score_experience * 0.15::DOUBLE + score_language * 0.13::DOUBLE + score_domain * 0.06::DOUBLE
  + score_education * 0.04::DOUBLE + CASE tier WHEN 'dream' THEN 0 WHEN 'high' THEN 0 ELSE 0 END
  - CASE seniority WHEN 'senior' THEN 10 ELSE 0 END - penalty_place - penalty_language - penalty_flags
  + CASE WHEN salary_basis = 'explicit' AND eur_lo > 0 THEN 3 ELSE 0 END
  - CASE relevance WHEN 1 THEN 8 WHEN 2 THEN 3 ELSE 0 END, 0)))::INT AS a FROM o_scored)"""))
def m11(spark, sf):
    kept = gates.kept(gates.gate(gates.usable(postings(spark, sf)), as_of()))
    changed = P.changed(tier_bonus={}, seniority_penalty={"senior": 10})
    return M.rescore(E.enrich(kept), P, changed, key="seq")
