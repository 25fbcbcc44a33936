"""Golden values of text functions, facts, gates and scores."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from vacatlas import fixed_values as V
from vacatlas.functions import dates, money, term_table, text as T
from vacatlas.functions.terms import TermIndex, ordered
from vacatlas.operators import enrich as E, gates, score as M
from vacatlas.profile import DEFAULT, Profile

AS_OF = F.lit("2024-01-31").cast("date")


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def posting(**kw):
    base = dict(seq=1, title="Machine Learning Engineer",
                description="We use PyTorch and Docker in an international team.", location="Munich, Germany",
                company="Acme", tier="normal", posted=dt.date(2024, 1, 30), url="https://x", tags="")
    return {**base, **kw}


SCHEMA = "seq long, title string, description string, location string, company string, tier string, posted date, url string, tags string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def score_rows(spark, rows, profile=DEFAULT):
    kept = gates.kept(gates.gate(frame(spark, rows), AS_OF, profile))
    return {r.seq: r for r in M.score(E.enrich(kept, profile), profile).collect()}


def test_titles_companies_cities(spark):
    a = column(spark, ["ML Engineer (m/w/d) 80-100%", "ML Engineer (all genders)", "ML Engineer (f/m/d) Ref. 123"], T.normalize_title)
    assert set(a) == {"ml engineer"}
    assert column(spark, ["BMW Group", "BMW AG", "Helsing GmbH", "Helsing", None], T.normalize_company) == [
        "bmw", "bmw", "helsing", "helsing", "unknown"]
    assert set(column(spark, ["Munich", "Munich, Germany", "Munich (HQ), Bavaria"], T.normalize_city)) == {"munich"}
    assert column(spark, ["engineer_JR10389233-1", "REQ-123456", "req_12345", "x"],
                  lambda c: T.requisition_id(c, F.lit(""))) == ["JR10389233", "REQ-123456", "REQ-12345", ""]
    assert column(spark, ["Celonis SE", "Celonis GmbH", "celonis"], T.match_key) == ["celonis"] * 3


def test_html_and_summary(spark):
    raw = ["<p>We use <b>PyTorch</b> daily.</p>", "a<script>alert(1)</script>b", "&lt;script&gt;x&lt;/script&gt; &#252;&amp;",
           "<ul><li>one</li><li>two</li></ul>", None]
    out = column(spark, raw, T.clean_html)
    assert out[0] == "We use PyTorch daily."
    assert "alert" not in out[1] and "<" not in out[2] and "ü&" in out[2]
    assert out[3].count("•") == 2 and out[4] == ""
    text = "About us we are great and this line is long enough\n" + "A" * 50 + "\nshort\n" + "B" * 60
    assert column(spark, [text], T.summarise) == ["A" * 50 + " " + "B" * 60]
    assert column(spark, ["x" * 700], T.summarise)[0].endswith("…")


@pytest.mark.parametrize("token,value", [
    ("90000", 90000), ("90,000", 90000), ("90.000", 90000), ("90k", 90000), ("90K", 90000), ("1.234,56", 1234.56),
    ("1,234.56", 1234.56), ("120'000", 120000), ("nonsense", None), ("", None)])
def test_amounts(spark, token, value):
    assert column(spark, [token], money.parse_amount) == [value]


def test_dates(spark):
    day = dt.date(2024, 1, 31)
    got = column(spark, ["Posted Today", "yesterday", "Posted 30+ Days Ago", "2 months ago", "3 weeks ago", "soon", None],
                 lambda c: dates.from_relative(c, AS_OF))
    assert got == [day, dt.date(2024, 1, 30), dt.date(2024, 1, 1), dt.date(2023, 12, 2), dt.date(2024, 1, 10), None, None]
    same = ["1707091200", "1707091200000", "2024-02-05T10:00", "Mon, 05 Feb 2024 10:00:00 +0100", "5 Feb 2024",
            "5.2.2024", "2/5/2024", "2024/2/5"]
    assert set(column(spark, same, dates.from_any)) == {dt.date(2024, 2, 5)}
    assert column(spark, ["", None, "2024-99-99", "later"], dates.from_any) == [None] * 4


def test_term_index_finds_each_term(spark):
    ix = TermIndex(["graph neural", "graph neural network", "scikit-learn", "c++", "c", "r", "ci/cd"])
    got = column(spark, ["a graph-neural  network, scikit learn and c++", "für ci-cd", "r."], lambda c: ordered(ix.hits(F.lower(c)), ix.terms))
    assert got == [["graph neural", "graph neural network", "scikit-learn", "c++", "c"], ["ci/cd"], ["r"]]


@pytest.mark.parametrize("text,level", [
    ("German C1 is required. English is our working language.", "german_c1_plus"),
    ("Deutsch als Muttersprache", "german_native"), ("Gute Deutschkenntnisse", "german_b2"),
    ("Sehr gute Deutschkenntnisse", "german_c1_plus"), ("German B1", "german_b1"), ("Basic German", "german_a1_a2"),
    ("German is a plus", "german_optional"), ("No German required", "german_optional"),
    ("English is our working language", "english_only"), ("Fluent in English", "english_preferred"), ("Nothing", "unclear")])
def test_language_levels(spark, text, level):
    assert E.language_requirement(frame(spark, [posting(description=text)])).first().language_requirement == level


@pytest.mark.parametrize("text,lo,hi,currency", [
    ("Salary: €70,000 - €90,000 per year", 70000, 90000, "EUR"),
    ("Gehalt 65.000 - 80.000 EUR brutto", 65000, 80000, "EUR"),
    ("Gehalt: 6.000 EUR brutto pro Monat", 72000, 72000, "EUR"),
    ("Compensation: CHF 120,000", 127200, 127200, "CHF"),
    ("Founded in 1998, €2 billion revenue", None, None, ""), ("Salary: €5", None, None, "")])
def test_salary(spark, text, lo, hi, currency):
    r = E.salary(frame(spark, [posting(description=text)])).first()
    assert (r.salary_annual_eur_min, r.salary_annual_eur_max, r.salary_currency) == (lo, hi, currency)


@pytest.mark.parametrize("text,lo,hi", [
    ("3+ years", 3, None), ("at least 5 years", 5, None), ("2-4 years of experience", 2, 4), ("mindestens 3 Jahre", 3, None),
    ("7 years of professional experience", 7, None), ("5+ years leadership, 3+ years Python", 3, None), ("none", None, None)])
def test_years(spark, text, lo, hi):
    r = E.years_required(frame(spark, [posting(description=text)])).first()
    assert (r.experience_min_years, r.experience_max_years) == (lo, hi)


@pytest.mark.parametrize("title,text,level", [
    ("Senior Staff Engineer", "", "lead"), ("Head of AI", "", "executive"), ("Senior Engineer", "1 year", "senior"),
    ("Graduate Engineer", "", "graduate"), ("Junior Engineer", "", "junior"), ("Engineer", "8+ years", "senior"),
    ("Engineer", "0-1 years", "graduate"), ("Engineer", "", "unknown")])
def test_seniority(spark, title, text, level):
    assert E.seniority(frame(spark, [posting(title=title, description=text)])).first().seniority == level


@pytest.mark.parametrize("title,text,policy", [
    ("x", "100% remote", "remote"), ("x", "hybrid working", "hybrid"), ("x", "No remote work", "onsite"), ("x", "nothing", "unknown"),
    ("Remote Engineer", "office-based", "remote")])
def test_remote(spark, title, text, policy):
    assert E.remote_policy(frame(spark, [posting(title=title, description=text, location="")])).first().remote_policy == policy


def test_location_and_exclusion(spark):
    rows = [posting(seq=i, location=p) for i, p in enumerate(
        ["Munich", "Leipzig", "Lisbon", "Bangalore, India", "Munich; Bangalore", ""])]
    got = {r.seq: r for r in E.excluded_region(E.location(frame(spark, rows))).collect()}
    assert got[0].tier_points > got[1].tier_points > got[2].tier_points
    assert [got[i].excluded_region for i in range(6)] == ["", "", "", "india", "", ""]


def test_gates_give_reasons_and_do_not_hit_parts_of_words(spark):
    rows = [posting(seq=1), posting(seq=2, title="Praktikum Data Science"), posting(seq=3, title="Sales Engineer"),
            posting(seq=4, location="Tokyo, Japan"), posting(seq=5, posted=dt.date(2023, 12, 1)), posting(seq=6, posted=None),
            posting(seq=7, title="International Machine Learning Engineer")]
    got = {r.seq: r.reject_reason for r in gates.gate(frame(spark, rows), AS_OF).collect()}
    assert got[1] == got[6] == got[7] == ""
    assert "full-time" in got[2] and "profession" in got[3] and "region" in got[4] and "older" in got[5]


def test_score_directions(spark):
    rows = [posting(seq=1), posting(seq=2, title="Senior Machine Learning Engineer"), posting(seq=3, title="Head of Machine Learning"),
            posting(seq=4, posted=dt.date(2024, 1, 19)), posting(seq=5, tier="dream"), posting(seq=6, location="Reykjavik, Iceland"),
            posting(seq=7, location="3 Locations"), posting(seq=8, description="German C1 required. PyTorch."),
            posting(seq=9, location="Reykjavik (Remote)")]
    got = score_rows(spark, rows)
    s = {k: r.score for k, r in got.items()}
    assert all(0 <= v <= 100 for v in s.values())
    assert s[2] < s[1] - 20 and s[3] <= s[2] and s[4] < s[1] < s[5]
    assert s[6] < 60 < s[1] and got[7].penalty_place == 0 and got[6].penalty_place > got[9].penalty_place > 0
    assert s[8] < s[1] and len(got[1].match_reasons) <= 8 and any("PyTorch".lower() in r.lower() for r in got[1].match_reasons)


def test_experience_ladder_never_rises(spark):
    rows = [posting(seq=n, description=f"PyTorch. {n}+ years of experience.") for n in range(1, 13)]
    got = score_rows(spark, rows)
    ladder = [got[n].score_experience for n in range(1, 13)]
    assert ladder == sorted(ladder, reverse=True)


def test_transfers_are_explained(spark):
    r = E.skills(frame(spark, [posting(description="TensorFlow and Kubernetes and SAP")])).first()
    assert [t.requirement for t in r.transfers] == ["tensorflow"] and r.transfers[0].via == "pytorch"
    assert r.unmet == ["kubernetes", "sap"] and r.transfer_credit == 0.75


def test_profile_is_validated():
    with pytest.raises(ValueError):
        Profile.from_dict({"no_such_key": 1})
    with pytest.raises(ValueError):
        Profile(min_score=70, recommend_min_score=60)
    assert set(V.LANGUAGE_SCORE) == set(V.LANGUAGE_LEVELS)


def test_salary_takes_the_first_window_with_a_figure(spark):
    def brute(text):
        """Window by window, every pattern on its own."""
        low = text.lower()
        for m in re.finditer(V.PAY_CONTEXT, low):
            window = low[max(0, m.start() - V.PAY_WINDOW_BEFORE):m.end() + V.PAY_WINDOW_AFTER]
            found = [x for p in (V.PAY_RANGE, V.PAY_SINGLE)
                     for x in re.finditer(re.sub(r"\\x\{(\w+)\}", lambda h: chr(int(h[1], 16)), p), window, re.I)]
            for x in found:
                figures = [float(n.replace(",", "")) for n in re.findall(r"[0-9][0-9,]*", x[0])]
                if re.search("eur|€", x[0]) and all(12_000 <= n <= 500_000 for n in figures) and figures[0] <= figures[-1]:
                    return figures[0], figures[-1]
        return None, None

    r = random.Random(12)
    parts = ["salary", "gross pay", " package ", "lohn", "EUR 50,000", "70,000 EUR", "EUR 60,000 - 80,000", "3 people", "12 EUR", "x" * 90,
             " and so on ", "2024", "EUR 99,000 - 10,000"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(120)]
    texts += ["salary " * 10_000 + "of 64,000 EUR", "pay \x01 EUR \x02 salary 55,000 EUR", "salary " + "y" * 300 + " EUR 50,000"]
    got = E.salary(frame(spark, [posting(title="", description=t) for t in texts])).select("description", "salary_min", "salary_max").collect()
    assert {(x.description, x.salary_min, x.salary_max) for x in got} == {(t, *brute("\n" + t)) for t in texts}


def test_a_table_of_terms_finds_what_the_pattern_finds(spark):
    r = random.Random(13)
    words = ["graph", "neural", "network", "c", "c++", "c#", ".net", "ci/cd", "scikit-learn", "r", "node.js", "für", "é", "a_b", "+"]
    terms = list(dict.fromkeys(words + [" ".join(r.sample(words, r.randint(2, 4))) for _ in range(60)] + ["Graph-Neural"]))
    seps = [" ", "  ", "-", "/", "\n", ", ", ".", "", "(", "\u00a0", " - "]
    texts = ["".join(r.choice(words + ["x", "the"]) + r.choice(seps) for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", F.lower("t"))
    index = TermIndex(terms)
    want = {(x.i, t) for x in df.select("i", index.hits(F.col("t")).alias("h")).collect() for t in x.h or []}
    table = term_table.vocabulary(spark.createDataFrame([(t, n) for n, t in enumerate([*terms, "", " - ", None])], "term string, n int"))
    got = [(x.i, x.term) for x in term_table.find(df, "i", F.col("t"), table).collect()]
    assert set(got) == want and len(want) > 300
    assert term_table.find(df, "i", F.col("t"), table.filter("n < 0")).count() == 0


def test_skills_by_table_are_the_skills(spark):
    texts = ["PyTorch, C++ and TensorFlow; ci/cd", "Docker, neural networks in robotics", "nothing", "MariaDB, Kafka"]
    df = frame(spark, [posting(seq=i, description=t, tags="Python; Kafka" if i % 2 else "") for i, t in enumerate(texts)])
    cols = ["seq", "skills", "skill_groups", "domains", "missing", "transfers", "unmet", "transfer_credit"]
    a = E.skills(df).select(cols).orderBy("seq").collect()
    assert a == E.skills_by_table(df, E.skill_vocabulary(spark), "seq").select(cols).orderBy("seq").collect() and a[0].transfers
