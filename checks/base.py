"""Registry of the checked queries and the derived input views they share.

``VIEWS`` holds SQL that Spark and DuckDB both run unchanged, so the two sides
of a check start from the same rows.  ``O`` holds DuckDB-only steps that the
oracles are put together from; ``sql()`` adds the steps a query needs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
O: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
AS_OF_SQL = "DATE '2024-01-31'"
NOW_SQL = "TIMESTAMP '2024-01-31 12:00:00'"


def as_of() -> Column:
    return F.lit("2024-01-31").cast("date")


def now() -> Column:
    return F.lit("2024-01-31 12:00:00").cast("timestamp_ntz").cast("timestamp")


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL over tables, views and steps."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def _names(text: str) -> list[str]:
    return [n for n in {**VIEWS, **O} if re.search(rf"\b{n}\b", text)]


def sql(text: str) -> str:
    """Prefix a statement with every view or step it uses, directly or not."""
    need: list[str] = []

    def visit(t: str, inside: tuple = ()) -> None:
        for n in _names(t):
            if n not in need and n not in inside:  # a recursive step names itself
                visit({**VIEWS, **O}[n], (*inside, n))
                if n not in need:
                    need.append(n)

    visit(text)
    if not need:
        return text
    body = {**VIEWS, **O}
    steps = ",\n".join(f"{n} AS ({body[n]})" for n in need)
    return f"WITH RECURSIVE {steps}\n{text}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared derived view as a DataFrame, read straight from the given tables."""
    def resolve(n: str) -> DataFrame:
        text, args = VIEWS[n], {}
        for other in [*TABLES, *VIEWS]:
            if other != n and re.search(rf"(FROM|JOIN) {other}\b", text):
                args[other] = table(spark, sf, other) if other in TABLES else resolve(other)
                text = re.sub(rf"(FROM|JOIN) {other}\b", rf"\1 {{{other}}}", text)
        return spark.sql(text, **args)
    return resolve(name)


VIEWS["posting_view"] = """
SELECT d.doc_id AS seq,
  CASE d.doc_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'arbeitnow'
                    WHEN 3 THEN 'jobsch' ELSE 'adzuna' END AS provider,
  s.s_name || CASE d.doc_id % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' AG' WHEN 2 THEN ' Group' ELSE '' END AS company,
  CASE d.doc_id % 12
    WHEN 0 THEN 'Machine Learning Engineer (m/w/d)' WHEN 1 THEN 'Machine Learning Engineer'
    WHEN 2 THEN 'Senior Data Scientist' WHEN 3 THEN 'Junior Data Engineer 80-100%'
    WHEN 4 THEN 'Perception Engineer' WHEN 5 THEN 'Software Engineer'
    WHEN 6 THEN 'Praktikum Data Science' WHEN 7 THEN 'Warehouse Operative'
    WHEN 8 THEN 'Head of AI' WHEN 9 THEN 'Graduate AI Engineer'
    WHEN 10 THEN 'Staff Research Scientist' ELSE 'Sales Engineer' END AS title,
  CASE d.doc_id % 9 WHEN 0 THEN 'Munich, Germany' WHEN 1 THEN 'München' WHEN 2 THEN 'Zürich, Switzerland'
    WHEN 3 THEN 'Bangalore, India' WHEN 4 THEN 'Lisbon, Portugal' WHEN 5 THEN '3 Locations'
    WHEN 6 THEN '' WHEN 7 THEN 'Munich; Bangalore' ELSE 'Berlin (Remote)' END AS location,
  'https://jobs.example.com/' || CAST(d.doc_id AS VARCHAR(20)) AS url,
  'REQ-' || CAST(100000 + d.doc_id - d.doc_id % 3 AS VARCHAR(20)) AS external_id,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(d.doc_id % 45 AS INT) END AS posted,
  CASE d.doc_id % 3 WHEN 0 THEN 'dream' WHEN 1 THEN 'high' ELSE 'normal' END AS tier,
  d.lang AS doc_lang,
  d.text || CASE d.doc_id % 10
    WHEN 0 THEN ' English is our working language. PyTorch, Docker and Kubernetes.'
    WHEN 1 THEN ' German C1 is required. 5+ years of experience. TensorFlow.'
    WHEN 2 THEN ' Salary: EUR 70,000 - 90,000 per year. Deep learning, RAG, FastAPI.'
    WHEN 3 THEN ' Gehalt: 6.000 EUR brutto pro Monat. Gute Deutschkenntnisse.'
    WHEN 4 THEN ' Hybrid working. 2-4 years experience. scikit learn and C++.'
    WHEN 5 THEN ' EU citizenship required. No sponsorship. PhD preferred.'
    WHEN 6 THEN ' German is a plus. machine learning, neural networks, embeddings.'
    WHEN 7 THEN ' Compensation: CHF 120,000 per year. Automotive and robotics.'
    WHEN 8 THEN ' On-site only. Bachelor degree. Full-time, unbefristet.'
    ELSE '' END AS description
FROM documents d JOIN supplier s ON s.s_suppkey = (SELECT min(s_suppkey) FROM supplier) + d.doc_id % 10
"""
