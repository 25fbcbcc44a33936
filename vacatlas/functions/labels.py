"""Codes to labels and scores to bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .terms import lookup


def language_label(c: Column) -> Column:
    return lookup(c, V.LANGUAGE_LABELS, "Not stated")


def seniority_label(c: Column) -> Column:
    return lookup(c, V.SENIORITY_LABELS, "Not stated")


def remote_label(c: Column) -> Column:
    return lookup(c, V.REMOTE_LABELS, "Not stated")


def status_label(c: Column) -> Column:
    return lookup(c, V.STATUS_LABELS, "Not stated")


def relevance_label(c: Column) -> Column:
    return lookup(c, V.RELEVANCE_LABELS, "Not stated")


def _band(score: Column, bands) -> Column:
    out = F.lit(bands[-1][1])
    for floor, label in reversed(bands[:-1]):
        out = F.when(score >= floor, F.lit(label)).otherwise(out)
    return out


def chart_band(score: Column) -> Column:
    return _band(score, V.CHART_BANDS)


def match_band(score: Column) -> Column:
    return _band(score, V.MATCH_BANDS)


def salary_band(value: Column) -> Column:
    return _band(value, [(f, label) for f, label in reversed(V.SALARY_BANDS)])


def fresh_band(posted: Column, as_of: Column) -> Column:
    """Undated postings fall into the last band."""
    out = F.lit(V.FRESH_BANDS[-1][1])
    for days, label in reversed(V.FRESH_BANDS[:-1]):
        out = F.when(posted >= F.date_sub(as_of, days), F.lit(label)).otherwise(out)
    return out
