"""Amounts of money: parsing, yearly figures in euro, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .terms import lookup


def parse_amount(token: Column) -> Column:
    """'90k', '90.000', '90,000', '1.234,56', '1,234.56', "120'000"; NULL when unreadable."""
    t = F.trim(token)
    factor = F.when(F.rlike(t, F.lit("[kK]$")), F.lit(1000.0)).otherwise(F.lit(1.0))
    raw = F.regexp_replace(F.regexp_replace(t, "[kK]+$", ""), r"[ \x{A0}\x{202F}']", "")
    dot, comma = F.contains(raw, F.lit(".")), F.contains(raw, F.lit(","))
    no_dot, no_comma = F.replace(raw, F.lit("."), F.lit("")), F.replace(raw, F.lit(","), F.lit(""))
    comma_last = F.rlike(raw, F.lit(r",[^.]*$"))
    thousands = F.rlike(raw, F.lit(r"[.,][^.,]{3}$"))
    number = (F.when(dot & comma & comma_last, F.replace(no_dot, F.lit(","), F.lit(".")))
              .when(dot & comma, no_comma)
              .when(comma & thousands, no_comma)
              .when(comma, F.replace(raw, F.lit(","), F.lit(".")))
              .when(dot & thousands, no_dot)
              .otherwise(raw))
    return F.when(F.rlike(number, F.lit(r"^[0-9]+\.?[0-9]*$")),
                  number.try_cast("double") * factor)


def annual_eur(amount: Column, period: Column, currency: Column) -> Column:
    """Yearly euro figure with fixed rates; '' counts as a year and as euro."""
    factor = lookup(F.when(period == "", F.lit("year")).otherwise(period), V.PERIOD_FACTOR, 1.0)
    rate = lookup(F.when(currency == "", F.lit("EUR")).otherwise(currency), V.FX_TO_EUR)
    return F.rint(amount * factor * rate * 100) / 100


def format_salary(basis: Column, lo: Column, hi: Column, currency: Column, period: Column) -> Column:
    """Short display; '≈' marks a converted figure, '' means nothing was stated."""
    hi = F.when(F.coalesce(hi, F.lit(0.0)) == 0, lo).otherwise(hi)
    mark = F.when((currency != "EUR") | (period != "year"), F.lit("≈ ")).otherwise(F.lit(""))
    low = F.format_number(F.bround(lo, 0), 0)
    high = F.format_number(F.bround(hi, 0), 0)
    text = F.when(F.abs(hi - lo) < 1, F.concat(mark, F.lit("€"), low)).otherwise(
        F.concat(mark, F.lit("€"), low, F.lit("–"), high))
    return F.when((basis == "explicit") & lo.isNotNull(), text).otherwise(F.lit(""))
