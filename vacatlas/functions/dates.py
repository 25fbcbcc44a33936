"""Dates as sources write them.  Anything unreadable becomes NULL, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import lookup

_MONTHS = {m: f"{i:02d}" for i, m in enumerate(
    "jan feb mar apr may jun jul aug sep oct nov dec".split(), start=1)}
_RFC = r"(?i)^(?:[a-z]{3}, )?(\d{1,2}) ([a-z]{3}) (\d{4})(?: \d{2}:\d{2}:\d{2} \S+)?$"


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def from_relative(text: Column, as_of: Column) -> Column:
    """'Posted 5 Days Ago' to a date; '30+ days' is a floor, so 30."""
    t = F.lower(text)
    days, months, weeks = (_number(t, rf"(\d+)\+?\s*{unit}") for unit in ("day", "month", "week"))
    return (F.when(F.contains(t, F.lit("today")) | F.contains(t, F.lit("just posted")), as_of)
            .when(F.contains(t, F.lit("yesterday")), F.date_sub(as_of, 1))
            .when(days.isNotNull(), F.date_sub(as_of, days))
            .when(months.isNotNull(), F.date_sub(as_of, months * 30))
            .when(weeks.isNotNull(), F.date_sub(as_of, weeks * 7)))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((y != "") & (m != "") & (d != ""), text.try_cast("date"))


def from_any(value: Column) -> Column:
    """Epoch seconds or milliseconds, ISO inside a text, RFC 822, d Mon Y, d.m.Y, m/d/Y, Y/m/d."""
    s = F.trim(value.cast("string"))
    n = F.when(F.rlike(s, F.lit(r"^\d{1,18}$")), s.try_cast("long"))
    seconds = F.when(n > 4_000_000_000, F.floor(n / 1000)).otherwise(n)
    epoch = F.date_add(F.lit("1970-01-01").cast("date"),
                       F.when(seconds < 253_402_300_800, F.floor(seconds / 86400)).cast("int"))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    iso = r"(\d{4})-(\d{2})-(\d{2})"
    dmy, mdy, ymd = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", \
        r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    month = F.coalesce(lookup(F.lower(part(_RFC, 2)), _MONTHS), F.lit(""))
    return F.when(n.isNotNull(), epoch).when(
        F.rlike(s, F.lit(iso)), _ymd(part(iso, 1), part(iso, 2), part(iso, 3))
    ).otherwise(F.coalesce(
        _ymd(part(_RFC, 3), month, part(_RFC, 1)),
        _ymd(part(dmy, 3), part(dmy, 2), part(dmy, 1)),
        _ymd(part(mdy, 3), part(mdy, 1), part(mdy, 2)),
        _ymd(part(ymd, 1), part(ymd, 2), part(ymd, 3))))


def days_old(posted: Column, as_of: Column) -> Column:
    """Whole days since posting, NULL when undated."""
    return F.datediff(as_of, posted)


def within_age(posted: Column, as_of: Column, days: int, keep_undated: bool = True) -> Column:
    """The freshness test; on a date column it is pushed into the scan."""
    fresh = posted >= F.date_sub(as_of, days)
    return (posted.isNull() | fresh) if keep_undated else fresh
