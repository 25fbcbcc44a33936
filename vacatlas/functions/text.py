"""String functions over columns: accents, titles, companies, places, HTML, evidence."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .terms import constant_map


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters whose decomposition is one base letter plus marks.

    Stand-alone combining marks come last and have no counterpart, so
    ``translate`` drops them.
    """
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(cp))
                       if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(cp) and not bare.isspace():
            src.append(chr(cp))
            dst.append(bare)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(src) + marks, "".join(dst)


def strip_accents(c: Column) -> Column:
    """Drop accents from alphabetic scripts with ``translate`` (ß stays)."""
    src, dst = _accent_table()
    return F.translate(c, src, dst)


def _plain(c: Column) -> Column:
    return strip_accents(F.lower(F.coalesce(c, F.lit(""))))


def _dashed(plain: Column, limit: int) -> Column:
    s = F.regexp_replace(plain, "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, limit)


def _or_unknown(c: Column) -> Column:
    return F.when(c == "", F.lit("unknown")).otherwise(c)


def slugify(c: Column, limit: int = 80) -> Column:
    return _or_unknown(_dashed(_plain(c), limit))


def normalize_title(c: Column) -> Column:
    """Comparable form of a title: gender markers, workloads and reference numbers gone."""
    t = F.regexp_replace(_plain(c), "(?i)" + V.TITLE_NOISE, " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def normalize_company(c: Column) -> Column:
    """Employer name without legal suffixes, as a slug."""
    suffix = r"\b(?:" + "|".join(V.COMPANY_SUFFIXES) + r")\b\.?"
    return slugify(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), suffix, " "))


def normalize_city(c: Column) -> Column:
    """First component of a place, without brackets, as a short slug."""
    first = F.split(F.coalesce(c, F.lit("")), r"[,;/|]").getItem(0)
    return F.substring(slugify(F.regexp_replace(first, r"\(.*?\)", " ")), 1, 40)


def canonical_key(company: Column, title: Column, location: Column) -> Column:
    """Identity of a vacancy: company|title|city.  Never the URL, which changes on every edit."""
    return F.concat_ws("|", normalize_company(company), normalize_title(title), normalize_city(location))


def requisition_id(external_id: Column, url: Column) -> Column:
    """First requisition id in the external id, else in the URL; '' when there is none."""
    tries = []
    for text in (external_id, url):
        for pattern, fold in V.REQUISITION_PATTERNS:
            hit = F.regexp_extract(text, ("(?i)" if fold else "") + pattern, 1)
            tries.append(F.when(hit != "", hit))
    return F.regexp_replace(F.upper(F.coalesce(*tries, F.lit(""))), "_", "-")


def match_key(c: Column) -> Column:
    """Employer name for registry look-ups: listed endings cut once each, in order."""
    t = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for suffix in V.MATCH_KEY_SUFFIXES:
        t = F.trim(F.regexp_replace(t, re.escape(suffix) + "$", ""))
    return F.regexp_replace(t, r"[^\p{L}\p{N}]", "")


def title_tokens(normalized: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != "")))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token arrays, 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# -- HTML -------------------------------------------------------------------
_BLOCKS = r"(?is)<(script|style|iframe|object|embed|noscript|template)\b[^>]*>.*?</\1\s*>"
_OPENERS = r"(?i)<(?:script|style|iframe|object|embed)\b[^>]*>"
_BREAKS = r"(?i)</(?:p|div|li|tr|h[1-6]|section|article)\s*>|<br\s*/?>"
_ENTITY = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,7};)"


@lru_cache(maxsize=1)
def _entities() -> dict[str, str]:
    named = {f"&{n};": chr(cp) for n, cp in html.entities.name2codepoint.items()}
    return {**named, "&apos;": "'"}


def _decode_entity(e: Column) -> Column:
    named = constant_map(_entities())
    digits = F.regexp_extract(e, r"^&#([0-9]+)", 1)
    hexa = F.regexp_extract(e, r"^&#[xX]([0-9a-fA-F]+)", 1)
    code = F.when(digits != "", F.hex(digits.cast("long"))).when(hexa != "", hexa)
    cp = F.conv(code, 16, 10).cast("int")
    valid = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.when(valid, code), 8, "0")), "UTF-32")
    return F.coalesce(char, F.try_element_at(named, e), e)


def unescape(c: Column) -> Column:
    """HTML 4 named and numeric entities to characters, only where there is an ampersand."""
    gaps = F.split(c, _ENTITY, -1)
    marks = F.transform(F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0)), _decode_entity)
    joined = F.array_join(F.zip_with(
        gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def clean_html(c: Column) -> Column:
    """HTML to plain text; scripts go with their contents, encoded markup is stripped too."""
    t = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(t, _BLOCKS, " ")
    t = F.regexp_replace(t, _OPENERS, " ")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n• ")
    t = F.regexp_replace(t, _BREAKS, "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(unescape(t), r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[ \t\x{A0}\x{2007}\x{202F}]+", " ")
    t = F.regexp_replace(t, r"(?m)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


# -- summaries and evidence -------------------------------------------------
def summarise(text: Column, limit: int = 600) -> Column:
    """First real prose: lines of 40+ characters that are no boilerplate, up to the limit."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")),
        lambda b: (F.length(b) >= 40) & ~F.rlike(b, F.lit("(?iU)" + V.BOILERPLATE)))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    taken = F.aggregate(lines, start, lambda acc, b: F.when(
        acc["used"] >= limit, acc).otherwise(F.struct(
            F.when(acc["used"] == 0, b).otherwise(F.concat(acc["text"], F.lit(" "), b)).alias("text"),
            (acc["used"] + F.length(b)).alias("used"))))["text"]
    body = F.when(taken != "", taken).otherwise(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.substring(body, 1, limit), r"\s+$", "")
    return F.concat(cut, F.when(F.length(body) > limit, F.lit("…")).otherwise(F.lit("")))


def find_evidence(text: Column, needle: Column, window: int = 140) -> Column:
    """The fragment around the first case-insensitive hit; '' when there is none."""
    half = window // 2
    pos = F.position(F.lower(needle), F.lower(text))
    start = F.greatest(F.lit(1), pos - half)
    end = F.least(F.length(text), pos - 1 + F.length(needle) + half)
    piece = F.substring(text, start, end - start + 1)
    piece = F.trim(F.regexp_replace(piece, r"(?U)\s+", " "))
    whole = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), piece,
                     F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when((F.coalesce(needle, F.lit("")) == "") | (F.coalesce(pos, F.lit(0)) == 0),
                  F.lit("")).otherwise(whole)


def search_blob(company, title, location, city, country, category, skills, domains) -> Column:
    """Lower-case text the free-text filters look into."""
    parts = [F.coalesce(c, F.lit("")) for c in (company, title, location, city, country, category)]
    lists = [F.when(F.size(a) > 0, F.array_join(a, " ")) for a in (skills, domains)]
    return F.lower(F.concat_ws(" ", *parts, *lists))
