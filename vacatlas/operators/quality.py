"""Governance checks: links, credentials, contact details, registry and snapshot invariants."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..schemas import HUMAN_COLUMNS


#: Address ranges that are not of the public internet (the registries of special purposes), first and last
#: address as numbers; of IPv6 as the first four groups of four hexadecimal digits.
SPECIAL = [(0, 8), (10 << 24, 8), ((100 << 24) + (64 << 16), 10), (127 << 24, 8), ((169 << 24) + (254 << 16), 16),
           ((172 << 24) + (16 << 16), 12), (192 << 24, 24), ((192 << 24) + (2 << 8), 24), ((192 << 24) + (168 << 16), 16),
           ((198 << 24) + (18 << 16), 15), ((198 << 24) + (51 << 16) + (100 << 8), 24), ((203 << 24) + (113 << 8), 24),
           (224 << 24, 4), (240 << 24, 4)]
SPECIAL_6 = [("0100000000000000", "0100000000000000"), ("20010db800000000", "20010db8ffffffff"), ("fc00000000000000", "fdffffffffffffff"),
             ("fe80000000000000", "febfffffffffffff"), ("fec0000000000000", "feffffffffffffff"), ("ff00000000000000", "ffffffffffffffff")]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: the variable of a function over one item."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _part(s: Column) -> Column:
    """A part of an address in decimal, octal (a leading 0) or hexadecimal (0x) digits."""
    return (F.when(F.rlike(s, F.lit(r"^0x[0-9a-f]{1,8}$")), F.conv(F.substring(s, 3, 8), 16, 10))
            .when(F.rlike(s, F.lit(r"^0[0-7]{1,11}$")), F.conv(s, 8, 10))
            .when(F.rlike(s, F.lit(r"^[0-9]{1,10}$")), s)).try_cast("long")


def address_number(host: Column) -> Column:
    """A literal IPv4 host as a number, in every form that resolvers take; null for names and other hosts.

    One to four parts; the last one fills what the others leave.
    """
    def number(parts: Column) -> Column:
        n = F.size(parts)
        head = F.slice(parts, 1, n - 1)
        room = F.element_at(F.array(*[F.lit(1 << 32 - 8 * k) for k in range(4)]), F.least(n, F.lit(4)))
        last = F.element_at(parts, -1)
        good = (n <= 4) & ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(head, lambda p: p > 255) & (last < room)
        return F.when(good, F.aggregate(head, F.lit(0).cast("long"), lambda a, p: a * 256 + p) * room + last)

    # a trailing dot belongs to names and addresses alike; only parts that begin with a digit can make a number
    parts = F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _part)
    return F.when(F.rlike(host, F.lit(r"^[0-9][0-9a-fx.\s\u0085\u2028\u2029]*$")), _let(parts, number))


def address_groups(host: Column) -> Column:
    """A bracketed IPv6 host as 32 hexadecimal digits; null for anything else."""
    tail = r"[0-9]+(?:\.[0-9]+){3}$"

    def plain(body: Column) -> Column:
        """With a trailing IPv4 address as two groups."""
        low = lambda four: F.lpad(F.lower(F.hex(four)), 8, "0")
        return _let(address_number(F.regexp_extract(body, f"({tail})", 1)), lambda four: F.when(four.isNotNull(), F.concat(
            F.regexp_replace(body, tail, ""), F.substring(low(four), 1, 4), F.lit(":"), F.substring(low(four), 5, 4))).otherwise(body))

    def filled(halves: Column) -> Column:
        groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
        sides = F.array(groups(F.get(halves, 0)), F.coalesce(groups(F.get(halves, 1)), F.array().cast("array<string>")))

        def every(sides: Column) -> Column:
            known = F.size(sides[0]) + F.size(sides[1])
            fits = F.when(F.size(halves) == 2, known <= 7).otherwise((F.size(halves) == 1) & (known == 8))
            return F.when(fits, F.concat(sides[0], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - known)), sides[1]))
        return _let(sides, every)

    def digits(every: Column) -> Column:
        good = ~F.exists(every, lambda g: ~F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    body = F.regexp_replace(F.regexp_extract(host, r"^\[([0-9a-f:.]+)(?:%[^\]]*)?\]$", 1), r"^$", "x")
    return _let(F.split(_let(body, plain), "::"), lambda halves: _let(filled(halves), digits))


def special_address(host: Column) -> Column:
    """Whether a host is a literal address outside the public internet; literal addresses that make no sense are, too."""
    def inside(number: Column) -> Column:
        spans = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(a + (1 << 32 - bits) - 1).cast("long").alias("b")) for a, bits in SPECIAL])
        return F.exists(spans, lambda s: number.between(s["a"], s["b"]))

    def inside_six(six: Column) -> Column:
        top = F.substring(six, 1, 16)
        # addresses that carry an IPv4 one: mapped, compatible (:: and ::1 among them), translated
        carried = F.when(F.rlike(six, F.lit("^0{20}(?:0000|ffff)|^0064ff9b0{16}")), F.conv(F.substring(six, 25, 8), 16, 10).cast("long"))
        bad = F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SPECIAL_6]), lambda s: top.between(s["a"], s["b"]))
        return six.isNull() | bad | F.coalesce(_let(carried, inside), F.lit(False))

    return F.coalesce(F.when(F.startswith(host, F.lit("[")), _let(address_groups(host), inside_six))
                      .otherwise(_let(address_number(host), inside)), F.lit(False))


def url_class(url: Column) -> Column:
    """'ok' or the reason a link must not be followed, judged by its structure alone."""
    def of_host(host: Column) -> Column:
        return (F.when(host == "", "no host").when(host.isin(V.BLOCKED_HOSTS), "blocked host")
                .when(special_address(host), "private address").otherwise("ok"))

    def of_url(url: Column) -> Column:
        scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
        return (F.when(F.coalesce(url, F.lit("")) == "", "empty")
                .when(F.length(url) > V.MAX_URL_LENGTH, "too long").when(scheme != "https", "scheme")
                .otherwise(_let(host, of_host)))

    return _let(url, of_url)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + V.CREDENTIAL_PARAMETER, "$1[redacted]")


def secret_hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that look like a secret, by kind; example lines are let off."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(
        ~F.rlike("line", F.lit(V.SECRET_ALLOW)))
    kinds = F.array_compact(F.array(*[F.when(F.rlike("line", F.lit(p)), F.lit(n)) for n, p in V.SECRET_RULES]))
    return lines.select(key, "line_no", F.explode(kinds).alias("kind"))


def _finding(kind: str):
    return lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def contact_hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phone numbers and mail addresses, one row per finding."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).filter(
        ~F.rlike("line", F.lit(V.CONTACT_ALLOW)))
    found = F.concat(*[F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(0)), _finding(k)) for k, p in (("phone", V.PHONE), ("mail", V.EMAIL))])
    return lines.select(key, F.explode(found).alias("f")).select(key, "f.kind", "f.value")


def registry_violations(companies: DataFrame) -> DataFrame:
    """``rule, subject`` for every broken registry rule."""
    c = F.col
    keyed = companies.withColumn("match_key", T.match_key(c("name")))
    auto = c("adapter").isNotNull()

    def broken(rule: str, cond: Column) -> DataFrame:
        return companies.filter(cond).select(F.lit(rule).alias("rule"), c("id").alias("subject"))

    def repeated(rule: str, df: DataFrame, cols: list[str]) -> DataFrame:
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.lit(rule).alias("rule"), F.concat_ws(":", *cols).alias("subject"))

    parents = companies.select(c("id").alias("parent_id"))
    orphans = companies.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left_anti").select(
        F.lit("unknown parent").alias("rule"), c("id").alias("subject"))
    return reduce(DataFrame.union, [
        broken("unknown adapter", auto & ~c("adapter").isin(list(V.PROVIDER_RANK))),
        broken("adapter without argument", auto & (F.coalesce("adapter_arg", F.lit("")) == "")),
        broken("manual without link", ~auto & ~F.coalesce(F.startswith("careers_url", F.lit("https://")), F.lit(False))),
        repeated("employer listed twice", keyed, ["match_key"]),
        repeated("source listed twice", companies.filter(auto), ["adapter", "adapter_arg"]), orphans])


def snapshot_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Invariants of an upsert: human columns unchanged, scores and codes in range."""
    human = [h for h in HUMAN_COLUMNS if h in before.columns and h in after.columns]
    old = before.select("id", *[F.col(h).alias(f"_{h}") for h in human])
    touched = after.join(old, "id").filter(reduce(lambda a, b: a | b, [
        ~F.col(h).eqNullSafe(F.col(f"_{h}")) for h in human])).select(
        F.lit("human column changed").alias("rule"), F.col("id").alias("subject"))
    range_ = after.filter(~F.col("score").between(0, 100)).select(F.lit("score out of range"), "id")
    guess = after.filter((F.col("salary_basis") != "explicit") & F.col("salary_annual_eur_min").isNotNull()).select(
        F.lit("salary without a statement"), "id")
    code = after.filter(~F.col("status").isin(V.STATUSES)).select(F.lit("unknown status"), "id")
    return reduce(DataFrame.union, [touched, range_, guess, code])


def markup_left(pages: DataFrame) -> DataFrame:
    """Pages whose cleaned text still carries a script or a tag."""
    clean = T.clean_html(F.col("html"))
    return pages.withColumn("clean", clean).filter(
        F.rlike("clean", F.lit(r"(?i)<script|<[a-z/][^>]*>"))).select("page_id")
