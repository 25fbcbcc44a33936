"""Main text of web pages by consensus paths: the pages of a host vote on where the article is.

First pass: every page scores its containers and votes for the generalised tag-class path of the
best one; Spark adds the votes up per host.  Second pass: every page is read again and gives the
blocks under its host's winning path, or under its own best container if it has no such path.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Kinds of HTML elements, and words in class and id that name what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math select object".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark nobr q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr".split())
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot figcaption caption summary".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
               "menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
OUTSIDE = set("nav footer aside form button menu dialog head".split())
OUTSIDE_WORDS = set("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner menu nav navbar "
                    "navigation breadcrumb breadcrumbs footer header masthead sidebar aside cookie cookies consent gdpr notice "
                    "notices alert popup modal overlay subscribe newsletter signup login share sharing social related "
                    "recommended widget comment comments discussion disqus respond replies pagination pager".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "path", "outside", "link")

    def __init__(self, tag: str, path: str, outside: bool, link: bool):
        self.tag, self.path, self.outside, self.link = tag, path, outside, link


def blocks(html: str) -> Iterator[tuple[str, str, float]]:
    """(container path, text, share of the text in links) of every block of a page that can be article text.

    Unclosed elements end where HTML ends them (a paragraph at the next block); a tag cut off at the
    end of the page is dropped.
    """
    stack = [Element("", "", False, False)]
    parts: list[str] = []
    linked = 0
    container = ""

    def flush() -> tuple[str, str, float] | None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        share, linked = linked / max(1, sum(map(len, parts))), 0
        parts.clear()
        return (container, text, share) if text else None

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        end = m.start() if m else len(html)
        top = stack[-1]
        if end > at and not top.outside:
            if not parts:
                container = top.path
            parts.append(html[at:end])
            linked += (end - at) * top.link
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE or tag == "br":
            if tag == "br":
                parts.append(" ")
            elif block := flush():
                yield block
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth and (tag not in INLINE or all(e.tag in INLINE for e in stack[depth:])):
                del stack[depth:]
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in INLINE | LEAF:
            continue
        _close_implied(stack, tag)
        top = stack[-1]
        words, role = _names(m[3])
        outside = (top.outside or tag in OUTSIDE or tag == "header" and not any(e.tag == "article" for e in stack)
                   or tag not in ("html", "body", "article", "main") and not OUTSIDE_WORDS.isdisjoint(words)
                   or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"))
        path = top.path if tag in INLINE or tag in LEAF else f"{top.path}/{'.'.join([tag, *words])}"
        stack.append(Element(tag, path, outside, top.link or tag == "a"))
    if block := flush():
        yield block


def _close_implied(stack: list[Element], tag: str) -> None:
    ends = {"p"} if tag in CLOSES_P else SIBLINGS.get(tag, set())
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ends:
            del stack[k:]
            return
        if stack[k].tag not in INLINE and stack[k].tag not in ("p", "td", "th"):
            return


def _names(attributes: str) -> tuple[list[str], str]:
    """Words of class and id, without numbers, sorted; and the role."""
    words, role = set(), ""
    if attributes:
        for a in _ATTRIBUTE.finditer(attributes):
            value = (a[2] or a[3] or a[4] or "").lower()
            if a[1].lower() == "role":
                role = value
            else:
                words.update(_TOKEN.findall(value))
    return sorted(words), role


def best_path(page: list[tuple[str, str, float]]) -> str:
    """The container with most text that is no link: a block counts for its container, half for the one around it."""
    score: dict[str, float] = defaultdict(float)
    for path, text, linked in page:
        worth = len(text) * (1 - linked) + 0.001
        score[path] += worth
        score[path.rpartition("/")[0]] += worth / 2
    return max(score.items(), key=lambda x: (x[1], x[0]))[0] if score else ""


def main_text(page: list[tuple[str, str, float]], path: str | None) -> str:
    """The page's blocks under ``path``, or under its own best container if there are none."""
    under = lambda p: [t for own, t, _ in page if own == p or own.startswith(p + "/")]
    return "\n".join((under(path) if path else []) or under(best_path(page)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """One row per page: key, url, ``text`` (empty if none) and ``n_chars``.

    A null html counts as empty, pages without a host vote together, repeated rows vote and come
    out each, an empty table gives no rows, other columns are not looked at.  The votes are
    combined before they are shuffled, so a host with a third of all pages is no hot spot; the
    join with the winning paths is left to Spark (the written table has a known size).
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    own = pages.select(F.col(key), F.col(url), F.col(text), host(F.col(url)).alias("_host"))

    def votes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            paths = [best_path(list(blocks(h.as_py() or ""))) for h in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(paths, pa.string())], ["_host", "_path"])

    cast = own.select(text, "_host").mapInArrow(votes, "_host string, _path string").filter("_path <> ''")
    tallied = cast.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"))
    winners = written(tallied.groupBy("_host").agg(F.max_by("_path", F.struct("n", "_path")).alias("_path")))

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [main_text(list(blocks(h.as_py() or "")), p.as_py()) for h, p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                [key, url, "text", "n_chars"])

    return (own.join(winners, "_host", "left").select(key, url, text, "_path")
            .mapInArrow(texts, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long"))
