"""Finding many vocabulary terms in one pass over a text.

A posting is tested against hundreds of terms.  One ``rlike`` per term would
read the text hundreds of times, so a vocabulary is folded into one prefix
tree pattern, wrapped in a look-ahead: it captures, at every word start, the
longest term that begins there.  Shorter terms that end on a boundary inside
the captured one ("graph neural" in "graph neural network") follow from a
small constant map.  The text is read once and everything stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[\s\-_/]+"
# letters and digits of any alphabet end a term: "r" is not found in "für"
WORD = r"\p{L}\p{N}"


def canonical(term: str) -> str:
    """Lower case, with every separator run (blank, hyphen, slash, underscore) as one blank."""
    return re.sub(SEPARATOR, " ", term.strip().lower()).strip()


def body(term: str) -> str:
    """Pattern of one term without boundaries."""
    return SEPARATOR.join(re.escape(w) for w in canonical(term).split(" "))


def _insert(tree: dict, key: str) -> None:
    for ch in key:
        tree = tree.setdefault(ch, {})
    tree[""] = {}


def _render(tree: dict, end: str, separator: str) -> str:
    branches = [(separator if ch == " " else re.escape(ch)) + _render(sub, end, separator)
                for ch, sub in tree.items() if ch]
    if "" in tree:
        branches.append(end)
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def tree_pattern(keys, word: str = WORD, separator: str = SEPARATOR) -> str:
    """All keys as one prefix tree, deepest match first, ending on a boundary."""
    tree: dict = {}
    for key in keys:
        _insert(tree, key)
    return _render(tree, f"(?![{word}])", separator) if tree else "(?!)"


def any_of(terms, word: str = WORD) -> str:
    """Pattern matching any of the terms, longest first, on lower-case text."""
    keys = dict.fromkeys(canonical(t) for t in terms if t.strip())
    return f"(?<![{word}])" + tree_pattern(keys, word)


class TermIndex:
    """A vocabulary ready to be searched.  ``flexible`` lets separators vary."""

    def __init__(self, terms, word: str = WORD, flexible: bool = True) -> None:
        self.terms = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
        self.key = canonical if flexible else (lambda t: t)
        self.flexible = flexible
        self.keys = list(dict.fromkeys(self.key(t) for t in self.terms))
        self.word = re.compile(f"[{word}]" if word != WORD else r"[^\W_]")
        self.pattern = (f"(?<![{word}])(?=("
                        + tree_pattern(self.keys, word, SEPARATOR if flexible else " ") + "))")

    def _implied(self) -> dict[str, list[str]]:
        """For each key: the terms that are present wherever that key is captured."""
        by_key: dict[str, list[str]] = {}
        for t in self.terms:
            by_key.setdefault(self.key(t), []).append(t)
        out = {}
        for key in self.keys:
            starts = [key[:n] for n in range(1, len(key) + 1)
                      if key[:n] in by_key and (n == len(key) or not self.word.match(key[n]))]
            out[key] = [t for s in starts for t in by_key[s]]
        return out

    def hits(self, lowered: Column) -> Column:
        """Distinct terms present in a lower-cased text, in no particular order."""
        if not self.terms:
            return constant_array([])
        found = F.regexp_extract_all(lowered, F.lit(self.pattern), F.lit(1))
        if self.flexible:
            found = F.transform(found, lambda h: F.trim(F.regexp_replace(h, SEPARATOR, " ")))
        found = F.array_distinct(found)
        more = {k: ts for k, ts in self._implied().items() if ts != [k]}
        if not more:
            return found
        implied = constant_map(more)
        return F.array_distinct(F.flatten(F.transform(
            found, lambda h: F.coalesce(F.try_element_at(implied, h), F.array(h)))))


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(map(_literal, v)) + ")"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return repr(v)


def constant_array(values) -> Column:
    """A constant array of strings, parsed in one call instead of one call per element."""
    values = list(values)
    return F.expr(_literal(values)) if values else F.expr("CAST(array() AS ARRAY<STRING>)")


def constant_map(mapping: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in mapping.items()) + ")")


def ordered(hits: Column, terms) -> Column:
    """The given terms that were hit, in declaration order."""
    return F.array_intersect(
        constant_array(dict.fromkeys(t.strip().lower() for t in terms if t.strip())), hits)


def first_hit(hits: Column, terms) -> Column:
    """First of the given terms that was hit, NULL if none."""
    return F.get(ordered(hits, terms), 0)


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """A constant map as an expression."""
    if not mapping:
        return F.lit(default)
    found = F.try_element_at(constant_map(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))
