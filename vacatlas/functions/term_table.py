"""Vocabularies as tables: terms of any number are found by joins instead of one pattern.

A text and a term are both cut into atoms: runs of letters and digits, runs of separators, and every
other character by itself.  A term occurs where its atoms follow each other, so every atom of a text
that can begin a term is joined, on that one atom, to the terms that begin with it; the atoms that
follow decide.  All terms that begin at a place are found, the shorter ones inside the longer, which is
what the pattern of ``terms.TermIndex`` finds by its longest match and what that implies.

Rows of texts are narrow from the first step on: a key and as many atoms as the longest term has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import SEPARATOR, WORD

_ATOM = rf"[{WORD}]+|{SEPARATOR}|[^{WORD}\s\-_/]"
_MARK = "\x01"
_IS_WORD = rf"^[{WORD}]"


def _atoms(text: Column) -> Column:
    """Atoms of a lower-case text, every run of separators as one blank."""
    found = F.regexp_extract_all(F.translate(text, _MARK, " "), F.lit(_ATOM), F.lit(0))
    return F.transform(found, lambda a: F.when(F.rlike(a, F.lit(r"^[\s\-_/]")), F.lit(" ")).otherwise(a))


def _line(atoms: Column) -> Column:
    return F.concat(F.array_join(atoms, _MARK), F.lit(_MARK))


def vocabulary(terms: DataFrame, term: str = "term") -> DataFrame:
    """A table of terms ready to be joined; other columns stay.  Empty and null terms never match."""
    lowered = F.lower(F.trim(F.col(term)))
    atoms = _atoms(F.trim(F.regexp_replace(lowered, SEPARATOR, " ")))
    return (terms.withColumns({term: lowered, "_atoms": atoms}).filter(F.size("_atoms") > 0)
            .withColumns({"_first": F.get("_atoms", 0), "_size": F.size("_atoms"),
                          "_open": ~F.rlike(F.element_at("_atoms", -1), F.lit(_IS_WORD)), "_line": _line(F.col("_atoms"))})
            .drop("_atoms"))


def find(texts: DataFrame, key: str, text: Column, table: DataFrame, term: str = "term") -> DataFrame:
    """Distinct (key, term) with the term's other columns, for every term of a ``vocabulary`` in a lower-case text.

    ``key`` tells rows apart.  A null text holds no term.  Spark sends the vocabulary to the tasks where it
    knows it to be small and otherwise joins on the first atom, splitting frequent ones at run time.
    """
    longest = table.agg(F.max("_size")).first()[0]
    rest = [c for c in table.columns if c not in ("_first", "_size", "_open", "_line")]
    if longest is None:
        none = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in rest]
        return texts.select(key, *none).filter(F.lit(False))
    cut = texts.select(F.col(key), _atoms(text).alias("_a"))
    places = F.transform("_a", lambda a, i: F.when(a != " ", F.struct(
        a.alias("first"), F.when(i > 0, F.get("_a", i - 1)).alias("before"),
        _line(F.slice("_a", i + 1, longest + 1)).alias("line"))))
    starts = cut.select(key, F.inline(F.filter(places, lambda p: p.isNotNull() & ~(
        ~F.rlike(p["first"], F.lit(_IS_WORD)) & F.rlike(F.coalesce(p["before"], F.lit("")), F.lit(_IS_WORD))))))
    follows = F.expr("substr(line, length(_line) + 1)")
    hit = starts.join(table, F.col("first") == F.col("_first")).filter(
        F.startswith("line", F.col("_line")) & ~(F.col("_open") & F.rlike(follows, F.lit(_IS_WORD))))
    return hit.select(key, *rest).distinct()
