"""Learned decision lists: sequential covering over threshold conjunctions.

Measures of a text are DataFrame expressions.  Rules are grown and pruned on the statistics of a
bounded labelled sample: each step is one aggregate that counts labels per (measure, bin), and the
driver sees that table only (measures x bins rows).  The list is applied as one ordered CASE.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, written

#: What counts as white space between words, and as a symbol.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
BINS = 24


def _n_matching(text: Column, characters: str) -> Column:
    """How many characters of the text are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def measures(text: Column) -> Column:
    """A struct with the measures of the whole text.

    Exact counts: n_words, word_chars, n_symbols, n_dup_lines (lines with a word, equal to an earlier
    line), n_repeat_words (words inside 3-word windows that occur twice or more).  Windows are told
    apart by 64-bit hashes of their words.  A null text has no words; every measure is then 0.
    """
    rest = lambda t: F.translate(t, "abcdefghijklmnopqrstuvwxyz ", "")  # noqa: E731  what the shares look at
    return let(F.coalesce(text, F.lit("")), lambda t: let(
        F.array_remove(F.split(t, SPACE), ""), lambda words: let(
            F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))), lambda lines: let(
                F.struct(F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("chars"),
                         _n_repeated(words).alias("repeat"), rest(t).alias("rest"),
                         (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"), F.size(lines).alias("lines"),
                         F.size(F.array_distinct(words)).alias("distinct")), _measured))))


def _n_repeated(words: Column) -> Column:
    """How many words lie inside a 3-word window that occurs more than once."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def repeated(hashes: Column) -> Column:  # in the order of the hashes, equal neighbours are repeats
        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: F.transform(
            F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])),
            lambda x: x["i"]))

    def covered(at: Column) -> Column:  # three words each, but no further than the next repeated window
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
                           F.lit(0), lambda a, x: a + x)
    return let(windows, lambda hashes: F.when(
        F.size(hashes) > F.size(F.array_distinct(hashes)),
        let(F.sort_array(repeated(hashes)), covered)).otherwise(F.lit(0)))


def _measured(c: Column) -> Column:
    of = lambda characters: _n_matching(c["rest"], characters)
    share = lambda x: (x / F.greatest(c["chars"], F.lit(1))).cast("double")
    per_word = lambda x: (x / F.greatest(c["n"], F.lit(1))).cast("double")
    exact = {"n_words": "n", "word_chars": "chars", "n_dup_lines": "dup", "n_repeat_words": "repeat"}
    return F.struct(
        *[c[k].cast("long").alias(n) for n, k in exact.items()], of(SYMBOLS).cast("long").alias("n_symbols"),
        per_word(c["chars"]).alias("word_length"), share(of(SYMBOLS)).alias("symbol_share"),
        (c["dup"] / F.greatest(c["lines"], F.lit(1))).cast("double").alias("dup_line_share"),
        per_word(c["repeat"]).alias("repeat_share"),
        share(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("upper_share"),
        share(of("0123456789")).alias("digit_share"),
        share(of(".,;:!?")).alias("stop_share"),
        share(of("!")).alias("shout_share"),
        per_word(c["distinct"]).alias("distinct_share"))


MEASURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "stop_share", "shout_share", "distinct_share"]


@dataclass
class Rule:
    """A conjunction of (measure, is_above, threshold); it rejects what it covers."""
    tests: list[tuple[str, bool, float]] = field(default_factory=list)
    bad: int = 0
    good: int = 0

    def column(self, m: Column) -> Column:
        out = F.lit(True)
        for name, above, t in self.tests:
            x = m[name]
            out = out & ((x > t) if above else (x <= t))
        return out


def learn(sample: DataFrame, label: str = "bad", precision: float = 0.97, least: int = 8, max_tests: int = 3,
          max_rules: int = 12) -> list[Rule]:
    """Ordered rules that reject rows with ``label`` = 1.

    ``sample`` has ``_m`` and the label (1 bad, 0 good, null unused).  A third of it is kept for
    pruning.  A rule grows by the test of greatest information gain, is cut back while that raises
    (bad - good) / (bad + good) on the pruning part, and is taken if it covers ``least`` bad rows in
    all and at least ``precision`` of what it covers is bad.  What it covers is then set aside.
    No labels, or labels of one kind: no rules.
    """
    rows = written(sample.filter(F.col(label).isin(0, 1)).select(
        "_m", F.col(label).cast("int").alias("_bad"),
        (F.pmod(F.xxhash64("_m"), F.lit(3)) == 0).alias("_prune")))
    edges = rows.agg(*[F.percentile_approx(f"_m.{m}", [i / BINS for i in range(1, BINS)], 10_000).alias(m)
                       for m in MEASURES]).first()
    cuts = {m: sorted(set(edges[m] or [])) for m in MEASURES}
    if not any(cuts.values()):
        return []
    # fine cuts near the smallest and largest values too: rare junk hides in the tails
    ends = rows.agg(*[F.percentile_approx(f"_m.{m}", [0.001, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.999], 10_000)
                      .alias(m) for m in MEASURES]).first()
    cuts = {m: sorted({*cuts[m], *ends[m]}) for m in MEASURES}
    binned = written(rows.select("_m", "_bad", "_prune", F.array(*[
        F.struct(F.lit(m).alias("m"), _bin(F.col(f"_m.{m}"), cuts[m]).alias("b")) for m in MEASURES]).alias("_bins")))
    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(max_rules):
        rule = _grow(binned.filter(left), cuts, max_tests)
        if rule is None:
            break
        rule = _prune(binned.filter(left), rule)
        if rule.bad < least or rule.bad < precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        left = left & ~rule.column(F.col("_m"))
    return rules


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x))


def _histogram(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
    """Good and bad rows per measure and bin; one row per pair reaches the driver."""
    out: dict[str, dict[int, list[int]]] = {m: {} for m in MEASURES}
    for r in (rows.select("_bad", F.explode("_bins").alias("x")).groupBy("x.m", "x.b", "_bad")
              .agg(F.count(F.lit(1)).alias("n")).collect()):
        out[r["m"]].setdefault(r["b"], [0, 0])[r["_bad"]] += r["n"]
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_tests: int) -> Rule | None:
    rule, grown = Rule(), rows.filter(~F.col("_prune"))
    for _ in range(max_tests):
        best = None
        for m, bins in _histogram(grown.filter(rule.column(F.col("_m")))).items():
            good, bad = (sum(b[i] for b in bins.values()) for i in (0, 1))
            if not good or not bad:
                continue
            base, below = log2(bad / (bad + good)), [0, 0]
            for i, c in enumerate(cuts[m]):
                below = [a + b for a, b in zip(below, bins.get(i, [0, 0]), strict=True)]
                for above, (g, b) in ((False, below), (True, [good - below[0], bad - below[1]])):
                    if b:
                        gain = b * (log2(b / (b + g)) - base)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, (m, above, float(c))
        if best is None or best[0] <= 0:
            break
        rule.tests.append(best[1])
    return rule if rule.tests else None


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The prefix of the rule's tests that is worth most on the pruning part, with its counts over all rows."""
    heads = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    got = rows.agg(*[F.count_if(h.column(F.col("_m")) & (F.col("_bad") == b) & p).alias(f"{k}_{b}_{n}")
                     for k, h in enumerate(heads) for b in (0, 1)
                     for n, p in (("prune", F.col("_prune")), ("all", F.lit(True)))]).first()

    def worth(k: int) -> float:
        b, g = got[f"{k}_1_prune"], got[f"{k}_0_prune"]
        return (b - g) / (b + g) if b + g else -1.0
    best = max(range(len(heads)), key=lambda k: (worth(k), -k))
    return Rule(_centred(rows, heads[best].tests), got[f"{best}_1_all"], got[f"{best}_0_all"])


def _centred(rows: DataFrame, tests: list[tuple[str, bool, float]]) -> list[tuple[str, bool, float]]:
    """The same tests with each threshold midway between the values of the sample next to it."""
    gaps = rows.agg(*[x.alias(f"{n}{i}") for i, (m, _, t) in enumerate(tests) for n, x in (
        ("low", F.max(F.when(F.col(f"_m.{m}") <= t, F.col(f"_m.{m}")))),
        ("high", F.min(F.when(F.col(f"_m.{m}") > t, F.col(f"_m.{m}")))))]).first()
    return [(m, above, t if gaps[f"low{i}"] is None or gaps[f"high{i}"] is None
             else (gaps[f"low{i}"] + gaps[f"high{i}"]) / 2) for i, (m, above, t) in enumerate(tests)]


def base_failed(m: Column) -> Column:
    """The fixed floor: under 50 words, or more than half of the words inside repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(rules: list[Rule], m: Column) -> Column:
    """0 if no rule covers a row, else the number of the first that does (from 1): one ordered CASE."""
    out = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(m), F.lit(i)).otherwise(out)
    return out


def decide(text: Column, rules: list[Rule]) -> Column:
    """A struct of the measures ``m``, ``base_failed``, the ``rule`` that fired (0: none) and ``kept``.

    A null or empty text has no words and fails the floor.  The measures are computed once.
    """
    return let(measures(text), lambda m: F.struct(
        m.alias("m"), base_failed(m).alias("base_failed"), verdict(rules, m).alias("rule"),
        (~base_failed(m) & (verdict(rules, m) == 0)).alias("kept")))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, key: str = "doc_id",
        text: str = "text", **options) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled rows (``quality`` 0 is bad), those of smallest key hash.

    Of several labels of a key the lowest counts; rows that fail the floor teach nothing.
    """
    chosen = hash_sample(labels.filter(F.col("quality").isin(0, 1) & F.col(key).isNotNull())
                         .groupBy(key).agg(F.min("quality").alias("_quality")), key, sample_rows)
    # bounded by sample_rows
    own = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key)
    measured = written(own.select(measures(F.col("_text")).alias("_m"), (1 - F.col("_quality")).alias("bad")))
    return learn(measured.filter(~base_failed(F.col("_m"))), **options)
