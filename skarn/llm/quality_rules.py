"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a condition over measures of the whole text.  On a bounded random sample
each rule's cost (seconds of evaluating it) and the rows it rejects are measured; the
cascade then takes, again and again, the rule that rejects most of the rows
still left per second.  The verdict is one CASE over the rules in that order, so
a row pays only for the rules up to the first that rejects it.  The order changes
the cost and never which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import stash

#: Texts on which costs and selectivities are estimated, in how many partitions, and evaluations of a rule on each.
SAMPLE, PARTS, COPIES, SEED = 1000, 4, 3, 11
_SPACE = "[\\x20\\x09-\\x0D]+"

Measures = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the measures to a condition; null counts as not rejected."""

    name: str
    rejects: Callable[[Measures], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
OWN_RULES = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("no_letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    Rule("shouting", lambda m: 2 * m["n_upper"] > m["n_letters"]),
)
RULES = BASE_RULES + OWN_RULES


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _count(text: Column, other: str) -> Column:
    """Characters of ``text`` outside the class ``other``."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), other, "")).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(own: Column) -> Column:
    """Words covered by 3-word windows that the text has twice or more."""
    windows = F.greatest(F.size(own) - 2, F.lit(0))
    hashes = F.slice(F.transform(own, lambda w, i: F.xxhash64(w, F.get(own, i + 1), F.get(own, i + 2))), F.lit(1), windows)
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))

    def places(pairs: Column) -> Column:
        again = F.filter(pairs, lambda e, i: (e["h"] == F.get(pairs, i - 1)["h"]) | (e["h"] == F.get(pairs, i + 1)["h"]))
        return F.sort_array(F.transform(again, lambda e: e["p"]))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        # a window adds the words that its predecessor has not covered: 3 at most
        add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"))
        total = F.aggregate(_let(pairs, places), start, add, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(total)

    return _let(hashes, covered)


def measures_of(text: Column, own: Column) -> Measures:
    """The measures as expressions over a text and its words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(own).cast("long"),
        "word_chars": F.char_length(F.array_join(own, "")).cast("long"),
        "n_symbols": _count(text, "[^#*$%&|<>]+"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated(own),
        "n_letters": _count(text, "\\P{L}+"),
        "n_upper": _count(text, "\\P{Lu}+"),
    }


def _over(body: Callable[[Measures], Column]) -> Column:
    """``body`` of the measures of column text, whose words are cut once."""
    text = F.col("text").cast("string")
    return _let(words(text), lambda own: body(measures_of(text, own)))


def cascade(rules: Sequence[Rule], measures: Measures) -> Column:
    """The first rule in this order that rejects a row, else null."""
    out = None
    for rule in rules:
        case = rule.rejects(measures)
        out = F.when(case, F.lit(rule.name)) if out is None else out.when(case, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def plan_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """``rules`` by rows rejected per second among the rows that the rules before them leave, as measured on a random sample.

    The sample is about ``sample`` whole texts from all partitions, written once.
    A rule's cost is the time of a job that evaluates it ``COPIES`` times on each
    text, less that of the same job without a rule.
    """
    if len(rules) < 2:
        return list(rules)
    text = docs.select(F.col("text").cast("string").alias("text"))
    share = min(1.0, sample / max(1, docs.count()))
    rows = stash((text.sample(share, SEED) if share < 1 else text).repartition(PARTS))

    def seconds(verdict: Column) -> float:
        many = rows.select("text", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))
        began = clock()
        many.agg(F.count_if(verdict)).collect()
        return clock() - began

    seconds(F.col("text").isNull())  # the first job also pays for the file's opening
    empty = seconds(F.col("text").isNull())
    cost = {rule.name: max(seconds(_over(rule.rejects)) - empty, 1e-6) for rule in rules}
    flags = [F.coalesce(_over(rule.rejects), F.lit(False)).alias(rule.name) for rule in rules]
    left = [(r.asDict(), r["n"]) for r in rows.select(*flags).groupBy(*[r.name for r in rules]).agg(F.count("*").alias("n")).collect()]  # at most 2^rules rows
    out, rest = [], list(rules)
    while rest:
        gain = {r.name: sum(n for row, n in left if row[r.name]) / cost[r.name] for r in rest}
        best = max(rest, key=lambda r: (gain[r.name], -cost[r.name]))
        out.append(best)
        rest.remove(best)
        left = [(row, n) for row, n in left if not row[best.name]]
    return out


def quality_report(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, the five base counts, base_failed and kept for every row of ``docs`` (doc_id, text).

    A null text has no words and fails.  ``kept`` is false for rows that fail a
    base rule, else the cascade's verdict.  Repeated rows are judged each for
    itself; an empty table gives no rows; other columns are ignored.
    """
    own = plan_order(docs, OWN_RULES) if rules is None else list(rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def all_of(m: Measures) -> Column:
        base = F.struct(*[m[c].alias(c) for c in counts])
        return _let(base, lambda c: _judged(m | {k: c[k] for k in counts}, c))

    def _judged(m: Measures, base: Column) -> Column:
        failed = F.coalesce(cascade(BASE_RULES, m).isNotNull(), F.lit(False))
        return F.struct(*[base[c].alias(c) for c in counts], failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(cascade(own, m).isNull()).alias("kept"))

    return docs.select("doc_id", _over(all_of).alias("r")).select("doc_id", "r.*")


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    use = plan_order(docs, rules) if order is None else list(order)
    return docs.filter(_over(lambda m: cascade(use, m)).isNull())
