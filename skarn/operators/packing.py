"""Packing of text segments into a token budget, handles, and what a pack lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import count_tokens, let
from skarn.operators.structure import positions

REVERSIBILITY = ("full", "partial", "none")


def budget_pack(segments: DataFrame, budget: int, group: str = "goal", order: str = "seq", cost: str = "cost", summary: str = "summary_costs") -> DataFrame:
    """group, seq, action (included, summarized, removed) and spent of segments in order.

    A segment is included if its cost fits what is left, else summarised by as
    many lines as fit (``summary``: the cost of its first line, first two, ...),
    else removed; later smaller ones may still fit.  The state runs along one
    group's segments, of which a pack has a few hundred, in one ``aggregate`` over
    their ordered array: no Python and one shuffle by group.
    """
    item = F.struct(F.col(order).cast("long").alias("seq"), F.col(cost).cast("long").alias("cost"), F.col(summary).cast("array<long>").alias("brief"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<seq: bigint, action: string, spent: bigint>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        short = F.array_max(F.filter(s["brief"], lambda c: c <= acc["left"]))
        fits = s["cost"] <= acc["left"]
        action = F.when(fits, "included").when(short.isNotNull(), "summarized").otherwise("removed")
        spent = F.when(fits, s["cost"]).otherwise(F.coalesce(short, F.lit(0).cast("long")))
        return let(F.struct(s["seq"].alias("seq"), action.alias("action"), spent.alias("spent")), lambda r: F.struct((acc["left"] - r["spent"]).alias("left"), F.concat(acc["out"], F.array(r)).alias("out")))

    packed = segments.groupBy(group).agg(F.aggregate(F.sort_array(F.collect_list(item)), start, step, lambda acc: acc["out"]).alias("__o"))
    return packed.select(group, F.explode("__o").alias("o")).select(group, F.col("o.seq").alias(order), "o.action", "o.spent")


def summary_lines(text: Column) -> Column:
    """The lines that may stand for a segment, first to last: its head and its code if it has some, else the first four."""

    def of(lines: Column) -> Column:
        code = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("Snippet ")), i + 1)), lambda i: i.isNotNull())
        return F.when(F.size(code) > 0, F.concat(F.slice(lines, 1, 1), F.slice(lines, F.coalesce(F.get(code, 0), F.lit(1)), F.size(lines)))).otherwise(F.slice(lines, 1, 4))

    return let(F.split(text, "\n", -1), of)


def _line_costs(lines: Column) -> Column:
    """What the first line costs, the first two, ...: no token goes over a line's end."""
    zero = F.array().cast("array<bigint>")
    return F.aggregate(F.transform(lines, count_tokens), zero, lambda acc, c: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + c)))


def summarise(text: Column, spent: Column) -> Column:
    """As many of a segment's ``summary_lines`` as cost no more than ``spent``, one at least."""
    return let(summary_lines(text), lambda lines: F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.size(F.filter(_line_costs(lines), lambda c: c <= spent)))), "\n"))


def segment_costs(segments: DataFrame, text: str = "text") -> DataFrame:
    return segments.withColumns({"cost": count_tokens(F.col(text)), "summary_costs": _line_costs(summary_lines(F.col(text)))})


def worst_reversibility(refs: DataFrame, column: str = "reversibility") -> DataFrame:
    rank = F.array_position(F.lit(list(REVERSIBILITY)), F.col(column))
    return refs.agg(F.element_at(F.lit(list(REVERSIBILITY)), F.coalesce(F.max(rank), F.lit(1).cast("long")).cast("int")).alias("reversibility"))


def path_dictionary(paths: DataFrame, column: str = "path", least: int = 2) -> DataFrame:
    """Paths that occur ``least`` times or more with their count and alias: ``$`` and the place in the paths' order, from 0; none if fewer than two do."""
    often = positions(paths.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least), column)
    several = often.agg((F.count("*") >= 2).alias("__many"))
    named = often.join(F.broadcast(several)).filter("__many")  # one row by construction
    return named.select(column, "n", F.concat(F.lit("$"), F.col("position").cast("string")).alias("alias"))


def handle_of(content: Column) -> Column:
    """A handle derived from the content, so that equal packs share one."""
    return F.concat(F.lit("h_"), F.substring(F.sha2(content.cast("binary"), 256), 1, 16))
