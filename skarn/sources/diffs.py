"""Unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.structure import forward_fill


def parse_hunks(lines: DataFrame) -> DataFrame:
    """diff, path, start_line, end_line of the changed ranges in diff lines (diff, line_no, line).

    Ranges are of the new file; a pure deletion takes the removed range.  Only a
    ``+++`` line sets the path; that of a file that goes away is the old one.
    """
    old = F.when(F.startswith("line", F.lit("--- a/")), F.substring("line", 7, 1 << 30))
    before = forward_fill(lines, old, "__old", ["diff"], "line_no")
    new = F.when(F.startswith("line", F.lit("+++ b/")), F.substring("line", 7, 1 << 30)).when(F.col("line") == "+++ /dev/null", F.col("__old"))
    filled = forward_fill(before, new, "path", ["diff"], "line_no")
    n = lambda group: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", group)
    hunks = filled.filter("path is not null").filter(F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))
    number = lambda group, default: F.when(n(group) == "", F.lit(default)).otherwise(n(group)).cast("int")
    gone = number(4, 1) == 0
    start = F.when(gone, number(1, 1)).otherwise(number(3, 1))
    count = F.greatest(F.lit(1), F.when(gone, number(2, 1)).otherwise(number(4, 1)))
    return hunks.select("diff", "path", start.alias("start_line"), (start + count - 1).alias("end_line"))


def from_text(spark: SparkSession, text: str, name: str = "diff") -> DataFrame:
    return parse_hunks(spark.createDataFrame([(name, i, x) for i, x in enumerate(text.split("\n"))], "diff string, line_no int, line string"))
