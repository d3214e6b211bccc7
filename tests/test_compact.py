"""Compaction of texts: line numbers, white space, blank lines, nulls."""

import re

from pyspark.sql import functions as F

from skarn.functions import text as tx


def plain(t):
    lines = [re.sub(r"^\s*[0-9]+[:\t]", "", x).strip() for x in t.split("\n")]
    kept = [x for i, x in enumerate(lines) if x or i == 0 or lines[i - 1]]
    return "\n".join(kept).strip()


def test_texts_are_compacted_as_by_lines(spark):
    texts = ["1| first\n2: second\n", "  12\tfoo  \n\n\n  \n3: bar\n", "  plain \n\n\n\nend\t", "10:x", "\u00a0 7:\u3000y \r\n", "4: 5: z", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.compact_text(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert dict((r["i"], r["c"]) for r in got)[1] == "foo\n\nbar"
