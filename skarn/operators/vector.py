"""Vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import half_up
from skarn.functions.vectors import cosine_int8, quantize_int8


def dense_topk(vectors: DataFrame, query: DataFrame, k: int, allow: DataFrame | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by cosine of int8 codes, ties by id.

    ``query`` is a single row (vector_column); ``allow`` restricts the ids before
    the cut.  One scan and a bounded heap per task: no row but the best is shuffled.
    """
    rows = vectors if allow is None else vectors.join(allow.select(id_column).distinct(), id_column, "left_semi")
    q = query.limit(1).select(quantize_int8(F.col(vector_column))["codes"].alias("__q"))
    coded = rows.select(id_column, quantize_int8(F.col(vector_column))["codes"].alias("__v"))
    scored = coded.join(F.broadcast(q)).select(id_column, cosine_int8(F.col("__v"), F.col("__q")).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def ranked(top: DataFrame, *order: Column) -> DataFrame:
    """A list of at most a few hundred rows with its positions from 0."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(lists: list[DataFrame], k: int = 60, id_column: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of lists (id, rank from 0): sum of 1 / (k + rank + 1), ties by the id's text."""
    united = None
    for one in lists:
        part = one.select(id_column, (1.0 / (k + F.col("rank") + 1)).alias("__part"))
        united = part if united is None else united.unionByName(part)
    return united.groupBy(id_column).agg(F.sum("__part").alias("score")).orderBy(F.desc("score"), F.col(id_column).cast("string"))


def hybrid(dense: DataFrame, lexical: DataFrame, limit: int, id_column: str = "id") -> DataFrame:
    """Fuse a dense list (id, score) and a lexical list (id, rank from 0): id, fused, score, match_reason."""
    d = ranked(dense, F.desc("score"), F.col(id_column))
    fused = rrf([d.select(id_column, "rank"), lexical.select(id_column, "rank")], id_column=id_column).withColumnRenamed("score", "fused")
    top = ranked(fused, F.desc("fused"), F.col(id_column).cast("string")).filter(F.col("rank") < limit)
    named = top.join(d.select(id_column, F.col("score").alias("cosine")), id_column, "left").join(lexical.select(id_column, F.lit(True).alias("__lex")), id_column, "left")
    reason = F.when(F.col("cosine").isNotNull() & F.col("__lex").isNotNull(), "hybrid").when(F.col("cosine").isNotNull(), "semantic").otherwise("lexical")
    return named.select(id_column, half_up(F.col("fused"), 8).alias("fused"), half_up(F.coalesce("cosine", 1.0 / (F.col("rank") + 1))).alias("score"), reason.alias("match_reason"))
