"""Full-text search: postings, BM25, substring tiers, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import text as tx
from skarn.operators.graph import materialise

K1, B = 1.2, 0.75


def query_phrases(query: str) -> list[list[str]]:
    """Phrases that must all match: white-space words, each of one or more tokens."""
    import re

    words = [re.findall(r"[^\W_]+", tx.fold_word(w).lower()) for w in query.split()]
    return [w for w in words if w]


def query_terms(query: str) -> list[str]:
    """Terms any of which may match."""
    import re

    return list(dict.fromkeys(t for w in re.findall(r"[\w-]+", tx.fold_word(query).lower()) for t in re.findall(r"[^\W_]+", w)))


def token_line(text: F.Column) -> F.Column:
    """The text's tokens in order, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(tx.fold_marks(text)), "[^\\p{L}\\p{N}]+", " "))


def token_number(line: F.Column) -> F.Column:
    """How many tokens a ``token_line`` has."""
    return F.when(line == "", 0).otherwise(F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def phrase_count(line: F.Column, phrase: list[str]) -> F.Column:
    """How often a phrase of adjacent tokens stands in a ``token_line``; occurrences may overlap."""
    head, *rest = phrase
    return F.regexp_count(F.concat(F.lit(" "), line, F.lit(" ")), F.lit(f"(?<= ){head} " + (f"(?={' '.join(rest)} )" if rest else "")))


def bm25(docs: DataFrame, phrases: list[list[str]], match: str = "all", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that match, with rank (negative: better).

    The query's few phrases are counted in each row's tokens in one pass over the
    texts, so no postings are shuffled.  Its narrow result is written; document
    frequencies and lengths are one aggregate of that.  A phrase in over half the
    documents has weight 1e-6.
    """
    columns = [c for c in docs.columns if c != text_column]
    counted = docs.withColumn("__own", F.coalesce(token_line(F.col(text_column)), F.lit("")))
    tf = F.array(*[phrase_count(F.col("__own"), p) for p in phrases])
    rows = materialise(counted.select(*columns, token_number(F.col("__own")).cast("double").alias("__dl"), tf.alias("__tf")))
    stats = rows.agg(F.count("*").cast("double").alias("__n"), F.avg("__dl").alias("__avgdl"), F.array(*[F.sum(F.when(F.col("__tf")[i] > 0, 1).otherwise(0)).cast("double") for i in range(len(phrases))]).alias("__df"))
    found = F.exists("__tf", lambda c: c > 0) if match == "any" else F.forall("__tf", lambda c: c > 0)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df, f = F.col("__df")[i], F.col("__tf")[i].cast("double")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("__avgdl")))
    # stats is one row by construction
    return rows.filter(found).join(F.broadcast(stats)).select(*columns, (-score).alias("rank"))


def substring_tiers(rows: DataFrame, query: str, name: str = "name", path: str = "path", kind: str = "kind") -> DataFrame:
    """Rows whose name or path holds the query or whose kind equals it, with their tier (0 best)."""
    q = query.strip().lower()
    n, p = F.lower(F.col(name)), F.lower(F.col(path))
    hit = F.contains(n, F.lit(q)) | F.contains(p, F.lit(q)) | (F.lower(F.col(kind)) == q)
    tier = F.when(n == q, 0).when(F.startswith(n, F.lit(q)), 1).when(F.contains(n, F.lit(q)), 2).when(F.contains(p, F.lit(q)), 3).otherwise(4)
    return rows.filter(hit).withColumn("tier", tier)


def search(symbols: DataFrame, query: str, limit: int = 20, scope: str | None = None, kind: str | None = None) -> DataFrame:
    """Ranked candidates of symbols (id, name, path, kind, text).

    The best by substring tier and the best by text rank are united, the former
    first and hiding the latter's rank, scored by the reason of the match, and cut.
    """
    limit = max(1, min(100, limit))
    wide = min(100, 4 * limit)
    rows = symbols
    if scope:
        rows = rows.filter(F.contains(F.lower("path"), F.lit(scope.strip().lower())))
    if kind:
        rows = rows.filter(F.lower("kind") == kind.strip().lower())
    keep = ["id", "name", "path", "kind"]
    tiers = substring_tiers(rows, query).orderBy("tier", F.char_length("name"), "path", "id").limit(wide).select(*keep, F.lit(0.0).alias("rank"), F.lit(0).alias("origin"))
    phrases = query_phrases(query)
    both = tiers
    if phrases:
        text = bm25(rows.select(*keep, "text"), phrases, id_column="id").orderBy("rank", "id").limit(wide).select(*keep, "rank", F.lit(1).alias("origin"))
        both = tiers.unionByName(text)
    first = both.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy("origin"))).filter("__k = 1")
    reason = tx.match_reason(query, F.col("name"), F.col("path"), F.col("kind"))
    scored = first.withColumn("match_reason", reason).withColumn("score", tx.candidate_score(F.col("match_reason"), F.col("rank"), F.col("path")))
    return scored.orderBy(F.desc("score"), "name", "path", "id").limit(limit).select(*keep, "score", "match_reason")
