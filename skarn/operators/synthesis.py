"""Synthesised answers: what is known is cited, what is not is said; and the envelope of an answer."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.memory import filled

_CODE = r"^([EW]_[A-Z0-9_]+)\b"


def parse_answer(raw: str) -> tuple[list[dict], list[dict]]:
    """Known and unknown items of a model's JSON, plain or fenced; anything else gives none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S | re.I)
    try:
        found = json.loads((fenced[1] if fenced else raw).strip())
    except ValueError:
        return [], []
    if not isinstance(found, dict):
        return [], []
    cited = lambda x: [c for c in x.get("citation_ids") or [] if isinstance(c, str) and c.strip()] if isinstance(x.get("citation_ids"), list) else []
    of = lambda k: [x for x in found[k] if isinstance(x, dict)] if isinstance(found.get(k), list) else []
    text = lambda x: str(x.get("text") if x.get("text") is not None else "").strip()
    known = [{"text": text(x), "citation_ids": cited(x)} for x in of("known")]
    unknown = [{"text": text(x), "reason": x.get("reason") if isinstance(x.get("reason"), str) else None, "handle": x.get("handle") if isinstance(x.get("handle"), str) else None} for x in of("unknown")]
    return known, unknown


def check_citations(items: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (text, citation_ids) with those of their ids that ``citations`` (id) has, and as unknown (text, reason, handle) the ones left without any."""
    item = items.select(F.trim("text").alias("text"), "citation_ids").filter("text <> ''").withColumn("__i", F.monotonically_increasing_id())
    asked = item.select("text", "__i", F.posexplode_outer("citation_ids").alias("at", "id"))
    held = asked.join(citations.select("id").distinct().withColumn("__ok", F.lit(True)), "id", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("__ok"), F.struct("at", "id")))), lambda x: x["id"])
    found = held.groupBy("__i", "text").agg(ids.alias("citation_ids"))
    known = found.filter(F.size("citation_ids") > 0).select("text", "citation_ids")
    bare = found.filter(F.size("citation_ids") == 0).select("text", F.lit("sem_citacao_valida").alias("reason"), F.lit(None).cast("string").alias("handle"))
    return known, bare


def link_supersedence(facts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``facts`` with pairs (origin, current) linked both ways, no fact erased; and the pairs refused (a blank id) with a code."""
    blank = ~filled(F.col("origin")) | ~filled(F.col("current"))
    good = pairs.filter(~blank).select(F.trim("origin").alias("origin"), F.trim("current").alias("current"))
    out = facts.join(good.groupBy(F.col("origin").alias("id")).agg(F.min("current").alias("__by")), "id", "left")
    out = out.join(good.groupBy(F.col("current").alias("id")).agg(F.min("origin").alias("__of")), "id", "left")
    out = out.withColumns({"superseded_by": F.coalesce("__by", "superseded_by"), "supersedes": F.coalesce("__of", "supersedes")})
    return out.select(facts.columns), pairs.filter(blank).withColumn("code", F.lit("E_MEMORY_V2_SUPERSEDENCE"))


def concise(envelopes: DataFrame) -> DataFrame:
    """Envelopes (message, limitations, ...) by their codes alone: prose goes, and so do confidence and staleness_hint."""
    code = lambda c: F.nullif(F.regexp_extract(c, _CODE, 1), F.lit(""))
    codes = F.array_distinct(F.filter(F.transform("limitations", code), lambda c: c.isNotNull()))
    out = envelopes.withColumns({"message": code(F.col("message")), "limitations": F.when(F.size(codes) > 0, codes)})
    return out.drop("confidence", "staleness_hint")
