"""Column functions over vectors."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.text import let


def quantize_int8(vector: Column) -> Column:
    """struct<scale, codes>: bytes of the vector over its largest magnitude; a zero vector has scale 1."""
    top = F.array_max(F.transform(vector, lambda v: F.abs(v.cast("double"))))
    scale = F.when(F.coalesce(top, F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(top / 127.0)

    def codes(s: Column) -> Column:
        return F.transform(vector, lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(v.cast("double") / s + 0.5).cast("int"))))

    return let(scale, lambda s: F.struct(s.alias("scale"), codes(s).alias("codes")))


def dequantize(packed: Column) -> Column:
    return F.transform(packed["codes"], lambda c: c * packed["scale"])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("long") * F.coalesce(y, F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine_int8(a: Column, b: Column) -> Column:
    """Cosine of two code arrays over their common length; 0 if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(_dot(a, a).cast("double")) * F.sqrt(_dot(b, b).cast("double"))
    return let(norm, lambda m: F.when(m == 0.0, F.lit(0.0)).otherwise(_dot(a, b) / m))


@lru_cache(1_000_000)
def _bucket(word: str, dim: int) -> int:
    h = 0x811C9DC5
    for c in word.encode():
        h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
    return min(h, (1 << 32) - h) % dim  # of the hash as a signed number's magnitude


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embed(text: pd.Series) -> pd.Series:
    """A deterministic stand-in for a text encoder: ASCII words and numbers counted in 64 hash buckets, unit length."""

    def one(value: str | None) -> np.ndarray:
        out = np.zeros(64, np.float32)
        for word, n in Counter(re.findall("[a-z0-9]+", (value or "").lower())).items():
            out[_bucket(word, 64)] += n
        norm = np.sqrt((out.astype(float) ** 2).sum())
        return (out / norm).astype(np.float32) if norm else out

    return text.map(one)
