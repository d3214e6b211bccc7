import pytest

TEXTS = [
    "Is and retitioning ouen the of, nterti thorreou ndernt.",
    "",
    None,
    "Is and retitioning ouen the of, nterti thorreou ndernt.",
    "é ü\nñ " * 40,
    "word " * 30_000,
    "a",
]


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "src0", 55), (None, None, None, None, None)]
    rows = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, fingerprint string")
