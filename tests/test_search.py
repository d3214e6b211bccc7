"""Queries over texts against their SQL on odd texts."""

import duckdb
import pytest

from skarn import registry

TEXTS = [None, "", " ", "\n\t\x0b\f\r", "\u00a0", "a", "someLongIdentifier HTTPServer2", "ação naïve \U0001f600\U0001f600", "\u2028x\u0085y\u200b", "e\u0301", "ABCDe aB1c", "\x00a\x1f", "İstanbul ſK"]


@pytest.mark.parametrize("name", ["token_count"])
def test_odd_texts_count_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = duckdb.connect().execute(f"WITH documents AS (SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')) {registry.ORACLE_SQL[name]}").fetchall()
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(rows)
