"""Every query of the subpackage through the driver's entry: the columns and types of its contract, and one row for each it owes."""

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9": "page_id bigint, host string, path string, rule string, verdict string",
    "op10": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.mark.parametrize("op", COLUMNS)
def test_a_query_keeps_its_contract(spark, op):
    name = next(n for n in entry.queries() if n.startswith(f"{op}_"))
    out = entry.queries()[name](spark, D)
    want = dict(c.split(" ") for c in COLUMNS[op].split(", "))
    types = dict(out.dtypes)
    ids = {"doc_id", "page_id", "refers_to", "component_id"}  # of the tables' own type
    assert {c: types[c] for c in want if c not in ids} == {c: t for c, t in want.items() if c not in ids}
    key = "page_id" if "page_id" in want else "doc_id"
    source = spark.read.parquet(f"{D}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    rows = [r[key] for r in out.select(key).collect()]
    all_ids = [r[key] for r in source.select(key).collect()]
    assert set(rows) == set(all_ids) and (op == "op2" or sorted(rows) == sorted(all_ids))


def test_names_and_sql_of_all_queries_agree():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert {"pipeline", *(n for n in entry.queries() if n.startswith("op"))} >= {"pipeline"}
    assert [sum(n.startswith(f"op{k}_") for n in entry.queries()) for k in range(1, 11)] == [1] * 10
