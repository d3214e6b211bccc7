import corpus_pipeline
from skarn.llm import decontaminate, pii, quality_rules, simhash
from tests.llm.test_pii import brute as spans
from tests.llm.test_simhash import brute_classes, brute_fingerprint

D = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, D)
    report = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(docs).collect()}
    rows = sorted(kept.collect())
    assert rows == sorted(r for r in docs.collect() if report[r["doc_id"]])
    unique = sorted(corpus_pipeline.near_duplicates(spark, kept, D).collect())
    label = brute_classes([brute_fingerprint(r["text"]) for r in rows])
    assert unique == [r for i, r in enumerate(rows) if label[i] == i]
    unique_df = spark.createDataFrame(unique, docs.schema)
    clean = sorted(corpus_pipeline.decontamination(spark, unique_df, D).collect())
    benchmark = spark.read.parquet(f"{D}/benchmark.parquet")
    hit = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination_report(unique_df, benchmark).collect()}
    assert clean == [r for r in unique if not hit[r["doc_id"]]]
    private = {r["doc_id"]: r for r in corpus_pipeline.privacy(spark, spark.createDataFrame(clean, docs.schema), D).collect()}
    assert len(private) == len(clean)
    for r in clean:
        assert not spans(private[r["doc_id"]]["text"]), r["doc_id"]
        assert spans(r["text"]) or private[r["doc_id"]] == r


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, D).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert by and all(a == b for a, b in by.values())


def test_odd_rows_pass_through_every_stage(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), D).count() == 0
    assert simhash and pii
