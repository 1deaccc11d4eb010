import corpus_pipeline
from crosswise.llm.stages import STAGES

D = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names, n = docs.columns, docs.count()
    for name, step in STAGES[:-1]:
        docs = step(spark, docs, D).cache()
        assert docs.columns == names and 0.7 * n < docs.count() <= n, name


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in seen.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
