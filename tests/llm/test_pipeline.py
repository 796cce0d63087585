"""The pipeline over the smallest tables: every stage's decision holds in the next."""

import corpus_pipeline
from tidemark.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or seen[name].columns == columns
        docs = seen[name]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.classify(first, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    ids = lambda n: sorted(r.doc_id for r in seen[n].select("doc_id").collect())
    assert ids("quality") == sorted(d for d, p in scores.items() if p)
    assert len(set(ids("near_duplicates"))) == len(ids("near_duplicates")) and set(ids("near_duplicates")) <= set(ids("quality"))
    assert ids("substring_dedup") == ids("near_duplicates")
    assert all(r.n_chars == len(r.text or "") for r in seen["substring_dedup"].collect())
    copies = {r.doc_id: r.copies for r in mixing.mix(seen["substring_dedup"]).collect()}
    assert ids("mixing") == sorted(d for d, n in copies.items() for _ in range(n))
    starts = sorted(r.doc_id for r in seen["packing"].where("piece = 0").collect())
    assert starts == ids("mixing")


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
