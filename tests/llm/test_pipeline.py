"""The pipeline against its stages' rules on the smallest tables."""

import corpus_pipeline
from fieldspark.llm import decontaminate, quality, simhash
from fieldspark.llm.common import documents, materialize


def test_stages(spark, sf):
    docs = documents(spark, sf)
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_target_weights", "token_binary_output"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], sf), "test-" + name))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert ids[1] == {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert ids[2] == {r.component_id for r in simhash.simhash_components(seen[1]).collect()} and seen[2].count() == len(ids[2])
    assert ids[3] == {r.doc_id for r in decontaminate.contamination(seen[2], bench).where("not contaminated").collect()}
    assert ids[4] <= ids[3] and ids[5] == ids[4] and seen[5].count() == seen[4].count()
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()
