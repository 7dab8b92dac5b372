"""The pipeline's stages over whole tables, each against what its operator decides."""

import corpus_pipeline
from sightline.llm import decontam, near_dup, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near duplicates", "benchmark decontamination", "source mixing", "token ids"]
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns and ids(good) == ids(quality.quality_scores(docs, labels).where("predicted = 1"))
    apart = stages["near duplicates"](spark, docs, SF)
    assert apart.columns == docs.columns and ids(apart) == ids(near_dup.near_duplicates(docs).where("kept"))
    clean = stages["benchmark decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and ids(clean) == ids(decontam.decontamination_report(docs, bench).where("not contaminated"))
    mixed = stages["source mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= docs.count()

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and set(ids(out)) <= set(ids(good))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
