"""Each stage of the pipeline against what its operator decides."""

import corpus_pipeline as P

from skein.llm.decontaminate import decontaminate
from skein.llm.jaccard_join import jaccard_join


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, stage in P.STAGES:
        before, docs = docs, P.stash(stage(spark, docs, sf), name)
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "near_duplicates":
            want = jaccard_join(before).select("component_id").distinct().count()
            assert docs.count() == want
        if name == "decontaminate":
            assert docs.count() == decontaminate(before, bench).where("not contaminated").count()
        if name == "secrets":
            assert docs.count() == before.count()
    assert docs.where("not lossless").count() == 0 and docs.count() > 0
